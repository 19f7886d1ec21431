"""Substring and map searches by index."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import lookup, resolve
from ..staging import Workspace
from .base import query, table

LAT, LNG = "(c_custkey * 7919 % 18001)::double / 100.0 - 90.0", "(c_custkey * 104729 % 36001)::double / 100.0 - 180.0"


def positions(spark, sf_dir):
    """Customers with a position worked out from their key."""
    key = F.col("c_custkey").cast("long")
    return table(spark, sf_dir, "customer").select(key.alias("c_custkey"), ((key * 7919 % 18001).cast("double") / 100.0 - 90.0).alias("lat"), ((key * 104729 % 36001).cast("double") / 100.0 - 180.0).alias("lng"))


def cells(spark, sf_dir):
    """The same on disk, sorted by cell."""
    at = f"{Workspace(spark, 'cells').path}/customer"
    lookup.write_cells(positions(spark, sf_dir), at)
    return spark.read.parquet(at)


@query("select s_suppkey, count(c_custkey) n, min(c_custkey) first_key, max(c_custkey) last_key from supplier left join customer on contains(lower(c_name), lower(right(s_name, (1 + s_suppkey % 5)::int))) group by s_suppkey")
def substring_search(spark, sf_dir):
    """Which customers' names have the last one to five characters of each supplier's name: many substring queries by n-grams."""
    names = lookup.NameIndex(spark, f"{Workspace(spark, 'names').path}/names").build(table(spark, sf_dir, "customer"), "c_custkey", "c_name")
    asked = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("query"), F.right("s_name", (F.col("s_suppkey") % 5 + 1).cast("int")).alias("text"))
    return names.count_each(asked).withColumnRenamed("query", "s_suppkey")


@query("select c_custkey, c_name from customer where contains(lower(c_name), '#00000012')")
def substring_one(spark, sf_dir):
    names = lookup.NameIndex(spark, f"{Workspace(spark, 'names').path}/names").build(table(spark, sf_dir, "customer"), "c_custkey", "c_name")
    return names.find("#00000012").select(F.col("key").alias("c_custkey"), F.col("name").alias("c_name"))


@query(f"select c_custkey, lat, lng from (select c_custkey, {LAT} lat, {LNG} lng from customer) where lat between 10.5 and 42.25 and (lng >= 170 or lng <= -95.5)")
def box_cells(spark, sf_dir):
    """A box over the 180th meridian, by ranges of Z-order cells."""
    return lookup.in_box(cells(spark, sf_dir), 10.5, 170.0, 42.25, -95.5).select("c_custkey", "lat", "lng")


@query(f"select c_custkey from (select c_custkey, {LAT} lat, {LNG} lng from customer) where 2 * 6371.0088 * asin(sqrt(least(1.0, pow(sin(radians(lat - 61.5) / 2), 2) + cos(radians(lat)) * cos(radians(61.5)) * pow(sin(radians(lng - -179.2) / 2), 2)))) <= 1500.5")
def radius_cells(spark, sf_dir):
    return lookup.in_radius(cells(spark, sf_dir), 61.5, -179.2, 1500.5).select("c_custkey")


@query("select c_custkey query, case when c_custkey % 11 = 0 then 'bad_request' when c_custkey % 7 = 0 then 'ready' when c_acctbal >= 0 then 'known' when c_custkey % 3 < 2 then 'discovered' else 'not_found' end status, "
       "case when c_custkey % 11 <> 0 and c_custkey % 7 <> 0 then case when c_acctbal >= 0 then 'pub' when c_custkey % 3 = 0 then 'municode' when c_custkey % 3 = 1 then 'amlegal' end end publisher, "
       "case when c_custkey % 11 <> 0 and c_custkey % 7 <> 0 and c_acctbal < 0 then case when c_custkey % 3 = 0 then 's' || c_nationkey || '-' || replace(lower(c_name), '#', '-') when c_custkey % 3 = 1 then replace(lower(c_name), '#', '_') end end source_id from customer")  # fmt: skip
def lookup_discovery(spark, sf_dir):
    """Customers as places asked for by name: some cached, some listed with a publisher, some found by probing, some not at all."""
    key, name = F.col("c_custkey"), F.col("c_name")
    state = F.concat(F.lit("S"), F.col("c_nationkey").cast("string"))
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal", state.alias("state"))
    none = F.lit(None).cast("string")
    asked = rows.select(key.alias("query"), none.alias("slug"), name.alias("city"), none.alias("county"), F.when(key % 11 != 0, F.col("state")).alias("state"), none.alias("address"))
    places = rows.select(key.cast("string").alias("id"), name.alias("name"), F.lit("city").alias("type"), "state", F.when(F.col("c_acctbal") >= 0, "pub").alias("publisher"), key.alias("k"))
    slug = F.replace(F.lower(name), F.lit("#"), F.lit("-"))
    published = rows.where(key % 3 < 2).select(F.when(key % 3 == 0, "municode").otherwise("amlegal").alias("publisher"), F.when(key % 3 == 0, F.concat_ws("-", F.lower("state"), slug)).otherwise(F.replace(slug, F.lit("-"), F.lit("_"))).alias("id"))
    cached = places.where("k % 7 = 0").withColumn("id", F.concat(F.lit("c"), F.col("id")))
    # the gazetteer has the places that the catalog lacks
    found = resolve.look_up(asked, cached, places.where("k % 2 = 0 or publisher is not null"), places.where("k % 2 = 1 and publisher is null"), published)
    return found.select("query", "status", "publisher", "source_id")
