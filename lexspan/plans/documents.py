"""Saved contents, XML documents and versions in force, over tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import asof
from ..sources import documents
from . import scalars
from .base import events, query, table

CONTENTS = """
n as (select n_regionkey r, n_nationkey k, row_number() over (partition by n_regionkey order by n_nationkey) - 1 p, n_name name from nation),
c as (select c_nationkey k, c_custkey c, row_number() over (partition by c_nationkey order by c_custkey) - 1 p, c_name name from customer where c_nationkey is not null),
w as (select r, 'n' || k path, null::varchar parent_path, 'title' as level, name heading, false has_content, 1 depth, p a, -1 b from n
      union all select r, 'n' || n.k || '/c' || c, 'n' || n.k, 'section', c.name, true, 2, n.p, c.p from n join c on c.k = n.k)
"""


@query(f"with {CONTENTS} select 'region-' || r jurisdiction_id, path, parent_path, level, heading, has_content, depth, row_number() over (partition by r order by a, b) - 1 sort_order from w")
def contents_import(spark, sf_dir):
    """Contents as nested JSON, one text for each region, to nodes in walk order."""
    customers = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.sort_array(F.collect_list(F.struct("c_custkey", "c_name"))).alias("cs"))
    nations = table(spark, sf_dir, "nation").join(customers, F.col("n_nationkey") == F.col("c_nationkey"), "left")
    path = F.concat(F.lit("n"), F.col("n_nationkey").cast("string"))
    below = F.transform(F.coalesce("cs", F.array().cast("array<struct<c_custkey:bigint,c_name:string>>")), lambda x: F.struct(F.concat(path, F.lit("/c"), x["c_custkey"].cast("string")).alias("path"), F.lit("section").alias("level"), x["c_name"].alias("heading"), F.lit(True).alias("hasContent")))
    node = F.struct("n_nationkey", F.struct(path.alias("path"), F.lit("title").alias("level"), F.col("n_name").alias("heading"), below.alias("children")).alias("node"))
    saved = nations.groupBy("n_regionkey").agg(F.sort_array(F.collect_list(F.struct(F.col("n_nationkey").alias("k"), F.to_json(node["node"]).alias("json")))).alias("nodes"))
    text = F.concat(F.lit('{"children":['), F.array_join(F.transform("nodes", lambda x: x["json"]), ","), F.lit("]}"))
    nodes, _ = documents.contents(saved.select(F.concat(F.lit("region-"), F.col("n_regionkey").cast("string")).alias("jurisdiction_id"), text.alias("toc")))
    return nodes.select("jurisdiction_id", "path", "parent_path", "level", "heading", "has_content", "depth", F.col("sort_order").cast("long").alias("sort_order"))


@query("with p as (select page_id, list_filter(list_transform(regexp_extract_all(html, '(?is)<p(?: [^>]*)?>(.*?)</p>', 1), lambda x: " + scalars.STRIP.format("x") + "), lambda x: x <> '') l, html from pages) "
       "select page_id, array_to_string(case when len(l) > 0 then l else [" + scalars.STRIP.format("html") + "] end, chr(10)) body from p")  # fmt: skip
def xml_round_trip(spark, sf_dir):
    """Pages to XML section documents and back to their paragraphs."""
    pages = table(spark, sf_dir, "pages")
    xml = documents.uslm(F.lit("us"), F.lit("title-1"), F.col("page_id").cast("string"), F.lit("A & B"), T.paragraphs_of_html(F.col("html")))
    bodies = documents.text_of(documents.uslm_rows(pages.select("page_id", xml.alias("xml")), "page_id", "xml"))
    return pages.select("page_id").join(bodies, F.col("page_id") == F.col("key"), "left").select("page_id", F.coalesce("body", F.lit("")).alias("body"))


@query("select l.event_id, l.user_id, arg_max(r.event_id, (epoch_us(r.ts), r.event_id)) last_id from events l left join events r on r.user_id = l.user_id and r.ts <= l.ts and r.event_type <> 'error' where l.event_type = 'error' group by 1, 2")
def last_before(spark, sf_dir):
    """For each error of a user the last other event at that time or before it: an as-of join."""
    rows = events(spark, sf_dir).select("event_id", "user_id", "ts", "event_type")
    joined = asof.as_of(rows.where("event_type = 'error'"), rows.where("event_type != 'error'"), "user_id", "ts", "ts", ["event_id"])
    return joined.select("event_id", "user_id", F.col("found.event_id").alias("last_id"))


VERSIONS = "select o_custkey k, o_orderkey v, o_orderdate::date starts, (o_orderdate + interval 200 day)::date ends, o_orderstatus = 'P' removed from orders"


@query(f"with v as ({VERSIONS}), a as (select c_custkey k, date '1993-01-01' + (c_custkey % 2000)::int asked_day from customer), "
       "n as (select *, row_number() over (partition by k order by starts desc, v desc) r from (select a.k, a.asked_day, v.v, v.starts, v.ends, v.removed from a join v on v.k = a.k and v.starts <= a.asked_day)) "
       "select a.k, case when not n.removed and n.ends > a.asked_day then n.v end version from a left join n on n.k = a.k and n.r = 1")  # fmt: skip
def version_in_force(spark, sf_dir):
    """Which order counts as a customer's version in force at a date: the latest begun, unless it has ended or is a removal."""
    versions = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("v"), F.col("o_orderdate").cast("date").alias("starts"), F.date_add(F.col("o_orderdate").cast("date"), 200).alias("ends"), F.col("o_orderstatus").alias("status"))
    asked = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.date_add(F.lit("1993-01-01").cast("date"), (F.col("c_custkey") % 2000).cast("int")).alias("at"))
    found = asof.in_force(asked, versions, "k", "at", "starts", "ends", F.col("status") == "P", ["v"])
    return found.select("k", F.col("found.v").alias("version"))
