"""Scans, filters and projections."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..operators import changes
from ..operators.registry import in_box
from ..schema import split_valid
from .base import events, pick, pick_sql, query, table


@query("select p_partkey, p_name, p_size from part where p_brand = 'Brand#2' and p_size >= 10 order by p_size, p_partkey")
def scan_filter(spark, sf_dir):
    return table(spark, sf_dir, "part").where("p_brand = 'Brand#2' and p_size >= 10").select("p_partkey", "p_name", "p_size").orderBy("p_size", "p_partkey")


@query("select event_id, json_extract_string(props, '$.k')::bigint k from events where json_valid(props)")
def events_json_scan(spark, sf_dir):
    parsed = F.from_json("props", "k bigint", {"mode": "PERMISSIVE"})
    return table(spark, sf_dir, "events").select("event_id", parsed["k"].alias("k")).where("k is not null")


@query("select p_partkey, p_brand, p_type from part where p_brand = 'Brand#2' and p_type = 'ECONOMY'")
def dynamic_filter(spark, sf_dir):
    return changes.where_given(table(spark, sf_dir, "part"), p_brand="Brand#2", p_type="ECONOMY", p_size=None).select("p_partkey", "p_brand", "p_type")


@query("select n_nationkey, n_name from nation where lower(n_name) = lower('nAtIoN_3')")
def ci_equals(spark, sf_dir):
    return table(spark, sf_dir, "nation").where(F.lower("n_name") == F.lower(F.lit("nAtIoN_3"))).select("n_nationkey", "n_name")


@query("select l_orderkey, l_linenumber, l_partkey, l_quantity from lineitem where l_orderkey = 7 and l_linenumber = 1")
def point_lookup(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").where("l_orderkey = 7 and l_linenumber = 1").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")


@query("select doc_id, quality from labels where quality = 1 order by doc_id limit 50")
def default_status_filter(spark, sf_dir):
    return changes.page(table(spark, sf_dir, "labels").where("quality = 1").select("doc_id", "quality"), 50, 0, F.col("doc_id"))


@query("select o_orderkey, o_custkey, strftime(o_orderdate, '%Y-%m-%d') as day from orders order by o_orderdate desc, o_orderkey desc limit 20 offset 40")
def filter_page(spark, sf_dir):
    rows = changes.page(table(spark, sf_dir, "orders"), 20, 40, F.desc("o_orderdate"), F.desc("o_orderkey"))
    return rows.select("o_orderkey", "o_custkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))


@query("select event_id, user_id from events where ts >= timestamp '2024-01-05 00:00:00'")
def since_filter(spark, sf_dir):
    return events(spark, sf_dir).where("ts >= timestamp '2024-01-05 00:00:00'").select("event_id", "user_id")


@query("select event_id, case when event_type = 'error' then 500 else 200 end status, case when event_type = 'error' then 'error' else 'ok' end class from events")
def status_class(spark, sf_dir):
    status = F.when(F.col("event_type") == "error", 500).otherwise(200)
    return table(spark, sf_dir, "events").select("event_id", status.alias("status")).withColumn("class", F.when(F.col("status") >= 400, "error").otherwise("ok"))


@query("select c_custkey, c_acctbal, c_nationkey from customer where c_acctbal between 1000 and 2500 and c_nationkey between 3 and 9")
def bbox_filter(spark, sf_dir):
    return table(spark, sf_dir, "customer").where(in_box(F.col("c_acctbal"), F.col("c_nationkey"), 1000, 3, 2500, 9)).select("c_custkey", "c_acctbal", "c_nationkey")


@query("select c_custkey::varchar id, c_name n, c_nationkey s, c_acctbal lat, c_mktsegment p from customer")
def geo_projection(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("n"), F.col("c_nationkey").alias("s"), F.col("c_acctbal").alias("lat"), F.col("c_mktsegment").alias("p"))


@query("select s_suppkey id, s_name publisher_name, s_nationkey publisher_source_id, s_acctbal > 5000 is_primary from supplier")
def nest_struct(spark, sf_dir):
    nested = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.struct(F.col("s_name").alias("name"), F.col("s_nationkey").alias("source_id")).alias("publisher"), (F.col("s_acctbal") > 5000).alias("is_primary"))
    return nested.select("id", F.col("publisher.name").alias("publisher_name"), F.col("publisher.source_id").alias("publisher_source_id"), "is_primary")


BAD = "(s_suppkey = 3 and s_name = 'Supplier#000000003') or (s_suppkey = 5 and s_nationkey < 0)"


@query(f"select s_suppkey, s_name from supplier where not ({BAD})")
def suppress_rule(spark, sf_dir):
    return table(spark, sf_dir, "supplier").where(f"not ({BAD})").select("s_suppkey", "s_name")


@query("select s_suppkey, case when s_suppkey = 7 then 'Renamed' else s_name end s_name, case when s_suppkey = 7 then 99 else s_nationkey end s_nationkey from supplier")
def override_rule(spark, sf_dir):
    rules = {7: {"s_name": "Renamed", "s_nationkey": 99}}
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    for key, fields in rules.items():
        rows = rows.withColumns({c: F.when(F.col("s_suppkey") == key, F.lit(v)).otherwise(F.col(c)) for c, v in fields.items()})
    return rows


@query("select conv_id, turn, case when role is null or role not in ('user', 'assistant') then 'role' when text is null or length(text) > 500 then 'length' end reason, "
       "role is not null and role in ('user', 'assistant') and text is not null and length(text) <= 500 ok from conversations")  # fmt: skip
def validate_split(spark, sf_dir):
    rules = {"role": F.col("role").isin("user", "assistant"), "length": F.length("text") <= 500}
    return split_valid(table(spark, sf_dir, "conversations"), rules).select("conv_id", "turn", "reason", "ok")


POPULATION = "coalesce(try_cast(json_extract_string(props, '$.pop') as bigint), try_cast(json_extract_string(props, '$.k') as bigint), 0)"


@query(f"select event_id, {POPULATION} pop from events")
def coalesce_cast(spark, sf_dir):
    field = lambda k: F.get_json_object("props", f"$.{k}").try_cast("bigint")
    return table(spark, sf_dir, "events").select("event_id", F.coalesce(field("pop"), field("k"), F.lit(0)).alias("pop"))


@query(f"select event_id, {POPULATION} pop from events where {POPULATION} > 10 and value is not null")
def reject_rows(spark, sf_dir):
    return coalesce_cast(spark, sf_dir).join(table(spark, sf_dir, "events").where("value is not null").select("event_id"), "event_id").where("pop > 10")


BOXES = ["1,2,#,4", "a,#", "1,#,3", " -1.#,2, 3e1,#", "", "1,2,3,4,#", "#,#,#,#"]


@query(f"select event_id, case when ok then try_cast(p[1] as double) end south, case when ok then try_cast(p[2] as double) end west, case when ok then try_cast(p[3] as double) end north, case when ok then try_cast(p[4] as double) end east from "
       f"(select *, coalesce(len(p) = 4 and len(list_filter(p, lambda x: try_cast(x as double) is not null)) = 4, false) ok from (select event_id, list_transform(string_split(case when event_id % 50 <> 0 then replace({pick_sql(BOXES, 'event_id')}, '#', user_id::varchar) end, ','), lambda x: trim(x)) p from events))")  # fmt: skip
def parse_bbox(spark, sf_dir):
    box = F.when(F.col("event_id") % 50 != 0, F.replace(pick(BOXES, F.col("event_id")), F.lit("#"), F.col("user_id").cast("string")))
    numbers = F.transform(F.split(box, ","), lambda x: F.trim(x).try_cast("double"))
    good = (F.size(numbers) == 4) & F.forall(numbers, lambda x: x.isNotNull())
    rows = table(spark, sf_dir, "events").select("event_id", F.when(good, numbers).alias("p"))
    return rows.select("event_id", *[F.col("p")[i].alias(n) for i, n in enumerate(("south", "west", "north", "east"))])


@query("select s_suppkey, s_name from supplier where contains(lower(s_name), '07') or contains(s_suppkey::varchar, '42')")
def substring_or(spark, sf_dir):
    return table(spark, sf_dir, "supplier").where(F.contains(F.lower("s_name"), F.lit("07")) | F.contains(F.col("s_suppkey").cast("string"), F.lit("42"))).select("s_suppkey", "s_name")


@query("select user_id, count(*) n from events where ts > (select max(ts) from events) - interval 60 minute group by user_id")
def rate_limit_count(spark, sf_dir):
    rows = events(spark, sf_dir)
    newest = rows.agg(F.max("ts").alias("newest"))  # one row
    return rows.crossJoin(F.broadcast(newest)).where("ts > newest - interval 60 minutes").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


@query("select doc_id, source from documents where doc_id in (select doc_id from labels where quality = 1) and not (source = 'src3' and lang = 'de')")
def usable_rows(spark, sf_dir):
    good = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return table(spark, sf_dir, "documents").select("doc_id", "source", "lang").where("not (source = 'src3' and lang = 'de')").join(good, "doc_id", "left_semi").select("doc_id", "source")


@query("select d.doc_id, case when l.doc_id is not null then 'cached' else 'available' end status from documents d left join (select distinct doc_id from labels where quality = 1) l using (doc_id)")
def derive_status(spark, sf_dir):
    usable = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id").distinct().withColumn("hit", F.lit(True))
    return table(spark, sf_dir, "documents").select("doc_id").join(usable, "doc_id", "left").select("doc_id", F.when(F.col("hit"), "cached").otherwise("available").alias("status"))


@query("select conv_id, turn, role from conversations")
def explode_docs(spark, sf_dir):
    packed = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.collect_list(F.struct("turn", "role")).alias("documents"))
    return packed.select("conv_id", F.explode("documents").alias("d")).select("conv_id", "d.turn", "d.role")


@query("select conv_id, turn, row_number() over (partition by conv_id order by turn) - 1 sort_order, row_number() over (partition by conv_id order by turn) = 1 is_primary from conversations where role = 'user'")
def positional_flag(spark, sf_dir):
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1
    return table(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", place.cast("long").alias("sort_order")).withColumn("is_primary", F.col("sort_order") == 0)


@query("select c_nationkey, case when g then coalesce(p, f) end code_id from (select c_nationkey, true g, min(c_custkey) filter (where c_mktsegment = 'MACHINERY') p, min(c_custkey) f from customer group by c_nationkey)")
def default_code(spark, sf_dir):
    rank = F.row_number().over(Window.partitionBy("c_nationkey").orderBy((F.col("c_mktsegment") == "MACHINERY").desc(), "c_custkey"))
    return table(spark, sf_dir, "customer").withColumn("n", rank).where("n = 1").select("c_nationkey", F.col("c_custkey").alias("code_id"))


@query("select item_id, case when length(text) > 60 then left(text, 60) || '...' else text end short from benchmark")
def truncate(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", T.truncate(F.col("text"), 60).alias("short"))
