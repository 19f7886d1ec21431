"""Aggregates, sorting and paging."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import changes, logs, registry, search
from .base import events, query, table


@query("select count(*) n from lineitem where l_returnflag = 'R' and l_quantity > 10")
def count_filtered(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").where("l_returnflag = 'R' and l_quantity > 10").agg(F.count(F.lit(1)).alias("n"))


@query("select p_brand, count(*) n from part group by p_brand")
def count_by_key(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"))


DIMENSIONS = ["publisher", "status", "kind", "state"]
REGISTRY = ("(select c_mktsegment publisher, case when c_acctbal < 0 then 'cached' else 'known' end status, case when c_custkey % 4 = 0 then 'county' else 'city' end kind, case when c_nationkey <> 3 then c_nationkey::varchar end state from customer "
            "union all select 'none', 'unknown', 'city', s_nationkey::varchar from supplier where s_suppkey not in (select c_custkey from customer where c_custkey % 2 = 0))")  # fmt: skip


@query(" union all ".join(f"select '{d}' dimension, {d} as key, count(*) n from {REGISTRY} where {d} is not null group by 2" for d in DIMENSIONS) + f" union all select 'total', '', count(*) from {REGISTRY}")
def registry_stats(spark, sf_dir):
    """Four dimensions over the catalog and the gazetteer's places that it lacks."""
    known = table(spark, sf_dir, "customer")
    own = known.select(F.col("c_mktsegment").alias("publisher"), F.when(F.col("c_acctbal") < 0, "cached").otherwise("known").alias("status"), F.when(F.col("c_custkey") % 4 == 0, "county").otherwise("city").alias("kind"), F.when(F.col("c_nationkey") != 3, F.col("c_nationkey").cast("string")).alias("state"))
    lacked = table(spark, sf_dir, "supplier").join(known.where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("s_suppkey")), "s_suppkey", "left_anti")
    places = lacked.select(F.lit("none").alias("publisher"), F.lit("unknown").alias("status"), F.lit("city").alias("kind"), F.col("s_nationkey").cast("string").alias("state"))
    return registry.stats(own.unionByName(places), DIMENSIONS)


@query("select count(*) total, count(*) filter (where event_type = 'error') errors, round(avg(value))::bigint avg_duration from events")
def log_stats(spark, sf_dir):
    return logs.summary(table(spark, sf_dir, "events"), F.col("event_type") == "error", F.col("value"))


@query("select user_id, count(*) n from events group by user_id order by n desc, user_id limit 10")
def top10_keys(spark, sf_dir):
    return logs.top(table(spark, sf_dir, "events"), F.col("user_id"), "user_id")


@query("select regexp_replace(regexp_extract(url, '^[a-z]+://[^/]+([^?]*)', 1), '/\\d+', '/:id') route, count(*) n from pages group by 1 order by n desc, route limit 10")
def top10_routes(spark, sf_dir):
    path = F.regexp_extract("url", r"^[a-z]+://[^/]+([^?]*)", 1)
    return logs.top(table(spark, sf_dir, "pages"), logs.route(path), "route")


@query("select source, coalesce(round(100.0 * count(*) filter (where lang = 'en') / nullif(count(*), 0)), 0)::bigint pct from documents group by source")
def pct_guard(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("source").agg(logs.percentage(F.count_if(F.col("lang") == "en"), F.count(F.lit(1))).alias("pct"))


@query("select c_nationkey, sum(n)::bigint children from (select c_custkey, c_nationkey, (select count(*) from orders where o_custkey = c_custkey) n from customer) group by c_nationkey")
def sum_children(spark, sf_dir):
    per = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"))
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey").join(per, "c_custkey", "left")
    return rows.groupBy("c_nationkey").agg(F.sum(F.coalesce("n", F.lit(0))).alias("children"))


@query("select conv_id, string_agg(turn::varchar || ':' || role, ',' order by turn) turns, count(*) n from conversations group by conv_id")
def group_collect(spark, sf_dir):
    ordered = F.sort_array(F.collect_list(F.struct("turn", F.concat_ws(":", F.col("turn").cast("string"), "role").alias("t"))))
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(ordered, lambda x: x["t"]), ",").alias("turns"), F.count(F.lit(1)).alias("n"))


@query("select md5(text) digest, min(doc_id) doc_id from documents group by 1")
def dedupe_keep_first(spark, sf_dir):
    # a minimum needs no window: copies are reduced before the shuffle
    return table(spark, sf_dir, "documents").groupBy(F.md5("text").alias("digest")).agg(F.min("doc_id").alias("doc_id"))


@query("select l_orderkey, l_linenumber, l_partkey from (select *, row_number() over (partition by l_orderkey order by l_linenumber desc, l_partkey desc) n from lineitem) where n = 1")
def dedupe_keep_last(spark, sf_dir):
    return changes.keep_last(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), ["l_orderkey"], F.col("l_linenumber"), F.col("l_partkey"))


CITED = "[0-9]+ (?:USC|CFR)|https?://[a-z.]+|[A-Z][a-z]+ License"


@query(f"select case when c like 'http%' then 'url' when c like '%License' then 'license' else 'code' end kind, count(*) n from (select unnest(regexp_extract_all(text, '{CITED}')) c from documents) group by 1")
def citations_by_type(spark, sf_dir):
    found = table(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all("text", F.lit(CITED), F.lit(0))).alias("c"))
    kind = F.when(F.startswith("c", F.lit("http")), "url").when(F.endswith("c", F.lit("License")), "license").otherwise("code")
    return found.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("select (year(o_orderdate) // 10 * 10)::bigint as decade, count(*) n from orders group by 1")
def count_by_decade(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy((F.floor(F.year("o_orderdate") / 10) * 10).cast("long").alias("decade")).agg(F.count(F.lit(1)).alias("n"))


@query("select count(*) cached, count(*) filter (where length(text) > 1000) searchable from documents")
def coverage_counts(spark, sf_dir):
    return table(spark, sf_dir, "documents").agg(F.count(F.lit(1)).alias("cached"), F.count_if(F.length("text") > 1000).alias("searchable"))


@query("select conv_id, turn, role from conversations order by conv_id, turn")
def ordered_children(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role").orderBy("conv_id", "turn")


@query("select p_type, p_name, p_partkey from part order by p_type, p_name, p_partkey")
def multi_key_sort(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_type", "p_name", "p_partkey").orderBy("p_type", "p_name", "p_partkey")


@query("select coalesce(nullif(c_mktsegment, 'BUILDING'), '') state, c_name from customer order by state, c_name")
def sort_state_name(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.coalesce(F.nullif("c_mktsegment", F.lit("BUILDING")), F.lit("")).alias("state"), "c_name").orderBy(F.collate("state", "UNICODE"), F.collate("c_name", "UNICODE"))


@query("select event_id, user_id from (select * from events order by ts desc, event_id desc limit 50) order by ts, event_id")
def last_n(spark, sf_dir):
    return logs.last(events(spark, sf_dir), 50, "ts", "event_id").select("event_id", "user_id")


@query("select o_orderkey, (select count(*) from orders where o_orderstatus = 'F') total from orders where o_orderstatus = 'F' order by o_orderkey limit 15 offset 30")
def page_with_total(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select("o_orderkey")
    total = rows.agg(F.count(F.lit(1)).alias("total"))  # one row
    return changes.page(rows, 15, 30, F.col("o_orderkey")).crossJoin(F.broadcast(total))


@query("select source, doc_id from (select source, doc_id, row_number() over (partition by source order by doc_id) n from documents) where n <= 5 order by source, doc_id limit 20")
def topn_per_group(spark, sf_dir):
    return search.top_per_group(table(spark, sf_dir, "documents").select("source", "doc_id"), "source", 5, 20, F.col("doc_id"))


@query("select n_name, regexp_extract(n_name, '(\\d+)', 1)::bigint k from nation order by k desc")
def sort_extracted_num(spark, sf_dir):
    return table(spark, sf_dir, "nation").select("n_name", F.regexp_extract("n_name", r"(\d+)", 1).cast("long").alias("k")).orderBy(F.desc("k"))


RANKS = {"FURNITURE": 0, "MACHINERY": 1, "BUILDING": 2}


@query("select c_mktsegment, c_custkey from customer order by case c_mktsegment when 'FURNITURE' then 0 when 'MACHINERY' then 1 when 'BUILDING' then 2 else 9 end, c_name")
def enum_rank_sort(spark, sf_dir):
    rank = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in RANKS.items() for x in kv]), F.col("c_mktsegment")), F.lit(9))
    return table(spark, sf_dir, "customer").orderBy(rank, "c_name").select("c_mktsegment", "c_custkey")


@query("select user_id, event_id from (select user_id, event_id, row_number() over (partition by user_id order by value desc, event_id) n from events) where n = 1")
def best_by_value(spark, sf_dir):
    best = F.max_by(F.struct("event_id"), F.struct("value", -F.col("event_id")))
    return table(spark, sf_dir, "events").where("value is not null").groupBy("user_id").agg(best.alias("b")).select("user_id", "b.event_id")
