"""Change sets and windows in time."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import changes, logs
from ..snapshots import ScopedTable, once
from ..staging import Workspace
from .base import events, query, table


@query("select s_suppkey id, s_name name from supplier where s_suppkey not in (select c_custkey from customer where c_mktsegment = 'BUILDING') union all select c_custkey, c_name from customer where c_mktsegment = 'BUILDING'")
def upsert_merge(spark, sf_dir):
    old = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    new = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return changes.upsert(old, new, ["id"])


@query("select coalesce(s_suppkey, c_custkey) id, case when s_suppkey is not null then s_name else c_name end name, case when c_custkey is not null then c_acctbal else s_acctbal end bal "
       "from supplier full join (select * from customer where c_mktsegment = 'BUILDING') on s_suppkey = c_custkey")  # fmt: skip
def upsert_partial_cols(spark, sf_dir):
    old = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("bal"))
    new = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("bal"))
    return changes.upsert_columns(old, new, ["id"], ["bal"])


@query("select s_suppkey id, s_name name from supplier union all select c_custkey, c_name from customer where c_custkey not in (select s_suppkey from supplier)")
def insert_ignore(spark, sf_dir):
    old = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    new = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return changes.insert_ignore(old, new, ["id"], F.col("name"))


@query("with o as (select * from orders where o_orderdate < timestamp '1998-01-01'), n as (select * from orders where o_orderdate >= timestamp '1998-01-01' and o_orderstatus in ('F', 'O')) "
       "select o_orderkey, row_number() over (partition by o_orderstatus, case when o_orderstatus = 'F' then o_custkey else o_custkey % 100 end, case when o_orderstatus = 'F' then o_orderpriority else '' end order by o_orderkey) = 1 "
       "and not exists (select 1 from o where o.o_orderstatus = n.o_orderstatus and case when n.o_orderstatus = 'F' then o.o_custkey = n.o_custkey and o.o_orderpriority = n.o_orderpriority else o.o_custkey % 100 = n.o_custkey % 100 end) accepted from n")  # fmt: skip
def partial_unique(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").withColumn("k", F.col("o_custkey") % 100)
    keys = {"F": ["o_custkey", "o_orderpriority"], "O": ["k"]}
    return changes.partial_unique(rows.where("o_orderdate < timestamp_ntz '1998-01-01 00:00:00'"), rows.where("o_orderdate >= timestamp_ntz '1998-01-01 00:00:00' and o_orderstatus in ('F', 'O')"), keys, "o_orderstatus", F.col("o_orderkey")).select("o_orderkey", "accepted")


@query("select source, count(*) filter (where source is distinct from 'src1' or lang is distinct from 'en') kept, count(*) filter (where source = 'src1' and lang = 'en') dropped from documents group by source")
def delete_scope(spark, sf_dir):
    """Survivors and deleted rows of every source."""
    return changes.delete_scope_counts(table(spark, sf_dir, "documents").select("source", "lang"), "source", source="src1", lang="en")


@query("select o_orderkey, coalesce(case when o_orderstatus = 'F' then 'resolved' when o_orderstatus = 'O' then 'triaged' end, o_orderstatus) status, case when o_orderstatus = 'F' then 1700000000::bigint when o_orderkey % 2 = 0 then o_orderkey::bigint end stamp from orders")
def status_transition(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderkey")).cast("long").alias("stamp"))
    new = F.when(F.col("status") == "F", "resolved").when(F.col("status") == "O", "triaged")
    return changes.change_status(rows, new, F.lit(1700000000).cast("long"), ("resolved", "dismissed"), "stamp")


@query("select l_orderkey, l_linenumber from lineitem where l_shipdate >= timestamp '2000-01-01' and l_orderkey not in (select o_orderkey from orders where o_orderstatus = 'F')")
def incremental_anti(spark, sf_dir):
    done = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return table(spark, sf_dir, "lineitem").where("l_shipdate >= timestamp_ntz '2000-01-01 00:00:00'").select("l_orderkey", "l_linenumber").join(done, "l_orderkey", "left_anti")


@query("select o_orderkey, o_orderdate > timestamp '1998-06-01' - interval 30 day and o_orderdate <= timestamp '1998-06-01' fresh from orders")
def cache_freshness(spark, sf_dir):
    now = F.lit("1998-06-01").cast("timestamp_ntz")
    return table(spark, sf_dir, "orders").select("o_orderkey", ((F.col("o_orderdate") > now - F.expr("interval 30 days")) & (F.col("o_orderdate") <= now)).alias("fresh"))


@query("select event_id, user_id, count(*) over (partition by user_id order by epoch_us(ts) range between 3600000000 preceding and 1 preceding) >= 10 rejected from events")
def rate_limit_window(spark, sf_dir):
    rows = logs.recent_count(events(spark, sf_dir), "user_id", F.unix_micros("ts"), 60)
    return rows.select("event_id", "user_id", (F.col("recent") >= 10).alias("rejected"))


@query("select epoch(time_bucket(interval '1 day', ts))::bigint as at, event_type, count(*) n from events group by 1, 2")
def tumbling_counts(spark, sf_dir):
    return events(spark, sf_dir).groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.unix_timestamp("w.start").alias("at"), "event_type", "n")


@query("select epoch(b)::bigint as at, count(*) n from (select unnest([time_bucket(interval '1 hour', ts), time_bucket(interval '1 hour', ts) - interval 1 hour]) b from events) group by 1")
def sliding_counts(spark, sf_dir):
    return events(spark, sf_dir).groupBy(F.window("ts", "2 hours", "1 hour").alias("w")).agg(F.count(F.lit(1)).alias("n")).select(F.unix_timestamp("w.start").alias("at"), "n")


@query("with g as (select *, case when ts - lag(ts) over (partition by user_id order by ts) < interval 30 minute then 0 else 1 end b from events), s as (select *, sum(b) over (partition by user_id order by ts, event_id rows unbounded preceding) k from g) "
       "select user_id, epoch_us(min(ts)) as at, count(*) n from s group by user_id, k")  # fmt: skip
def session_gaps(spark, sf_dir):
    return events(spark, sf_dir).groupBy(F.session_window("ts", "30 minutes").alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n")).select("user_id", F.unix_micros("w.start").alias("at"), "n")


@query("select o_orderstatus status, o_orderpriority priority, count(*) n, sum(case when o_orderpriority = '1-URGENT' and o_orderstatus = 'F' then o_orderkey + 1 else o_orderkey end)::bigint keys from orders where not (o_orderpriority = '2-HIGH' and o_orderstatus = 'O') group by 1, 2 "
       "union all select 'P', 'new', count(*), sum(o_orderkey)::bigint from orders where o_orderstatus = 'P'")  # fmt: skip
def scope_replace_on_disk(spark, sf_dir):
    """Scopes (status, priority) of a table on disk, one changed, one deleted and one added by commits, read back."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"), F.col("o_orderkey").cast("long").alias("key"))
    ws = Workspace(spark, "scopes")
    stored = ScopedTable(spark, f"{ws.path}/orders", "status string, priority string, key long", ["status", "priority"])
    stored.replace(rows)
    stored.replace(rows.where("status = 'F' and priority = '1-URGENT'").withColumn("key", F.col("key") + 1))
    stored.replace(rows.where("status = 'P'").withColumn("priority", F.lit("new")))
    stored.delete([stored.name("O", "2-HIGH")])
    return stored.read().groupBy("status", "priority").agg(F.count(F.lit(1)).alias("n"), F.sum("key").alias("keys"))


@query("select user_id, count(*) n, max(epoch_us(ts)) last_at, arg_max(event_type, (epoch_us(ts), event_id)) last_type from events where user_id is not null group by user_id")
def stream_upsert(spark, sf_dir):
    """A stream of events taken into a table of users exactly once: counts add up, the last event stays; read back."""
    ws = Workspace(spark, "stream")
    users = ScopedTable(spark, f"{ws.path}/users", "user_id long, n long, last_at long, last_type string, last_id long", ["user_id"], buckets=16)
    feed = spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events*.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    each = feed.where("user_id is not null").select(F.col("user_id").cast("long").alias("user_id"), F.lit(1).cast("long").alias("n"), F.unix_micros("ts").alias("last_at"), F.col("event_type").alias("last_type"), F.col("event_id").cast("long").alias("last_id"))
    query_ = each.writeStream.foreachBatch(once(users, "events", logs.fold_users)).trigger(availableNow=True).option("checkpointLocation", f"{ws.path}/checkpoint").start()
    query_.awaitTermination()
    return users.read().select("user_id", "n", "last_at", "last_type")


@query("select event_type kind, user_id % 7 bucket, count(distinct event_id) n from events where user_id is not null group by 1, 2")
def search_log(spark, sf_dir):
    """Log entries upserted by their id: entries that come again replace themselves."""
    ws = Workspace(spark, "log")
    log = ScopedTable(spark, f"{ws.path}/log", "id long, kind string, who long", ["id"], buckets=8)
    rows = table(spark, sf_dir, "events").where("user_id is not null").select(F.col("event_id").cast("long").alias("id"), F.col("event_type").alias("kind"), F.col("user_id").cast("long").alias("who"))
    merged = lambda old, new: changes.upsert(old, new, ["id"])
    log.change(rows.where("id % 3 != 0"), merged)
    log.change(rows.where("id % 3 != 1"), merged)
    return log.read().groupBy("kind", (F.col("who") % 7).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
