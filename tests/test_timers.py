"""Streams with timers: heartbeats, expiry, cooldowns, a restart from the checkpoint, answers that age."""

from pyspark.sql import functions as F

from lexspan.streaming import timers


def test_crawls_with_timers_and_a_restart(spark, tmp_path):
    (tmp_path / "in").mkdir()
    feed = spark.readStream.schema("jurisdiction string, event string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    def add(*rows):
        made = spark.createDataFrame(list(rows), "jurisdiction string, event string, s long")
        made.select("jurisdiction", "event", F.timestamp_seconds("s").alias("ts")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def run():
        """One start of the stream, from its checkpoint; its rows."""
        out = str(tmp_path / "out")
        timers.crawl_timers(feed).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "check")).outputMode("append").trigger(availableNow=True).start(out).awaitTermination()
        return sorted((tuple(r) for r in spark.read.parquet(out).collect()), key=lambda r: (r[2], r[0], r[1]))

    add(("a", "start", 1000), ("b", "start", 1000), ("b", "fail", 1030), ("c", "start", 1005), ("c", "done", 1010), ("d", "progress", 1011))
    first = run()
    assert first == [("a", "active", 1000.0), ("b", "active", 1000.0), ("c", "active", 1005.0), ("c", "done", 1010.0), ("b", "failed", 1030.0)]
    add(("b", "start", 1100), ("a", "start", 1150), ("clock", "done", 1200))  # in b's cooldown; while a runs
    second = run()
    assert [r for r in second if r not in first and r[0] != "clock"] == [("a", "heartbeat", 1060.0), ("b", "refused", 1100.0), ("a", "heartbeat", 1120.0), ("a", "running", 1150.0), ("a", "heartbeat", 1180.0)]
    add(("a", "progress", 1250), ("clock", "done", 1700))  # stream time goes on: b cools down
    third = [r for r in run() if r not in second and r[0] != "clock"]
    assert ("b", "cooled", 1630.0) in third and [r[2] for r in third if r[:2] == ("a", "heartbeat")] == [1240.0 + 60 * k for k in range(8)]
    add(("b", "start", 1710), ("clock", "done", 1250 + 35 * 60 + 100))  # a has been silent for 35 minutes
    add(("clock", "done", 9000))
    last = run()
    assert ("a", "expired", 1250.0 + 35 * 60) in last and ("b", "active", 1710.0) in last and ("b", "expired", 1710.0 + 35 * 60) in last
    beats = [r[2] for r in last if r[:2] == ("a", "heartbeat")]
    assert beats == [1060.0 + 60 * k for k in range(len(beats))] and beats[-1] <= 1250 + 35 * 60 < beats[-1] + 60
    assert {r.jurisdiction: r.minutes for r in timers.minutes_running(spark.read.parquet(str(tmp_path / "out"))).collect()}["a"] == len(beats)
    assert run() == last


def test_answers_age(spark, tmp_path):
    """Over two starts: an answer counts for 30 days of stream time, then its key has none."""
    (tmp_path / "in").mkdir()
    feed, day = spark.readStream.schema("key string, answer string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), 86_400

    def step(*rows):
        made = spark.createDataFrame(list(rows), "key string, answer string, s long").select("key", "answer", F.timestamp_seconds("s").alias("ts"))
        made.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        out = str(tmp_path / "out")
        timers.cached_answers(feed, 30 * day).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "check")).outputMode("append").trigger(availableNow=True).start(out).awaitTermination()
        return sorted((tuple(r) for r in spark.read.parquet(out).collect()), key=str)

    assert step(("q", "old", day), ("r", None, day), ("q", None, 2 * day)) == [("q", "old"), ("r", None)]
    assert step(("q", None, 31 * day - 1), ("q", None, 31 * day), ("r", "late", 40 * day)) == [("q", "old"), ("q", "old"), ("q", None), ("r", None)]
    assert step(("q", None, 41 * day), ("q", "new", 42 * day), ("q", None, 43 * day), ("r", None, 69 * day)) == [("q", "new"), ("q", "old"), ("q", "old"), ("q", None), ("q", None), ("r", "late"), ("r", None)]


def test_rows_do_not_depend_on_batches():
    """A crawl's rows by plain steps: whatever times advance() is called for in between."""
    events = [("start", 0.0), ("progress", 130.0), ("fail", 200.0), ("start", 500.0), ("start", 900.0), ("done", 1000.0), ("start", 1100.0)]

    def run(stops):
        crawl, out = ("", 0.0, 0.0), []
        for at, event in sorted([(t, e) for e, t in events] + [(s, "") for s in stops]):
            crawl, due = timers.advance(crawl, at)
            crawl, made = timers.follow(crawl, event, at) if event else (crawl, [])
            out += due + made
        return out + timers.advance(crawl, 1e6)[1]

    plain = run([])
    assert plain == run(range(0, 4000, 7)) == run([60.0, 61.0, 799.0, 800.0])
    assert plain[:8] == [("active", 0.0), ("heartbeat", 60.0), ("heartbeat", 120.0), ("heartbeat", 180.0), ("failed", 200.0), ("refused", 500.0), ("cooled", 800.0), ("active", 900.0)]
    assert plain[-1] == ("expired", 1100.0 + 35 * 60) and sum(k == "heartbeat" for k, _ in plain) == 3 + 1 + 35
