import json

from lexspan.sources import files
from lexspan.streaming import state


def test_gazetteer(spark, tmp_path):
    path = tmp_path / "g.txt"
    path.write_text("USPS\tGEOID\tNAME\tINTPTLAT\tINTPTLONG   \nCA\t0655184\tPalm Desert city\t33.7\t-116.3   \n\t0664500\tRosemead CDP\t34.0\t-118.0\nNV\t\tNowhere\t1\t2\nTX\t48\tBad\tx\t2\n\t9900\tNo state\t1\t2\n")
    rows = {r.fips: r for r in files.gazetteer(spark, str(path), "place").collect()}
    assert set(rows) == {"0655184", "0664500"}
    assert rows["0655184"].name == "Palm Desert" and rows["0664500"].state == "CA" and rows["0664500"].name == "Rosemead" and rows["0655184"].lng == -116.3 and rows["0655184"].pop == 0


def test_json_sources(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps([{"id": "hoa-1", "name": "Oak", "documents": [{"id": "ccr", "title": "CC&Rs", "url": "u", "format": "pdf"}, {"id": "b", "title": "Bylaws"}]}]))
    docs = files.manual_documents(files.json_table(spark, str(tmp_path / "m.json"), "manual_sources")).orderBy("ord").collect()
    assert [(d.jurisdiction_id, d.document_id, d.format) for d in docs] == [("hoa-1", "ccr", "pdf"), ("hoa-1", "b", None)]
    (tmp_path / "log.jsonl").write_text('{"ts": "2024-01-01T00:00:00Z", "method": "GET", "path": "/a", "status": 200, "query": {"q": "x"}}\nnot json\n{"ts": "2024-01-02T00:00:00Z", "status": 404}\n')
    log = files.request_log(spark, str(tmp_path / "log.jsonl"))
    assert log.count() == 2 and log.where("query['q'] = 'x'").count() == 1
    files.append_log(log, str(tmp_path / "out"))
    files.append_log(log, str(tmp_path / "out"))
    assert files.request_log(spark, str(tmp_path / "out")).count() == 4


def test_html_tree_and_sections(spark, tmp_path):
    at = tmp_path / "codes" / "ca-x" / "title-1"
    at.mkdir(parents=True)
    (at / "section-1.html").write_text("<p>Text</p>")
    (row,) = files.html_tree(spark, str(tmp_path / "codes")).collect()
    assert (row.jurisdiction_id, row.path, row.html) == ("ca-x", "title-1/section-1", "<p>Text</p>")
    text = "An introduction that is certainly longer than fifty characters in all.\nA. First ..... 3\nA. First\nbody one\nB. Second\nbody two"
    assert files.lettered_sections(text)[1:] == [("A", "First", "body one"), ("B", "Second", "body two")]
    files.register(spark)
    spark.createDataFrame([(text,)], "t string").createOrReplaceTempView("texts")
    assert spark.sql("select s.* from texts, lateral lettered_sections(t) s").count() == 3


def test_crawl_state_machine():
    kind, since = state.next_state(None, None, "start", 0)
    assert not state.may_start(kind, since, 34 * 60) and state.may_start(kind, since, 36 * 60)
    kind, since = state.next_state(kind, since, "fail", 100)
    assert state.current(kind, since, 100 + 9 * 60) == "failed" and state.may_start(kind, since, 100 + 11 * 60)
    assert state.next_state("active", 5, "done", 9) == (None, None)


def test_streams(spark, tmp_path, sf_dir):
    from pyspark.sql import functions as F

    from lexspan.plans.base import events

    rows = events(spark, sf_dir)
    rows.write.parquet(str(tmp_path / "events"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "events"))
    run = lambda df, name, mode: df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / name)).start().awaitTermination()
    run(state.windowed_counts(stream), "counts", "complete")
    assert sorted(map(tuple, spark.table("counts").collect())) == sorted(map(tuple, state.windowed_counts(rows).collect()))
    run(state.rate_limited(stream, "user_id", limit=2), "limited", "complete")
    assert spark.table("limited").count() == state.rate_limited(rows, "user_id", limit=2).count()
    log = spark.createDataFrame([("a", "start", 0), ("a", "fail", 60), ("b", "start", 5), ("c", "start", 1), ("c", "done", 9)], "jurisdiction string, event string, s long")
    log.select("jurisdiction", "event", F.timestamp_seconds("s").alias("ts")).write.parquet(str(tmp_path / "crawl"))
    feed = spark.readStream.schema("jurisdiction string, event string, ts timestamp").parquet(str(tmp_path / "crawl"))
    run(state.crawl_states(feed), "crawls", "append")
    first = {r.jurisdiction: r.state for r in spark.table("crawls").where("state != 'expired'").collect()}
    assert first == {"a": "failed", "b": "active", "c": "done"}
