"""Commits of tables on disk: what stands after a stop, who is refused, which files are touched, batches that come again."""

import threading

import pytest
from pyspark.sql import functions as F

from lexspan.operators import changes, logs
from lexspan.snapshots import Conflict, ScopedTable, Snapshots, once

SCHEMA = "state string, code string, id long, name string"
ROWS = [("ca", "a", 1, "x"), ("ca", "a", 2, "y"), ("ca", "b", 3, "z"), ("ny", None, 4, "w"), (None, "a/b %=", 5, "v")]


def stored(spark, path):
    return ScopedTable(spark, f"file://{path}/t", SCHEMA, ["state", "code"])


def rows_of(table, **options):
    return sorted((tuple(r) for r in table.read(**options).collect()), key=str)


def files(path):
    return {p: p.stat().st_mtime_ns for p in path.rglob("*.parquet")}


def test_scopes_are_replaced_and_others_untouched(spark, tmp_path):
    make = lambda rows: spark.createDataFrame(rows, SCHEMA)
    table = stored(spark, tmp_path)
    assert rows_of(table) == []
    table.replace(make(ROWS))
    assert rows_of(table) == sorted(ROWS, key=str)
    before, first = files(tmp_path), table.snapshots.state()
    table.replace(make([("ca", "a", 9, "new"), (None, "a/b %=", 8, None)]))
    now = [r for r in ROWS if r[2] in (3, 4)] + [("ca", "a", 9, "new"), (None, "a/b %=", 8, None)]
    assert rows_of(table) == sorted(now, key=str) and before.items() <= files(tmp_path).items()
    assert rows_of(table, state=first) == sorted(ROWS, key=str)  # a reader keeps its state
    assert rows_of(table, scopes=[table.name("ny", None)]) == [ROWS[3]]
    table.replace(make([]), [table.name("ca", "b")])  # a scope that ends up empty
    table.delete([table.name("ny", None), table.name("absent", "x")])
    assert {r[2] for r in rows_of(table)} == {8, 9}
    with pytest.raises(ValueError, match="outside"):
        table.replace(make([("tx", "a", 1, "x")]), [table.name("ca", "a")])
    table.change(make([("ca", "a", 9, "changed"), ("wa", "c", 10, "added")]), lambda old, new: changes.upsert(old, new, ["id"]))
    assert {(r[2], r[3]) for r in rows_of(table)} == {(8, None), (9, "changed"), (10, "added")}
    table.snapshots.vacuum(older_than=-1)
    assert {r[2] for r in rows_of(table)} == {8, 9, 10} and len(files(tmp_path)) < len(before) + 9


@pytest.mark.parametrize("step", ["write", "put", "rename"])
def test_a_stop_leaves_the_old_scope(spark, tmp_path, monkeypatch, step):
    table = stored(spark, tmp_path)
    table.replace(spark.createDataFrame(ROWS, SCHEMA))
    new = spark.createDataFrame([("ca", "a", 7, "q")], SCHEMA)

    def stop(*_, **__):
        raise OSError("stopped")

    with monkeypatch.context() as m:
        if step == "write":
            m.setattr(Snapshots, "write", stop)
        elif step == "put":  # the rows are written, the manifest is not
            m.setattr(Snapshots, "commit", stop)
        else:  # the manifest has its temporary name only
            commit = Snapshots.commit
            m.setattr(Snapshots, "commit", lambda self, *a, **b: (self._fs.create(self._at("_manifest-left"), True).close(), stop()))
            assert commit
        with pytest.raises(OSError):
            table.replace(new)
    assert rows_of(stored(spark, tmp_path)) == sorted(ROWS, key=str)
    table.replace(new)
    assert {r[2] for r in rows_of(stored(spark, tmp_path))} == {7, 3, 4, 5}


def test_the_second_of_two_writers_is_refused(spark, tmp_path):
    one, two = stored(spark, tmp_path), stored(spark, tmp_path)
    one.replace(spark.createDataFrame(ROWS, SCHEMA))
    base = two.snapshots.state()
    one.replace(spark.createDataFrame([("ca", "a", 7, "q")], SCHEMA))
    with pytest.raises(Conflict):
        two.replace(spark.createDataFrame([("ny", None, 8, "r")], SCHEMA), base=base)
    assert {r[2] for r in rows_of(two)} == {7, 3, 4, 5}


def test_commits_at_once_leave_one_state(spark, tmp_path):
    store, won = Snapshots(spark, f"file://{tmp_path}/s"), []

    def run(n):
        try:
            Snapshots(spark, store.path).commit({"number": 0, "tables": {}, "facts": {}}, facts={"by": n})
            won.append(n)
        except Conflict:
            pass

    threads = [threading.Thread(target=run, args=(n,)) for n in range(6)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert store.numbers() == [1] and store.state()["facts"]["by"] in won


def test_a_batch_that_comes_again_changes_nothing(spark, tmp_path):
    schema = "user_id long, n long, last_at long, last_type string, last_id long"
    table = ScopedTable(spark, f"file://{tmp_path}/u", schema, ["user_id"], buckets=4)
    take = once(table, "s", logs.fold_users)
    batch = lambda *rows: spark.createDataFrame(list(rows), schema)
    take(batch((1, 1, 10, "a", 1), (1, 1, 20, "b", 2), (2, 1, 5, "c", 3)), 0)
    want = {(1, 2, 20, "b"), (2, 1, 5, "c")}
    now = lambda: {tuple(r)[:4] for r in table.read().collect()}
    assert now() == want
    take(batch((1, 1, 10, "a", 1), (1, 1, 20, "b", 2), (2, 1, 5, "c", 3)), 0)  # replayed after a failure
    assert now() == want and table.snapshots.numbers() == [1]
    once(table, "other", logs.fold_users)(batch((2, 1, 6, "d", 4)), 0)  # another stream has numbers of its own
    take(batch((3, 1, 1, "e", 5)), 1)
    assert now() == {(1, 2, 20, "b"), (2, 2, 6, "d"), (3, 1, 1, "e")}


def test_a_batch_is_merged_anew_after_a_conflict(spark, tmp_path, monkeypatch):
    table = ScopedTable(spark, f"file://{tmp_path}/t", "id long, name string", ["id"], buckets=2)
    merged = lambda old, new: changes.upsert(old, new, ["id"])
    commit, others = Snapshots.commit, [1]

    def late(self, base, *args):
        if others.pop() if others else 0:
            table.change(spark.createDataFrame([(1, "theirs"), (2, "theirs")], "id long, name string"), merged)
        return commit(self, base, *args)

    monkeypatch.setattr(Snapshots, "commit", late)
    once(table, "s", merged)(spark.createDataFrame([(1, "ours")], "id long, name string"), 0)
    assert {tuple(r) for r in table.read().collect()} == {(1, "ours"), (2, "theirs")}


def test_a_stream_restarts_where_it_stopped(spark, tmp_path):
    """A batch whose commit stood but whose stream died before noting it comes again and is passed over."""
    schema = "user_id long, n long, last_at long, last_type string, last_id long"
    table = ScopedTable(spark, f"file://{tmp_path}/u", schema, ["user_id"], buckets=2)
    take, died = once(table, "s", logs.fold_users), []

    def dying(batch, number):
        take(batch, number)
        if not died:
            died.append(number)
            raise RuntimeError("the driver died")

    def run(f):
        feed = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        feed.writeStream.foreachBatch(f).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "check")).start().awaitTermination()

    spark.createDataFrame([(1, 1, 1, "a", 1), (2, 1, 2, "b", 2)], schema).write.parquet(str(tmp_path / "in"))
    with pytest.raises(Exception, match="died"):
        run(dying)
    spark.createDataFrame([(1, 1, 3, "c", 3)], schema).write.mode("append").parquet(str(tmp_path / "in"))
    run(dying)
    run(dying)
    assert {(r.user_id, r.n, r.last_type) for r in table.read().collect()} == {(1, 2, "c"), (2, 1, "b")}


def test_buckets_and_too_many_scopes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("lexspan.snapshots.MAX_SCOPES", 3)
    with pytest.raises(ValueError, match="buckets"):
        stored(spark, tmp_path).replace(spark.createDataFrame(ROWS, SCHEMA))
    table = ScopedTable(spark, f"file://{tmp_path}/b", SCHEMA, ["state", "code"], buckets=2)
    table.replace(spark.createDataFrame(ROWS, SCHEMA))
    assert rows_of(table) == sorted(ROWS, key=str) and len(table.snapshots.state()["tables"]["rows"]) <= 2
    assert table.read().where(F.col("id") == 5).count() == 1
