"""The pipeline's stages on nulls in any column, repeated rows, ties, clashing column names and an empty table."""

from collections import Counter

import pytest

import corpus_pipeline
from lexspan.llm.common import Workspace


@pytest.fixture(scope="module")
def labels(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("labels")
    rows = [(i, 1, int(i % 5 == 0)) for i in range(1, 400)] + [(None, 1, 1), (3, None, None), (4, 1, 0), (4, 1, 1)]
    spark.createDataFrame(rows, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return str(at)


def through(spark, docs, sf_dir):
    """Each stage's rows before and after."""
    ws, steps = Workspace(spark, "edges"), {}
    for name, stage in corpus_pipeline.STAGES:
        after = ws.stage(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        steps[name] = (docs, after)
        docs = after
    return steps


def test_odd_rows_go_through(spark, docs, odd_rows, labels):
    rows = [(i, t, s) for (i, t), s in zip(odd_rows, [None, "a", "b", "a", "a", None, "b", "b", "a", "b", None, "a", "b"], strict=True)]
    rows += [(100 + i, f"document number {i} speaks of things numbered {i * 7} and {i * 13}\na line that is the same everywhere", "ab"[i % 2]) for i in range(60)]
    rows += [rows[-1]] * 3 + [(99, None, None), (99, None, None)]
    given = docs(rows, 4)
    steps = through(spark, given, labels)
    for name, (before, after) in steps.items():
        if name == "packing":
            continue
        assert after.columns == before.columns and after.dtypes == before.dtypes, name
        assert {r.row for r in after.collect()} <= {7} and {r.size for r in after.collect()} <= {"x"}, name  # columns whose names clash
    before, after = (Counter(x.collect()) for x in steps["toxicity"])
    assert after <= before and all(after[r] == before[r] for r in after)  # equal rows stay or go together
    before, after = (x.collect() for x in steps["line dedup"])
    assert Counter(r.doc_id for r in before) == Counter(r.doc_id for r in after) and any(r.text is None for r in after)
    assert sum("same everywhere" in (r.text or "") for r in after) <= 1 + sum(r.doc_id == min(x.doc_id for x in before if "same everywhere" in (x.text or "")) for r in before)
    before, after = (Counter((r.doc_id, r.text) for r in x.collect()) for x in steps["near duplicates"])
    assert after <= before and all(after[k] == before[k] for k in after)
    before, after = (x.collect() for x in steps["mixing"])
    assert all(r.text and r.text.split() and r.n_chars == len(r.text) for r in after) and {r.source for r in after} <= {r.source for r in before}
    before, after = (x.collect() for x in steps["packing"])
    assert Counter(p.doc_id for p in after if p.start == 0) == Counter(r.doc_id for r in before)
    assert sum(p.length for p in after) == sum(p.doc_tokens for p in after if p.start == 0)


def test_an_empty_table_goes_through(spark, docs, labels):
    for name, (before, after) in through(spark, docs([(1, "x", "s")]).where("doc_id = 2"), labels).items():
        assert after.count() == 0 and (name == "packing" or after.columns == before.columns)


def test_nothing_but_nulls(spark, docs, labels):
    steps = through(spark, docs([(None, None, None)] * 5), labels)
    assert steps["near duplicates"][1].count() == 5 and steps["mixing"][1].count() == 0 and steps["packing"][1].count() == 0


def test_whole_run_on_a_table_of_odd_rows(spark, docs, odd_rows, labels, tmp_path):
    for name in ("documents", "labels"):
        (docs([(i, t, "s") for i, t in odd_rows]) if name == "documents" else spark.read.parquet(f"{labels}/labels.parquet")).write.parquet(f"{tmp_path}/{name}.parquet")
    found = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert found and {p.sequence_id for p in found} and all(0 < p.length <= 1024 for p in found)
