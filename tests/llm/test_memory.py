"""What Python workers still hold when their tasks have ended."""

import re
from pathlib import Path

import pandas as pd
import pyarrow as pa
import public_tokenizers

from lexspan.llm import toxicity
from lexspan.llm.batches import give_back, giving_back
from lexspan.llm.packing import pack


def held_mb():
    return sum(map(int, re.findall(r"\nPss_Anon:\s+(\d+)", Path("/proc/self/smaps_rollup").read_text()))) / 1024


def test_freed_memory_goes_back():
    texts = [bytes(2_000) for _ in range(100_000)]
    pinned = texts[::1_000]  # lies above what is freed, so free() alone returns nothing
    before = held_mb()
    del texts
    list(giving_back(lambda batches: batches)(iter(())))
    assert held_mb() < before - 100 and len(pinned) == 100
    give_back()


def test_packing_forgets_its_chunks(spark, docs):
    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = pack(docs([(i, f"text{i} with words{i} of{i} its own") for i in range(200)], 8), path, 0).collect()
    assert len({r.doc_id for r in rows}) == 200

    def report(batches):
        from lexspan.llm.tokens import _encoders

        for _ in batches:
            yield pa.RecordBatch.from_pydict({"loaded": [len(_encoders)], "chunks": [sum(len(x.memo) for x in _encoders.values())]})

    found = spark.range(0, 64, 1, 16).mapInArrow(report, "loaded long, chunks long").collect()
    assert any(r.loaded for r in found) and not any(r.chunks for r in found)


def test_scoring_forgets_its_words(monkeypatch):
    calls = []
    monkeypatch.setattr(toxicity, "give_back", lambda: calls.append(1))
    model = toxicity.Model()
    texts = ["some words", None, "other words"]
    found = list(toxicity.scores(model, iter([pd.Series(texts), pd.Series(texts[:1])])))
    assert [len(x) for x in found] == [3, 1] and found[0].tolist() == [model.score(t) for t in texts[:2] + texts[2:]]
    model.memo.clear()
    list(toxicity.scores(model, iter([pd.Series(texts)])))
    assert not model.memo and len(calls) == 2
