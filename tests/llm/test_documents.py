"""op1, op3, op5, op7, op8 and the pipeline against plain versions."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lexspan.llm import toxicity
from lexspan.llm.exact import DigestIndex, exact_groups
from lexspan.llm.common import Workspace
from lexspan.llm.lines import dedup_lines
from lexspan.llm.mixing import mix_sources, mixture
from lexspan.llm.queries import op1_toxicity, op3_repetition, op5_mix, op7_line_dedup, op8_exact_dedup
from lexspan.llm.repetition import LINE_LIMIT, NGRAM_LIMITS, measure, repetition_rules

WORD, WHITE = re.compile("[^ \t-\r]+"), " \t\n\x0b\f\r"
sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
lower = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def rows_of(spark, sf_dir):
    return [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]


# lines


def slow_lines(rows, min_chars=10):
    holders = defaultdict(set)
    at = lambda i: math.inf if i is None else i
    key = lambda line: lower(line.strip(WHITE))
    for i, t, *_ in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= min_chars:
                holders[key(line)].add(at(i))
    gone = lambda i, line: len(holders.get(key(line), ())) > 1 and min(holders[key(line)]) != at(i)
    out = []
    for i, t, *_ in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not gone(i, x)]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return Counter(out)


def test_op7_against_brute_force(spark, sf_dir):
    got = Counter((r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256) for r in op7_line_dedup(spark, sf_dir).collect())
    assert got == Counter((i, n, d, sha(t)) for i, n, d, t in slow_lines(rows_of(spark, sf_dir)).elements())


def test_lines_odd_rows(docs, odd_rows):
    rows = [*odd_rows, (20, "A shared line here\nown\n  a SHARED line here\t\nA shared line here"), (21, "\na shared LINE here"), (None, "a shared line here"), (21, "a shared line here\n" * 3), (30, "İİİİİİİİİİİ\nshort"), (31, "iiiiiiiiiii\nshort"), (32, "İİİİİİİİİİİ")]
    got = Counter((r.row.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in dedup_lines(docs(rows)).collect())
    assert got == slow_lines(rows)
    assert dedup_lines(docs([])).count() == 0
    many = [(i, f"the very common line\nline of {i}\nthe very common line") for i in range(3000)]
    assert Counter((r.row.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in dedup_lines(docs(many)).collect()) == slow_lines(many)


# exact copies


def slow_exact(rows):
    norm = lambda t: re.sub("[ \t-\r]+", " ", t or "")
    groups = defaultdict(list)
    for i, t, *_ in rows:
        groups[norm(t)].append(i)
    out = []
    for i, t, *_ in rows:
        own = groups[norm(t)]
        keep = min((x for x in own if x is not None), default=None)
        out.append((i, keep, len(own), i == keep, sha(norm(t))))
    return Counter(out)


def tuples(df, *columns):
    return Counter(tuple(r[c] for c in columns) for r in df.collect())


EXACT = ("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def test_op8_against_brute_force(spark, sf_dir):
    assert tuples(op8_exact_dedup(spark, sf_dir), *EXACT) == slow_exact(rows_of(spark, sf_dir))


@pytest.mark.parametrize("bits", [256, 8])
def test_exact_odd_rows(docs, odd_rows, bits):
    """With 8-bit digests nearly all hits are false, so bytes decide."""
    rows = [*odd_rows, *[(100 + i, f"text {i % 70}") for i in range(400)], *[(1000 + i, "one  two three\nfour") for i in range(50)]]
    assert tuples(exact_groups(docs(rows), digest_bits=bits, memtable_rows=20), *EXACT) == slow_exact(rows)
    assert exact_groups(docs([])).count() == 0


def test_index_grows_by_batches(spark):
    index = DigestIndex(spark, f"{Workspace(spark, 'test').path}/index", memtable_rows=3)
    digest = lambda i: hashlib.sha256(b"%d" % i).digest()
    batch = lambda pairs: spark.createDataFrame([(bytearray(digest(d)), i) for d, i in pairs], "digest binary, id long")
    index.insert(batch([(d % 5, d) for d in range(10, 30)]))
    index.insert(batch([(3, 4), (9, 9)]))
    assert index.get(digest(3)) == (4, 5) and index.get(digest(77)) is None
    assert index.table().count() == 6
    index.compact()
    assert index.manifest()["level0"] == [] and index.get(digest(3)) == (4, 5) and index.table().count() == 6
    index.insert(batch([(3, 1)]))
    assert index.get(digest(3)) == (1, 6)
    # a second batch's rows that earlier ones repeat are found through the filter
    index.insert(batch([(100 + i, 100 + i) for i in range(200)] + [(9, 10)]))
    index.compact()
    asked = batch([(i, 0) for i in range(300)]).where(index.maybe_repeated(F.col("digest")))
    let = {bytes(r.digest) for r in asked.collect()}
    assert {digest(i) for i in (0, 1, 2, 3, 4, 9)} <= let and len(let) < 60


def test_index_files_are_sorted_runs(spark, tmp_path):
    index = DigestIndex(spark, f"file://{tmp_path}", memtable_rows=30)
    rows = [(bytearray(hashlib.sha256(b"%d" % (i % 150)).digest()), i) for i in range(400)]
    index.insert(spark.createDataFrame(rows, "digest binary, id long").repartition(2))
    runs = [pq.read_table(f).column("digest").to_pylist() for f in tmp_path.glob("level0-*/*.parquet")]
    assert len(runs) > 8 and all(r == sorted(set(r)) and len(r) <= 30 for r in runs)
    index.compact()
    runs = sorted(r for f in tmp_path.glob("level1-*/*.parquet") if (r := pq.read_table(f).column("digest").to_pylist()))
    assert sum(runs, []) == sorted({bytes(d) for d, _ in rows})  # ranges don't overlap


@pytest.mark.parametrize("step", ["create", "rename", "delete"])
def test_index_survives_a_crash_at_each_step(spark, tmp_path, step):
    """A commit that dies while writing, renaming or deleting leaves the state before it, or the whole new one."""
    path = f"file://{tmp_path}"
    batch = lambda *ids: spark.createDataFrame([(bytearray(b"%032d" % i), i) for i in ids], "digest binary, id long")
    index = DigestIndex(spark, path)
    index.insert(batch(1, 2))
    have = lambda: {r.id for r in DigestIndex(spark, path).table().collect()}

    class Dying:
        def __init__(self, fs):
            self.fs = fs

        def __getattr__(self, name):
            if name == step:
                raise RuntimeError("killed")
            return getattr(self.fs, name)

    for work in (lambda i: i.insert(batch(3)), lambda i: i.compact()):
        dying = DigestIndex(spark, path)
        dying._fs = Dying(dying._fs)
        before = have()
        with pytest.raises(RuntimeError):
            work(dying)
        assert have() in (before, before | {3})
    index.insert(batch(3, 4))
    index.compact()
    assert have() == {1, 2, 3, 4} and index.manifest()["level0"] == []


# repetition


def slow_repetition(text):
    words = WORD.findall(text or "")
    chars = [len(w) for w in words]

    def covered(n):
        grams = Counter(tuple(words[i : i + n]) for i in range(len(words) - n + 1))
        marked = [False] * len(words)
        for i in range(len(words) - n + 1):
            if grams[tuple(words[i : i + n])] > 1:
                marked[i : i + n] = [True] * n
        return marked

    seen, dup, dup_chars = set(), 0, 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            dup_chars += sum(map(len, WORD.findall(line))) if line in seen else 0
            seen.add(line)
    repeats, whole = sum(covered(8)), max(1, sum(chars))
    base = len(words) < 20 or 100 * repeats > 30 * len(words)
    bad = dup_chars > LINE_LIMIT * whole or any(sum(c for c, m in zip(chars, covered(n), strict=True) if m) / whole > limit for n, limit in NGRAM_LIMITS.items())
    return len(words), sum(chars), sum((text or "").count(c) for c in "#*$%&|<>"), dup, repeats, base, not (base or bad)


RULES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def test_op3_against_brute_force(spark, sf_dir):
    want = {i: slow_repetition(t) for i, t, _ in rows_of(spark, sf_dir)}
    got = {r.doc_id: tuple(r[c] for c in RULES) for r in op3_repetition(spark, sf_dir).collect()}
    assert got == want


def test_repetition_odd_rows(docs, odd_rows):
    rows = [*odd_rows, (50, "a b c d e f g h i j " * 10), (51, "x"), (52, "a\x0bb c é# <|>\n\n é# "), (53, "line one is here\n" * 9), (54, " ".join(f"u{i}" for i in range(100)))]
    got = tuples(repetition_rules(docs(rows)), "doc_id", *RULES)
    assert got == Counter((i, *slow_repetition(t)) for i, t in rows)
    assert repetition_rules(docs([])).count() == 0


# mixing


def slow_targets(sizes):
    """sizes: {source or None: words}"""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    fixed = {}
    while True:
        free = [s for s in order if s not in fixed]
        rest = sum(sizes.values()) - sum(fixed.values())
        target = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if target[s] > 3 * sizes[s]]
        if not over:
            return target | fixed
        fixed |= {s: 3 * sizes[s] for s in over}


def check_mix(got, rows):
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len(WORD.findall(t or ""))
    targets, taken = slow_targets(sizes), defaultdict(int)
    assert len(got) == len(rows)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(targets[r.source]) and 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
    assert all(abs(taken[s] - targets[s]) < 1 + 1e-6 for s in sizes)


def test_op5_meets_targets(spark, sf_dir):
    source = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source")
    got = op5_mix(spark, sf_dir).join(source, "doc_id").collect()
    check_mix(got, rows_of(spark, sf_dir))


def test_mixing_odd_rows(docs, odd_rows):
    rows = [(i, t, "s") for i, t in odd_rows] + [(100 + i, "w " * (i % 7), ["a", "b", None, "é"][i % 4]) for i in range(90)] + [(500, "tiny one", "z")]
    flat = lambda n: mix_sources(docs(rows, n)).select("row.doc_id", "row.source", "size", "source_size", "target", "taken").collect()
    check_mix(flat(3), rows)
    assert Counter(flat(3)) == Counter(flat(7))  # any partitioning
    assert mix_sources(docs([])).count() == 0 and mixture(docs([])).count() == 0
    assert {r.taken for r in mix_sources(docs([(1, None), (2, "")])).collect()} == {0}
    mixed = mixture(docs(rows)).collect()
    words = lambda t: len(WORD.findall(t))
    assert sum(words(r.text) for r in mixed) == sum(r.taken for r in flat(3)) and all(r.n_chars == len(r.text) for r in mixed)
    given = defaultdict(list)
    for i, t, _ in rows:
        given[i].append(t or "")
    assert all(any(t.startswith(r.text) for t in given[r.doc_id]) for r in mixed)


# toxicity


def toxic_rows(n=900):
    import random

    rng = random.Random(5)
    common = [f"w{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(n):
        words, bad = [rng.choice(common) for _ in range(rng.randrange(5, 80))], rng.random() < 0.25
        if bad:
            for w in rng.sample(["vile", "scumbag", "rotten", "filthx", "filthy"], 2):
                words.insert(rng.randrange(len(words)), w)
        # the group term goes with toxic texts in the data; the fit must not learn that
        if bad and rng.random() < 0.6 or rng.random() < 0.05:
            words.append("muslims")
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(bad)))
    return rows, labels


def test_counterfactual_fit(spark, docs):
    rows, labels = toxic_rows()
    table = docs(rows)
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.fit(table, known)
    got = {r.row.doc_id: r for r in toxicity.score(table, model).collect()}
    held = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    truth = {i: t for i, _, t in labels}
    assert sum(got[i].predicted == truth[i] for i in held) / len(held) > 0.97
    plain = toxicity.fit_rows([(truth[i], toxicity.np.unique([f for w in toxicity.words_of(t) for f in toxicity.features(w)]), ()) for i, t in rows], 0.25)
    change = lambda m: abs(m.score("w1 w2 muslims w3") - m.score("w1 w2 w3"))
    assert change(model) < 0.5 * change(plain)
    assert abs(model.score("w1 muslims") - model.score("w1 christians")) < 0.05


def test_toxicity_odd_rows(spark, docs, odd_rows):
    rows, labels = toxic_rows(200)
    known = spark.createDataFrame([*labels, (None, 1, 1), (3, None, None), (3, 1, 0)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs([*rows, *odd_rows]), known)
    got = toxicity.score(docs(odd_rows), model).collect()
    assert len(got) == len(odd_rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    none = toxicity.fit(docs(rows), known.where("toxic = 0"))
    assert {r.predicted for r in toxicity.score(docs(rows), none).collect()} == {0}
    assert toxicity.score(docs([]), model).count() == 0


def test_counterfactuals_are_true_differences():
    """Every change is the difference between the scored features of the text and of the text with the swap made."""
    rng = np.random.default_rng(3)
    of = lambda words: {f for w in words for f in toxicity.features(w)}
    texts = ["The women spoke. Many women, and men!", "muslims muslim muslimah prayed", "No group here at all.", "", None, "Women"]
    for text in texts:
        number, feature, sign = toxicity._counterfactuals(text, rng)
        sentences = toxicity._sentences(text)
        before = of(w for s in sentences for w in s)
        swaps = []
        for i, s in enumerate(sentences):
            for term in sorted(set(s) & toxicity._GROUP.keys()):
                swaps.append({(frozenset((f, 1) for f in after - before) | frozenset((f, -1) for f in before - after)) for other in toxicity._GROUP[term] if other != term for after in [of(w if (j, w) != (i, term) else other for j, t in enumerate(sentences) for w in t)]})
        for n, options in enumerate(swaps):
            assert frozenset(zip(feature[number == n].tolist(), sign[number == n].tolist())) in options, (text, n)
        assert (sign[number == len(swaps)] == 1).all()  # a mention put in only adds


def test_false_positives_on_neutral_mentions():
    """Where the labelled data ties group terms to toxic texts, the fit with swaps flags fewer neutral mentions and loses no toxic text."""
    import random

    rng, rows, truth = random.Random(8), [], {}
    for i in range(1500):
        words, bad = [f"w{rng.randrange(300)}" for _ in range(30)], rng.random() < 0.25
        words += [rng.choice(["vile", "scumbag", "rotten", "loser", "trash"])] * (bad and rng.random() < 0.7) + ["muslims"] * (rng.random() < (0.7 if bad else 0.03))
        rows.append((i, " ".join(words)))
        truth[i] = int(bad)
    ids = lambda t: toxicity.np.unique([f for w in toxicity.words_of(t) for f in toxicity.features(w)])
    made = [(truth[i], ids(t), toxicity._counterfactuals(t, np.random.default_rng(i))) for i, t in rows]
    regular, plain = toxicity.fit_rows(made, 0.25), toxicity.fit_rows([(y, x, ()) for y, x, _ in made], 0.25)
    neutral = [f"w{i % 300} w{(i * 7) % 300} the muslims w{(i * 3) % 300} w{(i * 11) % 300}" for i in range(300)]
    rate = lambda m, ts: sum(m.score(t) >= toxicity.THRESHOLD for t in ts) / len(ts)
    assert rate(plain, neutral) > 0.3 and rate(regular, neutral) < 0.1
    toxic = [f"w{i % 300} vile w{(i * 7) % 300} scumbag w{(i * 3) % 300}" for i in range(300)]
    assert rate(regular, toxic) > 0.95


def test_op1_on_held_out_labels(spark):
    """Scores equal a plain evaluation of the model, and the labels that the fit never saw are met."""
    sf_dir = "/root/testdata/sf0.1"
    got = {r.doc_id: r for r in op1_toxicity(spark, sf_dir).collect()}
    rows = rows_of(spark, sf_dir)
    assert len(got) == len(rows) and all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and r.predicted == int(r.score >= 0.3) for i, r in got.items())
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    model = toxicity.fit(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    held = {i for i in labels if got[i].held_out}
    for i, text, _ in rows:
        if i not in held:
            continue
        present = {f for w in {w.strip(toxicity._EDGES) for w in (text or "").lower().split()} - {""} for f in toxicity.features(w)}
        z = model.bias + sum(float(model.weights[f]) for f in present)
        assert got[i].score == pytest.approx(1 / (1 + math.exp(-max(-40.0, min(40.0, z)))), abs=1e-6)
    caught = sum(got[i].predicted for i in held if labels[i])
    assert caught >= 0.9 * sum(labels[i] for i in held) and sum(got[i].predicted for i in held if not labels[i]) <= 0.02 * len(held)


# the pipeline


def test_pipeline_stages(spark, sf_dir):
    from test_simhash import slow_components, slow_fingerprint

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, ws = docs.columns, Workspace(spark, "test")
    steps = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = ws.stage(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        steps[name] = (before.collect(), docs.collect())
        assert name == "packing" or docs.columns == columns
    before, after = steps["toxicity"]
    assert {r.doc_id for r in after} < {r.doc_id for r in before} and set(after) <= set(before)
    before, after = steps["line dedup"]
    want = slow_lines([(r.doc_id, r.text) for r in before])
    assert Counter((r.doc_id, r.text, r.n_chars) for r in after) == Counter((i, t, len(t)) for i, _, _, t in want.elements())
    before, after = steps["near duplicates"]
    root = slow_components(sorted((r.doc_id, slow_fingerprint(r.text)) for r in before))
    assert Counter(after) == Counter(r for r in before if root[r.doc_id] == r.doc_id)
    before, after = steps["mixing"]
    sizes, taken = defaultdict(int), defaultdict(int)
    for rows, of in ((before, sizes), (after, taken)):
        for r in rows:
            of[r.source] += len(WORD.findall(r.text or ""))
    assert all(abs(taken[s] - t) <= 1 for s, t in slow_targets(sizes).items())
    before, after = steps["packing"]
    assert sum(p.length for p in after) == sum(p.doc_tokens for p in after if p.start == 0)
    assert Counter(p.doc_id for p in after if p.start == 0) == Counter(r.doc_id for r in before)


@pytest.mark.parametrize("share, kept", [(0.08, True), (0.16, True), (0.19, True), (0.24, False), (0.28, False)])
def test_planted_repeats(share, kept):
    """Random words whose beginning comes again at the end: all below a fifth in repeats pass, all near a fourth fail."""
    rng = np.random.default_rng(1)
    texts = []
    for size in rng.integers(100, 400, 100):
        words = [f"w{x}" for x in rng.integers(0, 10**9, size)]
        n = round(size * share / 2)
        texts.append(" ".join(words[: size - n] + words[:n]))
    found = measure(pa.array(range(len(texts))), pa.array(texts))
    assert not found["base_failed"].any() and (found["kept"] == kept).all()


def test_a_repeated_labelled_id_comes_to_the_driver_once(spark, monkeypatch):
    """20,000 rows of one labelled doc_id are one row of the fit, whichever order they come in, and long texts are bounded."""

    docs = spark.range(20_000).select(F.lit(3).cast("long").alias("doc_id"), F.concat(F.lit("awful words "), F.lpad(F.col("id").cast("string"), 6, "0")).alias("text"))
    docs = docs.unionByName(spark.createDataFrame([(i, f"kind words {i} " + "many different words " * (5000 if i == 5 else 1)) for i in range(4, 12)], "doc_id long, text string"))
    labels = spark.createDataFrame([(i, int(i == 3)) for i in range(3, 12)], "doc_id long, toxic int")
    seen, plain = [], toxicity.fit_rows
    monkeypatch.setattr(toxicity, "fit_rows", lambda rows, *a: seen.append(rows) or plain(rows, *a))
    monkeypatch.setattr(toxicity, "MAX_FEATURES", 40)
    toxicity.fit(docs, labels)
    toxicity.fit(docs.repartition(7), labels)
    known = [i for i in range(3, 12) if zlib.crc32(str(i).encode()) % 4 != 2]
    assert len(seen[0]) == len(known) and all(len(r[1]) <= 40 for r in seen[0])
    assert [(t, i.tolist()) for t, i, _ in seen[0]] == [(t, i.tolist()) for t, i, _ in seen[1]]
