"""Toxicity: a word classifier whose fit penalises score changes under swapped group mentions."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import give_back

#: Labelled rows of each class that the fit uses at most (those with the smallest md5 of their doc_id).
MAX_ROWS = 3_000
#: Features, and changes of features, of a text that the fit takes at most. Scores see all of them.
MAX_FEATURES = 20_000
BITS = 18
#: Leading characters of a word that are features beside the word itself.
PREFIXES = (3, 4, 5)
#: A document is rejected from this score on.
THRESHOLD = 0.3
#: Words a worker remembers the weight of.
MEMO_WORDS = 400_000

#: Groups of identity terms; a term is swapped for the others of its group.
IDENTITY = (
    ("women", "men", "girls", "boys", "transgender", "nonbinary"),
    ("woman", "man", "girl", "boy"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "catholic", "sikh"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists", "catholics"),
    ("gay", "straight", "lesbian", "bisexual", "queer", "heterosexual"),
    ("black", "white", "asian", "latino", "african", "european", "arab", "hispanic", "indigenous"),
    ("immigrants", "refugees", "foreigners", "citizens", "natives"),
    ("mexican", "chinese", "indian", "german", "french", "spanish", "american", "turkish", "polish", "russian"),
    ("disabled", "blind", "deaf", "autistic", "elderly", "young", "old"),
    ("frauen", "männer", "mädchen", "jungen"),
    ("muslime", "christen", "juden", "hindus", "atheisten"),
    ("ausländer", "flüchtlinge", "deutsche", "türken"),
    ("femmes", "hommes", "filles", "garçons"),
    ("musulmans", "chrétiens", "juifs", "athées"),
    ("immigrés", "réfugiés", "étrangers", "français"),
    ("mujeres", "hombres", "chicas", "chicos"),
    ("musulmanes", "cristianos", "judíos", "ateos"),
    ("inmigrantes", "refugiados", "extranjeros", "españoles"),
)
_GROUP = {term: group for group in IDENTITY for term in group}
_EDGES = "".join(chr(c) for c in range(33, 128) if not chr(c).isalnum()) + "«»„“”‘’¡¿…–—"


_STOP = re.compile(r"[.!?\n]+")


def words_of(text: str | None) -> set[str]:
    """The distinct words of a text in lower case, without marks at their ends."""
    return {w.strip(_EDGES) for w in (text or "").lower().split()} - {""}


def features(word: str) -> list[int]:
    """Hashed features of a word: itself and its beginnings."""
    mask = (1 << BITS) - 1
    return [zlib.crc32(f"w{word}".encode("utf-8", "replace")) & mask, *[zlib.crc32(f"{n}{word[:n]}".encode("utf-8", "replace")) & mask for n in PREFIXES if len(word) >= n]]


@dataclass
class Model:
    weights: np.ndarray = field(default_factory=lambda: np.zeros(1 << BITS, np.float32))
    bias: float = -20.0
    memo: dict[str, tuple[int, ...]] = field(default_factory=dict)

    def __getstate__(self):
        return {"weights": self.weights, "bias": self.bias, "memo": {}}

    def _told(self, word: str) -> tuple[int, ...]:
        """Features of the word that have a weight."""
        found = self.memo[word] = tuple(i for i in features(word) if self.weights[i])
        return found

    def score(self, text: str | None) -> float:
        """Probability that the text is toxic; each feature counts once."""
        memo = self.memo
        if len(memo) > MEMO_WORDS:
            memo.clear()
        found: set[int] = set()
        for w in words_of(text):
            own = memo.get(w)
            if own is None:
                own = self._told(w)
            if own:
                found.update(own)
        z = self.bias + float(self.weights[sorted(found)].sum(dtype=np.float64))
        return float(1 / (1 + np.exp(-min(max(z, -40.0), 40.0))))


def _sentences(text: str | None) -> list[list[str]]:
    """Words of each sentence that has any."""
    found = ([w for w in (x.strip(_EDGES) for x in part.lower().split()) if w] for part in _STOP.split(text or ""))
    return [words for words in found if words]


def _counterfactuals(text: str | None, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature changes that must not move the score, as (number of the change, feature, +1 added or -1 removed).

    In every sentence each identity term is swapped for another of its group; and, as most texts have none, a mention is put in
    one sentence, and swapped after being put in. A change has the features by which the score of the changed text differs:
    one that another word of the text also has neither comes nor goes.
    """
    sentences = _sentences(text)
    words = Counter(w for s in sentences for w in s)
    holders = Counter(f for w in words for f in set(features(w)))

    def apart(old: dict[str, int], new: str) -> dict[int, int]:
        """Changes of features where `old` words go as often as it says and `new` comes."""
        gone = [w for w, n in old.items() if words[w] <= n and w != new]
        come = [new] if new and new not in words else []
        held = Counter(f for w in gone for f in set(features(w)))
        added = {f for w in come for f in features(w)}
        out = {f: -1 for f, n in held.items() if holders[f] == n and f not in added}
        return out | {f: 1 for f in added if not holders[f]}

    changes = []
    for sentence in sentences:
        for term in sorted(set(sentence) & _GROUP.keys()):
            other = str(rng.choice([t for t in _GROUP[term] if t != term]))
            changes.append(apart({term: sentence.count(term)}, other))
    group = IDENTITY[rng.integers(len(IDENTITY))]
    a, b = (group[i] for i in rng.choice(len(group), 2, replace=False))
    put_a, put_b = apart({}, a), apart({}, b)
    changes += [put_a, {f: put_a.get(f, 0) - put_b.get(f, 0) for f in put_a.keys() | put_b.keys()}]
    flat = [(n, f, sign) for n, change in enumerate(changes) for f, sign in sorted(change.items()) if sign]
    number, feature, sign = (np.array(x, np.int32) for x in zip(*flat, strict=True)) if flat else (np.zeros(0, np.int32),) * 3
    return number, feature, sign


def fit_rows(rows: list[tuple[int, np.ndarray, tuple]], prior: float, penalty: float = 2.0, l1: float = 1e-5, epochs: int = 40, rate: float = 0.3, seed: int = 11) -> Model:
    """Logistic regression on (label, distinct feature ids, counterfactual changes or ()) by AdaGrad with soft thresholding.

    The loss is the log loss plus `penalty` times the mean squared change of the logit over the rows' counterfactuals.
    Features that are rare or tell the classes apart no better than chance keep weight 0. The bias is shifted from the
    sample's class shares to `prior`, the share of label 1 among all labelled rows.
    """
    y = np.array([r[0] for r in rows], np.float64)
    if not len(y) or not 0 < y.mean() < 1:
        return Model(bias=float(np.log((prior or 1e-9) / (1 - prior or 1e-9))))
    size = 1 << BITS
    owner = np.repeat(np.arange(len(rows)), [len(r[1]) for r in rows])
    ids = np.concatenate([r[1] for r in rows]).astype(np.int32)
    held = np.bincount(ids, minlength=size).astype(float)
    with_toxic = np.bincount(ids, y[owner], size)
    share = (with_toxic / y.sum(), (held - with_toxic) / (len(y) - y.sum()))
    spread = np.sqrt(held / len(y) * (1 - held / len(y)) * (1 / y.sum() + 1 / (len(y) - y.sum()))) + 1e-12
    used = np.flatnonzero((held >= 4) & (np.abs(share[0] - share[1]) > 3 * spread))
    place = np.full(size, -1)
    place[used] = np.arange(len(used))
    keep = place[ids] >= 0
    ids, starts = place[ids[keep]], np.searchsorted(owner[keep], np.arange(len(rows) + 1))
    changes = []
    for number, feature, sign in (r[2] or (np.zeros(0, np.int32),) * 3 for r in rows):
        known = place[feature] >= 0
        changes.append((number[known], place[feature[known]], sign[known]))
    w, b, g2, gb2 = np.zeros(len(used)), 0.0, np.full(len(used), 1e-6), 1e-6
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for pick in np.array_split(rng.permutation(len(rows)), max(1, len(rows) // 64)):
            own = np.concatenate([np.arange(starts[i], starts[i + 1]) for i in pick])
            row = np.repeat(np.arange(len(pick)), starts[pick + 1] - starts[pick])
            z = b + np.bincount(row, w[ids[own]], len(pick))
            error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[pick]) / len(pick)
            grad = np.bincount(ids[own], error[row], len(used))
            for number, feature, signs in (changes[i] for i in pick):
                if len(feature):
                    moved = np.bincount(number, w[feature] * signs)
                    np.add.at(grad, feature, 2 * penalty / len(pick) * moved[number] * signs)
            g2 += grad * grad
            step = rate / np.sqrt(g2)
            w -= step * grad
            w = np.sign(w) * np.maximum(np.abs(w) - step * l1, 0)
            gb2 += error.sum() ** 2
            b -= rate / np.sqrt(gb2) * error.sum()
    full = np.zeros(size, np.float32)
    full[used] = w
    logit = lambda p: np.log(p / (1 - p))
    shift = logit(min(max(prior, 1e-6), 1 - 1e-6)) - logit(y.mean())
    return Model(full, float(b + shift))


def held_out(doc_id) -> F.Column:
    """Rows that the fit must not see: crc32 of doc_id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Model:
    """Fit on labelled rows that aren't held out: at most `max_rows` of each class, chosen by md5(doc_id).

    Features are made on the executors; a row of feature ids for each chosen id comes to the driver, however often the
    table repeats the id: of several rows the text that sorts first is taken. Of a text with more than MAX_FEATURES features
    (or changes of features) those with the smallest hashes (or from its first sentences) count, so the driver gets
    2 * max_rows * 4 * MAX_FEATURES numbers at the very most. A doc_id with several labels is toxic if one says so; null
    labels and ids are ignored. The class shares come from all labelled rows.
    """
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(~held_out(F.col("doc_id")))
    total, toxic = known.agg(F.count(F.lit(1)), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    order = F.md5(F.col("doc_id").cast("string"))
    sample = known.where("toxic = 1").orderBy(order, "doc_id").limit(max_rows).unionByName(known.where("toxic = 0").orderBy(order, "doc_id").limit(max_rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, text, toxic in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "toxic")), strict=True):
                words = words_of(text)
                ids = np.unique(np.array([i for w in words for i in features(w)], np.int32))
                made = [x[:MAX_FEATURES] for x in (ids, *_counterfactuals(text, np.random.default_rng(doc_id & 0xFFFFFFFF)))]
                yield pa.RecordBatch.from_arrays([pa.array([toxic], pa.int32()), *[pa.array([x.tobytes()], pa.binary()) for x in made]], names=["toxic", "ids", "number", "feature", "sign"])

    # the sample has 2 * max_rows ids at most
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(sample.select("doc_id", F.col("toxic").cast("int").alias("toxic"))), "doc_id")
    chosen = chosen.groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    made = chosen.mapInArrow(run, "toxic int, ids binary, number binary, feature binary, sign binary").toArrow()
    columns = [made[c].to_pylist() for c in ("toxic", "ids", "number", "feature", "sign")]
    rows = [(t, *(np.frombuffer(x, np.int32) for x in rest)) for t, *rest in sorted(zip(*columns, strict=True))]
    rows = [(t, ids, tuple(change)) for t, ids, *change in rows]
    return fit_rows(rows, toxic / total if total else 0.0)


def scores(model: Model, batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """The score of each text of a task's batches; then the words seen are forgotten and their memory handed back."""
    try:
        for texts in batches:
            found = pd.Series([model.score(t) for t in texts], dtype="float64")
            del texts
            yield found
    finally:
        model.memo.clear()
        give_back()


def score(docs: DataFrame, model: Model) -> DataFrame:
    """The columns of `docs` in `row`, with score (0 to 1) and predicted (1 from THRESHOLD on).

    The score depends on the text alone. Defined cases: null and empty texts get the score of a text without words;
    without labels of both classes every text gets the base rate; repeated rows get equal scores; other columns pass
    through. No shuffle; weights are 2**BITS numbers, whatever the input.
    """
    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from scores(model, batches)

    out = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")).withColumn("score", scored("row.text"))
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
