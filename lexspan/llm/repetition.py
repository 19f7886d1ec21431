"""Quality rules on repetition: how much of a text lies inside duplicated n-grams and lines."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .batches import slices, text_bytes

#: Most characters of words, as a share, that duplicated n-grams of each length may cover, and duplicated lines. Texts that
#: repeat a paragraph once stay below; texts made of repeats are far above.
NGRAM_LIMITS = {5: 0.25, 7: 0.22, 10: 0.20}
LINE_LIMIT = 0.30
#: The base rule's window, its fewest words and its most repeated words in a hundred.
WINDOW, MIN_WORDS, MAX_REPEATED = 8, 20, 30
SYMBOLS = b"#*$%&|<>"
#: Texts of about so many bytes are hashed and sorted together.
RUN_BYTES = 4 << 20

_WHITE = np.zeros(256, bool)
_WHITE[[32, *range(9, 14)]] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True
_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(1, 2**63, 256, np.uint64) | np.uint64(1)
_STEP, _ROLL = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)

FIELDS = [("doc_id", pa.int64()), ("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()), *[(f"dup_{n}gram_share", pa.float64()) for n in NGRAM_LIMITS], ("dup_line_share", pa.float64()), ("base_failed", pa.bool_()), ("kept", pa.bool_())]
SCHEMA = ", ".join(f"{k} {dict(int64='long', double='double', bool='boolean')[str(t)]}" for k, t in FIELDS)


def _mixed(x: np.ndarray) -> np.ndarray:
    """Avalanche of 64-bit values."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _inverse(x: int) -> np.uint64:
    return np.uint64(pow(x, -1, 2**64))


def duplicated(word: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Which words lie in an n-gram that its text has twice or more, the first one included.

    One rolling hash: prefix sums of word hashes times powers of an odd base, brought back to the window's start by
    the inverse base (both modulo 2**64); a text's number is part of its keys.
    """
    m = len(word) - n + 1
    inside = np.zeros(len(word), bool)
    if m <= 0:
        return inside
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(word * _powers(_ROLL, len(word)), dtype=np.uint64)])
        key = (sums[n:] - sums[:-n]) * _powers(_inverse(int(_ROLL)), m)
        key = _mixed(key + _mixed(doc[:m].astype(np.uint64) * _STEP + np.uint64(n)))
    whole = doc[:m] == doc[n - 1 :]
    key, at = key[whole], np.flatnonzero(whole)
    order = np.sort(key)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return inside
    twice = np.unique(twice)
    place = np.minimum(np.searchsorted(twice, key), len(twice) - 1)
    starts = at[twice[place] == key]
    edge = np.zeros(len(word) + 1, np.int32)
    edge[starts] += 1  # each start once
    np.add.at(edge, starts + n, -1)
    return np.cumsum(edge[:-1]) > 0


def _line_counts(text: bytes) -> tuple[int, int]:
    """Lines with a word that equal an earlier line, and their characters outside white space."""
    seen, n, chars = set(), 0, 0
    for line in text.split(b"\n"):
        if line in seen:
            n += 1
            chars += len(b"".join(line.split()).decode("utf-8", "replace"))
        elif line and not line.isspace():
            seen.add(line)
    return n, chars


def measure(ids: list, texts: pa.Array) -> dict[str, np.ndarray]:
    """The columns of FIELDS for some texts, all words of all of them at once."""
    raw, bounds = text_bytes(texts)
    k = len(ids)
    white = _WHITE[raw]
    blank = np.concatenate([[True], white, [True]])
    # a text's end also ends its word
    cut = np.zeros(len(raw) + 1, bool)
    cut[bounds] = True
    first = ~white & (blank[:-2] | cut[:-1])
    last = ~white & (blank[2:] | cut[1:])
    start, stop = np.flatnonzero(first), np.flatnonzero(last) + 1
    doc = np.searchsorted(bounds, start, "right") - 1
    chars = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    length = chars[stop] - chars[start]
    if len(start):
        with np.errstate(over="ignore"):
            place = np.arange(len(raw)) - np.repeat(start, np.diff(np.append(start, len(raw)))) if start[0] == 0 else np.arange(len(raw)) - np.concatenate([np.zeros(start[0], np.int64), np.repeat(start, np.diff(np.append(start, len(raw))))])
            powers = _powers(_STEP | np.uint64(1), int((stop - start).max()) + 1)
            value = np.where(white, np.uint64(0), _BYTE[raw] * powers[np.minimum(place, len(powers) - 1)])
            word = _mixed(np.add.reduceat(value, start) + (stop - start).astype(np.uint64))
    else:
        word = np.zeros(0, np.uint64)
    per = lambda weights: np.bincount(doc, weights, k).astype(np.int64) if len(doc) else np.zeros(k, np.int64)
    n_words, word_chars = per(None), per(length)
    symbols = np.concatenate([[0], np.cumsum(_SYMBOL[raw])])
    out = {"doc_id": ids, "n_words": n_words, "word_chars": word_chars, "n_symbols": symbols[bounds[1:]] - symbols[bounds[:-1]]}
    joined = raw.tobytes()
    lines = np.array([_line_counts(joined[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)], np.int64).reshape(k, 2)
    out["n_dup_lines"] = lines[:, 0]
    out["n_repeat_words"] = per(duplicated(word, doc, WINDOW))
    whole = np.maximum(word_chars, 1)
    bad = lines[:, 1] > LINE_LIMIT * whole
    for n, limit in NGRAM_LIMITS.items():
        out[f"dup_{n}gram_share"] = share = per(np.where(duplicated(word, doc, n), length, 0)) / whole
        bad |= share > limit
    out["dup_line_share"] = lines[:, 1] / whole
    out["base_failed"] = (n_words < MIN_WORDS) | (100 * out["n_repeat_words"] > MAX_REPEATED * n_words)
    out["kept"] = ~(out["base_failed"] | bad)
    return out


def repetition_rules(docs: DataFrame) -> DataFrame:
    """Repetition measures and the verdict `kept` for each document.

    Words are runs outside the six white-space characters. For each n of NGRAM_LIMITS the share of word characters
    inside n-grams found twice or more in the text (the first one included) must not exceed the limit, nor may lines
    that equal an earlier line hold more than LINE_LIMIT of them. `base_failed` is the plain rule: under MIN_WORDS
    words, or over MAX_REPEATED in a hundred words in repeated windows of WINDOW words.

    Defined cases: a null or empty text has zeros, fails the base and isn't kept; a null doc_id stays null; repeated
    rows are measured each; other columns are not read. No shuffle: each input partition is measured on its own, in
    runs of about RUN_BYTES of text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", RUN_BYTES):
                found = measure(part.column("doc_id"), part.column("text"))
                yield pa.RecordBatch.from_arrays([found[k] if isinstance(found[k], pa.Array) else pa.array(found[k], t) for k, t in FIELDS], names=[k for k, _ in FIELDS])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, SCHEMA)
