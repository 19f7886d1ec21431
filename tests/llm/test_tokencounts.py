import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lexspan.llm import tokencounts
from lexspan.llm.queries import op13_token_counts
from lexspan.llm.tokencounts import TokenCounter, count_tokens

BYTES = public_tokenizers.path("byte_bpe_50k.json")
SPACES = [chr(c) for c in range(0x3001) if chr(c).isspace()]
ODD = ["́", "‍", "​", "İ", "ß", "é", "Я", "中文字", "²", "٣", "ʼ", "\0", "\x01", "\x1c", "😀", "𝒳", "\U0001e900", "\U0002ebf0"]
USUAL = ["a", "the", "don't", "I'LL", "'s", " '", "\n", "\n\n", ".", ", ", "%%", "12", "x1", "Word", "antidisestablishment", "aaaa", "zzzzzzz"]
SPECIAL = ["<|endoftext|>", "<|ENDOFTEXT|>", "<|", "|>", " <|endoftext|> "]


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(BYTES)
    return lambda texts: [len(e.ids) for e in tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def naive(counter, piece):
    """Merge the leftmost pair of lowest rank until none is left, looking at every pair each time."""
    symbols = [counter.first[s] for s in piece]
    while found := [(m[0], i, m[1]) for i in range(len(symbols) - 1) if (m := counter.merges.get((symbols[i], symbols[i + 1])))]:
        _, i, new = min(found)
        symbols[i : i + 2] = [new]
    return len(symbols)


def test_heap_equals_repeated_search():
    counter, rng = TokenCounter(BYTES), random.Random(1)
    letters = list(counter.first)
    for k in range(3000):
        piece = "".join(rng.choice(("aeinrst", "ab", letters)[k % 3]) for _ in range(rng.randrange(1, 30)))
        assert counter.merged(piece) == naive(counter, piece), piece


def test_counts_equal_the_library(library):
    rng, counter = random.Random(2), TokenCounter(BYTES)
    pools = [USUAL, USUAL + [" "] * 8, USUAL + SPACES, USUAL + ODD + SPACES, USUAL + SPECIAL + [" "] * 3, ODD + SPACES + SPECIAL]
    texts = ["", " ", "\n", "  ", " \n x", "x \n", "a <|endoftext|> b", "<|endoftext|><|endoftext|>"]
    texts += ["".join(rng.choice(pools[k % len(pools)]) for _ in range(rng.randrange(1, 16))) for k in range(60_000)]
    for text, want in zip(texts, library(texts), strict=True):
        assert counter.count(text) == want, repr(text)


def test_every_character(library):
    """Classes of letters, digits and others are the library's own, also for characters of the latest Unicode."""
    counter, chars = TokenCounter(BYTES), [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(f"a{chr(c)}b1{chr(c)}. {chr(c)}" for c in chars[i : i + 512]) for i in range(0, len(chars), 512)]
    assert list(map(counter.count, texts)) == library(texts)


def test_long_pieces_take_no_quadratic_time(library):
    counter = TokenCounter(BYTES)
    texts = ["ab" * 300_000, "é" * 200_000, " " * 200_000, "\n \t" * 100_000]
    assert list(map(counter.count, texts)) == library(texts)


def test_memory_of_chunks_starts_anew(library, monkeypatch):
    monkeypatch.setattr(tokencounts, "MEMO_CHUNKS", 20)
    counter = TokenCounter(BYTES)
    texts = [" ".join(f"word{chr(97 + i % 26)}'{i}" for i in range(n)) for n in range(1, 40)]
    assert list(map(counter.count, texts)) == library(texts)
    assert len(counter.memo) <= 20 and len(counter.pieces) <= 20


def test_rows_keep_their_columns(spark, docs, odd_rows, library):
    given = docs(odd_rows)
    got = count_tokens(given, BYTES, 512)
    assert got.columns == ["row", "n_bytes", "n_tokens", "over_limit"] and got.select("row.*").columns == given.columns
    rows = got.collect()
    assert len(rows) == len(odd_rows)
    for r in rows:
        text = r.row.text or ""
        assert (r.n_bytes, r.n_tokens) == (len(text.encode()), library([text])[0]) and r.over_limit == (r.n_tokens > 512)
    assert count_tokens(given.where("doc_id = -1"), BYTES, 512).collect() == []


def test_limit_is_a_parameter(docs):
    text = " the" * 8
    assert [count_tokens(docs([(1, text)]), BYTES, n).first().over_limit for n in (7, 8, 9)] == [True, False, False]


def test_other_kinds_of_vocabulary_are_refused():
    with pytest.raises(ValueError):
        TokenCounter(public_tokenizers.path("word_bpe_49k.json"))


def test_query_equals_the_library(spark, sf_dir, library):
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in op13_token_counts(spark, sf_dir).collect()}
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    n = dict(zip(texts, library(texts.values()), strict=True))
    assert got == {d: (len((t or "").encode()), n[d], n[d] > 512) for d, t in texts.items()}
