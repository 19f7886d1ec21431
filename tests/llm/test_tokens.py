import random
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest
import public_tokenizers
from tokenizers import Tokenizer

from lexspan.llm import rangecoder, tokens
from lexspan.llm.packing import pack
from lexspan.llm.queries import op2_token_files, op4_pack
from lexspan.llm.tokenfiles import read_tokens, segment, segments, with_starts, write_tokens
from lexspan.llm.tokens import Encoder

WORDS, BYTES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")


def plain(path):
    tokenizer = Tokenizer.from_file(path)
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


SPACES = [chr(c) for c in range(0x3001) if chr(c).isspace()]
MARKS = ["\u0301", "\u0307", "\u0308", "\u0323", "\u200d", "\u180e", "\u200b"]
CASED = ["İ", "ı", "ß", "Σ", "ς", "ǅ", "ŉ", "ǰ", "\u212a", "\u212b", "ﬁ", "Ǆ", "É", "é", "Ⱥ", "ɐ", "Я", "я", "中", "ª", "º", "²", "½", "Ⅷ", "٣", "ʼ"]
OTHERS = ["a", "the", "don't", "I'LL", "'s", " '", "\n", "\n\n", ".", ",", ". ", ", ", ".\n", ",\n", "%%", "<|endoftext|>", "<|ENDOFTEXT|>", "<|startoftext|>", "<|", "\0", "\x01", "12", "3", "x1", "Word", "étE", "wörld,", "end."]
USUAL = ["Some", "words", "été", "NÃO", ",", " ", ",", ". ", "\n", ".\n", "x", "İ", "%%%", " 5", "é's"]


@pytest.mark.parametrize("path", [WORDS, BYTES])
def test_encoding_equals_the_library(path):
    """Chunked or not: strings over all white space, marks and letters with odd case, and special tokens' strings."""
    rng, pieces = random.Random(3), [*OTHERS, *SPACES, *MARKS, *CASED]
    texts = ["", " ", "end.\n\xa0\xa0Next", "İ, a", "a <|endoftext|> b", " word"]
    for k in range(100_000):
        pool = (pieces, rng.sample(pieces, 6) + ["word", " ", " ", "a"], USUAL)[k % 3]
        texts.append("".join(rng.choice(pool) + (rng.choice(["", " "]) if k % 2 else "") for _ in range(rng.randrange(1, 14))))
    coder, library = Encoder(path), Tokenizer.from_file(path)
    for at in range(0, len(texts), 5000):
        part = texts[at : at + 5000]
        for text, got, want in zip(part, coder.encode(pa.array(part)).to_pylist(), library.encode_batch(part, add_special_tokens=False), strict=True):
            assert np.frombuffer(got, "<u2").tolist() == want.ids, repr(text)
    assert coder.encode(pa.array([None, "", None], pa.string())).to_pylist() == [b"", b"", b""] and len(coder.encode(pa.array([], pa.string()))) == 0


def test_memory_of_chunks_starts_anew(monkeypatch):
    monkeypatch.setattr(tokens, "MEMO_CHUNKS", 20)
    texts = [" ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(n)) for n in range(1, 40)]
    coder, whole = Encoder(BYTES), plain(BYTES)
    for text in texts * 2:
        assert np.frombuffer(coder.encode(pa.array([text]))[0].as_py(), "<u2").tolist() == whole(text)
    assert len(coder.memo) <= 60


@pytest.mark.parametrize("seed", range(3))
def test_range_coder_round_trip(seed):
    rng = np.random.default_rng(seed)
    blocks = [rng.integers(0, 65536, n).astype(np.uint16) for n in (0, 1, 2, 700)] + [(rng.zipf(1.3, 5000) % 900).astype(np.uint16), np.zeros(4000, np.uint16), np.tile(np.arange(50, dtype=np.uint16), 100), np.arange(rangecoder.BLOCK_TOKENS, dtype=np.uint16) * 7]
    coded = rangecoder.encode_blocks(blocks)
    assert all((a == b).all() for a, b in zip(blocks, rangecoder.decode_blocks(coded), strict=True))
    for one, block in zip(coded, blocks, strict=True):  # each block alone
        assert (rangecoder.decode_blocks([one])[0] == block).all()
    assert len(coded[5]) < 900 and len(coded[6]) < 4500


def test_coder_format_stays():
    """Blocks as the coder has written them since its predictions learn every 64 ids, all ids distinct included."""
    rng = np.random.default_rng(5)
    blocks = [(rng.zipf(1.3, n) % 900).astype(np.uint16) for n in (8192, 700, 1)] + [np.arange(rangecoder.BLOCK_TOKENS, dtype=np.uint16) * 7]
    assert [(len(b), zlib.crc32(b)) for b in rangecoder.encode_blocks(blocks)] == [(6942, 30211391), (698, 1085015108), (34, 522308251), (13449, 2367085068)]


def test_coder_work_and_tables(monkeypatch):
    """A stretch's predictions are looked up once to encode it, and a block of 1,000 ids takes 50 kB of tables at most."""
    looked, models, look, model = [], [], rangecoder._Model.look, rangecoder._Model.__init__
    monkeypatch.setattr(rangecoder._Model, "look", lambda self, a, b, n: looked.append((a, b)) or look(self, a, b, n))
    monkeypatch.setattr(rangecoder._Model, "__init__", lambda self, *args: models.append(self) or model(self, *args))
    blocks = [np.arange(rangecoder.BLOCK_TOKENS, dtype=np.uint16) % 1000] * 20
    coded = rangecoder.encode_blocks(blocks)
    assert looked == [(a, b) for a, b, _ in rangecoder._stretches(rangecoder.BLOCK_TOKENS)]
    rangecoder.decode_blocks(coded)
    assert [sum(x.nbytes for x in vars(m).values() if isinstance(x, np.ndarray)) // 20 < 50_000 + 2 * rangecoder._WHOLE * m.decode for m in models] == [True, True]


def test_letters_and_marks_go_to_the_model(monkeypatch):
    """Latin words with marks need no whole run of the library; the ids are the library's."""
    coder, whole = Encoder(WORDS), plain(WORDS)
    texts = ["été; NÃO! naïve) word: École... ŒUVRE?", "l'été d'Éve; don't"]
    runs, of = [], coder._whole
    monkeypatch.setattr(coder, "_whole", lambda text: runs.append(text) or of(text))
    assert [np.frombuffer(x, "<u2").tolist() for x in coder.encode(pa.array(texts)).to_pylist()] == [whole(t) for t in texts]
    assert all("'" in r or not r[0].isalpha() for r in runs)


def test_damage_is_found():
    ids = (np.random.default_rng(0).zipf(1.3, 3000) % 900).astype(np.uint16)
    data = bytearray(segment([5], [3000], ids))
    data[-20] ^= 8
    with pytest.raises(ValueError):
        list(segments(bytes(data)))


def test_files_hold_all_documents_in_order(spark, docs, odd_rows, tmp_path):
    write_tokens(docs(odd_rows), f"file://{tmp_path}/t", WORDS, 2, partitions=3)
    back = with_starts(read_tokens(spark, f"file://{tmp_path}/t", with_ids=True)).orderBy("start").collect()
    ids = [r.doc_id for r in back]
    assert ids == sorted((r[0] for r in odd_rows if r[0] is not None)) + [None, None]
    whole, start = plain(WORDS), 0
    texts = sorted((r[0] is None, r[0] or 0, tuple(whole(r[1]))) for r in odd_rows)
    assert texts == sorted((r.doc_id is None, r.doc_id or 0, tuple(r.ids[:-1])) for r in back)
    for r in back:
        assert r.ids[-1] == 2 and r.start == start and r.n_tokens == len(r.ids) and r.ids_crc32 == crc(r.ids)
        start += r.n_tokens


def test_op2_against_plain_encoding(spark, sf_dir):
    rows = sorted(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect())
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in op2_token_files(spark, sf_dir).collect()}
    whole, start = plain(WORDS), 0
    for doc_id, text in rows:
        ids = [*whole(text), 2]
        assert got.pop(doc_id) == (start, len(ids), crc(ids))
        start += len(ids)
    assert not got


def verify_pieces(pieces, documents, window):
    """Each id lies in one piece; sequences have no gaps and need no padding."""
    by_doc, by_seq = {}, {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
        by_seq.setdefault(p.sequence_id, []).append(p)
    for doc_id, ids in documents.items():
        at = 0
        for p in sorted(by_doc.pop(doc_id), key=lambda p: p.start):
            assert p.start == at and p.length > 0 and p.doc_tokens == len(ids) and p.ids_crc32 == crc(ids[at : at + p.length])
            at += p.length
        assert at == len(ids)
    assert not by_doc
    for own in by_seq.values():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= window and at & (at - 1) == 0
    return by_seq


def test_op4_against_plain_encoding(spark, sf_dir):
    whole = plain(BYTES)
    documents = {r.doc_id: [*whole(r.text), 0] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    verify_pieces(op4_pack(spark, sf_dir).collect(), documents, 1024)


def test_packing_odd_rows_and_proportions(docs, odd_rows):
    whole = plain(BYTES)
    rows = [(i, t) for i, (_, t) in enumerate(odd_rows)] + [(100 + i, "word " * 500, "abc"[i % 3]) for i in range(60)] + [(200, "alone", None)]
    packed = pack(docs(rows), BYTES, 0, window=256, turn=16, part_tokens=20_000)
    pieces = packed.collect()
    by_seq = verify_pieces(pieces, {r[0]: [*whole(r[1]), 0] for r in rows}, 256)
    total, of = sum(p.length for p in pieces), {}
    for p in pieces:
        of[p.source] = of.get(p.source, 0) + p.length
    assert {"a", "b", "c", "s", None} == set(of)
    for own in by_seq.values():
        if sum(p.length for p in own) == 256:
            got = sum(p.length for p in own if p.source == "a")
            assert abs(got - 256 * of["a"] / total) <= 48
    assert pack(docs([]), BYTES, 0).count() == 0


def test_packing_to_targets(docs):
    """While both sources last, every window holds them 3 to 1, whatever the corpus's proportions; nothing is lost."""
    rows = [(i, "word " * 300, "ab"[i % 2]) for i in range(80)]
    pieces = pack(docs(rows), BYTES, 0, window=256, turn=16, targets={"a": 3, "b": 1}).collect()
    assert sum(p.length for p in pieces) == sum(p.doc_tokens for p in pieces if p.start == 0)
    of = {}
    for p in pieces:
        of.setdefault(p.sequence_id, {"a": 0, "b": 0})[p.source] += p.length
    full = [of[k] for k in sorted(of) if sum(of[k].values()) == 256]
    both = full[: int(0.6 * len(full))]  # source a lasts for two thirds of all ids
    assert all(abs(x["a"] - 192) <= 32 for x in both) and sum(x["a"] for x in both) / (256 * len(both)) == pytest.approx(0.75, abs=0.01)


def test_repeated_rows_are_packed_each(docs):
    pieces = pack(docs([(1, "same text"), (1, "same text"), (None, None)]), BYTES, 0).collect()
    assert sum(p.length for p in pieces) == sum(p.doc_tokens for p in pieces if p.start == 0)
    assert sorted(p.doc_id or -1 for p in pieces if p.start == 0) == [-1, 1, 1]


def test_segment_layout():
    data = segment([1, None], [2, 1], np.array([5, 6, 7], np.uint16))
    assert data[:8] == b"LXTOK1\n\0" and struct.unpack_from("<II", data, 8) == (2, 1)
    (doc_ids, sizes, ids), (again, _, _) = segments(data + b"\n" + data)
    assert doc_ids == again == [1, None] and sizes.tolist() == [2, 1] and ids.tolist() == [5, 6, 7]
