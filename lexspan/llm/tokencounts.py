"""Token counts by heap-and-linked-list byte-pair merging; no token ids are made."""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Chunks (and pieces) whose counts a worker remembers, and the length up to which it does; when full, it starts anew.
MEMO_CHUNKS, MEMO_CHARS = 400_000, 64
#: White space of Unicode, which is what \s means to the vocabulary's pre-tokenizer.
_WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: White space and the word after it; white space at the end. No piece begins before and ends after such a place.
_CHUNK = re.compile(f"[{_WHITE}]*[^{_WHITE}]+|[{_WHITE}]+")


def merges_of(path: str) -> tuple[dict[str, int], dict[tuple[int, int], tuple[int, int]]]:
    """Symbols of one byte, and (left symbol, right symbol) -> (rank, merged symbol), of a byte-level BPE file."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    model, cut = spec["model"], spec["pre_tokenizer"] or {}
    plain = model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
    if not plain or cut.get("type") != "ByteLevel" or cut.get("add_prefix_space") or not cut.get("use_regex", True) or spec["normalizer"] is not None:
        raise ValueError(f"{path} is no plain byte-level BPE vocabulary")
    if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
        raise ValueError("special tokens that take their surroundings with them")
    vocabulary, found = model["vocab"], {}
    for rank, pair in enumerate(model["merges"]):
        left, right = pair.split(" ") if isinstance(pair, str) else pair
        found.setdefault((vocabulary[left], vocabulary[right]), (rank, vocabulary[left + right]))
    return {s: i for s, i in vocabulary.items() if len(s) == 1}, found


class TokenCounter:
    """How many tokens the `tokenizers` library gives a text, special strings inside it handled as by its default.

    Texts are cut at special strings and then before each run of white space; the library's own pre-tokenizer cuts these
    chunks into pieces of byte symbols. A piece of n symbols begins as a linked list of n places and a heap of its
    adjacent pairs by (rank, place). The lowest is popped again and again: if both symbols are still there it is a
    merge, the right one leaves the list, and the two pairs that arise go on the heap. The piece has n minus merges
    tokens, after O(n log n) steps however long it is.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        self.cut = tokenizer.pre_tokenizer.pre_tokenize_str
        self.first, self.merges = merges_of(path)
        special = sorted((t.content for t in tokenizer.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.marks = special
        counter = self

        class Memo(dict):
            def __missing__(self, chunk: str) -> int:
                n = counter.chunk(chunk)
                if len(chunk) <= MEMO_CHARS:
                    if len(self) >= MEMO_CHUNKS:
                        self.clear()
                    self[chunk] = n
                return n

        self.memo, self.pieces = Memo(), {}

    def merged(self, piece: str) -> int:
        """Tokens of one piece, given in byte symbols."""
        n, merges = len(piece), self.merges
        symbols = [self.first[s] for s in piece]
        heap = [(m[0], i, m[1]) for i in range(n - 1) if (m := merges.get((symbols[i], symbols[i + 1]))) is not None]
        heapq.heapify(heap)
        after, before, count = list(range(1, n + 1)), list(range(-1, n - 1)), n
        while heap:
            _, i, new = heapq.heappop(heap)
            j = after[i]
            # stale: a symbol of the pair has been merged into another since
            if symbols[i] < 0 or j >= n or (m := merges.get((symbols[i], symbols[j]))) is None or m[1] != new:
                continue
            symbols[i], symbols[j], count = new, -1, count - 1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (m := merges.get((new, symbols[k]))) is not None:
                    heapq.heappush(heap, (m[0], i, m[1]))
            h = before[i]
            if h >= 0 and (m := merges.get((symbols[h], new))) is not None:
                heapq.heappush(heap, (m[0], h, m[1]))
        return count

    def piece(self, piece: str) -> int:
        n = self.pieces.get(piece)
        if n is None:
            n = self.merged(piece)
            if len(piece) <= MEMO_CHARS:
                if len(self.pieces) >= MEMO_CHUNKS:
                    self.pieces.clear()
                self.pieces[piece] = n
        return n

    def chunk(self, chunk: str) -> int:
        """Tokens of white space and the word after it."""
        word = chunk[1:] if chunk[0] == " " else chunk
        if word.isascii() and word.isalpha():  # one piece; a space's symbol is U+0120
            return self.merged(word if word is chunk else f"Ġ{word}")
        return sum(self.piece(p) for p, _ in self.cut(chunk))

    def count(self, text: str | None) -> int:
        """Tokens of a whole text; null counts as empty."""
        if not text:
            return 0
        if not any(s in text for s in self.marks):
            return sum(map(self.memo.__getitem__, _CHUNK.findall(text)))
        parts = self.special.split(text)
        return len(parts) - 1 + sum(sum(map(self.memo.__getitem__, _CHUNK.findall(p))) for p in parts)


_counters: dict[str, TokenCounter] = {}


def counter(path: str) -> TokenCounter:
    """This process's counter for a vocabulary file; workers keep it from task to task."""
    if path not in _counters:
        _counters[path] = TokenCounter(path)
    return _counters[path]


def count_tokens(docs: DataFrame, path: str, limit: int) -> DataFrame:
    """The columns of `docs` in `row`, with n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit) for every row.

    Defined cases: null and empty texts have no bytes and no tokens; texts are counted whole, whatever their length (a
    single piece needs memory in proportion to itself, as it does in the library); each of several rows of one doc_id
    has its own count; an empty table gives no rows; other columns, whatever their names, stay in `row`.

    Nothing is shuffled: each row is counted where it is read, so a lost executor costs its tasks and no more, and no
    key can be hot. Distinct chunks are merged once for a worker.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path).count
        for batch in batches:
            texts = batch.column("__text")
            # texts become Python strings one by one, so a batch of long ones isn't held twice
            n = pa.array((count(t.as_py()) for t in texts), pa.int64(), size=len(texts))
            size = pc.fill_null(pc.cast(pc.binary_length(texts), pa.int64()), 0)
            yield pa.RecordBatch.from_arrays([batch.column("row"), size, n, pc.greater(n, pa.scalar(limit, pa.int64()))], names=["row", "n_bytes", "n_tokens", "over_limit"])

    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("text").alias("__text"))
    schema = rows.select("row").withColumns({"n_bytes": F.lit(0).cast("long"), "n_tokens": F.lit(0).cast("long"), "over_limit": F.lit(False)}).schema
    return rows.mapInArrow(counted, schema)
