"""Texts to token ids by the `tokenizers` library, each distinct chunk of a text encoded once."""

from __future__ import annotations

import codecs
import os
import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Chunks whose ids a worker remembers; then it starts anew.
MEMO_CHUNKS = 800_000
#: Marks a chunk that no space goes before. A text that has it is encoded as a whole.
_FIRST = "\x01"
_BLANKS = re.compile(r"\A | \Z| \s|\s ")
_BETWEEN = re.compile(r"(?<=\S) (?=\S)")
#: Latin letters that normalisation and lower case keep single letters: all but U+0130, whose lower case has a mark.
_LATIN = r"A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{12f}\x{131}-\x{24f}"
_NEAR = re.compile("[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-įı-ɏ]+")
#: White space other than space and line feed in Unicode or in Python.
_OTHER_WHITE = r"\t\x0b\x0c\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
#: What a text must not have to be cut at every space, line feed and final mark (RE2): other white space, two in a row or at an
#: end; a comma or full stop before white space that doesn't come after a Latin letter or a digit, as it may belong to a longer piece.
_ODD = rf"[ \n][ \n]|\A[ \n]|[ \n]\z|[\x01{_OTHER_WHITE}]|(?:\A|[^0-9{_LATIN}])[,.][ \n]"
#: Letters, then marks other than apostrophes: two pieces for both vocabularies.
_MARKS = r"([!-&(-/:-@\[-`{-~]+)"
_ENDED = re.compile(rf"([A-Za-z]+){_MARKS}")
_NEAR_ENDED = re.compile(f"({_NEAR.pattern}){_MARKS}")
#: Byte-level symbols: printable bytes stand for themselves, the others, in order, for the characters from U+0100 on.
_PRINTED = {*range(33, 127), *range(161, 173), *range(174, 256)}
_HIDDEN = [b for b in range(256) if b not in _PRINTED]
_SYMBOLS = "".join(chr(b) if b in _PRINTED else chr(256 + _HIDDEN.index(b)) for b in range(256))


class Encoder:
    """Ids of whole texts as 16-bit little-endian bytes, equal to the library's encode(text, add_special_tokens=False).

    A single space between two characters that aren't white space always starts a new piece for the pre-tokenizers
    of both vocabularies (byte-level: the space opens the next piece; word-level: it is dropped), no normalisation
    reaches across it, and no special token's string has one, so the chunks between such spaces can be encoded apart.
    Plain texts (see _ODD) are also cut at line feeds and before a comma or full stop that ends a word: these are
    pieces of their own there. Most chunks are words seen before. As the library does by default, the strings of
    special tokens in a text become those tokens; texts with one aren't plain.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        if self.tokenizer.get_vocab_size() > 65_536:
            raise ValueError("ids must fit 16 bits")
        self.tokenize = self.tokenizer.model.tokenize
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        if any(c.isspace() for t in special for c in t):
            raise ValueError("a special token with white space")
        self.odd = "|".join([_ODD, *map(re.escape, special)])
        # does the space belong to the piece after it?
        self.glue = self._whole(" a") != self._whole("a")
        self.make = self._glued if self.glue else self._apart
        self.memo: dict[str, bytes] = {}
        self.two_bytes = [i.to_bytes(2, "little") for i in range(self.tokenizer.get_vocab_size())]

    def _whole(self, text: str) -> bytes:
        return array("H", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _model(self, symbols: str) -> bytes:
        two_bytes = self.two_bytes
        return b"".join([two_bytes[t.id] for t in self.tokenize(symbols)])

    def _glued(self, chunk: str) -> bytes:
        """Ids of a chunk and the space before it. A run of Latin letters is one piece and goes straight to the tokenizer's model,
        in the symbols that byte-level pre-tokenisation gives bytes."""
        if chunk.isalpha() and chunk.isascii():
            return self._model(f"Ġ{chunk}")
        word = chunk[1:] if chunk[:1] == _FIRST else f" {chunk}"
        letters = word.removeprefix(" ")
        if letters.isascii():
            if letters.isalpha():
                return self._model(letters if letters == word else f"Ġ{letters}")
            if ended := _ENDED.fullmatch(letters):
                return self._ids(chunk[: len(chunk) - len(ended[2])]) + self._ids(_FIRST + ended[2])
        elif _NEAR.fullmatch(letters):
            return self._model(codecs.charmap_decode(word.encode(), "strict", _SYMBOLS)[0])
        return self._whole(word)

    def _apart(self, chunk: str) -> bytes:
        """Ids of a chunk where white space is dropped and letters are lowered."""
        ascii = chunk.isascii()
        if chunk.isalpha() if ascii else _NEAR.fullmatch(chunk):
            low = chunk.lower()
            if low != chunk:
                return self._ids(low)
            return self._model(chunk if ascii else codecs.charmap_decode(chunk.encode(), "strict", _SYMBOLS)[0])
        if ended := _NEAR_ENDED.fullmatch(chunk):
            return self._ids(ended[1]) + self._ids(ended[2])
        return self._whole(chunk)

    def _ids(self, chunk: str) -> bytes:
        found = self.memo.get(chunk)
        if found is None:
            found = self.memo[chunk] = self.make(chunk)
        return found

    def _known(self, chunks: list[str]) -> list[bytes]:
        """Ids of distinct chunks; those that are new are remembered."""
        found = list(map(self.memo.get, chunks))
        new = [i for i, x in enumerate(found) if x is None]
        if len(self.memo) + len(new) > MEMO_CHUNKS:
            self.memo.clear()
        make, memo = self.make, self.memo
        for i in new:
            chunk = chunks[i]
            found[i] = memo[chunk] = make(chunk)
        return found

    def forget(self) -> None:
        self.memo.clear()

    def _plain(self, texts: pa.Array) -> pa.Array:
        """Ids of plain texts. Arrow cuts them and finds the distinct chunks, so Python sees each of these once a batch. In the
        glued form _FIRST tells chunks without a space of their own."""
        first = _FIRST if self.glue else ""
        texts = pc.replace_substring(texts, "\n", f" {first}\n {first}" if first else " ")
        for mark in ",.":
            texts = pc.replace_substring(texts, f"{mark} ", f" {first}{mark} ")
        if first:
            texts = pc.binary_join_element_wise(first, texts, "")
        lists = pc.split_pattern(texts, " ")
        chunks = lists.flatten().dictionary_encode()
        found = pa.array(self._known(chunks.dictionary.to_numpy(zero_copy_only=False).tolist()), pa.binary()).take(chunks.indices)
        ends = np.frombuffer(found.buffers()[1], np.int32)[: len(found) + 1][lists.offsets.to_numpy() - lists.offsets[0].as_py()]
        return pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(ends.tobytes()), found.buffers()[2]])

    def _other(self, text: str) -> bytes:
        if _FIRST in text:
            return self._whole(text)
        chunks = _BETWEEN.split(text) if _BLANKS.search(text) else text.split(" ")
        if self.glue:
            chunks[0] = _FIRST + chunks[0]
        return b"".join(self._known(chunks))

    def encode(self, texts: pa.Array) -> pa.Array:
        """Ids of each text of a string column (binary); null counts as empty."""
        texts = texts.fill_null("")
        other = pc.match_substring_regex(texts, self.odd)
        if not len(texts) or not pc.any(other).as_py():
            return self._plain(texts)
        rest = pa.array([self._other(t) for t in texts.filter(other).to_pylist()], pa.binary())
        order = np.argsort(other.to_numpy(zero_copy_only=False), kind="stable")  # plain texts come first
        return pa.concat_arrays([self._plain(texts.filter(pc.invert(other))), rest]).take(pa.array(np.argsort(order)))


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This process's encoder for a vocabulary file; workers keep it from task to task."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
