"""Adaptive context-mixing range coder for token ids, many independent blocks in step.

Each block starts from nothing: it carries the sorted list of its distinct ids (its alphabet) and codes every id by a
mixture of three predictors that learn as they go:

* order 2: the id that last followed the two ids before (hashed), with a confidence of 0 to 7;
* order 1: the id that last followed the id before, with a confidence of 0 to 7;
* order 0: frequencies over the alphabet.

For each pair of confidences the mixture gives the order-2 prediction a share, the order-1 prediction a share of the
rest, and what remains to the order-0 frequencies. Predictions, confidences and shares learn every STEP ids, frequencies
at places that double up to every FREQ_STEP ids; in between the model stands still, so an encoder finds the
probabilities of a whole stretch in a few numpy operations. A 64-bit carry-less range coder codes each id in one step,
with 32-bit output words. All blocks of a call advance together, one numpy operation for all of them.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

#: Ids of a block; a block can be decoded without any other. So many blocks advance together at most.
BLOCK_TOKENS, LANES = 8192, 1536
#: Ids between two places of learning: of predictions and shares, and (at most) of frequencies.
STEP, FREQ_STEP = 64, 1024
_HASH_BITS, _HASH_STEP = 12, 4
_SHARE_BITS, _FREQ_BITS = 16, 13
_WHOLE = 1 << _FREQ_BITS
_BOTTOM = np.uint64(1 << 32)
_HALF, _MASK, _ZERO, _ONE = np.uint64(32), np.uint64(2**32 - 1), np.uint64(0), np.uint64(1)
_TOTAL = np.uint64(_SHARE_BITS + _FREQ_BITS)
_UPPER, _LOWER = np.uint32(16), np.uint32(0xFFFF)
#: A prediction is a symbol (below BLOCK_TOKENS) above three bits of confidence. Where none is known yet: the last symbol, confidence 0.
_CONF, _SURE = np.uint16(3), np.uint16(7)
_NONE = np.uint16((BLOCK_TOKENS - 1) << 3)
_PREV2, _HASHED = np.uint16(_HASH_STEP), np.uint16((1 << _HASH_BITS) - 1)
#: What a place adds to its pair of confidences, by which orders were right (none, 2, 1, both): three counts of 16 bits in one float,
#: of places, hits of order 2 and hits of order 1 only.
_KINDS = np.array([1, 1 + (1 << 16), 1 + (1 << 32), 1 + (1 << 16)], float)
#: Lanes whose frequencies are set together.
_SOME_LANES = 64


def _stretches(most: int) -> list[tuple[int, int, bool]]:
    """Where the model stands still, and whether frequencies learn before."""
    freqs = {0, 64, 128, 256, 512, *range(FREQ_STEP, most, FREQ_STEP)}
    places = sorted({p for p in (*freqs, 16, 32, *range(0, most, STEP)) if p < most})
    return [(a, b, a in freqs) for a, b in zip(places, [*places, most][1:], strict=True)]


class _Model:
    """The predictors of k blocks; lanes are sorted by length, longest first, so the first `n` are at work.

    syms[:, t + 2] are the local symbols at place t, after two columns that stand for what is before the block. Stretches are
    learnt lane by lane, so that a lane's tables stay in the cache.
    """

    def __init__(self, sizes: np.ndarray, lengths: np.ndarray, decode: bool):
        k, self.width, most = len(sizes), int(sizes.max(initial=1)) + 1, int(lengths.max())
        self.sizes, self.lengths, self.decode, self.upto = sizes.astype(np.int32), lengths, decode, 0
        self.counts = np.zeros((k, self.width), np.int32)
        self.seen = np.zeros(k * 64)
        self.syms = np.repeat(self.sizes.astype(np.uint16)[:, None], most + 2, axis=1)  # before a block: a symbol beyond its own alphabet
        self.at1, self.at2 = np.full(k * self.width, _NONE), np.full(k << _HASH_BITS, _NONE)
        self.order0 = np.zeros(k * self.width, np.uint32)
        self.symbol = np.zeros(k << _FREQ_BITS if decode else 0, np.uint16)
        lanes = np.arange(k)
        self.row0, self.row2, self.row_share, self.row_freq = lanes * self.width, lanes << _HASH_BITS, lanes * 64, lanes << _FREQ_BITS

    def look(self, a: int, b: int, n: int) -> tuple[np.ndarray, ...]:
        """Places a to b of the first n lanes, a row each: symbols, where the predictions of order 2 and order 1 are kept, these
        predictions, which are right, and where the pair of their confidences is kept."""
        syms = self.syms[:n, a : b + 2]
        sym, prev = syms[:, 2:], syms[:, 1:-1]
        i2 = ((syms[:, :-2] << _PREV2 ^ prev) & _HASHED) + self.row2[:n, None]
        i1 = prev + self.row0[:n, None]
        e2, e1 = self.at2.take(i2), self.at1.take(i1)
        hit2, hit1 = e2 >> _CONF == sym, e1 >> _CONF == sym
        if self.width > BLOCK_TOKENS:  # _NONE's symbol occurs; without a prediction it is no hit
            hit2, hit1 = hit2 & (e2 != _NONE), hit1 & (e1 != _NONE)
        return sym, i2, i1, e2, e1, hit2, hit1, ((e2 & _SURE) << _CONF | e1 & _SURE) + self.row_share[:n, None]

    def learn(self, a: int, b: int, looked: tuple[np.ndarray, ...]) -> None:
        """Take in what look() found at places a to b."""
        n = len(looked[0])
        if self.lengths[n - 1] < b:  # places beyond a block's end don't count
            real = np.arange(a, b) < self.lengths[:n, None]
            looked = tuple(x[real] for x in looked)
        sym, i2, i1, e2, e1, hit2, hit1, pair = looked
        kinds = _KINDS.take(hit2 + 2 * hit1.view(np.int8))
        self.seen[: n * 64] += np.bincount(pair.ravel(), kinds.ravel(), n * 64)
        # the last id to follow a context is predicted next; its confidence rises if it was predicted before
        new = (sym << _CONF) + np.uint16(1)
        for table, i, e, hit in ((self.at2, i2, e2, hit2), (self.at1, i1, e1, hit1)):
            table[i] = np.where(hit, np.minimum(e + np.uint16(1), e | _SURE), new)

    def prepare(self, b: int, n: int, freqs: bool) -> None:
        """Set the shares of the first n lanes by what was learnt before place b, and the frequencies if wanted."""
        if freqs:
            for lane in range(0, n, _SOME_LANES):
                self.count(b, lane, min(lane + _SOME_LANES, n))
            self.upto = b
        # of each pair of confidences: hits of order 2, of order 1 only, places; a few are assumed beforehand
        of = self.seen[: n * 64].astype(np.int64).reshape(n, 64)
        hit2, hit1, both = (of >> 16 & 0xFFFF).astype(float), (of >> 32).astype(float), (of & 0xFFFF).astype(float)
        guess2, guess1 = np.repeat(np.arange(8), 8) * 3, np.tile(np.arange(8), 8) * 2
        full = 1 << _SHARE_BITS  # all are whole numbers below 2**53, so that quotients' floors are exact
        share2 = np.clip(np.floor((hit2 * 8 + guess2) * full / (both * 8 + 32)), 32, full * 7 // 8)
        left = full - share2
        share1 = np.clip(np.floor(left * (hit1 * 8 + guess1) / ((both - hit2) * 8 + 32)), 32, np.floor(left * 7 / 8))
        self.end2 = (share2 * _WHOLE).astype(np.uint64).ravel()
        self.end1 = ((share2 + share1) * _WHOLE).astype(np.uint64).ravel()
        self.rest = (left - share1).astype(np.uint64).ravel()

    def count(self, b: int, first: int, stop: int) -> None:
        """Take the symbols from the last count to place b into the frequencies of some lanes."""
        k, counts, sizes = stop - first, self.counts[first:stop], self.sizes[first:stop, None]
        if b > self.upto:
            sym, where = self.syms[first:stop, self.upto + 2 : b + 2] + self.row0[:k, None], np.arange(self.upto, b) < self.lengths[first:stop, None]
            counts += np.bincount(sym.ravel() if where.all() else sym[where], minlength=k * self.width).reshape(k, -1)
        known = np.arange(self.width) < sizes
        weight = (2 * counts + 1) * known  # each symbol counts for a half beforehand; products stay below 2**28
        freq = weight * (_WHOLE - sizes) // weight.sum(1, keepdims=True, dtype=np.int32) + known
        freq[np.arange(k), weight.argmax(1)] += _WHOLE - freq.sum(1, dtype=np.int32)
        self.order0[first * self.width : stop * self.width] = ((np.cumsum(freq, axis=1, dtype=np.int32) - freq) << 16 | freq).ravel()
        if self.decode:
            self.symbol[first << _FREQ_BITS : stop << _FREQ_BITS] = np.repeat(np.tile(np.arange(self.width, dtype=np.uint16), k), freq.ravel())


def _settle(low: np.ndarray, wide: np.ndarray, move) -> None:
    """Where the range fell below 2**32, shift out a word; move(lanes, words) takes it.

    If the top 32 bits aren't fixed yet, the range is cut at the point where they would change. A range is 1 at least, so
    one shift brings every lane back to 2**32 or more.
    """
    lanes = (wide < _BOTTOM).nonzero()[0]
    if len(lanes):
        own, w = low[lanes], wide[lanes]
        move(lanes, own >> _HALF)
        left = (~own & _MASK) + _ONE  # up to the next change of the top 32 bits
        low[lanes], wide[lanes] = own << _HALF, np.minimum(w, left) << _HALF


def _sorted(sizes: list[int]) -> list[list[int]]:
    """Numbers of blocks, longest first, in equal groups of LANES at most."""
    order = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    step = max(1, -(-len(order) // max(1, -(-len(order) // LANES))))
    return [order[i : i + step] for i in range(0, len(order), step)]


def _alphabet(block: np.ndarray) -> np.ndarray:
    there = np.zeros(1 << 16, bool)
    there[block] = True
    return np.flatnonzero(there)


def encode_blocks(blocks: list[np.ndarray]) -> list[bytes]:
    """Each block (at most BLOCK_TOKENS ids below 65536) as bytes: count, alphabet, length and coded words, CRC-32 of its ids."""
    result: list[bytes] = [b""] * len(blocks)
    for group in _sorted([len(b) for b in blocks]):
        for i, coded in zip(group, _encode([blocks[i] for i in group]), strict=True):
            result[i] = coded
    return result


def _encode(blocks: list[np.ndarray]) -> list[bytes]:
    lengths = np.array([len(b) for b in blocks])
    alphabets = [_alphabet(b) for b in blocks]
    k, most = len(blocks), int(lengths.max())
    working = np.searchsorted(-lengths, -np.arange(most), "left")  # lanes longer than each place
    model = _Model(np.array([max(len(a), 1) for a in alphabets]), lengths, False)
    number = np.zeros(1 << 16, np.uint16)
    for lane, (block, alphabet) in enumerate(zip(blocks, alphabets, strict=True)):
        number[alphabet] = np.arange(len(alphabet))
        model.syms[lane, 2 : 2 + len(block)] = number[block]
    low, wide = np.zeros(k, np.uint64), np.full(k, 2**64 - 1, np.uint64)
    room = most + 8  # a step puts out one word at most
    out, put = np.zeros(k * room, np.uint32), np.arange(k) * room

    def move(lanes: np.ndarray, words: np.ndarray) -> None:
        at = put[lanes]
        out[at] = words
        put[lanes] = at + 1

    with np.errstate(over="ignore"):
        for a, b, freqs in _stretches(most):
            n = int(working[a])
            model.prepare(a, n, freqs)
            looked = model.look(a, b, n)
            sym, _, _, _, _, hit2, hit1, pair = looked
            end2, end1, rest = model.end2.take(pair), model.end1.take(pair), model.rest.take(pair)
            found = model.order0.take(sym + model.row0[:n, None])
            start = np.where(hit2, _ZERO, np.where(hit1, end2, end1 + (found >> _UPPER) * rest)).T.copy()
            width = np.where(hit2, end2, np.where(hit1, end1 - end2, (found & _LOWER) * rest)).T.copy()
            model.learn(a, b, looked)
            for t in range(a, b):
                n = int(working[t])
                lo, r = low[:n], wide[:n]
                r >>= _TOTAL
                lo += r * start[t - a, :n]
                r *= width[t - a, :n]
                _settle(lo, r, move)
    result = []
    for lane, block in enumerate(blocks):
        a = put[lane]
        last = [int(low[lane]) >> s & 0xFFFFFFFF for s in (32, 0)]
        coded = np.append(out[lane * room : a], np.array(last, np.uint32)).astype("<u4").tobytes()
        gaps = np.diff(alphabets[lane], prepend=0).astype("<u2")
        alphabet = zlib.compress(gaps.view(np.uint8).reshape(-1, 2).T.tobytes(), 6)  # lower bytes, then the upper ones, which are few
        raw = np.ascontiguousarray(block, "<u4").tobytes()
        result.append(struct.pack("<IIII", len(block), len(alphabet), len(coded), zlib.crc32(raw)) + alphabet + coded)
    return result


def decode_blocks(blocks: list[bytes]) -> list[np.ndarray]:
    """The ids of each block as 32-bit values; a block whose CRC-32 differs raises ValueError."""
    result: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(blocks)
    for group in _sorted([struct.unpack_from("<I", b)[0] for b in blocks]):
        for i, ids in zip(group, _decode([blocks[i] for i in group]), strict=True):
            result[i] = ids
    return result


def _decode(blocks: list[bytes]) -> list[np.ndarray]:
    heads = [struct.unpack_from("<IIII", b) for b in blocks]
    lengths = np.array([h[0] for h in heads])
    planes = [np.frombuffer(zlib.decompress(b[16 : 16 + h[1]]), np.uint8).reshape(2, -1).astype(np.int64) for b, h in zip(blocks, heads, strict=True)]
    alphabets = [np.cumsum(p[0] + (p[1] << 8)) for p in planes]
    k, most = len(blocks), int(lengths.max())
    words = [np.frombuffer(b[16 + h[1] :], "<u4", h[2] // 4) for b, h in zip(blocks, heads, strict=True)]
    take = np.concatenate([[0], np.cumsum([len(w) for w in words])])[:-1]
    data = np.concatenate([*words, np.zeros(4, np.uint32)]).astype(np.uint64)
    model = _Model(np.array([max(len(a), 1) for a in alphabets]), lengths, True)
    low, wide, code = np.zeros(k, np.uint64), np.full(k, 2**64 - 1, np.uint64), np.zeros(k, np.uint64)
    for _ in range(2):
        code = (code << _HALF) | data[take]
        take += 1
    beyond = len(data) - 1

    def move(lanes: np.ndarray, _: np.ndarray) -> None:
        at = take[lanes]
        code[lanes] = (code[lanes] << _HALF) | data.take(np.minimum(at, beyond))
        take[lanes] = at + 1

    with np.errstate(over="ignore", divide="ignore"):
        working = np.searchsorted(-lengths, -np.arange(most), "left")
        last = (model.sizes - 1).astype(np.uint16)
        prev2 = prev = model.sizes.astype(np.uint16)
        for a, b, freqs in _stretches(most):
            model.prepare(a, int(working[a]), freqs)
            found = np.zeros((b - a, int(working[a])), np.uint16)
            for t in range(a, b):
                n = int(working[t])
                prev2, prev = prev2[:n], prev[:n]
                e2 = model.at2.take(((prev2 << _PREV2 ^ prev) & _HASHED) + model.row2[:n])
                e1 = model.at1.take(prev + model.row0[:n])
                pair = ((e2 & _SURE) << _CONF | e1 & _SURE) + model.row_share[:n]
                end1, rest = model.end1.take(pair), model.rest.take(pair)
                lo, r = low[:n], wide[:n]
                r >>= _TOTAL
                v = (code[:n] - lo) // r
                place = (v - end1) // rest  # of use where both predictions miss
                sym = model.symbol.take(place.view(np.int64) + model.row_freq[:n], mode="clip")
                freq = model.order0.take(sym + model.row0[:n], mode="clip")
                start, width = end1 + (freq >> _UPPER) * rest, (freq & _LOWER) * rest
                hits = (v < end1).nonzero()[0]
                if len(hits):
                    own1, own2 = end1[hits], model.end2.take(pair[hits])
                    second = v[hits] < own2
                    start[hits] = np.where(second, _ZERO, own2)
                    width[hits] = np.where(second, own2, own1 - own2)
                    sym[hits] = np.where(second, e2[hits], e1[hits]) >> _CONF
                lo += r * start
                r *= width
                _settle(lo, r, move)
                # damaged data can point anywhere; the checksum tells at the end
                prev2, prev = prev, np.minimum(sym, last[:n], out=found[t - a, :n])
            model.syms[: found.shape[1], a + 2 : b + 2] = found.T
            model.learn(a, b, model.look(a, b, found.shape[1]))
    result = []
    for lane, (alphabet, head) in enumerate(zip(alphabets, heads, strict=True)):
        ids = alphabet[model.syms[lane, 2 : 2 + head[0]]].astype(np.uint32) if head[0] else np.zeros(0, np.uint32)
        if zlib.crc32(ids.astype("<u4").tobytes()) != head[3]:
            raise ValueError("a block's ids don't match their checksum")
        result.append(ids)
    return result
