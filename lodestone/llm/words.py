"""Words of many texts at once, as numpy arrays over the UTF-8 bytes of an Arrow column; no Python object a word."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash

#: Bytes handled at once; a longer text is a block of its own.
BLOCK = 1 << 19
#: Set for the bytes that separate words: [\x20\x09-\x0D].
SPACE = np.isin(np.arange(256), [0x20, 9, 10, 11, 12, 13])
#: Set for the bytes outside [^\x00-\x2F\x3A-\x60\x7B-\x7F], after lower-casing.
NOT_ALNUM = ~np.array([0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 for b in range(256)])
LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], np.uint8)

#: What is kept of a lane of 8 bytes of which the first n count.
_KEEP = np.array([(1 << (8 * n)) - 1 for n in range(9)], np.uint64)
_A, _B, _C = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F), np.uint64(0x9E3779B97F4A7C15)


def mix(h: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64: every bit of the result depends on every bit of h."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def both(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """A hash of two hashes in order. It isn't linear in either, so no pattern of words makes spans collide, as it may with polynomials modulo 2**64."""
    return mix(mix(left + _A) * _B + right)


def span_hash(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of values[start:end] for each span, the same wherever the span stands.

    A span is told by its length and by the two spans of the next lower power of two at its ends, which cover it; those are built
    by doubling. Levels are arrays as long as values, of which one is held at a time.
    """
    out, n = np.zeros(len(start), np.uint64), end - start
    level, size = values, 1
    while len(n) and size <= n.max():
        own = np.flatnonzero((n >= size) & (n < 2 * size))
        if len(own):
            out[own] = both(level[start[own]], level[end[own] - size]) + n[own].astype(np.uint64) * _C
        if 2 * size > min(n.max(), len(values)):
            break
        level = both(level[:-size], level[size:])
        size *= 2
    return mix(out)


@dataclass
class Block:
    """Texts lo..hi of the batch. word_at[d]..word_at[d+1] are the words of text d; start and end are byte offsets into data."""

    lo: int
    hi: int
    data: np.ndarray
    text_at: np.ndarray
    start: np.ndarray
    end: np.ndarray
    word_at: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.word_at)

    def text(self, d: int) -> bytes:
        return self.data[self.text_at[d] : self.text_at[d + 1]].tobytes()

    def doc_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(self.hi - self.lo), self.counts)

    def hashes(self) -> np.ndarray:
        """A hash of each word: of its bytes as two lanes and its length, and of longer words by XXH3."""
        padded = np.concatenate([self.data, np.zeros(16, np.uint8)])
        lane = np.ndarray(len(padded) - 7, "<u8", padded, strides=(1,))  # the 8 bytes from each place on
        n = self.end - self.start
        low = lane[self.start] & _KEEP[np.minimum(n, 8)]
        high = lane[np.minimum(self.start + 8, len(lane) - 1)] & _KEEP[np.clip(n - 8, 0, 8)]
        out = mix(both(low, high) + n.astype(np.uint64) * _C)
        for i in np.flatnonzero(n > 16).tolist():
            out[i] = xxhash.xxh3_64_intdigest(self.data[self.start[i] : self.end[i]].tobytes(), 16)
        return out


def blocks(texts: pa.Array, space: np.ndarray = SPACE, lower: bool = False, limit: int = BLOCK) -> Iterator[Block]:
    """Blocks of whole texts, null as empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    whole = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        data, at = whole[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        if lower:
            data = LOWER[data]
        inside = ~space[data]
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        full = at[:-1] < at[1:]
        a, b = at[:-1][full], at[1:][full] - 1
        first[a] |= inside[a]
        last[b] |= inside[b]
        start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
        yield Block(lo, hi, data, at, start, end, np.searchsorted(start, at))
        lo = hi


def windows(hashes: np.ndarray, k: int) -> np.ndarray:
    """The hash of each k consecutive words; windows that run over the end of a text are for the caller to leave out."""
    i = np.arange(max(0, len(hashes) - k + 1))
    return span_hash(hashes, i, i + k)


def sliding_argmin(h: np.ndarray, w: int) -> np.ndarray:
    """The place of the least of each w consecutive hashes, by their upper bits; the leftmost of equals.

    Winnowing: windows of equal content choose the same place, relative to their start, in whatever text they stand.
    """
    n = len(h) - w + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    bits = max(20, len(h).bit_length())
    v = (h >> np.uint64(bits)) << np.uint64(bits) | np.arange(len(h), dtype=np.uint64)
    pad = -len(v) % w
    v = np.concatenate([v, np.full(pad, np.iinfo(np.uint64).max)]).reshape(-1, w)
    left = np.minimum.accumulate(v, 1).ravel()
    right = np.minimum.accumulate(v[:, ::-1], 1)[:, ::-1].ravel()
    return (np.minimum(right[:n], left[w - 1 : w - 1 + n]) & np.uint64((1 << bits) - 1)).astype(np.int64)
