"""Word positions and word hashes of Arrow text batches, by numpy over the raw bytes.

A word is a run of bytes other than the six ASCII blanks, which is the same as
``[^\\x20\\x09-\\x0D]+`` over the text.  Hashes are 64-bit polynomials over the bytes,
taken from one running sum, then mixed; no Python object is made per word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Splits a text into words in Spark SQL; empty pieces at either end are not words.
BLANKS = r"[\x20\x09-\x0D]+"

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}

#: Documents are handled in slices of about this many bytes, which bounds the work arrays.
SLICE_BYTES = 1 << 21
#: Inside a slice, which a long document fills alone, work arrays cover so many bytes or words at a time.
CHUNK = 1 << 18


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept for the next call; ``n`` is at most a little over ``CHUNK``."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), np.uint64(base & (2**64 - 1)), np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _running(values: np.ndarray, base: int) -> np.ndarray:
    """Sums of ``values[i] * base**i`` before each place."""
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(base, len(values)), out=sums[1:])
    return sums


def windows(values: np.ndarray, size: int, base: int, at: np.ndarray) -> np.ndarray:
    """Hash of ``values[p:p+size]`` for each p in ``at``, which ascends."""
    out = np.empty(len(at), np.uint64)
    inverse, a = pow(base, -1, 1 << 64), 0
    while a < len(at):
        lo = int(at[a])
        b = int(np.searchsorted(at, lo + CHUNK))
        spot = at[a:b] - lo
        sums = _running(values[lo : int(at[b - 1]) + size], base)
        out[a:b] = mix((sums[spot + size] - sums[spot]) * powers(inverse, CHUNK)[spot])
        a = b
    return out


def spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, sizes: tuple[int, ...] = ()) -> np.ndarray:
    """Polynomials over the bytes of spans that ascend and do not overlap, not mixed yet; with ``sizes`` there is a column for
    the whole span and one for its first so many bytes, which means nothing where it has fewer."""
    out, a = np.empty((len(starts), 1 + len(sizes)), np.uint64), 0
    while a < len(starts):
        lo = int(starts[a])
        b = int(np.searchsorted(ends, lo + CHUNK, "right"))
        if b <= a:  # one span longer than a chunk
            total = 0
            for p in range(lo, int(ends[a]), CHUNK):
                part = data[p : min(p + CHUNK, int(ends[a]))].astype(np.uint64) + np.uint64(1)
                sums = _running(part, _BASE)
                if p == lo:
                    out[a, 1:] = sums[np.minimum(sizes, len(part)).astype(np.int64)]
                total += int(sums[-1]) * pow(_BASE, p - lo, 1 << 64)
            out[a, 0] = total & (2**64 - 1)
            a += 1
            continue
        sums = _running(data[lo : int(ends[b - 1])].astype(np.uint64) + np.uint64(1), _BASE)
        begin = starts[a:b] - lo
        base, scale = sums[begin], powers(_INVERSE, CHUNK)[begin]
        out[a:b, 0] = (sums[ends[a:b] - lo] - base) * scale
        for k, size in enumerate(sizes, 1):
            out[a:b, k] = (sums[np.minimum(begin + size, len(sums) - 1)] - base) * scale
        a = b
    return out if sizes else out[:, 0]


@dataclass
class Words:
    """Words of a slice of documents: byte span and hash of each, and each document's first word."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray  # one more entry than documents

    @property
    def n_docs(self) -> int:
        return len(self.first) - 1

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def doc_of(self) -> np.ndarray:
        return np.repeat(np.arange(self.n_docs), self.counts())

    def hashes(self, a: int = 0, b: int | None = None) -> np.ndarray:
        """Hashes of the words a to b, all by default."""
        starts, ends = self.starts[a:b], self.ends[a:b]
        return self._hash(spans(self.data, starts, ends), starts, ends)

    def _hash(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix(raw + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))

    def prefixes(self, sizes: tuple[int, ...]) -> np.ndarray:
        """Hashes of the words and of their first so many bytes; 0 for words that have fewer."""
        out = spans(self.data, self.starts, self.ends, sizes)
        out[:, 0] = self._hash(out[:, 0], self.starts, self.ends)
        long = self.ends - self.starts
        for k, size in enumerate(sizes, 1):
            out[:, k] = np.where(long >= size, mix(out[:, k] + np.uint64(size << 32)), np.uint64(0))
        return out


def text_buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a string array; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, offsets, data = texts.buffers()
    if len(texts) == 0:
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    offs = np.frombuffer(offsets, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return offs - offs[0], raw[offs[0] : offs[-1]]


def slices(offsets: np.ndarray, size: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about ``size`` bytes; a longer document is a range of its own."""
    n, lo = len(offsets) - 1, 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + size, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def find_words(offsets: np.ndarray, data: np.ndarray, lower: bool = False) -> Words:
    """Words of the documents ``data[offsets[i]:offsets[i+1]]``; none runs over a document's end."""
    if lower:
        data = _LOWER[data]
    n, starts, ends = len(data), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    cuts = offsets[(offsets > 0) & (offsets < n)]
    for lo in range(0, n, CHUNK):
        hi = min(lo + CHUNK, n)
        # With the bytes beside the chunk, so that words may run over its edges.
        blank = np.ones(hi - lo + 2, bool)
        inside = slice(max(lo - 1, 0), min(hi + 1, n))
        blank[inside.start - lo + 1 : inside.stop - lo + 1] = _SPACE[data[inside]]
        before, after = blank[:-2].copy(), blank[2:].copy()
        a, b, c = np.searchsorted(cuts, (lo, lo + 1, hi))
        d = int(np.searchsorted(cuts, hi, "right"))
        before[cuts[a:c] - lo] = True
        after[cuts[b:d] - lo - 1] = True
        starts.append(np.flatnonzero(~blank[1:-1] & before) + lo)
        ends.append(np.flatnonzero(~blank[1:-1] & after) + lo + 1)
    begin = np.concatenate(starts)
    return Words(data, begin, np.concatenate(ends), np.searchsorted(begin, offsets))


def each_slice(texts: pa.Array, lower: bool = False, size: int = SLICE_BYTES) -> Iterator[tuple[int, int, Words]]:
    """(first document, one past the last, their words) over an Arrow text column."""
    offsets, data = text_buffers(texts)
    for lo, hi in slices(offsets, size):
        part = offsets[lo : hi + 1]
        yield lo, hi, find_words(part - part[0], data[part[0] : part[-1]], lower)
