"""Elias-Fano sequences in memory-mapped files, read by whole arrays of queries.

A non-decreasing sequence of n values below u keeps the low ``log2(u / n)`` bits of each value as they are and the
rest in unary: value i sets bit ``(value >> low) + i`` of a bit vector.  Two directories hold the number
of ones and of zeros before each 64-bit word.  Access is a select of the i-th one; a
search for a value selects the zeros around its high part and compares low bits in between.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np

_U = np.uint64


def container(arrays: dict[str, np.ndarray]) -> list[bytes]:
    """Bytes of a file that holds the arrays, each at a multiple of 64 bytes."""
    head, at, body = {}, 0, []
    for name, values in arrays.items():
        raw = np.ascontiguousarray(values).tobytes()
        head[name] = [values.dtype.str, at, len(values)]
        pad = -len(raw) % 64
        body.append(raw + bytes(pad))
        at += len(raw) + pad
    text = json.dumps(head).encode()
    text += b" " * (-(len(text) + 8) % 64)
    return [len(text).to_bytes(8, "little"), text, *body]


@lru_cache(maxsize=4096)
def open_container(path: str) -> dict[str, np.ndarray]:
    """The arrays of a file, mapped; pages are read when they are touched."""
    mapped = np.asarray(np.memmap(path, np.uint8, "r"))
    size = int.from_bytes(mapped[:8].tobytes(), "little")
    out = {}
    for name, (kind, at, n) in json.loads(mapped[8 : 8 + size].tobytes()).items():
        width = np.dtype(kind).itemsize
        out[name] = mapped[8 + size + at : 8 + size + at + n * width].view(kind)
    return out


def _counter(n: int) -> type:
    return np.uint32 if n < 1 << 32 else np.uint64


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    """Values of ``width`` bits each, one after the other."""
    if not width or not len(values):
        return np.zeros(1, _U)
    at = np.arange(len(values), dtype=_U) * _U(width)
    word, shift = (at >> _U(6)).astype(np.int64), at & _U(63)
    out = np.zeros(int((len(values) * width + 63) // 64) + 1, _U)
    begins = np.concatenate([[0], np.flatnonzero(np.diff(word)) + 1])
    out[word[begins]] |= np.bitwise_or.reduceat(values << shift, begins)
    over = np.flatnonzero(shift + _U(width) > 64)
    out[word[over] + 1] |= values[over] >> (_U(64) - shift[over])
    return out


def elias_fano(values: np.ndarray, name: str) -> dict[str, np.ndarray]:
    """Arrays of a non-decreasing sequence of unsigned values, to be stored under ``name``."""
    values = np.asarray(values).astype(_U)
    n = len(values)
    top = int(values[-1]) if n else 0
    low = max(0, (top // n).bit_length() - 1) if n else 0
    high = (values >> _U(low)).astype(np.int64)
    bits = np.zeros((n + (top >> low) + 2 + 63) // 64 * 64, np.uint8)
    bits[high + np.arange(n)] = 1
    words = np.packbits(bits, bitorder="little").view(_U)
    ones = np.concatenate([[0], np.cumsum(np.bitwise_count(words).astype(np.int64))])
    zeros = np.arange(len(ones)) * 64 - ones
    kind = _counter(max(int(ones[-1]), int(zeros[-1])) + 1)
    return {
        f"{name}.low": _pack(values & _U((1 << low) - 1), low),
        f"{name}.high": words,
        f"{name}.ones": ones.astype(kind),
        f"{name}.zeros": zeros.astype(kind),
        f"{name}.size": np.array([n, low], np.int64),
    }


def _bit_table() -> np.ndarray:
    """Place of the k-th set bit of a byte, at ``byte | k << 8``."""
    out = np.zeros(256 * 8, np.int64)
    for byte in range(256):
        for k, place in enumerate(i for i in range(8) if byte >> i & 1):
            out[byte | k << 8] = place
    return out


_BITS = _bit_table()


def _select_in_word(word: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Position of the k-th set bit (from 0) of each word: the byte by sums of byte counts, then the bit by table."""
    ones, tops = _U(0x0101010101010101), _U(0x8080808080808080)
    sums = word - (word >> _U(1) & _U(0x5555555555555555))
    sums = (sums & _U(0x3333333333333333)) + (sums >> _U(2) & _U(0x3333333333333333))
    sums = (sums + (sums >> _U(4)) & _U(0x0F0F0F0F0F0F0F0F)) * ones
    rank = k.astype(_U)
    shift = np.bitwise_count(((rank * ones | tops) - sums) & tops).astype(_U) << _U(3)
    rank -= (sums << _U(8)) >> shift & _U(255)
    return shift.astype(np.int64) + _BITS[((word >> shift & _U(255)) | rank << _U(8)).astype(np.int64)]


class EliasFano:
    """A sequence stored by :func:`elias_fano`."""

    def __init__(self, arrays: dict[str, np.ndarray], name: str):
        self.low, self.high = arrays[f"{name}.low"], arrays[f"{name}.high"]
        self.ones, self.zeros = arrays[f"{name}.ones"], arrays[f"{name}.zeros"]
        self.n, self.width = (int(x) for x in arrays[f"{name}.size"])
        self.mask = _U((1 << self.width) - 1)

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.width:
            return np.zeros(len(i), _U)
        at = i.astype(_U) * _U(self.width)
        word, shift = (at >> _U(6)).astype(np.int64), at & _U(63)
        over = np.where(shift == 0, _U(0), self.low[word + 1] << ((_U(64) - shift) & _U(63)))
        return (self.low[word] >> shift | over) & self.mask

    def _select0(self, k: np.ndarray) -> np.ndarray:
        word = np.searchsorted(self.zeros, k.astype(self.zeros.dtype), "right") - 1
        inside = k - self.zeros[word].astype(np.int64)
        return word * 64 + _select_in_word(~self.high[word], inside)

    def access(self, i: np.ndarray) -> np.ndarray:
        """Values at positions i (all within the sequence)."""
        word = np.searchsorted(self.ones, i.astype(self.ones.dtype), "right") - 1
        inside = i - self.ones[word].astype(np.int64)
        at = word * 64 + _select_in_word(self.high[word], inside)
        return (at - i).astype(_U) << _U(self.width) | self._low(i)

    def successor(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position of the first element that is not less, whether it is equal)."""
        values = values.astype(_U)
        high = values >> _U(self.width)
        inside = high < _U(max(int(self.zeros[-1]) - 1, 0))  # the high part of every element is below
        part = np.where(inside, high, _U(0)).astype(np.int64)
        lo = np.where(part > 0, self._select0(np.maximum(part - 1, 0)) - (part - 1), 0)
        hi = self._select0(part) - part
        lo, hi = np.minimum(lo, self.n), np.minimum(hi, self.n)
        end, want = hi.copy(), values & self.mask
        live = np.flatnonzero(lo < hi)
        while len(live):
            mid = (lo[live] + hi[live]) >> 1
            less = self._low(mid) < want[live]
            lo[live] = np.where(less, mid + 1, lo[live])
            hi[live] = np.where(less, hi[live], mid)
            live = live[lo[live] < hi[live]]
        equal = inside & (lo < end)
        spot = np.flatnonzero(equal)
        equal[spot] = self._low(lo[spot]) == want[spot]
        return np.where(inside, lo, self.n), equal
