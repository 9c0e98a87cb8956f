"""Token ids of whole texts by a ``tokenizers`` vocabulary, one encoding per distinct word.

The default vocabulary drops white space and never joins across it, so a text's ids are
its words' ids in order (tested against encoding whole texts).  Each Python worker keeps
the ids of the words it has met in at most ``MEMO_BYTES``: the memo is emptied when it has grown beyond.
Words are looked up ``PART`` at a time and new ones encoded ``BATCH`` at a time, so that a long text takes
its own bytes, 16 bytes a word and its ids, and nothing else grows with it.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

from tessera.llm.words import SLICE_BYTES, each_slice

END_ID = 1
MEMO_BYTES = 32 << 20
PART, BATCH = 1 << 17, 1 << 11


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordEncoder:
    """Ids of words, by hash of the word; ``pool[at[k]:at[k]+size[k]]`` are those of ``keys[k]``."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # Ids that end a run of letters: so many words of letters alone can be one encoding and be told apart again.
        suffix = json.loads(self.tokenizer.to_str())["model"].get("end_of_word_suffix")
        self.last = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.last[[i for token, i in self.tokenizer.get_vocab().items() if suffix and token.endswith(suffix)]] = True
        self.joins = bool(self.last.any())
        self.reset()

    def _each(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        encoded = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        size = np.fromiter(map(len, encoded), np.int64, len(encoded))
        return np.fromiter((i for ids in encoded for i in ids), np.int32, int(size.sum())), size

    def _joined(self, words: list[str], runs: int) -> tuple[np.ndarray, np.ndarray]:
        """Of words that are ``runs`` runs or more, of letters and of marks: many as one encoding."""
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, np.int32)
        ends = np.flatnonzero(self.last[ids])
        # With so many ends in all, each word has exactly its least.
        return (ids, np.diff(ends[runs - 1 :: runs], prepend=-1)) if len(ends) == runs * len(words) else self._each(words)

    def _encode(self, words: list[str], runs: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the words one after the other, ids of each)."""
        out = [(np.zeros(0, np.int32), np.zeros(0, np.int64))]
        for lo in range(0, len(words), BATCH):
            some = words[lo : lo + BATCH]
            out.append(self._joined(some, runs) if runs and self.joins else self._each(some))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    def reset(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.at = np.zeros(0, np.uint32)
        self.size = np.zeros(0, np.uint32)
        self.pool = np.zeros(1 << 16, np.int32)
        self.used = 0

    @property
    def held(self) -> int:
        return 16 * len(self.keys) + 4 * self.used

    def _learn(self, keys: np.ndarray, words: list[str]) -> None:
        kinds = np.fromiter((1 if w.isalpha() else 2 if w[-1] in ".,;:!?" and w[:-1].isalpha() else 0 for w in words), np.int64, len(words))
        for runs in range(3):
            chosen = np.flatnonzero(kinds == runs)
            ids, size = self._encode([words[i] for i in chosen.tolist()], runs)
            if self.used + len(ids) > len(self.pool):
                self.pool = np.concatenate([self.pool[: self.used], np.zeros(max(len(ids), len(self.pool) // 2), np.int32)])
            self.pool[self.used : self.used + len(ids)] = ids
            at = self.used + np.cumsum(size) - size
            self.used += len(ids)
            order = np.searchsorted(self.keys, keys[chosen])
            self.keys, self.at, self.size = (np.insert(a, order, b) for a, b in ((self.keys, keys[chosen]), (self.at, at), (self.size, size)))

    def _part(self, words, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the words a to b, how many of each)."""
        if self.held > MEMO_BYTES:
            self.reset()
        hashes, first, back = np.unique(words.hashes(a, b), return_index=True, return_inverse=True)
        spot = np.minimum(np.searchsorted(self.keys, hashes), max(len(self.keys) - 1, 0))
        new = self.keys[spot] != hashes if len(self.keys) else np.ones(len(hashes), bool)
        if new.any():
            base = int(words.starts[a])
            raw = words.data[base : int(words.ends[b - 1])].tobytes()
            at = a + first[new]
            places = zip((words.starts[at] - base).tolist(), (words.ends[at] - base).tolist(), strict=True)
            self._learn(hashes[new], [raw[x:y].decode("utf-8", "replace") for x, y in places])
            spot = np.searchsorted(self.keys, hashes)
        size, at = self.size[spot][back].astype(np.int64), self.at[spot][back].astype(np.int64)
        ends = np.cumsum(size)
        return self.pool[np.repeat(at - ends + size, size) + np.arange(ends[-1])], size.astype(np.uint32)

    def ids(self, words) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all documents of the slice, each ended by END_ID; ids per document)."""
        n = len(words.starts)
        parts = [self._part(words, a, min(a + PART, n)) for a in range(0, n, PART)]
        upto = np.zeros(n + 1, np.int64)
        if parts:
            np.cumsum(np.concatenate([size for _, size in parts]), out=upto[1:])
        before = upto[words.first]  # one more than documents
        out = np.full(int(upto[-1]) + words.n_docs, END_ID, np.int32)
        place = np.ones(len(out), bool)
        place[before[1:] + np.arange(words.n_docs)] = False
        if parts:
            out[place] = np.concatenate([ids for ids, _ in parts])
        return out, np.diff(before) + 1


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """This worker's encoder for a vocabulary file."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


@lru_cache(maxsize=16)
def id_type(path: str) -> np.dtype:
    """The least unsigned type that holds every id of a vocabulary file."""
    from tokenizers import Tokenizer

    return np.dtype("<u2" if Tokenizer.from_file(path).get_vocab_size() <= 1 << 16 else "<u4")


def encode_texts(texts: pa.Array, path: str) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first document, one past the last, ids, ids per document) by slices of a text column."""
    known = encoder(path)
    # Half the usual slice: the memo already takes its share of a worker's memory.
    for lo, hi, words in each_slice(texts, size=SLICE_BYTES // 2):
        yield lo, hi, *known.ids(words)


def ids_crc32(ids: np.ndarray) -> int:
    """Unsigned CRC-32 of the ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(np.ascontiguousarray(ids, "<u4"))
