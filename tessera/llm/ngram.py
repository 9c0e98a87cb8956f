"""Trigram language model in Elias-Fano tries, trained and queried in the cluster.

Words are identified by 64-bit hashes; a word's number is its rank among the sorted hashes.  All n-grams of the
training texts are counted and all of them stay in the model, with absolute discounting; what is taken
off goes to the shorter context, so that for every context the probabilities of all words and the unknown word sum to one:

    p(w | u v) = d(u v w) + b(u v) * (d(v w) + b(v) * p(w))

The trie is cut into shards of about ``SHARD_TOKENS`` training tokens, by ranges of (u, v, w) in order.  The ranges' bounds
are quantiles of a random sample of the training trigrams (:func:`shard_bounds`), so a frequent context is cut by the next word
and a frequent pair by the third: whatever repeats, a shard gets its share of the tokens and the sampling error
(``PER_SHARD`` sampled trigrams a shard, a standard error of about a fourteenth).  The sample decides where shards end and nothing else.
A shard's files have

* contexts u, and monotone pointers to their successors v,
* for each (u, v) monotone pointers to its successors w, written as their places among the successors of v,
  which are smaller numbers than the words themselves (context-relative); the first list belongs to the pair that the
  shard begins inside of, if it does, and every other list to a pair of its own,
* discounted probabilities and weights of shorter contexts as 16-bit logarithms.

Successor lists are made monotone by adding the last value of the list before, stored as Elias-Fano
sequences (:mod:`tessera.llm.succinct`) and searched by value.  Files stand in the shared folder and
are memory-mapped by the workers; only one row per shard is kept on the driver.

Defined cases: a null or empty text has the end token alone; rows with the same ``doc_id`` are all read and scored;
a null ``doc_id`` is hashed as an empty text; a very long text is a slice of its own and is read and scored whole; texts with equal
scores keep them; without training texts every probability is one, and an empty table has no scores; other columns are not read,
whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.groups import every, rank_among, runs
from tessera.llm.store import arrow_map, fetch, materialize, new_path, write_bytes
from tessera.llm.succinct import EliasFano, container, elias_fano, open_container
from tessera.llm.words import Words, each_slice

DISCOUNT = 0.75
SHARD_TOKENS = 1 << 21
#: Sampled trigrams a shard, and the documents they are taken from: this share of all, or so many if that is more.
PER_SHARD, SAMPLE_SHARE, SAMPLE_DOCS = 200, 0.02, 20_000
VOCABULARY_SHARD = 1 << 20
#: Entries that a task holds before it adds them up and sends them on: its memory, whatever the input.
FLUSH = 1_500_000
#: Pairs that a task looks up at a time while it builds triples.
LOOK_UP = 1 << 18
#: Logarithms are kept in steps of 1/1024 of a decade, rounded down, so that sums stay below one.
STEP = 1024.0
#: Stands for the end of a text; no word hashes to it but by a chance of 2**-64.
END = np.uint64(0x9D39247E33776D41)
_U = np.uint64
#: In place of a word's number: no such word.
_NONE = 0xFFFFFFFF


def _quantise(p: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        return np.clip(np.ceil(-np.log10(p) * STEP - 1e-9), 0, 65535).astype(np.uint16)


def _restore(code: np.ndarray) -> np.ndarray:
    """Probabilities; the greatest code stands for zero."""
    return np.where(code == 65535, 0.0, 10.0 ** (-code.astype(np.float64) / STEP))


def sequence(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all tokens, first token of each document): words, then one end."""
    first = words.first + np.arange(words.n_docs + 1)
    out = np.full(int(first[-1]), END)
    place = np.ones(len(out), bool)
    place[first[1:] - 1] = False
    out[place] = words.hashes()
    return out, first


# --- vocabulary -------------------------------------------------------------------------------------------------


def _merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    key, count = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(key)
    key, count = key[order], count[order]
    begins = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1]) if len(key) else np.zeros(0, np.int64)
    return key[begins], np.add.reduceat(count, begins) if len(key) else count


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, count): each task adds up what it reads before anything is moved."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        size = 0

        def out() -> pa.RecordBatch:
            key, n = _merge(held)
            return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n)], ["word", "count"])

        for batch in batches:
            for _, _, words in each_slice(batch.column(0), lower=True):
                key, n = np.unique(sequence(words)[0], return_counts=True)
                held.append((key, n.astype(np.int64)))
                size += len(key)
                if size > FLUSH:
                    held = [_merge(held)]
                    size = len(held[0][0])
                    if size > FLUSH // 2:
                        yield out()
                        held, size = [], 0
        if held:
            yield out()

    return arrow_map(texts, count, "word long, count long").groupBy("word").agg(F.sum("count").alias("count"))


@dataclass
class Vocabulary:
    """Files of word hashes in order, and for each file its first number."""

    root: str
    bits: int
    base: np.ndarray
    tokens: int
    size: int
    discount: float
    shard_tokens: int = SHARD_TOKENS

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number or -1, count) of sorted distinct hashes."""
        number, count = np.full(len(hashes), -1, np.int64), np.zeros(len(hashes), np.int64)
        shard = (hashes >> _U(64 - self.bits)).astype(np.int64) if self.bits else np.zeros(len(hashes), np.int64)
        cuts = np.searchsorted(shard, np.arange(len(self.base) + 1))
        for s in np.flatnonzero(cuts[1:] > cuts[:-1]):
            if self.base[s] < 0:
                continue
            a, b = cuts[s], cuts[s + 1]
            keys, upto = _open_vocabulary(f"{self.root}/words-{s}.bin")
            at, known = keys.successor(hashes[a:b])
            at = at[known]
            spot = a + np.flatnonzero(known)
            number[spot] = self.base[s] + at
            count[spot] = (upto.access(at + 1) - upto.access(at)).astype(np.int64)
        return number, count

    def counts(self, numbers: np.ndarray) -> np.ndarray:
        """Counts of words by their numbers, which ascend."""
        live = np.flatnonzero(self.base >= 0)
        part = np.searchsorted(self.base[live], numbers, "right") - 1
        out = np.zeros(len(numbers), np.int64)
        for k in np.unique(part):
            here = np.flatnonzero(part == k)
            _, upto = _open_vocabulary(f"{self.root}/words-{live[k]}.bin")
            at = numbers[here] - self.base[live[k]]
            out[here] = (upto.access(at + 1) - upto.access(at)).astype(np.int64)
        return out


@lru_cache(maxsize=4096)
def _open_vocabulary(uri: str) -> tuple[EliasFano, EliasFano]:
    arrays = open_container(fetch(uri))
    return EliasFano(arrays, "words"), EliasFano(arrays, "upto")


def build_vocabulary(texts: DataFrame, root: str, shard_tokens: int = SHARD_TOKENS, vocabulary_shard: int = VOCABULARY_SHARD) -> Vocabulary:
    """Count the words of ``texts`` and write the vocabulary's files."""
    counts = materialize(word_counts(texts), "word-counts")
    bits = max(0, math.ceil(math.log2(max(1, counts.count()) / vocabulary_shard)))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, ["shard"]):
            shard = int(group["shard"][0].as_py())
            key, count = group["word"].to_numpy().view(np.uint64), group["count"].to_numpy()
            order = np.argsort(key)
            key, count = key[order], count[order]
            upto = np.concatenate([[0], np.cumsum(count)])
            write_bytes(f"{root}/words-{shard}.bin", container(elias_fano(key, "words") | elias_fano(upto, "upto")))
            row = [shard, len(key), int(upto[-1]), int((count == 1).sum()), int((count == 2).sum())]
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in row], ["shard", "size", "tokens", "once", "twice"])

    shard = F.shiftrightunsigned("word", 64 - bits) if bits else F.lit(0).cast("long")
    placed = counts.select(shard.alias("shard"), "word", "count").repartition("shard").sortWithinPartitions("shard")
    rows = arrow_map(placed, write, "shard long, size long, tokens long, once long, twice long").collect()  # one per file
    base = np.full(1 << bits, -1, np.int64)
    size = tokens = 0
    for row in sorted(rows, key=lambda r: r["shard"]):
        base[row["shard"]] = size
        size, tokens = size + row["size"], tokens + row["tokens"]
    if size >= 1 << 32:
        raise ValueError("more than 2**32 different words; n-gram keys have 32 bits a word")
    once, twice = sum(r["once"] for r in rows), sum(r["twice"] for r in rows)
    return Vocabulary(root, bits, base, tokens, size, min(0.9, max(0.1, once / max(1, once + 2 * twice))), shard_tokens)


@dataclass
class Tokens:
    """Tokens of a slice with what the vocabulary knows about each; ``number`` is -1 for unknown words."""

    first: np.ndarray
    number: np.ndarray
    count: np.ndarray
    index: np.ndarray  # place in the document


def look_up(words: Words, vocabulary: Vocabulary) -> Tokens:
    hashes, first = sequence(words)
    keys, back = np.unique(hashes, return_inverse=True)
    number, count = vocabulary.find(keys)
    index = np.arange(len(hashes)) - np.repeat(first[:-1], np.diff(first))
    return Tokens(first, number[back], count[back], index)


def trigrams(t: Tokens) -> tuple[np.ndarray, np.ndarray]:
    """(pair, third): every pair of neighbours as one integer, and the word after it or ``_NONE`` at the end of a text."""
    at = np.flatnonzero(t.index > 0) - 1  # first word of each pair
    following = np.minimum(at + 2, len(t.number) - 1)
    third = np.where((at + 2 < len(t.number)) & (t.index[following] > 1), t.number[following], _NONE)
    return _joint(t.number[at], t.number[at + 1]), third.astype(np.uint32)


def _joint(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a.astype(_U) << _U(32) | b.astype(_U)


# --- where shards end -------------------------------------------------------------------------------------------


@dataclass
class Bounds:
    """The first trigram of every shard but shard 0, in order."""

    pair: np.ndarray
    third: np.ndarray

    def home(self, pair: np.ndarray) -> np.ndarray:
        """The shard that holds a pair."""
        return np.searchsorted(self.pair, pair)

    def place(self, pair: np.ndarray, third: np.ndarray) -> np.ndarray:
        """The shard that holds a trigram: its pair's, or a later one where a shard begins inside the pair."""
        return rank_among(self.pair, self.third, pair, third)


def shard_bounds(texts: DataFrame, vocabulary: Vocabulary) -> Bounds:
    """Every ``PER_SHARD``-th of a random sample of trigrams in order; one row per shard is gathered."""
    shards = -(-vocabulary.tokens // vocabulary.shard_tokens)
    if shards < 2:
        return Bounds(np.zeros(0, _U), np.zeros(0, np.int64))
    share = min(1.0, max(SAMPLE_SHARE, SAMPLE_DOCS / texts.count()))
    rate = min(1.0, PER_SHARD * shards / (vocabulary.tokens * share))

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        chance = np.random.default_rng([11, TaskContext.get().partitionId()])
        for batch in batches:
            for _, _, words in each_slice(batch.column(0), lower=True):
                pair, third = trigrams(look_up(words, vocabulary))
                chosen = (third != _NONE) & (chance.random(len(pair)) < rate)
                columns = (pair[chosen] >> _U(32), pair[chosen] & _U(0xFFFFFFFF), third[chosen])
                yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], ["u", "v", "w"])

    sample = materialize(arrow_map(texts.filter(F.rand(5) < share), draw, "u long, v long, w long"), "trigram-sample")
    rows = every(sample, ["u", "v", "w"], PER_SHARD).collect()
    found = sorted({tuple(r) for r in rows})
    u, v, w = (np.array(x, np.int64) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3
    return Bounds(_joint(u, v), w)


# --- counts of n-grams ------------------------------------------------------------------------------------------

def _squeeze(columns: list[np.ndarray]) -> bytes:
    """Columns of unsigned 32-bit numbers, byte plane by byte plane, compressed."""
    planes = b"".join(np.ascontiguousarray(c, "<u4").view(np.uint8).reshape(-1, 4).T.tobytes() for c in columns)
    return len(columns[0]).to_bytes(8, "little") + zstandard.compress(planes, 1)


def _expand(blob: bytes, many: int) -> list[np.ndarray]:
    n = int.from_bytes(blob[:8], "little")
    planes = np.frombuffer(zstandard.decompress(blob[8:]), np.uint8).reshape(many, 4, n)
    return [np.ascontiguousarray(p.T).view("<u4").ravel() for p in planes]


def ngram_blobs(texts: DataFrame, vocabulary: Vocabulary, bounds: Bounds) -> DataFrame:
    """(shard, order, blob): distinct n-grams and their counts, added up within a task before they are moved.

    Of pairs (order 2) only those at the end of a text and those whose trigram has another shard: the counts of all others are
    sums over their triples (order 3).  Triples that stand in a shard after their pair's have order 4.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        apart: list[list[np.ndarray]] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            key, third, shard = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.argsort(key)
            key = key[order]
            new = np.ones(len(key), bool)
            new[1:] = key[1:] != key[:-1]
            begins = np.flatnonzero(new)
            pair, place = key[begins], shard[order[begins]]
            number = (np.cumsum(new) - 1).astype(_U)
            third = third[order]
            last, n = np.unique(number[third == _NONE].astype(np.int64), return_counts=True)
            yield from rows(place[last], 2, [pair[last] >> _U(32), pair[last] & _U(0xFFFFFFFF), n])
            # Triples by number of their pair and third word, in one integer each.
            triple, n = np.unique((number << _U(32) | third.astype(_U))[third != _NONE], return_counts=True)
            yield from triples(3, pair, (triple >> _U(32)).astype(np.int64), triple & _U(0xFFFFFFFF), n, place)
            if apart:
                pair, third = (np.concatenate(x) for x in zip(*apart, strict=True))
                pair, number = np.unique(pair, return_inverse=True)
                triple, n = np.unique(_joint(number, third), return_counts=True)
                number, third = (triple >> _U(32)).astype(np.int64), triple & _U(0xFFFFFFFF)
                yield from triples(4, pair, number, third, n, None)

        def triples(order: int, pair: np.ndarray, number: np.ndarray, third: np.ndarray, n: np.ndarray, place: np.ndarray | None) -> Iterator[pa.RecordBatch]:
            shard = place[number] if place is not None else bounds.place(pair[number], third.astype(np.int64))
            yield from rows(shard, order, [pair[number] >> _U(32), pair[number] & _U(0xFFFFFFFF), third, n])

        def rows(place: np.ndarray, order: int, columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            cuts = [0, *(np.flatnonzero(np.diff(place)) + 1).tolist(), len(place)] if len(place) else []
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                blob = _squeeze([c[a:b] for c in columns])
                yield pa.RecordBatch.from_arrays([pa.array([int(place[a])], pa.int64()), pa.array([order], pa.int32()), pa.array([blob], pa.binary())], ["shard", "order", "blob"])

        for batch in batches:
            for _, _, words in each_slice(batch.column(0), lower=True):
                pair, third = trigrams(look_up(words, vocabulary))
                shard = bounds.home(pair)
                stray = (third != _NONE) & (bounds.place(pair, third.astype(np.int64)) != shard)
                if stray.any():
                    apart.append([pair[stray], third[stray]])
                    third[stray] = _NONE
                held.append([pair, third, shard.astype(np.int32)])
                size += len(pair)
                if size > FLUSH:
                    yield from flush()
                    held, apart, size = [], [], 0
        if size:
            yield from flush()

    return arrow_map(texts, count, "shard long, order int, blob binary")


# --- trie shards ------------------------------------------------------------------------------------------------


def _chained(values: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Ascending lists, one after the other from ``begins``, made one ascending sequence: to each list the last value of
    the one before is added, and one to each value so that no two are equal."""
    last = np.append(begins[1:], len(values)) - 1
    ends = values[last] + 1
    base = np.cumsum(ends) - ends
    return (values + 1 + np.repeat(base, np.diff(np.append(begins, len(values))))).astype(_U)


def build_pairs(shard: int, blobs: list[tuple[int, bytes]], vocabulary: Vocabulary) -> dict:
    """Write a shard's contexts and pairs, and its triples for the next step. Returns what the driver keeps of it (``_ROW``):
    its first and last context, their pairs here and their mass, its last pair, and the pair that it begins inside of."""
    root = vocabulary.root
    empty = np.zeros(0, np.uint32)

    def gathered(order: int, many: int) -> list[np.ndarray]:
        parts = [_expand(b, many) for o, b in blobs if o == order]
        return [np.concatenate(x) for x in zip(*parts, strict=True)] if parts else [empty] * many

    u, v, n = gathered(2, 3)
    ends, end_counts = _merge([(_joint(u, v), n.astype(np.int64))])
    a, b, w, m = gathered(3, 4)
    pair = _joint(a, b)
    key = np.unique(np.concatenate([pair, ends]))
    joint = _joint(np.searchsorted(key, pair), w)
    del a, b, w, pair
    joint, m = _merge([(joint, m.astype(np.int64))])
    spot, w = (joint >> _U(32)).astype(np.int64), (joint & _U(0xFFFFFFFF)).astype(np.int64)
    n = np.bincount(spot, weights=m, minlength=len(key)).astype(np.int64)
    n[np.searchsorted(key, ends)] += end_counts
    u, v = (key >> _U(32)).astype(np.int64), (key & _U(0xFFFFFFFF)).astype(np.int64)
    begins = np.concatenate([[0], np.flatnonzero(np.diff(u)) + 1]) if len(u) else np.zeros(0, np.int64)
    contexts = u[begins]
    many = np.diff(np.append(begins, len(u))) if len(u) else begins
    d = (n - DISCOUNT) / np.repeat(vocabulary.counts(contexts), many)
    mass = np.add.reduceat(d, begins) if len(u) else np.zeros(0)
    d3 = (m - DISCOUNT) / n[spot] if len(spot) else np.zeros(0)
    mass3 = np.bincount(spot, weights=d3, minlength=len(key)) if len(spot) else np.zeros(len(key))
    write_bytes(
        f"{root}/pairs-{shard}.bin",
        container(
            elias_fano(contexts, "contexts")
            | elias_fano(np.append(begins, len(u)), "pointers")
            | elias_fano(_chained(v, begins) if len(u) else v, "successors")
            | {"d": _quantise(d), "rest": _quantise(np.maximum(1 - mass, 1e-12)), "rest3": _quantise(np.maximum(1 - mass3, 1e-12))}
        ),
    )
    write_bytes(f"{root}/raw-{shard}.bin", [_squeeze([np.diff(spot, prepend=0), w, _quantise(d3)])])
    row = dict.fromkeys(_ROW, -1) | {"shard": shard, "pairs": len(u), "triples": len(w)}
    a, b, w, m = gathered(4, 4)
    if len(a):  # all of one pair: the shard's first trigram is inside it
        w, m = _merge([(w.astype(_U), m.astype(np.int64))])
        write_bytes(f"{root}/inside-{shard}.bin", [_squeeze([w, m])])
        row |= {"inside_u": int(a[0]), "inside_v": int(b[0]), "triples": row["triples"] + len(w)}
    if len(u):
        row |= {"first": int(contexts[0]), "first_pairs": int(many[0]), "first_mass": float(mass[0]), "last": int(contexts[-1]), "last_pairs": int(many[-1]), "last_mass": float(mass[-1])}
        row |= {"end_v": int(v[-1]), "end_count": int(n[-1]), "end_mass": float(mass3[-1])}
    return row


@dataclass
class Trie:
    """Files of the shards and one row about each: successors of its first context that stand in shards before, and
    weights of contexts and of pairs that are cut between shards."""

    root: str
    vocabulary: Vocabulary
    bounds: Bounds
    continued: np.ndarray  # -1 for shards without pairs
    cut_context: np.ndarray
    cut_rest: np.ndarray
    cut_pair: np.ndarray = field(default_factory=lambda: np.zeros(0, _U))
    cut_rest3: np.ndarray = field(default_factory=lambda: np.zeros(0))
    triples: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))  # by shard

    def find_pairs(self, u: np.ndarray, v: np.ndarray, shard: np.ndarray) -> dict[str, np.ndarray]:
        """For sorted (u, v): place in the shard or -1, place among all successors of u, d, weights of u and of (u, v)."""
        n = len(u)
        out = {"at": np.full(n, -1, np.int64), "place": np.full(n, -1, np.int64), "d": np.zeros(n), "rest": np.ones(n), "rest3": np.ones(n)}
        cuts = np.flatnonzero(np.diff(shard)) + 1
        for a, b in zip([0, *cuts], [*cuts, n], strict=True) if n else ():
            s = int(shard[a])
            if s >= len(self.continued) or self.continued[s] < 0:
                continue
            level = _open_pairs(f"{self.root}/pairs-{s}.bin")
            # Pairs of one context stand together: the context is looked up once.
            begins = np.concatenate([[a], a + 1 + np.flatnonzero(np.diff(u[a:b]))])
            row, known = level.contexts.successor(u[begins])
            many = np.diff(np.append(begins, b))[known]
            has = a + np.flatnonzero(np.repeat(known, np.diff(np.append(begins, b))))
            row = row[known]
            lo, hi = level.pointers.access(row).astype(np.int64), level.pointers.access(row + 1).astype(np.int64)
            base = np.where(lo > 0, level.successors.access(np.maximum(lo - 1, 0)), _U(0)) if level.successors.n else np.zeros(len(lo), _U)
            row, lo, hi, base = (np.repeat(x, many) for x in (row, lo, hi, base))
            at, found = level.successors.successor(base + v[has].astype(_U) + _U(1))
            found &= at < hi
            out["rest"][has] = _restore(level.rest[row])
            spot, at, row, lo = has[found], at[found], row[found], lo[found]
            out["at"][spot] = at
            out["place"][spot] = at - lo + np.where(row == 0, self.continued[s], 0)
            out["d"][spot] = _restore(level.d[at])
            out["rest3"][spot] = _restore(level.rest3[at])
        # A context that is cut: its weight is over all its shards, also where this one has none of its pairs.
        if len(self.cut_context):
            k = np.minimum(np.searchsorted(self.cut_context, u), len(self.cut_context) - 1)
            out["rest"] = np.where(self.cut_context[k] == u, self.cut_rest[k], out["rest"])
        if len(self.cut_pair):
            pair = _joint(u, v)
            k = np.minimum(np.searchsorted(self.cut_pair, pair), len(self.cut_pair) - 1)
            out["rest3"] = np.where(self.cut_pair[k] == pair, self.cut_rest3[k], out["rest3"])
        return out

    def find_triples(self, shard: np.ndarray, at: np.ndarray, place: np.ndarray) -> np.ndarray:
        """d of the word at ``place`` among the successors of v, in list ``at`` of ``shard``; sorted by both."""
        out = np.zeros(len(at))
        cuts = np.flatnonzero(np.diff(shard)) + 1
        for a, b in zip([0, *cuts], [*cuts, len(at)], strict=True) if len(at) else ():
            if not self.triples[shard[a]]:
                continue
            pointers, successors, d = _open_triples(f"{self.root}/triples-{int(shard[a])}.bin")
            begins = np.concatenate([[a], a + 1 + np.flatnonzero(np.diff(at[a:b]))])
            many = np.diff(np.append(begins, b))
            lo, hi = pointers.access(at[begins]).astype(np.int64), pointers.access(at[begins] + 1).astype(np.int64)
            base = np.where(lo > 0, successors.access(np.maximum(lo - 1, 0)), _U(0)) if successors.n else np.zeros(len(lo), _U)
            hi, base = np.repeat(hi, many), np.repeat(base, many)
            spot, found = successors.successor(base + place[a:b].astype(_U) + _U(1))
            found &= spot < hi
            here = np.flatnonzero(found)
            out[a + here] = _restore(d[spot[here]])
        return out


@dataclass
class _Pairs:
    contexts: EliasFano
    pointers: EliasFano
    successors: EliasFano
    d: np.ndarray
    rest: np.ndarray
    rest3: np.ndarray

    def second_words(self) -> np.ndarray:
        """The number of the second word of every pair."""
        begins = self.pointers.access(np.arange(self.contexts.n)).astype(np.int64)
        flat = self.successors.access(np.arange(self.successors.n)).astype(np.int64)
        base = np.where(begins > 0, flat[np.maximum(begins - 1, 0)], 0)
        return flat - np.repeat(base, np.diff(np.append(begins, len(flat)))) - 1


@lru_cache(maxsize=4096)
def _open_pairs(uri: str) -> _Pairs:
    x = open_container(fetch(uri))
    return _Pairs(EliasFano(x, "contexts"), EliasFano(x, "pointers"), EliasFano(x, "successors"), x["d"], x["rest"], x["rest3"])


@lru_cache(maxsize=4096)
def _open_triples(uri: str) -> tuple[EliasFano, EliasFano, np.ndarray]:
    x = open_container(fetch(uri))
    return EliasFano(x, "pointers"), EliasFano(x, "successors"), x["d"]


_ROW = (
    "shard", "pairs", "triples", "first", "first_pairs", "first_mass", "last", "last_pairs", "last_mass", "end_v", "end_count", "end_mass", "inside_u", "inside_v",
)
_ROW_SCHEMA = ", ".join(f"{n} {'double' if n.endswith('mass') else 'long'}" for n in _ROW)
_ROW_ARROW = pa.schema([(n, pa.float64() if n.endswith("mass") else pa.int64()) for n in _ROW])


def build_trie(texts: DataFrame, vocabulary: Vocabulary) -> Trie:
    """Count n-grams and write the shards, pairs first, then triples by their places among pairs."""
    spark, root = texts.sparkSession, vocabulary.root
    bounds = shard_bounds(texts, vocabulary)
    n_shards = len(bounds.pair) + 1

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, ["shard"]):
            blobs = list(zip(group["order"].to_pylist(), group["blob"].to_pylist(), strict=True))
            yield pa.RecordBatch.from_pylist([build_pairs(int(group["shard"][0].as_py()), blobs, vocabulary)], _ROW_ARROW)

    placed = ngram_blobs(texts, vocabulary, bounds).repartition(min(n_shards, 100_000), "shard").sortWithinPartitions("shard")
    rows = sorted(arrow_map(placed, pairs, _ROW_SCHEMA).collect(), key=lambda r: r["shard"])  # one per shard
    continued, n_triples = np.full(n_shards, -1, np.int64), np.zeros(n_shards, np.int64)
    cut: dict[int, float] = {}
    last, so_far, mass = -1, 0, 0.0
    for r in rows:
        n_triples[r["shard"]] = r["triples"]
        if not r["pairs"]:
            continue
        same = r["first"] == last
        continued[r["shard"]] = so_far if same else 0
        if same:
            cut[last] = mass + r["first_mass"]
        if r["first"] == r["last"]:
            so_far, mass = (so_far + r["first_pairs"], mass + r["first_mass"]) if same else (r["first_pairs"], r["first_mass"])
        else:
            so_far, mass = r["last_pairs"], r["last_mass"]
        last = r["last"]
    # A frequent context may be cut and have pairs that stay in one of its shards only.
    for r in rows:
        for name in ("first", "last"):
            if r["pairs"]:
                cut.setdefault(r[name], r[f"{name}_mass"])
    context = np.array(sorted(cut), np.int64)
    trie = Trie(root, vocabulary, bounds, continued, context, np.array([max(1 - cut[c], 1e-12) for c in context.tolist()]), triples=n_triples)
    # A pair that goes on in later shards is the last one of its own: its count, and its mass there.
    ends = {(r["last"], r["end_v"]): r for r in rows if r["pairs"]}
    inside = {r["shard"]: (r["inside_u"], r["inside_v"]) for r in rows if r["inside_u"] >= 0}
    counts = {shard: ends[pair]["end_count"] for shard, pair in inside.items()}
    live = [(r["shard"], counts.get(r["shard"], 0)) for r in rows if r["triples"]]

    def triples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_build_triples(s, n, trie) for s, n in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.float64())], ["shard", "mass"])

    wanted = spark.createDataFrame(live, "shard long, n long").repartition(max(1, len(live)), "shard")
    masses: dict[tuple, float] = {}
    for r in arrow_map(wanted, triples, "shard long, mass double").collect():
        if r["shard"] in inside:
            pair = inside[r["shard"]]
            masses[pair] = masses.get(pair, ends[pair]["end_mass"]) + r["mass"]
    chosen = sorted(masses)
    trie.cut_pair = _joint(*(np.array(x, np.int64) for x in zip(*chosen, strict=True))) if chosen else trie.cut_pair
    trie.cut_rest3 = np.array([max(1 - masses[p], 1e-12) for p in chosen])
    return trie


def _build_triples(shard: int, inside_count: int, trie: Trie) -> float:
    """Write a shard's triples; returns the mass of those of the pair that it begins inside of, whose count is given."""
    with open(fetch(f"{trie.root}/raw-{shard}.bin"), "rb") as raw:
        spot, w, d = _expand(raw.read(), 3)
    pairs = _open_pairs(f"{trie.root}/pairs-{shard}.bin")
    spot, mass = np.cumsum(spot, dtype=np.int64), 0.0
    v = pairs.second_words()[spot] if len(spot) else np.zeros(0, np.int64)
    if inside_count:
        with open(fetch(f"{trie.root}/inside-{shard}.bin"), "rb") as raw:
            more, m = _expand(raw.read(), 2)
        own = (m - DISCOUNT) / inside_count
        mass = float(own.sum())
        v = np.concatenate([np.full(len(more), int(trie.bounds.pair[shard - 1] & _U(0xFFFFFFFF))), v])
        spot, w, d = np.concatenate([np.full(len(more), -1), spot]), np.concatenate([more, w]), np.concatenate([_quantise(own), d])
    place = np.zeros(0, np.int64)
    if len(spot):
        key, back = np.unique(_joint(v, w), return_inverse=True)
        parts = []
        for lo in range(0, len(key), LOOK_UP):
            some = key[lo : lo + LOOK_UP]
            a, b = (some >> _U(32)).astype(np.int64), (some & _U(0xFFFFFFFF)).astype(np.int64)
            parts.append(trie.find_pairs(a, b, trie.bounds.home(some))["place"])
        place = np.concatenate(parts)[back]
    begins = np.concatenate([[0], np.flatnonzero(np.diff(spot)) + 1]) if len(spot) else np.zeros(0, np.int64)
    pointers = np.searchsorted(spot, np.arange(-1, len(pairs.d) + 1))
    write_bytes(
        f"{trie.root}/triples-{shard}.bin",
        container(elias_fano(pointers, "pointers") | elias_fano(_chained(place, begins) if len(spot) else place, "successors") | {"d": d.astype(np.uint16)}),
    )
    return mass


# --- scoring ----------------------------------------------------------------------------------------------------


def score_slice(words: Words, trie: Trie) -> dict[str, np.ndarray]:
    """Per document: tokens, known tokens, base score and the model's log10 probability."""
    vocabulary = trie.vocabulary
    t = look_up(words, vocabulary)
    many = np.diff(t.first)
    doc = np.repeat(np.arange(len(many)), many)
    total, size = vocabulary.tokens, vocabulary.size
    known = t.number >= 0
    if total:
        p = np.where(known, (t.count - vocabulary.discount) / total, vocabulary.discount * size / total)
    else:
        p = np.ones(len(doc))
    at = np.flatnonzero((t.index > 0) & np.concatenate([[False], known[:-1]])) if len(doc) else np.zeros(0, np.int64)
    pair_of = np.full(len(doc), -1, np.int64)
    d2, rest, rest3 = np.zeros(len(doc)), np.ones(len(doc)), np.ones(len(doc))
    # Pairs whose second word is unknown still tell the weight of their context: it is asked with the context's own number.
    key, back = np.unique(_joint(t.number[at - 1], np.where(known[at], t.number[at], _NONE)), return_inverse=True)
    ku, kv = (key >> _U(32)).astype(np.int64), (key & _U(0xFFFFFFFF)).astype(np.int64)
    shard = trie.bounds.home(key)
    found = trie.find_pairs(ku, kv, shard)
    pair_of[at] = back
    d2[at], rest[at], rest3[at] = found["d"][back], found["rest"][back], found["rest3"][back]
    p2 = d2 + rest * p
    # The pair of the two words before, and the place of this word after the last of them.
    third = np.flatnonzero(t.index > 1)
    before, here = pair_of[third - 1], pair_of[third]
    stored = lambda k: (k >= 0) & (found["at"][k] >= 0) if len(key) else np.zeros(len(k), bool)
    live = stored(before)
    third, before, here = third[live], before[live], here[live]
    out = p2.copy()
    out[third] = rest3[third - 1] * p2[third]
    ask = np.flatnonzero(stored(here))
    if len(ask):
        joint, back3 = np.unique(_joint(before[ask], here[ask]), return_inverse=True)
        a, b = (joint >> _U(32)).astype(np.int64), (joint & _U(0xFFFFFFFF)).astype(np.int64)
        where = trie.bounds.place(key[a], kv[b])
        out[third[ask]] += trie.find_triples(where, np.where(where == shard[a], found["at"][a] + 1, 0), found["place"][b])[back3]
    base = np.log10((t.count + 1) / (total + 1 * (size + 1)))
    add = lambda x: np.bincount(doc, weights=x, minlength=len(many))
    return {"n_tokens": many.astype(np.int64), "n_known": add(known).astype(np.int64), "base_score": add(base), "score": add(np.log10(out))}


def held_out() -> F.Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 7 == 2


def train_model(texts: DataFrame, shard_tokens: int = SHARD_TOKENS, vocabulary_shard: int = VOCABULARY_SHARD) -> Trie:
    """Fit the model on the column ``text``."""
    root = new_path(texts.sparkSession, "language-model")
    texts = texts.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    vocabulary = build_vocabulary(texts, root, shard_tokens, vocabulary_shard)
    if not vocabulary.tokens:
        none = np.zeros(0, np.int64)
        return Trie(root, vocabulary, Bounds(none.astype(_U), none), none, none, np.zeros(0))
    return build_trie(texts, vocabulary)


def score(docs: DataFrame, trie: Trie) -> DataFrame:
    """(doc_id, n_tokens, n_known, base_score, score) of whole texts."""
    shared = docs.sparkSession.sparkContext.broadcast(trie)  # paths and one number or two per shard

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for lo, hi, words in each_slice(batch.column(1), lower=True):
                found = score_slice(words, model)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *map(pa.array, found.values())], ["doc_id", *found])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return arrow_map(rows, run, "doc_id long, n_tokens long, n_known long, base_score double, score double")


def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all ``documents`` by a model of those whose id's crc32 is not 2 modulo 7."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    trie = train_model(docs.filter(~held_out()))
    return score(docs, trie).select(
        "doc_id", held_out().alias("held_out"), "n_tokens", "n_known", F.lit(trie.vocabulary.tokens).cast("long").alias("train_tokens"), "base_score", "score"
    )
