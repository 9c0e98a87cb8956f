"""Best-fit packing of token sequences by a configuration linear program.

Texts longer than a sequence are cut into full pieces and a rest; nothing else is cut.
The number of pieces of each length is a histogram of at most ``capacity`` rows, whatever the
corpus.  Over it the configuration program (fewest sequences such that every piece has a slot)
is solved by multiplicative weights: lengths still in need of slots weigh more, and a knapsack
by dynamic programming finds the most valuable configuration for the weights, in whole sequences.  When the program
finds no full configuration any more, or nearly all is placed, best-fit packs the rest from the longest down
(measured shares are in the README).  Pieces take their slots by their rank among the
pieces of the same length, which is counted per partition and summed, so no length is
gathered in one task, however many pieces share it.

Defined cases: a null text is empty and has the end id alone; a very long text is cut into as many pieces as it takes;
rows with an equal ``doc_id`` are packed separately; pieces of equal length are alike and take slots in the order in which
they were written; an empty table gives no rows; other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.store import arrow_map, materialize
from tessera.llm.tokens import default_tokenizer, encode_texts, ids_crc32

CAPACITY = 4096
PIECE_SCHEMA = "part int, doc_id long, piece int, start long, length long, ids_crc32 long, rank long"


def token_pieces(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None) -> DataFrame:
    """One row per piece of at most ``capacity`` ids; ``rank`` counts equal lengths within the task ``part``."""
    vocabulary = tokenizer or default_tokenizer()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            for lo, hi, ids, sizes in encode_texts(batch.column(1), vocabulary):
                pieces = -(-sizes // capacity)
                doc = np.repeat(np.arange(hi - lo), pieces)
                number = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                start = number * capacity
                length = np.minimum(sizes[doc] - start, capacity)
                at = (np.cumsum(sizes) - sizes)[doc] + start
                sums = [ids_crc32(ids[a : a + n]) for a, n in zip(at.tolist(), length.tolist(), strict=True)]
                order = np.argsort(length, kind="stable")
                rank = np.empty(len(length), np.int64)
                group = np.concatenate([[0], np.flatnonzero(np.diff(length[order])) + 1])
                rank[order] = np.arange(len(length)) - np.repeat(group, np.diff(np.append(group, len(length))))
                rank += seen[length]
                seen += np.bincount(length, minlength=capacity + 1)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(doc), part, np.int32)),
                        batch.column(0).slice(lo, hi - lo).take(pa.array(doc)),
                        pa.array(number.astype(np.int32)),
                        pa.array(start),
                        pa.array(length),
                        pa.array(sums, pa.int64()),
                        pa.array(rank),
                    ],
                    ["part", "doc_id", "piece", "start", "length", "ids_crc32", "rank"],
                )

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return arrow_map(texts, cut, PIECE_SCHEMA)


#: Cells of the capacity that the knapsack is solved on; lengths are rounded up to them, and what that leaves open is filled exactly.
CELLS = 256
#: The program goes on until so much of the tokens has a slot; best-fit packs the last ones.
PLACED = 0.97


def knapsack(lengths: np.ndarray, weights: np.ndarray, limits: np.ndarray, capacity: int) -> np.ndarray:
    """Most valuable number of pieces of each length within ``capacity``: an unbounded knapsack by dynamic programming over cells
    of the capacity, each with the most valuable length that fills it; then no more of a length than ``limits``."""
    width = -(-capacity // CELLS)
    live = np.flatnonzero(limits > 0)
    cell = -(-lengths[live] // width)
    order = np.lexsort((-weights[live], cell))
    sizes, first = np.unique(cell[order], return_index=True)
    best = live[order[first]]
    worth = weights[best]
    keep = worth > np.concatenate([[-1.0], np.maximum.accumulate(worth)[:-1]])  # a longer piece must be worth more
    sizes, best, worth = sizes[keep], best[keep], worth[keep]
    rooms = capacity // width
    value, choice = np.zeros(rooms + 1), np.full(rooms + 1, -1)
    upto = np.searchsorted(sizes, np.arange(rooms + 1), "right")
    for room in range(1, rooms + 1):
        k = upto[room]
        value[room] = value[room - 1]
        if k:
            gain = value[room - sizes[:k]] + worth[:k]
            top = gain.argmax()
            if gain[top] > value[room]:
                value[room], choice[room] = gain[top], top
    counts, room = np.zeros(len(lengths), np.int64), rooms
    while room > 0:
        if choice[room] < 0:
            room -= 1
            continue
        i = best[choice[room]]
        if counts[i] < limits[i]:
            counts[i] += 1
        room -= int(sizes[choice[room]])
    return counts


def best_configuration(lengths: np.ndarray, weights: np.ndarray, limits: np.ndarray, capacity: int) -> np.ndarray:
    """The knapsack's configuration, filled up: its two shortest pieces give way to the one or two most valuable ones that leave
    no room, if there are any."""
    counts = knapsack(lengths, weights, limits, capacity)
    pieces = np.sort(np.repeat(np.arange(len(lengths)), counts))[::-1]
    room = capacity - int(counts @ lengths)
    for drop in pieces[-2:][::-1] if room else ():
        counts[drop] -= 1
        room += int(lengths[drop])
    if room:
        counts = _fill(counts, room, lengths, weights, limits, capacity)
    return counts


def _fill(counts: np.ndarray, room: int, lengths: np.ndarray, weights: np.ndarray, limits: np.ndarray, capacity: int) -> np.ndarray:
    """``counts`` with the one or two most valuable pieces more that leave no room, or else with the longest ones that fit."""
    left = limits - counts
    number, value = np.full(room + 1, -1), np.full(room + 1, -np.inf)
    fit = np.flatnonzero((left > 0) & (lengths <= room))
    number[lengths[fit]], value[lengths[fit]] = fit, weights[fit]
    value[0] = 0.0
    both = value + value[::-1]
    if room % 2 == 0 and number[room // 2] >= 0 and left[number[room // 2]] < 2:
        both[room // 2] = -np.inf
    top = int(both.argmax())
    if np.isfinite(both[top]):
        for size in (top, room - top):
            if size:
                counts[number[size]] += 1
        return counts
    for i in fit[np.argsort(-lengths[fit])]:
        more = min(room // int(lengths[i]), int(left[i]))
        counts[i] += more
        room -= more * int(lengths[i])
    return counts


def solve_configurations(lengths: np.ndarray, counts: np.ndarray, capacity: int, eta: float = 8.0) -> list[tuple[dict[int, int], int]]:
    """Configurations (pieces by number of length) and how many sequences use each; together they hold every piece exactly once.

    Multiplicative weights over the covering constraints of the configuration program: a length
    is worth its share of a sequence times ``exp(-eta * share of its pieces that have a slot)``, and each round
    adds the configuration that is worth most, for as many whole sequences as its scarcest length has pieces left for, one at
    least.  No length gets more slots than pieces.  The rounds end when ``PLACED`` of all tokens have slots, or no
    configuration is full any more; the rest is packed best-fit.  Where lengths are few the program may use up the pieces
    that best-fit needs for the last room, so its last rounds are taken back by quarters as long as that saves sequences.
    """
    share, left = lengths / capacity, counts.astype(np.int64).copy()
    found: list[tuple[dict[int, int], int]] = []
    goal = (1 - PLACED) * float(counts @ lengths)
    while len(lengths) and left @ lengths > goal:
        covered = 1 - left / counts
        config = best_configuration(lengths, share * np.exp(-eta * (covered - covered.min())), left, capacity)
        used = np.flatnonzero(config)
        if config @ lengths < capacity:
            break
        times = int((left[used] // config[used]).min())
        found.append((dict(zip(used.tolist(), config[used].tolist(), strict=True)), times))
        left -= config * times
    best = None
    for quarters in range(4, -1, -1):
        cut = len(found) * quarters // 4
        rest = counts.astype(np.int64).copy()
        for config, times in found[:cut]:
            for i, n in config.items():
                rest[i] -= n * times
        last = best_fit(lengths, rest, capacity)
        used = sum(times for _, times in found[:cut]) + sum(times for _, times in last)
        if best is None or used < best[0]:
            best = used, cut, last
    merged: dict[tuple, int] = {}
    for config, times in found[: best[1]] + best[2]:
        key = tuple(sorted(config.items()))
        merged[key] = merged.get(key, 0) + times
    return [(dict(key), times) for key, times in merged.items()]


def best_fit(lengths: np.ndarray, counts: np.ndarray, capacity: int) -> list[tuple[dict[int, int], int]]:
    """Best-fit decreasing over what is left.  Sequences filled alike are handled together: ``open_`` maps
    the room left to the kinds of sequences that have it."""
    open_: dict[int, list[list]] = {}
    rooms = np.zeros(capacity + 1, np.int64)
    for i in np.argsort(lengths)[::-1].tolist():
        size, todo = int(lengths[i]), int(counts[i])
        while todo:
            fit = np.flatnonzero(rooms[size:])
            if not len(fit):
                per = capacity // size
                full, rest = divmod(todo, per)
                for many, times in ((per, full), (rest, 1 if rest else 0)):
                    if times:
                        open_.setdefault(capacity - many * size, []).append([{i: many}, times])
                        rooms[capacity - many * size] += times
                break
            room = size + int(fit[0])
            kind, times = open_[room].pop()
            per = min(room // size, todo)
            use = min(times, todo // per)
            if use < times:
                open_[room].append([kind, times - use])
            rooms[room] -= use
            open_.setdefault(room - per * size, []).append([{**kind, i: kind.get(i, 0) + per}, use])
            rooms[room - per * size] += use
            todo -= per * use
    return [(kind, times) for kinds in open_.values() for kind, times in kinds]


def slot_table(lengths: np.ndarray, configurations: list[tuple[dict[int, int], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, one past the last, slots per sequence, first sequence, offset of its first slot)."""
    rows, taken, sequence = [], np.zeros(len(lengths), np.int64), 0
    for config, times in configurations:
        offset = 0
        for i, many in sorted(config.items()):
            rows.append((int(lengths[i]), int(taken[i]), int(taken[i] + many * times), many, sequence, offset))
            taken[i] += many * times
            offset += many * int(lengths[i])
        sequence += times
    return rows


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to the rows of :func:`token_pieces` (written, so that ranks stay)."""
    spark = pieces.sparkSession
    counts = pieces.groupBy("length", "part").agg((F.max("rank") + 1).alias("n"))
    counts = materialize(counts, "piece-counts")
    histogram = counts.groupBy("length").agg(F.sum("n").alias("n")).orderBy("length").collect()  # at most `capacity` rows
    lengths = np.array([r["length"] for r in histogram], np.int64)
    totals = np.array([r["n"] for r in histogram], np.int64)
    slots = slot_table(lengths, solve_configurations(lengths, totals, capacity)) if len(lengths) else []
    # Rank of a piece among all of its length: those of earlier partitions come first.
    # Rows here are (length, part): few per part, and counted before they are moved.
    from pyspark.sql import Window

    before = counts.select(
        "length", "part", (F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).alias("before")
    )
    table: dict[int, list] = {}
    for length, lo, hi, many, sequence, offset in slots:
        table.setdefault(length, []).append((lo, hi, many, sequence, offset))
    packed = {k: np.array(v, np.int64) for k, v in table.items()}
    shared = spark.sparkContext.broadcast(packed)  # bounded by lengths times configurations, not by documents

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("rank").to_numpy()
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            order = np.argsort(length, kind="stable")
            cuts = np.flatnonzero(np.diff(length[order])) + 1
            for at in np.split(order, cuts) if len(order) else []:
                rows = shared.value[int(length[at[0]])]
                k = np.searchsorted(rows[:, 0], rank[at], "right") - 1
                inside = rank[at] - rows[k, 0]
                sequence[at] = rows[k, 3] + inside // rows[k, 2]
                offset[at] = rows[k, 4] + inside % rows[k, 2] * length[at]
            columns = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(sequence), pa.array(offset)],
                ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    # Lengths times tasks is no bound to broadcast on: a merge join, whatever the size.
    ranked = pieces.join(before.hint("merge"), ["length", "part"]).withColumn("rank", F.col("rank") + F.col("before")).drop("before", "part")
    return arrow_map(ranked, place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None) -> DataFrame:
    """Pack whole documents (doc_id, text) into sequences of at most ``capacity`` tokens."""
    return pack(materialize(token_pieces(docs, capacity, tokenizer), "pieces"), capacity)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` packed into sequences of 4096 tokens."""
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
