"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals.

Features of a token are its word and its first four and five bytes.  Fitting uses a bounded random sample of labelled rows that
may be learnt from, ``SAMPLE_TOXIC`` toxic and ``SAMPLE_CLEAN`` other ones, whatever their texts' lengths.  How many documents of
each class hold a feature is counted over the sample in the cluster; features whose counts differ significantly between
the classes are the model's vocabulary (``MOST_FEATURES`` at most), and a token of a toxic document is labelled toxic if
one of its features speaks for that class.  The sample's texts give stretches of up to ``SPAN`` tokens, none of which runs over a
document's end; of these ``STRETCHES`` with a toxic token and as many of any kind are drawn by a hash.
The field's weights maximise the regularised likelihood of these labelled tokens by forward-backward gradients.
The driver holds the chosen features, the drawn stretches and two figures for each row of the sample, whatever the texts' lengths.

Scoring runs forward-backward over whole texts.  Tokens without a feature all have the same potentials, so
a run of k of them is the k-th power of one 2 x 2 matrix, taken in closed form; the chain is walked
from one token with a feature to the next, which gives the same marginals as token by token.
The greatest marginal and the sum of marginals give the score by a logistic calibration.

Defined cases: a null or empty text gets the score of a text without any feature; a very long text is learnt from and scored
whole; rows with the same id are scored alike, and so are equal texts; without labels of both classes every score is the share of
toxic labels (0 without labels); where a document has several labels the greatest counts and null labels are ignored; features with
equal ratios are taken in the order of their hashes; an empty table has no scores; other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.store import arrow_map, materialize
from tessera.llm.words import Words, each_slice, mix

#: Labelled rows that the field and its calibration are fitted to, at most.
SAMPLE_TOXIC, SAMPLE_CLEAN = 4000, 8000
#: Of these rows' stretches of SPAN tokens, so many with a toxic token and so many of any kind, at most.
STRETCHES, SPAN = 6000, 96
#: A feature's least documents and least log-likelihood ratio, and how many features are kept.
LEAST_DOCS, LEAST_RATIO, MOST_FEATURES = 5, 20.0, 4096
PREFIXES = (4, 5)
#: Features that a task holds before it adds them up and sends them on.
COUNTED = 1 << 20
DECISION = 0.3
#: Tokens of a chain that are taken as one while it is walked.
RUN = 32


def token_features(words: Words) -> np.ndarray:
    """Hashes of each token's features, tokens by kinds; 0 where a word is too short for the kind."""
    return words.prefixes(PREFIXES)


@dataclass
class Field:
    """Weights of the label "toxic" against "clean": of features, of a token as such, and of transitions."""

    keys: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    bias: float = -6.0
    moves: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    calibration: np.ndarray = field(default_factory=lambda: np.array([0.0, 0.0, 0.0]))

    def emissions(self, features: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(token has a feature of the vocabulary, sum of its features' weights)."""
        if not len(self.keys):
            return np.zeros(len(features), bool), np.zeros(len(features))
        spot = np.minimum(np.searchsorted(self.keys, features), len(self.keys) - 1)
        known = self.keys[spot] == features
        return known.any(axis=1), np.where(known, self.weights[spot], 0.0).sum(axis=1)

    def marginals(self, doc: np.ndarray, position: np.ndarray, weight: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Probability of "toxic" at the given tokens (sorted by document and position) of documents of ``counts`` tokens."""
        n = len(doc)
        if not n:
            return np.zeros(0)
        move = np.exp(self.moves)
        plain = move * np.array([1.0, np.exp(self.bias)])
        values, vectors = np.linalg.eig(plain)
        order = np.argsort(-values.real)
        values, vectors = values.real[order], vectors.real[:, order]
        back = np.linalg.inv(vectors)
        main, rest = np.outer(vectors[:, 0], back[0]), np.outer(vectors[:, 1], back[1])
        ratio = values[1] / values[0]

        def power(k: np.ndarray) -> np.ndarray:
            """Matrices of k tokens without a feature, up to a factor."""
            out = main[None] + (np.sign(ratio) ** k * np.exp(k * np.log(max(abs(ratio), 1e-300))))[:, None, None] * rest[None]
            out[k == 0] = np.eye(2)
            return np.maximum(out, 0.0)

        begins = np.concatenate([[0], np.flatnonzero(np.diff(doc)) + 1])
        many = np.diff(np.append(begins, n))
        index = np.arange(n) - np.repeat(begins, many)
        before = np.where(index == 0, position, position - np.roll(position, 1) - 1)
        gap = power(before)
        # One step of the chain: the gap before a token, the move into it and its potential.
        step = gap @ move * np.stack([np.ones(n), np.exp(self.bias + weight)], axis=1)[:, None, :]
        ends = begins + many - 1
        last = power(counts[doc[ends]] - position[ends] - 1).sum(axis=2)
        left, right = _scan(step, index, np.array([1.0, 0.0]), last)
        both = left * right
        return both[:, 1] / both.sum(axis=1)

    def score(self, best: np.ndarray, total: np.ndarray) -> np.ndarray:
        """Document scores from the greatest marginal and the sum of marginals."""
        return 1 / (1 + np.exp(-(_evidence(best, total) @ self.calibration)))


def _scan(step: np.ndarray, index: np.ndarray, start: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward and backward vectors, up to factors, of chains of 2 x 2 matrices; ``index`` is a matrix's place in its chain, ``last``
    has the vector behind the end of each chain.

    Chains are cut into runs of ``RUN`` matrices. Products inside all runs are taken side by side, then the vectors at their
    ends chain by chain, so a long chain takes about ``RUN`` steps and one for each of its runs.
    """
    n, place = len(step), index % RUN
    run = np.cumsum(place == 0) - 1
    first = np.flatnonzero(place == 0)
    stop = np.append(first[1:], n) - 1
    level = lambda x: x / x.sum(axis=tuple(range(1, x.ndim)), keepdims=True)
    before, after = level(step), level(step)
    order = np.argsort(place, kind="stable")
    cuts = np.searchsorted(place[order], np.arange(int(place.max()) + 2))
    for k in range(1, int(place.max()) + 1):
        at = order[cuts[k] : cuts[k + 1]]
        before[at] = level(before[at - 1] @ step[at])
    back = stop[run] - np.arange(n)  # places to the end of the run
    order = np.argsort(back, kind="stable")
    cuts = np.searchsorted(back[order], np.arange(int(back.max()) + 2))
    for k in range(1, int(back.max()) + 1):
        at = order[cuts[k] : cuts[k + 1]]
        after[at] = level(step[at] @ after[at + 1])
    # Runs of a chain one after the other, all chains side by side.
    head = np.flatnonzero(index[first] == 0)
    runs = np.diff(np.append(head, len(first)))
    enter, leave = np.tile(start, (len(first), 1)), np.zeros((len(first), 2))
    leave[head + runs - 1] = level(last)
    for k in range(1, int(runs.max())):
        at = head[runs > k] + k
        enter[at] = level(np.einsum("ni,nij->nj", enter[at - 1], before[stop[at - 1]]))
        at = (head + runs)[runs > k] - 1 - k
        leave[at] = level(np.einsum("nij,nj->ni", after[first[at + 1]], leave[at + 1]))
    left = level(np.einsum("ni,nij->nj", enter[run], before))
    right, inner = leave[run], np.flatnonzero(back > 0)
    right[inner] = level(np.einsum("nij,nj->ni", after[inner + 1], leave[run[inner]]))
    return left, right


def _evidence(best: np.ndarray, total: np.ndarray) -> np.ndarray:
    clipped = np.clip(best, 1e-4, 1 - 1e-4)
    return np.stack([np.ones(len(best)), np.log(clipped / (1 - clipped)), np.log1p(total)], axis=1)


def feature_counts(texts: DataFrame) -> DataFrame:
    """(feature, total, hits): documents of ``texts`` (text, toxic) that hold a feature, and the toxic ones of these."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def out() -> pa.RecordBatch:
            key, hit = (np.concatenate(x) for x in zip(*held, strict=True))
            names, back, total = np.unique(key, return_inverse=True, return_counts=True)
            hits = np.bincount(back, hit, len(names)).astype(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(names.view(np.int64)), pa.array(total), pa.array(hits)], ["feature", "total", "hits"])

        for batch in batches:
            toxic = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            for lo, _, words in each_slice(batch.column(0), lower=True):
                features = token_features(words)
                for d, (a, b) in enumerate(zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True)):
                    key = np.unique(features[a:b])
                    key = key[key != 0]
                    held.append((key, np.full(len(key), toxic[lo + d])))
                if sum(len(k) for k, _ in held) > COUNTED:
                    yield out()
                    held = []
        if held:
            yield out()

    return arrow_map(texts, count, "feature long, total long, hits long").groupBy("feature").agg(F.sum("total").alias("total"), F.sum("hits").alias("hits"))


def significant_features(counts: DataFrame, n1: int, n0: int) -> tuple[np.ndarray, np.ndarray]:
    """(keys, speaks for toxic) of the features whose document counts differ most between ``n1`` toxic and ``n0`` other documents."""
    share, miss = n1 / (n1 + n0), F.col("total") - F.col("hits")
    part = lambda n, p: F.when(n > 0, n * F.log(n / (F.col("total") * p))).otherwise(0.0)
    ratio = 2 * (part(F.col("hits"), share) + part(miss, 1 - share))
    # "Speaks for": ten times likelier in a toxic document.
    speaks = (F.col("hits") + 0.5) / (n1 + 1) > 10 * (miss + 0.5) / (n0 + 1)
    chosen = counts.filter(F.col("total") >= LEAST_DOCS).select("feature", F.round(ratio, 9).alias("ratio"), speaks.alias("speaks")).filter(F.col("ratio") >= LEAST_RATIO)
    rows = chosen.orderBy(F.col("ratio").desc(), "feature").limit(MOST_FEATURES).collect()
    keys, speaks = np.array([r["feature"] for r in rows], np.int64).view(np.uint64), np.array([r["speaks"] for r in rows], bool)
    order = np.argsort(keys)
    return keys[order], speaks[order]


def label_tokens(words: Words, toxic: np.ndarray, keys: np.ndarray, speaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(numbers of each token's features, -1 for none; token is labelled toxic)."""
    features = token_features(words)
    spot = np.minimum(np.searchsorted(keys, features), len(keys) - 1)
    hit = keys[spot] == features
    return np.where(hit, spot, -1).astype(np.int32), (hit & speaks[spot]).any(axis=1) & toxic[words.doc_of()]


def stretches(texts: DataFrame, keys: np.ndarray, speaks: np.ndarray) -> DataFrame:
    """(draw, hot, slots): the stretches of ``texts`` (doc_id, text, toxic), a random number for each, and whether it has a toxic token;
    ``slots`` has for each token its features' numbers and its label."""
    kinds = 1 + len(PREFIXES)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = pc.fill_null(batch.column(0), 0).to_numpy().astype(np.int64).view(np.uint64)
            toxic = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
            for lo, hi, words in each_slice(batch.column(1), lower=True):
                if not len(words.starts):
                    continue
                known, label = label_tokens(words, toxic[lo:hi], keys, speaks)
                inside = np.arange(len(label)) - np.repeat(words.first[:-1], words.counts())
                begins = np.flatnonzero(inside % SPAN == 0)
                hot = np.add.reduceat(label, begins) > 0
                draw = mix(mix(ids[lo:hi][words.doc_of()[begins]]) + inside[begins].astype(np.uint64))
                flat = np.concatenate([known, label[:, None].astype(np.int32)], axis=1).ravel()
                ends = (np.append(begins, len(label)) * (kinds + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array((draw >> np.uint64(1)).astype(np.int64)), pa.array(hot), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], ["draw", "hot", "slots"]
                )

    return arrow_map(texts, cut, "draw long, hot boolean, slots array<int>")


def likelihood(theta: np.ndarray, slots: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[float, np.ndarray]:
    """(log-likelihood of the labels, its gradient).  ``theta`` is feature weights, the bias, and moves; ``slots`` (steps, stretches,
    kinds) are feature numbers, the number of the last one and one more for none; ``weight`` is 1 for tokens and 0 beyond a stretch's end."""
    size = len(theta) - 5
    steps, batch = label.shape
    weights = np.append(theta[:size], 0.0)
    score = weights[slots].sum(axis=2) + theta[size]
    move = np.exp(theta[size + 1 :].reshape(2, 2))
    potential = np.ones((steps, batch, 2))
    potential[:, :, 1] = np.exp(np.clip(score, -30, 30))
    left, right, norm = np.zeros_like(potential), np.ones_like(potential), np.ones((steps, batch, 1))
    live = weight[:, :, None] > 0
    for t in range(steps):
        now = potential[t] if t == 0 else left[t - 1] @ move * potential[t]
        norm[t] = np.where(live[t], now.sum(axis=1, keepdims=True), 1.0)
        # Beyond the end nothing changes.
        left[t] = now / norm[t] if t == 0 else np.where(live[t], now / norm[t], left[t - 1])
    for t in range(steps - 2, -1, -1):
        right[t] = np.where(live[t + 1], (potential[t + 1] * right[t + 1]) @ move.T / norm[t + 1], right[t + 1])
    toxic = (left * right)[:, :, 1] * weight
    truth, joined = label * weight, weight[1:]
    gap = truth - toxic
    gradient = np.zeros(len(theta))
    gradient[: size + 1] = np.bincount(slots.ravel(), np.repeat(gap.ravel(), slots.shape[2]), size + 1)
    gradient[size] = gap.sum()
    value = (score * truth).sum() - np.log(norm).sum()
    for i in range(2):
        for j in range(2):
            had = ((label[:-1] == i) & (label[1:] == j)) * joined
            both = left[:-1, :, i] * move[i, j] * (potential * right)[1:, :, j] / norm[1:, :, 0] * joined
            gradient[size + 1 + 2 * i + j] = had.sum() - both.sum()
            value += theta[size + 1 + 2 * i + j] * had.sum()
    return float(value), gradient


def fit_chain(flat: list[np.ndarray], keys: np.ndarray, rounds: int = 80, ridge: float = 1e-3) -> Field:
    """Weights by gradient ascent (Adam) over stretches, each an array of tokens by feature numbers and label."""
    size, kinds = len(keys), 1 + len(PREFIXES)
    slots = np.full((SPAN, len(flat), kinds), size, np.int32)
    label, weight = np.zeros((SPAN, len(flat)), np.int64), np.zeros((SPAN, len(flat)))
    for k, x in enumerate(flat):
        x = x.reshape(-1, kinds + 1)
        slots[: len(x), k] = np.where(x[:, :kinds] >= 0, x[:, :kinds], size)
        label[: len(x), k], weight[: len(x), k] = x[:, kinds], 1.0
    theta = np.zeros(size + 1 + 4)
    theta[size] = -4.0
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    for r in range(1, rounds + 1):
        gradient = likelihood(theta, slots, label, weight)[1] / len(flat) - ridge * theta
        first, second = 0.9 * first + 0.1 * gradient, 0.99 * second + 0.01 * gradient**2
        theta += 0.25 * (first / (1 - 0.9**r)) / (np.sqrt(second / (1 - 0.99**r)) + 1e-8)
    return Field(keys, theta[:size], float(theta[size]), theta[size + 1 :].reshape(2, 2))


def calibrate(evidence: np.ndarray, toxic: np.ndarray, share: float) -> np.ndarray:
    """Logistic weights by Newton's method; classes are weighted to their shares among all labels."""
    weight = np.where(toxic, share / max(toxic.mean(), 1e-9), (1 - share) / max(1 - toxic.mean(), 1e-9))
    theta = np.zeros(evidence.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(evidence @ theta, -30, 30)))
        gradient = evidence.T @ (weight * (toxic - p)) - 1e-2 * theta
        curve = (evidence * (weight * p * (1 - p))[:, None]).T @ evidence + 1e-2 * np.eye(len(theta))
        move = np.linalg.solve(curve, gradient)
        theta += np.clip(move, -2, 2)
        if np.abs(move).max() < 1e-8:
            break
    return theta


def document_evidence(model: Field, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(greatest marginal, sum of marginals) per document, and (token, marginal) of tokens with a feature."""
    known, weight = model.emissions(token_features(words)) if len(words.starts) else (np.zeros(0, bool), np.zeros(0))
    token = np.flatnonzero(known)
    doc = words.doc_of()[token]
    p = model.marginals(doc, token - words.first[doc], weight[token], words.counts())
    best, total = np.zeros(words.n_docs), np.zeros(words.n_docs)
    np.maximum.at(best, doc, p)
    np.add.at(total, doc, p)
    return best, total, token, p


def learnable() -> F.Column:
    """Rows whose labels may be learnt: crc32 of the id as text is not 2 modulo 4."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 != 2, F.lit(False))


def sampled(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, float]:
    """(doc_id, text, toxic) of the bounded sample of the labelled rows that may be learnt from, and the share of toxic ones among all such rows."""
    known = labels.filter(F.col("toxic").isNotNull() & learnable()).groupBy("doc_id").agg((F.max("toxic") > 0).alias("toxic"))
    share = known.agg(F.avg(F.col("toxic").cast("int")).alias("share")).first()["share"] or 0.0
    draw = F.xxhash64(F.lit(11), "doc_id")
    known = known.join(docs.select("doc_id"), "doc_id", "left_semi")
    parts = [known.filter(F.col("toxic") == y).orderBy(draw, "doc_id").limit(n) for y, n in ((True, SAMPLE_TOXIC), (False, SAMPLE_CLEAN))]
    # At most SAMPLE_TOXIC + SAMPLE_CLEAN ids: a proven bound for the broadcast.
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(parts[0].unionByName(parts[1])), "doc_id")
    return materialize(rows, "toxicity-sample"), float(share)


def train(docs: DataFrame, labels: DataFrame) -> Field:
    """Fit the field to the bounded sample of labelled rows, whose texts stay in the cluster."""
    sample, share = sampled(docs, labels)
    n = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    n1, n0 = n.get(True, 0), n.get(False, 0)
    model = Field()
    model.calibration = np.array([np.log(max(share, 1e-6) / max(1 - share, 1e-6)), 0.0, 0.0])
    if not n1 or not n0:
        return model
    keys, speaks = significant_features(feature_counts(sample.select("text", F.col("toxic").cast("int"))), n1, n0)
    if not len(keys):
        return model
    found = materialize(stretches(sample.select("doc_id", "text", "toxic"), keys, speaks), "stretches")
    drawn = [d.orderBy("draw").limit(STRETCHES) for d in (found.filter("hot"), found)]
    # At most 2 * STRETCHES rows of SPAN tokens.
    rows = drawn[0].unionByName(drawn[1]).dropDuplicates(["draw"]).orderBy("draw").toArrow()["slots"].to_numpy()
    model = fit_chain(list(rows), keys)
    evidence = _marginals(sample, model).toArrow()  # two figures for each row of the sample
    best, total, toxic = (evidence[c].to_numpy() for c in ("best", "total", "toxic"))
    model.calibration = calibrate(_evidence(best, total), toxic.astype(bool), share)
    return model


def _marginals(rows: DataFrame, model: Field) -> DataFrame:
    """(best, total, toxic) of labelled texts."""
    shared = rows.sparkSession.sparkContext.broadcast(model)  # at most MOST_FEATURES weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, words in each_slice(batch.column(0), lower=True):
                best, total, *_ = document_evidence(shared.value, words)
                yield pa.RecordBatch.from_arrays([pa.array(best), pa.array(total), batch.column(1).slice(lo, hi - lo)], ["best", "total", "toxic"])

    return arrow_map(rows.select("text", F.col("toxic").cast("int").alias("toxic")), run, "best double, total double, toxic int")


def tag(docs: DataFrame, model: Field) -> DataFrame:
    """(doc_id, score, spans): ``spans`` has start and end bytes and the marginal of each token likelier toxic than not."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most MOST_FEATURES weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field_ = shared.value
        for batch in batches:
            for lo, hi, words in each_slice(batch.column(1), lower=True):
                best, total, token, p = document_evidence(field_, words)
                token, p = token[p >= 0.5], p[p >= 0.5]
                doc = words.doc_of()[token]
                at = np.searchsorted(doc, np.arange(hi - lo + 1)).astype(np.int32)
                base = _doc_bytes(batch.column(1), lo, hi)[doc] if len(doc) else np.zeros(0, np.int64)
                spans = pa.StructArray.from_arrays(
                    [pa.array(words.starts[token] - base), pa.array(words.ends[token] - base), pa.array(p)], ["start", "end", "marginal"]
                )
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(field_.score(best, total)), pa.ListArray.from_arrays(pa.array(at), spans)],
                    ["doc_id", "score", "spans"],
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return arrow_map(rows, run, "doc_id long, score double, spans array<struct<start: long, end: long, marginal: double>>")


def _doc_bytes(texts: pa.Array, lo: int, hi: int) -> np.ndarray:
    """Where each document of the slice begins in the slice's bytes."""
    sizes = pc.fill_null(pc.binary_length(texts.slice(lo, hi - lo)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    return np.cumsum(sizes) - sizes


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all ``documents``, with the number of toxic tokens found."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    found = tag(docs, train(docs, labels))
    return found.select(
        "doc_id",
        F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= DECISION).cast("int").alias("predicted"),
        F.size("spans").cast("long").alias("n_toxic_tokens"),
    )
