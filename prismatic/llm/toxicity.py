"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text, each once: its words, their first letters (STEM of them), pairs of neighbours, and pairs that skip one word; each a 64-bit hash. The
classifier is fitted on a bounded sample of labelled rows (MAX_TOXIC and MAX_CLEAN rows, in order of a hash of doc_id; a documented limit of the fit alone),
with per-coordinate rates and L1, whose surviving weights (at most MAX_WEIGHTS, the largest) are broadcast. Every row is scored over its whole text.

Null text counts as empty; an empty text gets the score of the intercept. Labels that are null, or of unknown documents, teach nothing; of several labels for
a document the largest holds, and of several texts the least. Repeated rows each get a row. Without labels of both kinds nothing is learned: every score
is then the same and under 0.5 (UNLEARNED), so no document is rejected. Other columns, whatever their names, are not read. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import ids_and_texts, pieces, remainder, words_of

MAX_TOXIC, MAX_CLEAN, MAX_WEIGHTS = 3_000, 6_000, 200_000
#: Bits of the counters that tell rare features.
COUNTERS = 26
STEM = 4
#: The intercept where nothing is learned.
UNLEARNED = -0.01
#: Passes over the sample, and the L1 term: as a share of the toxic rows learned from, between bounds.
ROUNDS, L1_SHARE, L1_LEAST, L1_MOST = 3, 0.06, 1.0, 25.0
CHUNK_BYTES = 4_000_000
EDGE = "\"'()[]{}<>.,;:!?…*#&$%_-|/\\"


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct feature hashes of each text, end to end, and where each text's start, with the end."""
    flat, at = words_of(texts)
    coded = flat.dictionary_encode()
    words = [w.strip(EDGE) for w in coded.dictionary.to_pylist()]
    h = np.array([xxhash.xxh64_intdigest(w) for w in words], dtype=np.uint64)
    stem = np.array([xxhash.xxh64_intdigest(w[:STEM], 1) for w in words], dtype=np.uint64)
    codes = np.asarray(coded.indices)
    h, stem = (h[codes], stem[codes]) if len(words) else (np.zeros(0, dtype=np.uint64),) * 2
    pair = mixed(h[:-1]) + h[1:] + np.uint64(1) if len(h) > 1 else h[:0]
    skip = mixed(h[:-2]) * np.uint64(3) + h[2:] if len(h) > 2 else h[:0]
    out, ends = [], [0]
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        one = np.unique(np.concatenate([h[a:b], stem[a:b], pair[a : max(a, b - 1)], skip[a : max(a, b - 2)]]))
        out.append(one)
        ends.append(ends[-1] + len(one))
    return np.concatenate(out) if out else np.zeros(0, dtype=np.uint64), np.array(ends, dtype=np.int64)


class Ftrl:
    """FTRL-proximal with per-coordinate rates for binary features."""

    def __init__(self, size: int, alpha: float = 1.0, beta: float = 1.0, l1: float = L1_MOST, l2: float = 0.5):
        self.z, self.n = np.zeros(size), np.zeros(size)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, i) -> np.ndarray:
        z = self.z[i]
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(self.n[i])) / self.alpha + self.l2))

    def learn(self, i: np.ndarray, y: float, weight: float) -> None:
        w = self.weights(i)
        g = weight * (1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - y)
        self.z[i] += g - (np.sqrt(self.n[i] + g * g) - np.sqrt(self.n[i])) / self.alpha * w
        self.n[i] += g * g


def fitted(texts: list[str], labels: list[int], rounds: int = ROUNDS, least: int = 3) -> tuple[np.ndarray, np.ndarray, float]:
    """Sorted feature hashes with a weight, the weights, and the intercept. Features of fewer than `least` texts are left out."""
    # two passes over the texts, so that rare features, which are most, are never held
    seen, kept, sizes = np.zeros(1 << COUNTERS, dtype=np.uint8), [], []
    for keep in (False, True):
        for lo in range(0, len(texts), 128):
            f, at = features(pa.array(texts[lo : lo + 128], pa.string()))
            cell = (f >> np.uint64(64 - COUNTERS)).astype(np.int64)
            if keep:
                # a counter may stand for several features, so none that is frequent is lost
                ok = seen[cell] >= least
                sums = np.concatenate([[0], np.cumsum(ok)])
                sizes += np.diff(sums[at]).tolist()
                kept.append(f[ok])
            else:
                for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
                    own = cell[a:b]
                    seen[own] += seen[own] < least
    every = np.concatenate(kept) if kept else np.zeros(0, dtype=np.uint64)
    keys, codes = np.unique(every, return_inverse=True)
    edges = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    model = Ftrl(len(keys) + 1, l1=min(L1_MOST, max(L1_LEAST, L1_SHARE * sum(labels))))
    share = sum(labels) / max(1, len(labels))
    heavy = min(3.0, (1 - share) / share) if share else 1.0
    rng = np.random.default_rng(11)
    for _ in range(rounds):
        for k in rng.permutation(len(texts)).tolist():
            model.learn(np.append(codes[edges[k] : edges[k + 1]], len(keys)), float(labels[k]), heavy if labels[k] else 1.0)
    w = model.weights(np.arange(len(keys) + 1))
    some = np.flatnonzero(w[:-1])
    if len(some) > MAX_WEIGHTS:
        some = np.sort(some[np.argsort(-np.abs(w[some]), kind="stable")[:MAX_WEIGHTS]])
    return keys[some], w[some], float(w[-1]) or UNLEARNED  # without evidence a text isn't toxic


def sample(docs: DataFrame, labels: DataFrame, by: int, held: int) -> DataFrame:
    """doc_id, toxic and text of the rows to learn from: at most MAX_TOXIC + MAX_CLEAN documents."""
    doc = F.col("doc_id")
    marked = labels.select(doc.cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    marked = marked.where(F.crc32(doc.cast("string").cast("binary")) % by != held).join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    some = [marked.where(F.col("toxic") == t).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for t, n in ((1, MAX_TOXIC), (0, MAX_CLEAN))]
    return docs.join(F.broadcast(some[0].unionByName(some[1])), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))


def fit(docs: DataFrame, labels: DataFrame, by: int = 5, held: int = 0) -> tuple[np.ndarray, np.ndarray, float]:
    """The weights, learned in one executor task from the bounded sample."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((i, y, t) for b in batches for i, t, y in zip(*(b.column(c).to_pylist() for c in range(3))))
        if len({y for _, y, _ in rows}) < 2:
            return
        keys, w, bias = fitted([t for _, _, t in rows], [y for _, y, _ in rows])
        del rows
        pa.default_memory_pool().release_unused()  # the worker lives on for other tasks
        yield pa.RecordBatch.from_arrays([pa.array([keys.tobytes()], pa.binary()), pa.array([w.tobytes()], pa.binary()), pa.array([bias])], ["keys", "weights", "bias"])

    docs = ids_and_texts(docs)
    chosen = sample(docs, labels, by, held).select("doc_id", "text", "toxic").repartition(1)
    got = chosen.mapInArrow(run, "keys binary, weights binary, bias double").first()
    if got is None:
        return np.zeros(0, dtype=np.uint64), np.zeros(0), UNLEARNED
    return np.frombuffer(bytes(got["keys"]), np.uint64), np.frombuffer(bytes(got["weights"])), got["bias"]


def scores(texts: pa.Array, keys: np.ndarray, weights: np.ndarray, bias: float) -> np.ndarray:
    f, at = features(texts)
    if len(keys):
        k = np.searchsorted(keys, f)
        k[k == len(keys)] = 0
        own = np.where(keys[k] == f, weights[k], 0.0)
    else:
        own = np.zeros(len(f))
    sums = np.concatenate([[0.0], np.cumsum(own)])
    return 1 / (1 + np.exp(-np.clip(sums[at[1:]] - sums[at[:-1]] + bias, -35, 35)))


def scored(docs: DataFrame, labels: DataFrame, by: int = 5, held: int = 0) -> DataFrame:
    """doc_id, held_out, score and predicted for each row."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, by, held))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, weights, bias = model.value
        for batch in batches:
            for ids, texts in pieces(batch, CHUNK_BYTES):
                s = scores(texts, keys, weights, bias)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(remainder(ids, by) == held), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return ids_and_texts(docs).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def accepted(docs: DataFrame, labels: DataFrame, by: int = 5, held: int = 0, threshold: float = 0.5) -> DataFrame:
    """The rows of docs, all columns, whose score is under the threshold."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, by, held))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, weights, bias = model.value
        for batch in batches:
            texts = batch.column(at).cast(pa.string()).fill_null("")
            if batch.num_rows:
                ok = np.concatenate([scores(t, keys, weights, bias) for _, t in pieces(pa.RecordBatch.from_arrays([pa.nulls(batch.num_rows), texts], ["i", "t"]), CHUNK_BYTES)]) < threshold
                yield batch.filter(pa.array(ok))

    # by position, as names may hold anything
    plain = docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])
    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)
