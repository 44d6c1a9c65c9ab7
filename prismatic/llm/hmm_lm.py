"""Hidden Markov language model, with word counts of the whole corpus.

Tokens are words (A-Z in lower case) and one end token after each text. Counts of all training words come from the corpus-wide shuffle of each
block's distinct words (wordblocks). The HMM's symbols are word classes (a hash of the word; the end token has its own), so its tables have a
fixed size; within a class a word has the add-one estimate (c + 1) / (N_class + V_class + 1), whose last part is left for unseen words. Baum-Welch
runs over all training documents, each as one sequence: each task gathers expected counts over its blocks, which Spark sums by position. So that many
stretches of a long text can be worked on at once, and memory stays small, a text's forward and backward vectors are first found at every SEGMENT-th token, from the
products of the stretches' matrices; within a stretch they go on from there. The result is that of the plain recursions. The likelihood of a text is exact: scaled
forward recursion over the whole text.

A null or empty text is the end token alone. A null doc_id counts as the empty text for the split. Repeated rows each count and each get a row. An empty
table gives no rows; without training rows all counts are 0 and every state emits uniformly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import as_array, ids_and_texts, materialize, pack, remainder, unpack, words_of
from .wordblocks import DOCS, VALUES, blocks, buckets_for, by_bucket, dealt, header, reassembled, stepped, tokens_of, unstepped

#: Tokens of a stretch, and stretches in one matrix of the training pass; results don't depend on them.
SEGMENT = 64
ROWS = 2048


def hashes(words: pa.Array) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(w) for w in words.to_pylist()], dtype=np.uint64)


class Model:
    """start (K), move (K x K) and emit (symbols x K)."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start, self.move, self.emit = start, move, emit

    @classmethod
    def first(cls, states: int, frequency: np.ndarray, seed: int) -> Model:
        """States near the corpus frequencies, told apart by noise."""
        rng = np.random.default_rng(seed)
        emit = frequency[:, None] * rng.uniform(0.5, 1.5, (len(frequency), states))
        move = np.full((states, states), 0.1 / states) + 0.9 * np.eye(states)
        return cls(np.full(states, 1 / states), move / move.sum(1, keepdims=True), emit / emit.sum(0))

    def products(self, symbols: np.ndarray, lens: np.ndarray, first: np.ndarray) -> np.ndarray:
        """For each stretch (row of symbols, longest first, padded) the scaled product over its tokens of move times emission: what turns the forward vector before it
        into the one after it. A document's first token has no move before it."""
        n, t = symbols.shape
        k = len(self.start)
        out = np.empty((n, k, k))
        for i in range(t):
            m = int((lens > i).sum())
            p = np.where(first[:, None, None], np.eye(k), self.move) if i == 0 else (out[:m].reshape(-1, k) @ self.move).reshape(m, k, k)
            p = p * self.emit[symbols[:m, i]][:, None]
            out[:m] = p / p.sum((1, 2))[:, None, None]
        return out

    def expected(self, symbols: np.ndarray, lens: np.ndarray, total: list[np.ndarray], before: np.ndarray, after: np.ndarray, first: np.ndarray) -> None:
        """Add the expected counts of stretches (rows of symbols, longest first, padded) to total: start, move, emit. Those marked first start a document, others go on
        from the forward vector `before` of the token before them; after is the backward vector of their last token, up to a factor."""
        n, t = symbols.shape
        k = len(self.start)
        active = [int((lens > i).sum()) for i in range(t)]
        b = self.emit[symbols]
        alpha, scale = np.zeros((t, n, k)), np.ones((t, n))
        for i in range(t):
            m = active[i]
            a = (np.where(first[:, None], self.start, before @ self.move) if i == 0 else alpha[i - 1, :m] @ self.move) * b[:m, i]
            scale[i, :m] = a.sum(1)
            alpha[i, :m] = a / scale[i, :m, None]
        beta = after / (alpha[lens - 1, np.arange(n)] * after).sum(1, keepdims=True)
        gamma = np.zeros((t, n, k))
        for i in range(t - 1, -1, -1):
            m = active[i]
            gamma[i, :m] = alpha[i, :m] * beta[:m]
            ahead = beta[:m] * b[:m, i] / scale[i, :m, None]
            if i:
                total[1] += self.move * (alpha[i - 1, :m].T @ ahead)
                beta[:m] = ahead @ self.move.T
            elif not first.all():
                total[1] += self.move * (before[~first].T @ ahead[~first])
        total[0] += gamma[0][first].sum(0)
        flat = symbols.T.ravel()
        for j in range(k):
            total[2][:, j] += np.bincount(flat, weights=gamma[:, :, j].ravel(), minlength=len(self.emit))

    def gather(self, symbols: np.ndarray, lens: np.ndarray, total: list[np.ndarray], segment: int = SEGMENT, rows: int = ROWS) -> None:
        """Add the expected counts of documents, whose symbols lie end to end, to total; in stretches of `segment` tokens, `rows` of them at once."""
        parts, k = -(-lens // segment), len(self.start)
        of = np.repeat(np.arange(len(lens)), parts)
        place = np.arange(len(of)) - (np.cumsum(parts) - parts)[of]
        at = (np.cumsum(lens) - lens)[of] + place * segment
        left = np.minimum(lens[of] - place * segment, segment)
        symbols = np.append(symbols, np.zeros(segment, dtype=np.int64))
        order = np.argsort(-left, kind="stable")

        def batches(stretches: np.ndarray):
            for lo in range(0, len(stretches), rows):
                o = stretches[lo : lo + rows]
                yield o, symbols[at[o][:, None] + np.arange(int(left[o[0]]))], left[o], place[o] == 0

        matrix = np.empty((len(of), k, k)) if (parts > 1).any() else None
        for o, cells, n, first in batches(order[parts[of[order]] > 1]):
            matrix[o] = self.products(cells, n, first)
        # forward and backward vectors at the ends of stretches, place by place
        before, after = np.tile(self.start, (len(of), 1)), np.ones((len(of), k))
        by_place = np.argsort(place, kind="stable")
        steps = np.split(by_place, np.flatnonzero(np.diff(place[by_place])) + 1)
        for now in steps[1:]:
            a = np.einsum("ni,nij->nj", before[now - 1], matrix[now - 1])
            before[now] = a / a.sum(1, keepdims=True)
        for now in steps[:0:-1]:
            b = np.einsum("nij,nj->ni", matrix[now], after[now])
            after[now - 1] = b / b.sum(1, keepdims=True)
        for o, cells, n, first in batches(order):
            self.expected(cells, n, total, before[o], after[o], first)

    def next(self, total: list[np.ndarray], frequency: np.ndarray) -> Model:
        """Re-estimated; a pinch of the corpus frequencies keeps every symbol possible in every state."""
        start, move, emit = total[0] + 0.1, total[1] + 0.1, total[2] + 0.5 * len(frequency) * frequency[:, None] + 1e-3
        return Model(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0))

    def log10(self, symbols: np.ndarray, lens: np.ndarray) -> np.ndarray:
        """Exact log10 likelihood of each sequence; symbols holds them end to end."""
        begin = np.cumsum(lens) - lens
        order = np.argsort(-lens, kind="stable")
        lens, begin = lens[order], begin[order]
        out, a = np.zeros(len(lens)), None
        ends = np.searchsorted(-lens, -np.arange(1, (lens[0] if len(lens) else 0) + 1), side="right")
        for i, m in enumerate(ends):
            e = self.emit[symbols[begin[:m] + i]]
            a = (self.start if a is None else a[:m] @ self.move) * e
            s = a.sum(1)
            a /= s[:, None]
            out[:m] += np.log10(s)
        back = np.empty_like(out)
        back[order] = out
        return back


def count_blocks(docs: DataFrame, n_buckets: int, by: int, held: int, classes: int) -> DataFrame:
    def more(ids, codes, counts, words, hashed):
        train = (remainder(ids, by) != held).astype(np.int64)
        seen = np.bincount(codes, weights=np.repeat(train, counts), minlength=len(words)).astype(np.int64)
        return seen, (hashed % np.uint64(classes)).astype(np.uint16)

    return blocks(docs, words_of, hashes, n_buckets, more)


def global_counts(table: DataFrame, n_buckets: int, classes: int) -> DataFrame:
    """For each pack the training counts of its words; and, with kind 3, words and distinct words of each class in the task's buckets."""

    def bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n_all, v_all = np.zeros(classes, dtype=np.int64), np.zeros(classes, dtype=np.int64)
        for packs in by_bucket(batches):
            own = [tokens_of(p) for _, p in packs]
            coded = as_array(pa.chunked_array([w for _, w in own])).dictionary_encode()
            which = np.asarray(coded.indices).astype(np.int64)
            seen = np.bincount(which, weights=np.concatenate([np.frombuffer(p[3], np.int64) for _, p in packs]), minlength=len(coded.dictionary)).astype(np.int64)
            cls = (hashes(coded.dictionary) % np.uint64(classes)).astype(np.int64)
            n_all += np.bincount(cls, weights=seen, minlength=classes).astype(np.int64)
            v_all += np.bincount(cls, weights=seen > 0, minlength=classes).astype(np.int64)
            rows, lo = [], 0
            for (block, _), (codes, _) in zip(packs, own):
                rows.append((VALUES, block, pack(stepped(codes), seen[which[lo : lo + len(codes)]]), None, None, None))
                lo += len(codes)
            yield from batched(rows)
        yield from batched([(3, -1, None, int(c), int(n_all[c]), int(v_all[c])) for c in np.flatnonzero(v_all)])

    def batched(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int32(), pa.int64(), pa.binary(), pa.int32(), pa.int64(), pa.int64())
        for lo in range(0, len(rows), 2048):
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows[lo : lo + 2048]), kinds)], ["kind", "block", "data", "cls", "n", "v"])

    return dealt(table, n_buckets).mapInArrow(bucket, "kind int, block long, data binary, cls int, n long, v long")


def symbols_of(doc: list[bytes], classes: int) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """doc_ids, tokens of each document with the end, their symbols, and the words' codes."""
    ids, counts, codes = header(doc)
    cls = np.frombuffer(doc[6], np.uint16).astype(np.int64)
    return ids, counts + 1, np.insert(cls[codes], np.cumsum(counts), classes), codes


def trained(table: DataFrame, by: int, held: int, classes: int, states: int, rounds: int, frequency: np.ndarray, seed: int = 7) -> Model:
    """rounds of Baum-Welch over all training documents of table."""
    model = Model.first(states, frequency, seed)
    size = states + states * states + (classes + 1) * states
    for _ in range(rounds):

        def step(batches: Iterator[pa.RecordBatch], model: Model = model) -> Iterator[pa.RecordBatch]:
            total, any_row = [np.zeros(states), np.zeros((states, states)), np.zeros((classes + 1, states))], False
            for batch in batches:
                for data in batch.column(0):
                    ids, lens, symbols, _ = symbols_of(unpack(data.as_py()), classes)
                    train = remainder(ids.to_pylist(), by) != held
                    if train.any():
                        model.gather(symbols[np.repeat(train, lens)], lens[train], total)
                        any_row = True
            if any_row:
                yield pa.RecordBatch.from_arrays([pa.array([np.concatenate([x.ravel() for x in total])], pa.list_(pa.float64()))], ["counts"])

        counts = table.where(F.col("kind") == DOCS).select("data").mapInArrow(step, "counts array<double>")
        # one row for each of the model's `size` cells, whatever the input
        summed = counts.select(F.posexplode("counts").alias("at", "value")).groupBy("at").agg(F.sum("value").alias("value")).toPandas()
        flat = np.zeros(size)
        flat[summed["at"].to_numpy(dtype=np.int64)] = summed["value"].to_numpy(dtype=float)
        a, b = states, states + states * states
        model = model.next([flat[:a], flat[a:b].reshape(states, states), flat[b:].reshape(classes + 1, states)], frequency)
    return model


def scored(docs: DataFrame, by: int = 7, held: int = 2, classes: int = 2048, states: int = 6, rounds: int = 3) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score for each row."""
    docs = ids_and_texts(docs)
    n_buckets = buckets_for(docs)
    table = materialize(count_blocks(docs, n_buckets, by, held, classes), "hmm-blocks")
    counts = materialize(global_counts(table, n_buckets, classes), "hmm-counts")
    # one row for each class
    sums = counts.where(F.col("kind") == 3).groupBy("cls").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).toPandas()
    n_cls, v_cls = np.zeros(classes), np.zeros(classes)
    n_cls[sums["cls"].to_numpy(dtype=np.int64)], v_cls[sums["cls"].to_numpy(dtype=np.int64)] = sums["n"], sums["v"]
    ends = docs.where(F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(0)) % by != held).count()
    n, v = int(n_cls.sum()) + ends, int(v_cls.sum()) + (ends > 0)
    frequency = np.append(n_cls + 1, ends + 1).astype(float)
    model = trained(table, by, held, classes, states, rounds, frequency / frequency.sum())
    base_log, class_log = np.log10(n + v + 1), np.append(np.log10(n_cls + v_cls + 1), 0.0)

    def finish(doc: list[bytes], got: list[list[bytes]]) -> pa.RecordBatch:
        ids, lens, symbols, codes = symbols_of(doc, classes)
        got = [(unstepped(c), np.frombuffer(v, np.int64)) for c, v in got]
        seen = np.zeros(sum(len(c) for c, _ in got), dtype=np.int64)
        for c, values in got:
            seen[c] = values
        words = lens - 1
        at = np.concatenate([[0], np.cumsum(words)])

        def per_doc(x: np.ndarray) -> np.ndarray:
            sums = np.concatenate([[0], np.cumsum(x[codes])])
            return sums[at[1:]] - sums[at[:-1]]

        logs = np.array([s.sum() for s in np.split(np.log10(seen + 1.0)[codes], at[1:-1])]) if len(lens) else np.zeros(0)
        base = logs + np.log10(ends + 1) - lens * base_log
        known = per_doc((seen > 0).astype(np.int64)) + (ends > 0)
        within = np.add.reduceat(class_log[symbols], np.cumsum(lens) - lens) if len(lens) else np.zeros(0)
        score = model.log10(symbols, lens) + logs - within
        rows = [ids, pa.array(remainder(ids.to_pylist(), by) == held), pa.array(lens), pa.array(known), pa.array(np.full(len(lens), n)), pa.array(base), pa.array(score)]
        return pa.RecordBatch.from_arrays(rows, ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return reassembled(table, counts.where(F.col("kind") == VALUES).withColumn("bucket", F.lit(-1)), finish, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
