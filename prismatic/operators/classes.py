"""Searches of classes over any number of rows, for PLS-DA and forests: rows stay with the tasks. PLS comes from moments by fold and class, Newton steps of the logistic
regressions on its scores are sums over rows, and forests grow in tasks that hold the rows' bins as bytes. Results are those of models that hold all rows."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from prismatic import ByValue
from prismatic.functions.learners import BINS, Logistic, OneVsRest, ShareForest, auc
from prismatic.functions.registry import importances
from prismatic.operators import moments
from prismatic.operators.transfer import added_up

#: Rows that are scored at once; bytes of values that one pass for the bins' edges shuffles; bytes of bins that copies for more tasks may take.
CHUNK, EDGE_BYTES, COPY_BYTES = 20_000, 512 << 20, 512 << 20


class Dealt:
    """Rows with their place in the order of class, hash of seed and id, and id; c, the class's number; fold, the place modulo folds. starts: where classes begin, with the end."""

    def __init__(self, samples: DataFrame, folds: int, seed: int):
        spark = samples.sparkSession
        hashed = samples.withColumn("__h", F.xxhash64(F.lit(seed), "sample_id")).withColumn("__b", F.shiftright("__h", 56).cast("int"))
        counts = sorted((r["y"], r["__b"], r["count"]) for r in hashed.groupBy("y", "__b").count().collect())  # 256 at most for a class
        self.folds, self.classes = folds, np.array(sorted({y for y, _, _ in counts}), dtype=str)
        number = {y: c for c, y in enumerate(self.classes.tolist())}
        below = np.append(0, np.cumsum([n for _, _, n in counts])).tolist()
        self.n = below[-1]
        self.starts = np.append(0, np.cumsum(np.bincount([number[y] for y, _, _ in counts], [n for _, _, n in counts], len(number)))).astype(np.int64)
        start = spark.createDataFrame([(y, b, number[y], k) for (y, b, _), k in zip(counts, below)], "y string, __b int, c int, __k long")
        place = F.col("__k") + F.row_number().over(Window.partitionBy("y", "__b").orderBy("__h", "sample_id")) - 1
        rows = hashed.join(F.broadcast(start), ["y", "__b"]).select("values", "c", place.alias("place"))
        self.rows = rows.withColumn("fold", (F.col("place") % folds).cast("int")).persist(StorageLevel.DISK_ONLY)

    def learned(self, fold: int) -> np.ndarray:
        """How many rows of each class are learned from when `fold` is held out; none is at -1."""
        before = (self.starts + self.folds - 1 - fold) // self.folds if fold >= 0 else 0 * self.starts  # rows of the fold below each start
        return np.diff(self.starts) - np.diff(before)


class Fitted:
    """Of one treatment and fold: PLS of each class that is learned from, turned to scores one class after another, and a logistic regression for each number of components."""

    def __init__(self, dealt: Dealt, parts: list[moments.Moments], fold: int, components: list[int]):
        of, self.fold, self.classes = len(dealt.classes), fold, np.flatnonzero(dealt.learned(fold))
        own = [moments.total([parts[f * of + c] for f in range(dealt.folds) if f != fold]) for c in range(of)]
        every = moments.total(own)
        self.pls, turns, self.w, self.step = [], [], {}, {}
        for c in self.classes:
            a = every.a.copy()
            a[:, -1] = a[-1, :] = own[c].a[:, 0]
            a[-1, -1] = own[c].n
            m = moments.Moments(a, every.shift)
            p = moments.fitted_pls(m, max(components))
            turn = p.w @ np.linalg.pinv(p.p.T @ p.w)
            s = m.scatter
            square, along = np.zeros((turn.shape[1] + 1,) * 2), np.append(turn.T @ s[:-1, -1], m.a[-1, -1])
            square[:-1, :-1], square[-1, -1] = turn.T @ s[:-1, :-1] @ turn, m.n
            for k in components:
                at = [*range(min(k, turn.shape[1])), turn.shape[1]]
                self.w[c, k] = np.zeros(len(at))
                # the first step needs no pass: all shares are a half, and scores add up to 0
                g = -along[at]
                g[-1] += 0.5 * m.n
                self.moved(c, k, g, square[np.ix_(at, at)] / 4)
            self.pls.append(p)
            turns.append(turn)
        self.mean = every.means[:-1]
        self.ends = np.cumsum([0, *[t.shape[1] for t in turns]])
        self.turn = np.column_stack(turns)

    def moved(self, c: int, k: int, g: np.ndarray, h: np.ndarray) -> None:
        """A Newton step of Logistic."""
        w = self.w[c, k]
        ridge = Logistic().alpha * np.eye(len(w))
        ridge[-1, -1] = 1e-9
        step = np.linalg.solve(h + ridge, g + ridge @ w)
        self.w[c, k], self.step[c, k] = w - step, float(np.abs(step).max())

    def open(self) -> list[tuple[int, int]]:
        return [at for at, s in self.step.items() if not s < 1e-8]

    def scores(self, x: np.ndarray) -> list[np.ndarray]:
        """With a column of ones, by class."""
        z = (x - self.mean) @ self.turn
        return [np.column_stack([z[:, a:b], np.ones(len(z))]) for a, b in zip(self.ends, self.ends[1:])]

    def weights(self, i: int, models) -> np.ndarray:
        """A column for each of the models of the i-th class here."""
        size = int(self.ends[i + 1] - self.ends[i])
        out = np.zeros((size + 1, len(models)))
        for j, at in enumerate(models):
            out[: len(self.w[at]) - 1, j], out[-1, j] = self.w[at][:-1], self.w[at][-1]
        return out


def shares(eta: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(eta, -35, 35)))


def newton(dealt: Dealt, chains: list, fits: list[list[Fitted]], rounds: int = Logistic().rounds) -> None:
    """Steps of all logistic regressions until each has come to rest: gradients and curvatures are sums over rows. fits: by treatment and fold."""
    for _ in range(rounds - 1):
        todo = []  # treatment, fit, place of the class there, models, where their sums begin
        size = 0
        for t, some in enumerate(fits):
            for fit in some:
                going = fit.open()
                for i, c in enumerate(fit.classes):
                    if models := [at for at in going if at[0] == c]:
                        wide = int(fit.ends[i + 1] - fit.ends[i]) + 1
                        todo.append((t, fit, i, models, size, wide))
                        size += len(models) * (wide + wide * (wide + 1) // 2)
        if not todo:
            return

        held = dealt.rows.sparkSession.sparkContext.broadcast(ByValue((chains, todo)))

        def sums(out, b, held=held):
            made, x, fold, c = held.value, np.stack(b["values"]), b["fold"].to_numpy(), b["c"].to_numpy()
            treated, last, scores = None, (None, None), None
            for t, fit, i, models, lo, wide in made[1]:
                if last[0] != t:
                    treated, last = made[0][t].apply(x), (t, None)
                if last[1] is not fit:
                    rows, last = fold != fit.fold, (t, fit)
                    scores, own = fit.scores(treated[rows]), c[rows]
                z = scores[i]
                p = shares(z @ fit.weights(i, models))
                a, d = np.triu_indices(wide)
                g = z.T @ (p - (own == fit.classes[i])[:, None])
                h = (z[:, a] * z[:, d]).T @ (p * (1 - p))
                out[lo : lo + g.size] += g.ravel()
                out[lo + g.size : lo + g.size + h.size] += h.ravel()

        found = added_up(dealt.rows, size, sums)
        held.unpersist()
        for _, fit, i, models, lo, wide in todo:
            m, pairs = len(models), np.triu_indices(wide)
            g = found[lo : lo + wide * m].reshape(wide, m)
            h = found[lo + wide * m : lo + wide * m + len(pairs[0]) * m].reshape(-1, m)
            for j, (c, k) in enumerate(models):
                at = [*range(len(fit.w[c, k]) - 1), wide - 1]
                square = np.zeros((wide, wide))
                square[pairs] = square.T[pairs] = h[:, j]
                fit.moved(c, k, g[at, j], square[np.ix_(at, at)])


def judged(truth: np.ndarray, classes: np.ndarray, p: np.ndarray) -> tuple[float, float | None]:
    """Accuracy and mean area of the classes' shares."""
    areas = [a for k, c in enumerate(classes) if not np.isnan(a := auc((truth == c).astype(int), p[:, k]))]
    return float((classes[p.argmax(1)] == truth).mean()), float(np.mean(areas)) if areas else None


def by_task(rows: DataFrame, key: str, n: int) -> DataFrame:
    """The rows of each key, of 0 to n - 1, in a partition of its own."""
    return rows.repartitionById(n, key)


def scored_pls(dealt: Dealt, chains: list, fits: list[list[Fitted]], components: list[int]) -> list[tuple]:
    """(treatment, components, fold, accuracy, area): a task holds the rows of a fold."""
    held = dealt.rows.sparkSession.sparkContext.broadcast(ByValue((chains, fits, dealt.n, dealt.folds, dealt.starts)))

    def run(batches):
        chains, fits, n, folds, starts = held.value
        x = {}
        for b in batches:
            for f, own in b.groupby("fold"):
                v = np.stack(own["values"])
                if f not in x:
                    x[f] = np.empty((len(range(f, n, folds)), v.shape[1]), dtype=np.float32)
                if x[f].dtype == np.float32 and not np.array_equal(v.astype(np.float32), v, equal_nan=True):  # floats where they hold all digits
                    x[f] = x[f].astype(float)
                x[f][own["place"].to_numpy() // folds] = v
        for f, v in x.items():
            truth = np.searchsorted(starts, np.arange(f, n, folds), side="right") - 1
            for t, chain in enumerate(chains):
                fit = fits[t][f]
                for k in components:
                    eta = np.empty((len(v), len(fit.classes)))
                    for lo in range(0, len(v), CHUNK):
                        for i, z in enumerate(fit.scores(chain.apply(v[lo : lo + CHUNK].astype(float)))):
                            eta[lo : lo + CHUNK, i] = z @ fit.weights(i, [(fit.classes[i], k)])[:, 0]
                    yield pd.DataFrame([(t, k, f, *judged(truth, fit.classes, OneVsRest(None).shared(eta)))], columns=["t", "k", "fold", "a", "b"])

    found = by_task(dealt.rows.select("fold", "place", "values"), "fold", dealt.folds).mapInPandas(run, "t int, k int, fold int, a double, b double").collect()
    held.unpersist()
    return [tuple(r) for r in found]


def searched_pls(dealt: Dealt, chains: list, widths: list[int], components: list[int]) -> tuple[list[tuple], dict]:
    """As scored_pls(), and importances of channels by treatment and components, in models of all rows."""
    of, fits, about = len(dealt.classes), [], {}
    for t, chain in enumerate(chains):
        cells = dealt.rows.select("values", F.lit(0.0).alias("y"), (F.col("fold") * of + F.col("c")).alias("cell"))
        parts = moments.of_rows(cells, dealt.folds * of, widths[t], made=lambda b, chain=chain: chain.apply(np.stack(b["values"])))
        fits.append([Fitted(dealt, parts, f, components) for f in range(min(dealt.folds, dealt.n)) if dealt.learned(f).any()])
        for k in components:
            about[t, k] = np.mean([importances(p) for p in Fitted(dealt, parts, -1, [k]).pls], axis=0)
    newton(dealt, chains, fits)
    return scored_pls(dealt, chains, fits, components), about


def edges(dealt: Dealt, chain, width: int, folds: list[int]) -> dict[int, np.ndarray]:
    """By fold held out: the edges of each channel's bins, as Binned learns them. A task sorts a channel; passes over groups of channels bound what is shuffled."""
    at_once = max(1, EDGE_BYTES // (8 * max(1, dealt.n)))
    out = {f: np.empty((BINS - 1, width)) for f in folds}
    for lo in range(0, width, at_once):
        some = range(lo, min(width, lo + at_once))

        def columns(batches, some=some):
            for b in batches:
                if len(b):
                    v, fold = chain.apply(np.stack(b["values"])), b["fold"].to_numpy(dtype=np.int32).tobytes()
                    yield pd.DataFrame({"ch": [j - some[0] for j in some], "v": [v[:, j].tobytes() for j in some], "fold": [fold] * len(some)})

        def learn(batches):
            held: dict = {}
            for b in batches:
                for j, v, fold in zip(b["ch"], b["v"], b["fold"]):
                    held.setdefault(j, []).append((np.frombuffer(v), np.frombuffer(fold, dtype=np.int32)))
            for j in list(held):
                v, fold = (np.concatenate(p) for p in zip(*held.pop(j)))
                found = [np.quantile(v[fold != f], np.linspace(0, 1, BINS + 1)[1:-1]) for f in folds]
                yield pd.DataFrame({"ch": [j], "e": [np.array(found).tobytes()]})

        rows = dealt.rows.select("values", "fold").mapInPandas(columns, "ch int, v binary, fold binary")
        for r in by_task(rows, "ch", len(some)).mapInPandas(learn, "ch int, e binary").collect():  # 63 numbers a channel and fold
            for f, e in zip(folds, np.frombuffer(bytes(r["e"])).reshape(len(folds), BINS - 1)):
                out[f][:, lo + r["ch"]] = e
    return out


def binary(codes: np.ndarray) -> pa.Array:
    """A binary for each row of bytes."""
    n, width = codes.shape
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(n + 1, dtype=np.int32) * width), pa.py_buffer(np.ascontiguousarray(codes))])


def searched_forest(dealt: Dealt, chains: list, widths: list[int], n: int, depth: int, whole: bool) -> tuple[list[tuple], dict]:
    """(treatment, fold, accuracy, area); with whole also importances by treatment, of forests of all rows. A task holds the bins of all rows of a treatment and fold and grows
    trees of every class; where these are few bytes more tasks hold copies, each for some of the trees."""
    spark = dealt.rows.sparkSession
    folds = [f for f in range(min(dealt.folds, dealt.n)) if dealt.learned(f).any()] + [-1] * whole
    binned, keys = {}, [(t, f) for t in range(len(chains)) for f in folds]
    for t, chain in enumerate(chains):
        for f, e in edges(dealt, chain, widths[t], folds).items():
            binned[t, f] = ShareForest(n, depth)
            binned[t, f].edges = e
    size = sum(widths[t] for t, _ in keys) * dealt.n
    copies = max(1, min(n, COPY_BYTES // max(1, size), -(-4 * spark.sparkContext.defaultParallelism // len(keys))))
    held = spark.sparkContext.broadcast(ByValue((chains, keys, binned, dealt.n, dealt.folds, dealt.starts, {f: np.flatnonzero(dealt.learned(f)) for f in folds})))

    def codes(batches):
        chains, keys, binned, *_ = held.value
        for b in batches:
            place = b.column("place")
            values = b.column("values")
            x = np.asarray(values.flatten(), dtype=float).reshape(len(b), -1) if len(b) else None
            for t, chain in enumerate(chains) if len(b) else ():
                v = chain.apply(x)
                for k, (own, f) in enumerate(keys):
                    if own == t:
                        made = binary(binned[t, f].packed(v).T)
                        for r in range(copies):
                            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(b), k * copies + r, dtype=np.int32)), place, made], ["key", "place", "codes"])

    def grow(batches):
        chains, keys, binned, n, folds, starts, learned = held.value
        got: dict = {}
        for b in batches:
            key, place, v = np.asarray(b.column("key")), np.asarray(b.column("place")), b.column("codes").cast(pa.binary())
            if len(b):
                width = np.diff(np.frombuffer(v.buffers()[1], dtype=np.int32)[v.offset : v.offset + 2])[0]
                first = np.frombuffer(v.buffers()[1], dtype=np.int32)[v.offset]
                flat = np.frombuffer(v.buffers()[2], dtype=np.uint8)[first : first + len(b) * width].reshape(len(b), width)
                for k in np.unique(key):
                    if k not in got:
                        got[k] = np.empty((width, n), dtype=np.uint8)
                    got[k][:, place[key == k]] = flat[key == k].T
        for k in sorted(got):
            bins, f, forest = got.pop(k), keys[k // copies][1], binned[keys[k // copies]]
            own = np.arange(n) % folds
            rows, tested = np.flatnonzero(own != f), np.ascontiguousarray(bins[:, own == f])
            of = np.searchsorted(starts, np.arange(n), side="right") - 1
            for c in learned[f]:
                out, y = np.zeros(len(bins) if f < 0 else tested.shape[1]), (of == c).astype(np.uint8)
                for i in range(k % copies, forest.n, copies):
                    tree = forest.tree(bins, y, rows, i)
                    out += tree.gain if f < 0 else tree.predict(tested)
                yield pa.RecordBatch.from_arrays([pa.array([v], kind) for v, kind in ((k // copies, pa.int32()), (k % copies, pa.int32()), (c, pa.int32()), (out.tobytes(), pa.binary()))], ["key", "part", "c", "sums"])

    def judge(batches):
        chains, keys, binned, n, folds, starts, learned = held.value
        got: dict = {}
        for b in batches:
            for k, c, v in zip(b["key"], b["c"], b["sums"]):  # leaf values add up alike in any order
                one = got.setdefault(k, {})
                one[c] = one[c] + np.frombuffer(v) if c in one else np.frombuffer(v)
        for k, sums in got.items():
            f = keys[k][1]
            if f < 0:
                gain = np.mean([s / (s.sum() or 1.0) for s in sums.values()], axis=0)
                yield pd.DataFrame({"key": [k], "a": [None], "b": [None], "gain": [gain.tobytes()]})
                continue
            truth = np.searchsorted(starts, np.arange(f, n, folds), side="right") - 1
            p = np.stack([sums.pop(c) for c in learned[f]], axis=1) / binned[keys[k]].n
            a, area = judged(truth, learned[f], OneVsRest(None, False).shared(p))
            yield pd.DataFrame({"key": [k], "a": [a], "b": [area], "gain": [None]})

    rows = dealt.rows.select("place", "values").mapInArrow(codes, "key int, place long, codes binary")
    grown = by_task(rows, "key", len(keys) * copies).mapInArrow(grow, "key int, part int, c int, sums binary")
    found = by_task(grown, "key", len(keys)).mapInPandas(judge, "key int, a double, b double, gain binary").collect()
    held.unpersist()
    about = {keys[r["key"]][0]: np.frombuffer(bytes(r["gain"])) for r in found if r["gain"] is not None}
    return [(*keys[r["key"]], r["a"], r["b"]) for r in found if r["gain"] is None], about
