"""Sums of squares and products of spectra and a target, by fold or draw, over any number of rows: what PLS, ridge and what follows from them need to know of the
samples. Blocks are channels squared in size; rows stay with the tasks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prismatic.functions.linalg import Pls, Ridge
from prismatic.operators.spectra import channels
from prismatic.operators.transfer import added_up

#: Bytes that the blocks of one pass take at most, but for one block; more blocks take more passes over the rows.
PASS_BYTES = 64 << 20


class Moments:
    """a: the sum of u u' over rows, u being 1, the channels and the target less `shift`, so that no digits go where means are large. Moments of one shift add up."""

    def __init__(self, a: np.ndarray, shift: np.ndarray):
        self.a, self.shift = a, shift

    @classmethod
    def of(cls, x: np.ndarray, y: np.ndarray, shift: np.ndarray | None = None) -> Moments:
        z = np.column_stack([x, y])
        shift = z.mean(0) if shift is None else shift
        u = np.column_stack([np.ones(len(z)), z - shift])
        return cls(u.T @ u, shift)

    def __add__(self, other: Moments) -> Moments:
        return Moments(self.a + other.a, self.shift)

    def __sub__(self, other: Moments) -> Moments:
        return Moments(self.a - other.a, self.shift)

    def take(self, at) -> Moments:
        """Of the channels at these places."""
        at = np.asarray(at, dtype=int)
        keep = np.concatenate([[0], at + 1, [len(self.a) - 1]])
        return Moments(self.a[np.ix_(keep, keep)], self.shift[np.concatenate([at, [-1]])])

    @property
    def n(self) -> int:
        return int(round(self.a[0, 0]))

    @property
    def size(self) -> int:
        return len(self.shift) - 1

    @property
    def means(self) -> np.ndarray:
        return self.shift + self.a[0, 1:] / self.a[0, 0]

    @property
    def scatter(self) -> np.ndarray:
        """Sums of products about the means, the target last."""
        return self.a[1:, 1:] - np.outer(self.a[0, 1:], self.a[0, 1:]) / self.a[0, 0]

    def errors(self, fitted) -> float:
        """The sum of squared errors of a linear model over these rows."""
        v = np.concatenate([[self.shift[-1] - fitted.y_mean - (self.shift[:-1] - fitted.x_mean) @ fitted.coef], -fitted.coef, [1.0]])
        return float(np.maximum(0.0, v @ self.a @ v))  # NaN stays


def fitted_pls(m: Moments, components: int) -> Pls:
    """As Pls.fit() on the rows. Scores are not held: t is diagonal, with the scores' sizes."""
    s, out = m.scatter, Pls(components)
    s, c = s[:-1, :-1], s[:-1, -1].copy()
    least = max(1e-12, 1e-14 * np.linalg.norm(c))
    w, p, q, r, sizes = [], [], [], [], []
    for _ in range(min(components, m.n, m.size)):
        if (norm := np.linalg.norm(c)) < least:
            break
        one = c / norm
        turn = one.copy()
        for load, before in zip(p, r):
            turn -= (load @ one) * before
        if not (size := turn @ s @ turn) > 0:
            break
        load = s @ turn / size
        c = c - load * norm
        for keep, value in ((w, one), (p, load), (q, norm / size), (r, turn), (sizes, size)):
            keep.append(value)
    out.x_mean, out.y_mean = m.means[:-1], m.means[-1]
    out.w, out.p, out.q = (np.array(a).T if a else np.zeros((m.size, 0)) for a in (w, p, q))
    out.t = np.diag(np.sqrt(sizes)) if sizes else np.zeros((0, 0))
    out.coef = out.w @ np.linalg.pinv(out.p.T @ out.w) @ out.q if w else np.zeros(m.size)
    return out


def fitted_ridge(m: Moments, alpha: float) -> Ridge:
    s, out = m.scatter, Ridge(alpha)
    out.x_mean, out.y_mean = m.means[:-1], m.means[-1]
    out.coef = np.linalg.solve(s[:-1, :-1] + alpha * np.eye(m.size), s[:-1, -1])
    return out


def total(parts: list[Moments]) -> Moments:
    return sum(parts[1:], parts[0])


def cv_rmse(parts: list[Moments], components: int) -> float:
    """Of PLS fitted without each of the parts in turn."""
    every = total(parts)
    return float(np.sqrt(sum(one.errors(fitted_pls(every - one, components)) for one in parts if one.n) / every.n))


def dealt(samples: DataFrame, folds: int, seed: int = 42, key: str = "sample_id") -> DataFrame:
    """samples with `fold`: the place in an order by a hash of seed and key, modulo folds. Rows are numbered within 256 ranges of the hash, so no task sorts them all."""
    rows = samples.withColumn("__h", F.xxhash64(F.lit(seed), key)).withColumn("__b", F.shiftright("__h", 56).cast("int"))
    counts = {r["__b"]: r["count"] for r in rows.groupBy("__b").count().collect()}  # 256 at most
    below, so_far = [], 0
    for b in range(-128, 128):
        below.append(so_far)
        so_far += counts.get(b, 0)
    place = F.row_number().over(Window.partitionBy("__b").orderBy("__h", key)) - 1 + F.array(*[F.lit(k) for k in below])[F.col("__b") + 128]
    return rows.withColumn("fold", (place % folds).cast("int")).drop("__h", "__b")


def noise(keys: np.ndarray, p: int) -> np.ndarray:
    """Normal numbers, p for each 64-bit key: the same whatever the partitions."""

    def mixed(z):
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))

    at = mixed(keys.astype(np.int64).view(np.uint64)[:, None] + (np.arange(2 * p, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
    u = ((at >> np.uint64(11)).astype(float) + 0.5) / 2.0**53
    return np.sqrt(-2 * np.log(u[:, :p])) * np.cos(2 * np.pi * u[:, p:])


def of_rows(rows: DataFrame, cells: int, width: int, made=None, inside=None) -> list[Moments]:
    """Moments of each cell. rows: values, y and what made and inside read. made(pdf): the matrix of channels, `width` wide (else the values); inside(pdf, cell): the rows
    of a cell, as mask (else by the column cell)."""
    made = made or (lambda b: np.stack(b["values"]))
    inside = inside or (lambda b, k: b["cell"].to_numpy() == k)

    def sums(g, b):
        g[0] += len(b)
        g[1:] += np.column_stack([made(b), b["y"]]).sum(0)

    first = added_up(rows, width + 2, sums)
    shift = first[1:] / max(1.0, first[0])
    block, out = (width + 2) ** 2, []
    at_once = max(1, PASS_BYTES // (8 * block))
    for lo in range(0, cells, at_once):
        some = range(lo, min(cells, lo + at_once))

        def products(g, b, some=some):
            u = np.column_stack([np.ones(len(b)), np.column_stack([made(b), b["y"]]) - shift])
            for i, k in enumerate(some):
                own = u[inside(b, k)]
                g[i * block : (i + 1) * block] += (own.T @ own).ravel()

        blocks = added_up(rows, len(some) * block, products).reshape(len(some), width + 2, width + 2)
        out += [Moments(a, shift) for a in blocks]
    return out


def targeted(spectra: DataFrame, y: str, *more: str) -> DataFrame:
    return spectra.select("sample_id", "values", F.col(y).cast("double").alias("y"), *more)


def whole(spectra: DataFrame, y: str) -> Moments:
    """Of all rows."""
    return of_rows(targeted(spectra, y), 1, channels(spectra), inside=lambda b, k: np.ones(len(b), dtype=bool))[0]


def by_fold(spectra: DataFrame, y: str, folds: int = 5, seed: int = 42) -> list[Moments]:
    rows = dealt(targeted(spectra, y), folds, seed).withColumnRenamed("fold", "cell")
    return of_rows(rows, folds, channels(spectra))
