"""Choice of channels. Each method works on moments by fold (operators/moments.py), from rows of any number; the same methods take a matrix that the driver holds.
Independent fits run as Spark tasks, which hold blocks of channels squared, not rows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prismatic.functions.linalg import Pls
from prismatic.operators import moments
from prismatic.operators.moments import Moments, fitted_pls, total
from prismatic.operators.spectra import channels


def fold_of(n: int, k: int, seed: int = 42) -> np.ndarray:
    return np.random.default_rng(seed).permutation(n) % k


def cv_rmse(x: np.ndarray, y: np.ndarray, components: int, k: int = 5) -> float:
    fold, e = fold_of(len(y), k), np.empty(len(y))
    for f in range(k):
        test = fold == f
        e[test] = y[test] - Pls(components).fit(x[~test], y[~test]).predict(x[test])
    return float(np.sqrt((e**2).mean()))


def parts_of(x: np.ndarray, y: np.ndarray, k: int = 5, seed: int = 42) -> list[Moments]:
    """Moments by fold of a matrix."""
    fold, shift = fold_of(len(y), k, seed), np.column_stack([x, y]).mean(0)
    return [Moments.of(x[fold == f], y[fold == f], shift) for f in range(k)]


def scored_subsets(spark: SparkSession, parts: list[Moments], subsets: list[list[int]], components: int = 5) -> list[float]:
    """Cross-validated RMSE of each subset of channels, a task for some subsets."""
    data = spark.sparkContext.broadcast(parts)

    def run(batches):
        for b in batches:
            yield pd.DataFrame({"i": b["i"], "rmse": [moments.cv_rmse([m.take(c) for m in data.value], min(components, len(c))) for c in b["channels"]]})

    rows = spark.createDataFrame([(i, list(map(int, c))) for i, c in enumerate(subsets)], "i int, channels array<int>")
    got = rows.repartition(min(len(subsets), 4 * spark.sparkContext.defaultParallelism)).mapInPandas(run, "i int, rmse double").collect()
    return [r["rmse"] for r in sorted(got, key=lambda r: r["i"])]


def uve(x: np.ndarray, y: np.ndarray, cutoff: float = 1.0, components: int = 5, k: int = 5, seed: int = 42) -> np.ndarray:
    """Mask of channels whose coefficient is steadier over folds than that of any of as many noise channels; all, if none is."""
    steady, limit = steadiness(x, y, components, k, seed)
    mask = steady > cutoff * limit
    return mask if mask.any() else np.ones(x.shape[1], dtype=bool)


def steadiness(x: np.ndarray, y: np.ndarray, components: int = 5, k: int = 5, seed: int = 42) -> tuple[np.ndarray, float]:
    """Each channel's mean coefficient over its deviation over folds, and the largest of as many noise channels, which vary as the spectra do."""
    noise = np.random.default_rng(seed).normal(size=x.shape) * x.std()
    return steadiness_of(parts_of(np.hstack([x, noise]), y, k, seed), components)


def steadiness_of(parts: list[Moments], components: int = 5) -> tuple[np.ndarray, float]:
    """The same from moments by fold of channels and, after them, as many noise channels."""
    every, p = total(parts), parts[0].size // 2
    b = np.array([fitted_pls(every - one, components).coef for one in parts])
    steady = np.abs(b.mean(0)) / (b.std(0) + 1e-12)
    return steady[:p], float(steady[p:].max())


def uve_of_rows(spectra: DataFrame, y: str, cutoff: float = 1.0, components: int = 5, k: int = 5, seed: int = 42) -> np.ndarray:
    """uve() of any number of rows. Noise goes by a hash of seed and sample_id."""
    p = channels(spectra)
    rows = moments.targeted(spectra, y)
    every = F.aggregate("values", F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("q")), lambda a, v: F.struct((a["s"] + v).alias("s"), (a["q"] + v * v).alias("q")))
    # in two passes, so that a large mean costs no digits
    mean = rows.agg((F.sum(every["s"]) / F.sum(F.size("values"))).alias("m")).first()["m"]
    sd = rows.withColumn("values", F.transform("values", lambda v: v - F.lit(mean))).agg(F.sqrt(F.sum(every["q"]) / F.sum(F.size("values"))).alias("sd")).first()["sd"]
    keyed = moments.dealt(rows, k, seed).select("values", "y", F.col("fold").alias("cell"), F.xxhash64(F.lit(seed + 1), "sample_id").alias("key"))
    parts = moments.of_rows(keyed, k, 2 * p, made=lambda b: np.hstack([np.stack(b["values"]), moments.noise(b["key"].to_numpy(), p) * sd]))
    steady, limit = steadiness_of(parts, components)
    mask = steady > cutoff * limit
    return mask if mask.any() else np.ones(p, dtype=bool)


def ipls(spark: SparkSession, x: np.ndarray, y: np.ndarray, intervals: int = 20, components: int = 5, k: int = 5) -> list[tuple[int, int, float]]:
    return ipls_of(spark, parts_of(x, y, k), intervals, components)


def ipls_of(spark: SparkSession, parts: list[Moments], intervals: int = 20, components: int = 5) -> list[tuple[int, int, float]]:
    """(start, end, R2 in cross-validation, 0 at least) of equal intervals, the last taking the rest."""
    every, p = total(parts), parts[0].size
    width = p // intervals
    edges = [(i * width, p if i == intervals - 1 else (i + 1) * width) for i in range(intervals)]
    rmse = scored_subsets(spark, parts, [list(range(a, b)) for a, b in edges], components)
    return [(a, b, max(0.0, float(1 - r * r / (every.scatter[-1, -1] / every.n)))) for (a, b), r in zip(edges, rmse)]


def cars(spark: SparkSession, x: np.ndarray, y: np.ndarray, rounds: int = 30, components: int = 5, k: int = 5, seed: int = 42) -> list[int]:
    rng = np.random.default_rng(seed)

    def drawn(i: int) -> Moments:
        rows = rng.choice(len(y), max(components + 2, int(0.8 * len(y))), replace=False)
        return Moments.of(x[rows], y[rows])

    return cars_of(spark, parts_of(x, y, k), drawn, rng, rounds, components)


def cars_of_rows(spectra: DataFrame, y: str, rounds: int = 30, components: int = 5, k: int = 5, seed: int = 42) -> list[int]:
    """cars() of any number of rows: a round learns from the four fifths of them that a hash of seed, round and sample_id draws."""
    rows, p = moments.targeted(spectra, y), channels(spectra)
    draws = F.array(*[F.pmod(F.xxhash64(F.lit(seed), F.lit(i), "sample_id"), F.lit(5)) > 0 for i in range(rounds)])
    parts, some = moments.by_fold(spectra, y, k, seed), moments.of_rows(rows.withColumn("in", draws), rounds, p, inside=lambda b, i: np.stack(b["in"])[:, i].astype(bool))
    some = [m if m.n >= components + 2 else total(parts) for m in some]  # of a handful of rows a draw may leave too few
    return cars_of(spectra.sparkSession, parts, some.__getitem__, np.random.default_rng(seed), rounds, components)


def cars_of(spark: SparkSession, parts: list[Moments], drawn, rng: np.random.Generator, rounds: int = 30, components: int = 5) -> list[int]:
    """Competitive adaptive reweighted sampling: channels drawn by |coefficient|, in numbers that fall off exponentially; the subset of least error. drawn(i): moments of
    the rows that round i learns from."""
    p = parts[0].size
    now, subsets = np.arange(p), []
    for i in range(rounds):
        w = np.abs(fitted_pls(drawn(i).take(now), min(components, len(now))).coef)
        n = max(2, int(round(p * 0.8 * np.exp(-2 * i / rounds * np.log(p / 2) / 2))))
        if n < len(now) and (w > 0).sum() >= n:
            now = np.sort(rng.choice(now, n, replace=False, p=w / w.sum()))
        subsets.append(now.tolist())
    errors = scored_subsets(spark, parts, subsets, components)
    return subsets[int(np.argmin(errors))]


def vcpa(spark: SparkSession, x: np.ndarray, y: np.ndarray, outer: int = 5, draws: int = 60, components: int = 5, k: int = 5, seed: int = 42) -> list[int]:
    return vcpa_of(spark, parts_of(x, y, k), outer, draws, components, seed)


def vcpa_of(spark: SparkSession, parts: list[Moments], outer: int = 5, draws: int = 60, components: int = 5, seed: int = 42) -> list[int]:
    """Random subsets, each scored in a task; a channel's weight is the mean of 1 / error over the subsets that hold it, and those below the median weight go."""
    rng, now = np.random.default_rng(seed), np.arange(parts[0].size)
    best, least = now.tolist(), float("inf")
    for o in range(outer):
        share = 0.9 * (1 - o / outer) + 0.2
        masks = rng.random((draws, len(now))) < min(0.9, share)
        masks = masks[masks.sum(1) >= 2]
        errors = np.array(scored_subsets(spark, parts, [now[m].tolist() for m in masks], components))
        if errors.min() < least:
            least, best = float(errors.min()), now[masks[errors.argmin()]].tolist()
        w = (masks / errors[:, None]).sum(0) / np.maximum(1, masks.sum(0))
        keep = w >= np.median(w) if len(now) > 10 else w >= 0
        now = now[keep]
    return best


def least_related(alike: np.ndarray, first: int, n: int) -> list[int]:
    """first, then always the channel that the chosen ones have least squared correlation with in sum."""
    out, total = [first], alike[first].copy()
    while len(out) < min(n, len(alike)):
        total[out[-1]] = np.inf
        out.append(int(np.argmin(total)))
        total += alike[out[-1]]
    return out


def scored_spa(spark: SparkSession, x: np.ndarray, y: np.ndarray, n: int, starts: int = 10, components: int = 5, k: int = 5, seed: int = 42) -> list[int]:
    return scored_spa_of(spark, parts_of(x, y, k), n, starts, components, seed)


def scored_spa_of(spark: SparkSession, parts: list[Moments], n: int, starts: int = 10, components: int = 5, seed: int = 42) -> list[int]:
    """n little related channels in order of choice: of the runs from the channel most correlated with y and from random others, the one of least error in
    cross-validation. Runs are scored in tasks."""
    s, p = total(parts).scatter, parts[0].size
    size = np.sqrt(np.maximum(0, np.diag(s)[:-1]))
    over = np.divide(1.0, size, out=np.zeros(p), where=size > 0)
    lead = int(np.argmax(np.abs(s[:-1, -1] * over)))
    others = np.random.default_rng(seed).permutation(np.delete(np.arange(p), lead))[: starts - 1]
    alike = (s[:-1, :-1] * np.outer(over, over)) ** 2
    runs = [least_related(alike, int(first), n) for first in [lead, *others]]
    return runs[int(np.argmin(scored_subsets(spark, parts, runs, components)))]


def projected(scatter: np.ndarray, n: int, rows: int) -> list[int]:
    """spa() from the channels' scatter matrix: what is left of it when a channel is projected out is its Schur complement."""
    g = scatter.copy()
    out = [int(np.argmax(np.diag(g)))]
    while len(out) < min(n, rows, len(g)):
        at = out[-1]
        if g[at, at] < 1e-12:
            break
        g = g - np.outer(g[:, at], g[at]) / g[at, at]
        norms = np.diag(g).copy()
        norms[out] = -1
        out.append(int(np.argmax(norms)))
    return out


def compared(spark: SparkSession, x: np.ndarray, y: np.ndarray, n: int = 30, k: int = 5) -> list[dict]:
    """method, n_channels, rmse in cross-validation and seconds of SPA, CARS and VCPA."""
    import time

    from prismatic.functions.linalg import spa

    out = []
    for name, choose in {"spa": lambda: spa(x, n), "cars": lambda: cars(spark, x, y, k=k), "vcpa": lambda: vcpa(spark, x, y, k=k)}.items():
        t = time.perf_counter()
        channels = sorted(map(int, choose()))
        out.append({"method": name, "n_channels": len(channels), "rmse": cv_rmse(x[:, channels], y, min(5, len(channels)), k), "seconds": time.perf_counter() - t})
    return out


def uve_spa(x: np.ndarray, y: np.ndarray, n: int, cutoff: float = 1.0) -> list[int]:
    """n channels by SPA of those that UVE lets through, or all of these where they are fewer."""
    from prismatic.functions.linalg import spa

    inside = np.flatnonzero(uve(x, y, cutoff))
    return sorted(inside[spa(x[:, inside], n)].tolist())


def uve_spa_of_rows(spectra: DataFrame, y: str, n: int, cutoff: float = 1.0) -> list[int]:
    """uve_spa() of any number of rows."""
    inside, every = np.flatnonzero(uve_of_rows(spectra, y, cutoff)), moments.whole(spectra, y)
    return sorted(inside[projected(every.take(inside).scatter[:-1, :-1], n, every.n)].tolist())
