"""Reports over samples: outliers by four tests, and predictions with what is known of their trust."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismatic.functions.linalg import f_quantile, kennard_stone
from prismatic.operators.multivariate import principal, spaced
from prismatic.operators.search import prepared

# Samples that describe a model's domain: all of a small set, else this many in Kennard-Stone order; and components.
SMALL, DESCRIBED, MAX_COMPONENTS = 100, 150, 20


def outliers(spectra: DataFrame, y: str, k: int = 5, level: float = 0.95, lower: float | None = None, upper: float | None = None) -> DataFrame:
    """sample_id, y, t2, q, distance (Mahalanobis, on k scores), z of y, a flag for each, total_flags and confidence (high from 3, moderate 2, low 1, none)."""
    mean, v, var, n = principal(spectra, k)
    limit = k * (n - 1) / (n - k) * f_quantile(level, k, n - k) if n > k else float("inf")
    model = spectra.sparkSession.sparkContext.broadcast((mean, v, var))

    def run(batches):
        mean, v, var = model.value
        for b in batches:
            x = np.stack(b["values"]) - mean if len(b) else np.zeros((0, len(mean)))
            s = x @ v
            t2 = (s**2 / np.where(var > 0, var, 1)).sum(1)
            # scores are uncorrelated, so the distance by their covariance is the root of T2
            yield pd.DataFrame({"sample_id": b["sample_id"], "y": b["y"], "t2": t2, "q": ((x - s @ v.T) ** 2).sum(1), "distance": np.sqrt(t2)})

    rows = spectra.select("sample_id", "values", F.col(y).cast("double").alias("y")).mapInPandas(run, "sample_id long, y double, t2 double, q double, distance double")
    s = rows.agg(F.expr(f"percentile(q, {level})").alias("q"), F.expr("percentile(distance, 0.5)").alias("m"), F.avg("y").alias("mean"), F.stddev_pop("y").alias("sd")).first()
    mad = rows.agg(F.percentile(F.abs(F.col("distance") - s["m"]), F.lit(0.5)).alias("mad")).first()["mad"]
    z = F.try_divide(F.col("y") - s["mean"], F.lit(s["sd"]))
    beyond = F.coalesce(F.abs(z) > 3, F.lit(False))
    for bound, test in ((lower, F.col("y") < lower if lower is not None else None), (upper, F.col("y") > upper if upper is not None else None)):
        beyond = beyond if bound is None else beyond | F.coalesce(test, F.lit(False))
    flags = {"t2_outlier": F.col("t2") > limit, "q_outlier": F.col("q") > s["q"], "distance_outlier": F.col("distance") > s["m"] + 3 * mad, "y_outlier": beyond}
    total = sum((F.col(c).cast("int") for c in flags), F.lit(0))
    named = F.when(F.col("total_flags") >= 3, "high").when(F.col("total_flags") == 2, "moderate").when(F.col("total_flags") == 1, "low").otherwise("none")
    return rows.withColumn("z", z).withColumns(flags).withColumn("total_flags", total).withColumn("confidence", named)


def domain(x: np.ndarray, k: int = MAX_COMPONENTS) -> dict:
    """What describes the samples a model was fitted on: mean, loadings, scores of some, and percentiles of the distances between those."""
    mean = x.mean(0)
    _, s, vt = np.linalg.svd(x - mean, full_matrices=False)
    v = vt[: max(1, min(k, int((s > 1e-10 * (s[0] or 1)).sum())))].T
    scores = (x - mean) @ v
    return described(mean, v, scores if len(x) <= SMALL else scores[kennard_stone(scores, min(DESCRIBED, len(x)))])


def described(mean: np.ndarray, v: np.ndarray, some: np.ndarray) -> dict:
    d = np.sqrt(np.maximum(0, (some**2).sum(1)[:, None] + (some**2).sum(1)[None] - 2 * some @ some.T))[np.triu_indices(len(some), 1)]
    p = np.percentile(d, [50, 75, 95, 100]) if len(d) else np.zeros(4)
    return {"mean": mean, "loadings": v, "scores": some, "p50": p[0], "p75": p[1], "p95": p[2], "max": p[3]}


def domain_of_rows(spectra: DataFrame, k: int = MAX_COMPONENTS) -> dict:
    """domain() of any number of rows: loadings from their scatter, scores in Kennard-Stone order from tasks."""
    mean, v, var, n = principal(spectra, k)
    v = v[:, : max(1, int((var > 1e-14 * (var[0] or 1)).sum()))]  # below that a scatter matrix tells nothing

    @F.pandas_udf("array<double>")
    def scored(x: pd.Series) -> pd.Series:
        return pd.Series(list((np.stack(x) - mean) @ v)) if len(x) else x

    rows = spectra.select("sample_id", scored("values").alias("values"), F.lit(0.0).alias("y"))
    return described(mean, v, np.stack([s for _, s, _ in spaced(rows, n if n <= SMALL else DESCRIBED)]))


def predicted(spectra: DataFrame, fitted, of: dict, rmsecv: float, preprocess: str = "raw", window: int = 7) -> DataFrame:
    """spectra with pred, spread (of a forest's trees, else the error of cross-validation), distance to the nearest described sample, and trust: good up to
    the 75th percentile, caution up to the 95th, else extrapolation."""
    model = spectra.sparkSession.sparkContext.broadcast((fitted, of))

    @F.pandas_udf("pred double, spread double, distance double, trust string")
    def run(v: pd.Series) -> pd.DataFrame:
        if not len(v):
            return pd.DataFrame({"pred": [], "spread": [], "distance": [], "trust": []})
        fitted, of = model.value
        x = prepared(np.stack(v), preprocess, window)
        s, c = (x - of["mean"]) @ of["loadings"], of["scores"]
        d = np.sqrt(np.maximum(0, (s**2).sum(1)[:, None] + (c**2).sum(1)[None] - 2 * s @ c.T)).min(1)
        spread = fitted.spread(x) if hasattr(fitted, "spread") else np.full(len(x), rmsecv)
        return pd.DataFrame({"pred": fitted.predict(x), "spread": spread, "distance": d, "trust": np.where(d <= of["p75"], "good", np.where(d <= of["p95"], "caution", "extrapolation"))})

    return spectra.withColumn("__p", run("values")).select(*spectra.columns, "__p.*")


def compared_selections(spectra: DataFrame, n: int, y: str | None = None, seed: int = 42) -> list[dict]:
    """Mean and least distance between the samples that each method chooses, and the part of the channels' ranges that they cover."""
    from prismatic.operators import multivariate

    lo, hi = multivariate.channel_ranges(spectra)
    order = multivariate.ordered_samples(spectra, n + min(n, spectra.count() - n))
    dealt = multivariate.dealt_in_turn([i for i, _, _ in order], n, len(order) - n)
    made = {"kennard_stone": [i for i, _, _ in order[:n]], "duplex": [i for i, part in dealt if part == "calibration"], "random": [r["sample_id"] for r in multivariate.random_samples(spectra.select("sample_id"), "sample_id", n, seed).collect()]}
    made |= {"spxy": [i for i, _, _ in multivariate.ordered_samples(spectra, n, y)]} if y else {}
    every = {i for ids in made.values() for i in ids}
    values = {r["sample_id"]: np.array(r["values"]) for r in spectra.select("sample_id", "values").where(F.col("sample_id").isin(sorted(every))).collect()}
    out = []
    for name, ids in made.items():
        x = np.stack([values[i] for i in ids])
        d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))[np.triu_indices(len(x), 1)]
        out.append({"method": name, "mean_distance": float(d.mean()), "min_distance": float(d.min()), "coverage": float(np.mean(np.ptp(x, axis=0) / np.where(hi > lo, hi - lo, 1)))})
    return out
