"""Residuals, outliers and instrument measures."""

from __future__ import annotations

import statistics

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def one_row(df: DataFrame, **aggregates) -> dict:
    return df.agg(*[a.alias(n) for n, a in aggregates.items()]).first().asDict()


def residuals(df: DataFrame, y: str, predicted: str) -> DataFrame:
    """df with residual and standardized (by the population deviation, unless that is all but 0)."""
    r = df.withColumn("residual", F.col(y) - F.col(predicted))
    sd = one_row(r, sd=F.stddev_pop("residual"))["sd"] or 0.0
    return r.withColumn("standardized", F.col("residual") / sd if sd >= 1e-10 else F.col("residual"))


def z_outliers(df: DataFrame, y: str, limit: float = 3.0, lower: float | None = None, upper: float | None = None) -> DataFrame:
    s = one_row(df, m=F.avg(y), sd=F.stddev_pop(y))
    z = (F.col(y) - (s["m"] or 0.0)) / (s["sd"] or 1.0)
    out = F.abs(z) > limit
    if lower is not None:
        out = out | (F.col(y) < lower)
    if upper is not None:
        out = out | (F.col(y) > upper)
    return df.withColumn("z", z).withColumn("is_outlier", out)


def mad_outliers(df: DataFrame, x: str, times: float = 3.0) -> DataFrame:
    """Rows beyond median + times * MAD (without the 1.4826)."""
    m = one_row(df, m=F.expr(f"percentile({x}, 0.5)"))["m"]
    mad = one_row(df.select(F.abs(F.col(x) - m).alias("d")), m=F.expr("percentile(d, 0.5)"))["m"]
    return df.withColumn("is_outlier", F.col(x) > m + times * mad)


def spacing(axis: DataFrame, wl: str) -> DataFrame:
    """Median, least and greatest step of an axis of one row for each channel."""
    step = F.col(wl) - F.lag(wl).over(Window.orderBy(wl))
    s = axis.select(step.alias("s")).where("s is not null")
    return s.agg(F.expr("percentile(s, 0.5)").alias("median_step"), F.min("s").alias("min_step"), F.max("s").alias("max_step"), (F.stddev_pop("s") / F.avg("s") < 1e-6).alias("interpolated"))


def ranked(df: DataFrame, x: str, buckets: int = 256) -> DataFrame:
    """x of the rows that have it, its place from 1 in ascending order, and n, the number of such rows. Rows go to buckets between approximate quantiles, are
    numbered there, and get the number of rows in the buckets below: no task sorts them all."""
    rows = df.select(x).where(F.col(x).isNotNull())
    edges = sorted(set(rows.agg(F.percentile_approx(x, [k / buckets for k in range(1, buckets)], 10 * buckets).alias("q")).first()["q"] or []))
    rows = rows.withColumn("bucket", F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e <= F.col(x))) if edges else F.lit(0))
    counts = {r["bucket"]: r["count"] for r in rows.groupBy("bucket").count().collect()}  # at most `buckets`
    below, so_far = [], 0
    for b in range(len(edges) + 1):
        below.append(so_far)
        so_far += counts.get(b, 0)
    place = F.row_number().over(Window.partitionBy("bucket").orderBy(x)) + F.array(*[F.lit(k) for k in below])[F.col("bucket")]
    return rows.select(x, place.cast("long").alias("place"), F.lit(so_far).cast("long").alias("n"))


def quantile_pairs(df: DataFrame, x: str) -> DataFrame:
    """place, probability, expected (the normal quantile of probability) and observed, for a Q-Q plot: a row for every value, at place k of n the probability
    k / (n + 1)."""

    @F.pandas_udf("double")
    def normal(p: pd.Series) -> pd.Series:
        return p.map(statistics.NormalDist().inv_cdf)

    rows = ranked(df, x).select("place", (F.col("place") / (F.col("n") + 1)).alias("probability"), F.col(x).alias("observed"))
    return rows.withColumn("expected", normal("probability"))


def jackknife(spark, make, x: np.ndarray, y: np.ndarray, new: np.ndarray, confidence: float = 0.95) -> list[tuple[float, float, float]]:
    """(prediction, lower, upper) for each row of new: a model refitted without each sample in turn, a task for some of them."""
    from prismatic.functions.linalg import t_quantile

    data, n = spark.sparkContext.broadcast((x, y, new)), len(y)

    def run(batches):
        x, y, new = data.value
        for b in batches:
            rows = [make().fit(np.delete(x, i, 0), np.delete(y, i)).predict(new) for i in b["id"]]
            yield pd.DataFrame({"id": b["id"], "pred": rows})

    got = np.array([list(r["pred"]) for r in spark.range(n).repartition(min(n, 4 * spark.sparkContext.defaultParallelism)).mapInPandas(run, "id long, pred array<double>").collect()])
    half = t_quantile((1 + confidence) / 2, n - 1) * np.sqrt((n - 1) / n * ((got - got.mean(0)) ** 2).sum(0))
    middle = make().fit(x, y).predict(new)
    return [(float(m), float(m - h), float(m + h)) for m, h in zip(middle, half)]
