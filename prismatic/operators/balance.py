"""Imbalance of classes and of a numeric target: measures, weights, undersampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def severity(ratio: Column) -> Column:
    return F.when(ratio < 3, "none").when(ratio < 5, "moderate").when(ratio < 10, "severe").otherwise("extreme")


def class_imbalance(df: DataFrame, y: str) -> DataFrame:
    """One row: classes, sizes of the largest and smallest, their ratio and its name."""
    n = df.groupBy(y).count()
    return n.agg(F.count(F.lit(1)).alias("n_classes"), F.max("count").alias("largest"), F.min("count").alias("smallest")).withColumn("ratio", F.col("largest") / F.col("smallest")).withColumn("severity", severity(F.col("ratio")))


def limits(df: DataFrame, y: str) -> tuple[float, float]:
    r = df.agg(F.min(y).alias("a"), F.max(y).alias("b")).first()
    return r["a"], r["b"]


def binned(df: DataFrame, y: str, bins: int, lo: float, hi: float) -> DataFrame:
    """df with `bin` 0 .. bins - 1 of equal width; the greatest value falls in the last."""
    width = (hi - lo) / bins or 1.0
    return df.withColumn("bin", F.least(F.lit(bins - 1), F.floor((F.col(y) - lo) / width).cast("int")))


def bin_counts(df: DataFrame, y: str, bins: int = 10) -> DataFrame:
    """bin and n, empty bins too."""
    lo, hi = limits(df, y)
    n = binned(df, y, bins, lo, hi).groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
    return df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin")).join(n, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


def bin_weights(df: DataFrame, y: str, bins: int = 5) -> DataFrame:
    """df with `weight`: rows over (occupied edges' bins times the bin's rows), scaled to mean 1. The greatest value has a bin of its own, as edges close on the left."""
    lo, hi = limits(df, y)
    width = (hi - lo) / bins or 1.0
    rows = df.withColumn("bin", F.floor((F.col(y) - lo) / width).cast("int"))
    # one row for each bin: small whatever df is
    n = rows.groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
    sums = n.agg(F.sum("n").alias("all"), F.count(F.lit(1)).alias("k")).first()
    raw = sums["all"] / (sums["k"] * F.col("n"))
    scale = n.select(F.sum(raw * F.col("n")).alias("s")).first()["s"] / sums["all"]
    return rows.join(F.broadcast(n), "bin").withColumn("weight", raw / scale).drop("n")


def undersampled(df: DataFrame, y: str, order: list, bins: int = 10) -> DataFrame:
    """At most the median of the occupied bins' sizes from each bin, in the given order."""
    lo, hi = limits(df, y)
    rows = binned(df, y, bins, lo, hi)
    most = rows.groupBy("bin").count().agg(F.expr("percentile(count, 0.5)").cast("int").alias("m")).first()["m"]
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy("bin").orderBy(*order))).where(F.col("__n") <= most).drop("__n")


def rare_boost(df: DataFrame, y: str, boost: float = 2.0) -> DataFrame:
    """df with `weight`: 1 + (boost - 1) * d / max d, d the distance from the median in deviations; scaled to mean 1."""
    s = df.agg(F.expr(f"percentile({y}, 0.5)").alias("m"), F.stddev_pop(y).alias("sd")).first()
    d = F.abs(F.col(y) - s["m"]) / (s["sd"] or 1.0)
    top = df.agg(F.max(d).alias("t")).first()["t"] or 1.0
    raw = 1 + (boost - 1) * d / top
    mean = df.agg(F.avg(raw).alias("a")).first()["a"]
    return df.withColumn("weight", raw / mean)


def regression_imbalance(df: DataFrame, y: str, bins: int = 10, sparse: float = 0.2) -> dict:
    """Coverage (least over mean rows of a bin), its severity, and the bins that hold under `sparse` of an even share."""
    n = [(r["bin"], r["n"]) for r in bin_counts(df, y, bins).orderBy("bin").collect()]
    total = sum(x for _, x in n)
    coverage = min(x for _, x in n) * bins / total if total else 0.0
    return {"coverage": coverage, "severity": "none" if coverage >= 0.5 else "moderate" if coverage >= 0.2 else "severe", "sparse_bins": [b for b, x in n if x < sparse * total / bins]}


def tomek_links(df: DataFrame, label: str) -> DataFrame:
    """sample_id pairs (a, b) of different classes that are each other's nearest neighbour; sets of calibration size."""
    import numpy as np

    from prismatic.operators.multivariate import MAX_SAMPLES
    from prismatic.operators.resampling import tomek

    rows = df.select("sample_id", "values", F.col(label).alias("y")).orderBy("sample_id").limit(MAX_SAMPLES + 1).toPandas()
    if len(rows) > MAX_SAMPLES:
        raise ValueError(f"takes at most {MAX_SAMPLES} samples")
    pairs = tomek(np.stack(rows["values"]), rows["y"].to_numpy()) if len(rows) else []
    return df.sparkSession.createDataFrame([(int(rows["sample_id"][a]), int(rows["sample_id"][b])) for a, b in pairs], "a long, b long")
