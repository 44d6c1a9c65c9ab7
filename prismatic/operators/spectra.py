"""Spectra as rows with an array, and as rows with a channel each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prismatic.functions import arrays


def from_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sample_id, values array<double> and label: a table of short spectra over channels 0, 1, ..."""
    t = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return t.select(F.col("vec_id").alias("sample_id"), F.col("embedding").cast("array<double>").alias("values"), "label")


def long(spectra: DataFrame, *more: str) -> DataFrame:
    return spectra.select("sample_id", *more, F.posexplode("values").alias("ch", "value"))


def channels(spectra: DataFrame) -> int:
    first = spectra.select(F.size("values").alias("n")).first()
    return first["n"] if first else 0


def mean_spectrum(spectra: DataFrame) -> list[float]:
    """The mean of each channel: as many rows as channels come to the driver."""
    rows = long(spectra).groupBy("ch").agg(F.avg("value").alias("m")).collect()
    return [r["m"] for r in sorted(rows, key=lambda r: r["ch"])]


def median_spectrum(spectra: DataFrame) -> list[float]:
    rows = long(spectra).groupBy("ch").agg(F.percentile("value", F.lit(0.5)).alias("m")).collect()
    return [r["m"] for r in sorted(rows, key=lambda r: r["ch"])]


def msc(spectra: DataFrame, reference: str | list[float] = "mean") -> DataFrame:
    """Against the mean or median spectrum, or one given."""
    named = {"mean": mean_spectrum, "median": median_spectrum}
    return spectra.withColumn("values", arrays.scatter_corrected(F.col("values"), named[reference](spectra) if isinstance(reference, str) else reference))


def glsw(spectra: DataFrame, regularization: float = 1e-6) -> DataFrame:
    """Channels times the root of their weight: 1 / (population variance + regularization), scaled to mean 1."""
    rows = long(spectra).groupBy("ch").agg(F.var_pop("value").alias("v")).collect()
    w = [1 / (r["v"] + regularization) for r in sorted(rows, key=lambda r: r["ch"])]
    m = sum(w) / len(w)
    roots = F.array(*[F.lit((x / m) ** 0.5) for x in w])
    return spectra.withColumn("values", F.zip_with("values", roots, lambda x, k: x * k))
