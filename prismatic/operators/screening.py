"""Which channels and regions of the axis go with the target."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


# Width and step of regions, in units of the axis; single regions tried for up to so many regions, and how many go together.
REGION_SIZE, REGION_STEP = 50.0, 25.0
SINGLES = {5: 3, 10: 5, 15: 7}
MOST_SINGLES, TOGETHER = 10, (2, 5, 10, 15, 20)


def channel_correlations(rows: DataFrame, y: str) -> DataFrame:
    """ch and Pearson r of long rows; null where either side doesn't vary."""
    y = F.col(y).cast("double")
    r = F.try_divide(F.covar_pop("value", y), F.stddev_pop("value") * F.stddev_pop(y))
    return rows.groupBy("ch").agg(r.alias("r"))


def screened(rows: DataFrame, y: str, n: int = 20) -> DataFrame:
    """The n channels of largest |r|; ties to the lower channel."""
    return channel_correlations(rows, y).orderBy(F.desc_nulls_last(F.abs("r")), "ch").limit(n)


def regions(correlations: DataFrame, last: int, size: int = 16, step: int = 8) -> DataFrame:
    """start, mean and greatest |r|, and channels, of windows [start, start + size) over the axis. Each channel is sent to the windows that hold it."""
    starts = F.sequence(F.greatest(F.lit(0), F.ceil((F.col("ch") - (size - 1)) / step).cast("int")), F.floor(F.col("ch") / step).cast("int"))
    hit = correlations.where("r is not null").select(F.explode(starts).alias("k"), F.abs("r").alias("a"))
    return hit.groupBy((F.col("k") * step).alias("start")).agg(F.avg("a").alias("mean_corr"), F.max("a").alias("max_corr"), F.count(F.lit(1)).alias("n")).where(F.col("start") <= last)


def subsets(ranked: list[dict], n: int = 5) -> dict[str, list[int]]:
    """Channels of single regions and of the first 2, 5, 10, 15, 20 together, by name. ranked: start, end and channels of the best regions, the best first."""
    singles = next((k for most, k in SINGLES.items() if n <= most), MOST_SINGLES)
    out = {f"region_{r['start']:g}-{r['end']:g}": sorted(r["channels"]) for r in ranked[: min(singles, n)] if r["channels"]}
    for k in TOGETHER:
        if k <= n and (both := sorted({c for r in ranked[:k] for c in r["channels"]})):
            out[f"top{k}regions"] = both
    return out


def region_report(ranked: list[dict], top: int = 10) -> str:
    """A line for each of the first regions: start, end, mean and greatest |r|, channels."""
    lines = [f"{k + 1:>3}. {r['start']:g}-{r['end']:g}: mean |r| {r['mean_corr']:.3f}, max |r| {r['max_corr']:.3f}, {r['n']} channels" for k, r in enumerate(ranked[:top])]
    return "\n".join([f"Top {len(lines)} regions", *lines]) + "\n"
