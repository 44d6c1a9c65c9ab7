"""Instruments by how much detail their spectra hold, and a common grid for several."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismatic.functions import arrays
from prismatic.functions.linalg import find_peaks


def fwhm(v: np.ndarray, axis: np.ndarray, peak: int) -> float:
    """Width at half of the peak's height, crossings by straight lines; NaN where a side never falls so low."""
    half, out = v[peak] / 2, []
    for step in (-1, 1):
        i = peak
        while 0 <= i + step < len(v) and v[i] > half:
            i += step
        if v[i] > half:
            return float("nan")
        a = i - step
        out.append(axis[i] + (half - v[i]) / (v[a] - v[i]) * (axis[a] - axis[i]) if a != i and v[a] != v[i] else axis[i])
    return float(abs(out[1] - out[0]))


# What a peak of a spectrum scaled to [0, 1] must have: prominence, places to the next, places of width.
PROMINENCE, DISTANCE, WIDTH = 0.05, 5, 2.0


def characterized(spectra: DataFrame, instrument: str, axes: dict[str, list[float]], prominence: float = PROMINENCE, distance: int = DISTANCE, wide: float = WIDTH) -> DataFrame:
    """A row for each instrument: samples, ends and steps of its axis, whether that is a computed grid, roughness, peaks, their width and sharpness (height over
    width), and detail (root of roughness over the step), in order of detail."""

    def peaks(batches):
        for b in batches:
            n, width, sharp = [], [], []
            for name, v in zip(b[instrument], b["values"]):
                x, axis = np.asarray(v), np.asarray(axes[name])
                x = (x - x.min()) / (np.ptp(x) or 1.0)
                at = find_peaks(x, prominence, distance, wide)
                w = [(y, x[i] / y) for i, y in ((i, fwhm(x, axis, i)) for i in at) if y > 0]
                n.append(len(at))
                width.append(float(np.mean([y for y, _ in w])) if w else None)
                sharp.append(float(np.mean([y for _, y in w])) if w else None)
            yield b[[instrument]].assign(rough=b["rough"], n_peaks=n, width=width, sharp=sharp)

    rows = spectra.select(instrument, "values", arrays.roughness(F.col("values")).alias("rough"))
    each = rows.mapInPandas(peaks, f"{instrument} string, rough double, n_peaks int, width double, sharp double")
    stats = each.groupBy(instrument).agg(F.count(F.lit(1)).alias("n"), F.sqrt(F.avg("rough")).alias("roughness"), F.avg("n_peaks").alias("mean_peaks"), F.avg("width").alias("mean_fwhm"), F.avg("sharp").alias("mean_sharpness"))
    about = []
    for name, axis in axes.items():
        step = np.diff(axis)
        about.append((name, float(axis[0]), float(axis[-1]), float(np.median(step)), bool(step.std() / step.mean() < 1e-6)))
    grid = spectra.sparkSession.createDataFrame(about, f"{instrument} string, lo double, hi double, step double, interpolated boolean")
    return stats.join(F.broadcast(grid), instrument).withColumn("detail", F.col("roughness") / F.col("step")).orderBy(F.desc("detail"), instrument)


def common_grid(axes: list[list[float]]) -> list[float]:
    """From the largest start to the smallest end at the coarsest median step."""
    lo, hi, step = max(a[0] for a in axes), min(a[-1] for a in axes), max(float(np.median(np.diff(a))) for a in axes)
    if lo >= hi:
        raise ValueError("the axes don't overlap")
    return [lo + k * step for k in range(int((hi - lo) / step + 1e-9) + 1)]


def mapping(axis: list[float], grid: list[float], fitted: dict | None = None):
    """What takes an instrument's rows to the common grid: resampling and then, where one is given, a fitted transfer (transfer.apply_transfer) on that grid."""
    from prismatic.operators.transfer import apply_transfer

    def to_grid(df: DataFrame) -> DataFrame:
        out = df.withColumn("values", arrays.resampled(F.col("values"), axis, grid))
        return apply_transfer(out, fitted) if fitted else out

    return to_grid


def equalized(sources: dict[str, tuple[DataFrame, list[float]]], transfers: dict[str, dict] | None = None) -> tuple[DataFrame, list[float]]:
    """Rows of all instruments on the common grid, with `instrument`; transfers: fitted ones for some instruments, on that grid."""
    grid, out = common_grid([a for _, a in sources.values()]), None
    for name, (df, axis) in sources.items():
        part = mapping(axis, grid, (transfers or {}).get(name))(df).withColumn("instrument", F.lit(name))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out, grid


def smoothing_between(high: np.ndarray, high_axis: list[float], low: np.ndarray, low_axis: list[float], sigmas: list[float]) -> float:
    """The Gaussian width (in channels) that brings mean spectra of the finer instrument closest to the coarser's."""
    best, least = sigmas[0], float("inf")
    for s in sigmas:
        half = max(1, int(4 * s))
        k = np.exp(-0.5 * (np.arange(-half, half + 1) / s) ** 2) if s > 0 else np.eye(1, 2 * half + 1, half)[0]
        smooth = np.convolve(np.pad(high, half, mode="edge"), k / k.sum(), mode="valid")
        error = float(((np.interp(low_axis, high_axis, smooth) - low) ** 2).mean())
        if error < least:
            best, least = s, error
    return best
