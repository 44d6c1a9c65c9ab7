"""Row-wise functions on a spectrum held as array<double>: no shuffle, one pass."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def mean(v: Column) -> Column:
    return total(v) / F.size(v)


def snv(v: Column) -> Column:
    """Standard normal variate: (x - mean) / population deviation; a flat spectrum keeps its centred zeros."""
    stats = F.struct(mean(v).alias("m"), v.alias("v"))

    def scaled(s: Column) -> Column:
        sd = F.sqrt(total(F.transform(s["v"], lambda x: (x - s["m"]) * (x - s["m"]))) / F.size(s["v"]))
        one = F.struct(F.when(sd == 0, F.lit(1.0)).otherwise(sd).alias("sd"))
        return F.element_at(F.transform(F.array(one), lambda d: F.transform(s["v"], lambda x: (x - s["m"]) / d["sd"])), 1)

    return F.element_at(F.transform(F.array(stats), scaled), 1)


def absorbance(v: Column) -> Column:
    """log10(1 / reflectance), reflectance no less than 1e-6."""
    return F.transform(v, lambda x: F.log10(1.0 / F.greatest(x, F.lit(1e-6))))


def weighted(v: Column, rows: np.ndarray) -> Column:
    """v times the transpose of a small banded matrix, each output from its band alone."""
    parts = []
    for row in rows:
        at = np.flatnonzero(row)
        lo, hi = (int(at[0]), int(at[-1]) + 1) if len(at) else (0, 1)
        kernel = F.array(*[F.lit(float(x)) for x in row[lo:hi]])
        parts.append(total(F.zip_with(F.slice(v, lo + 1, hi - lo), kernel, lambda x, k: x * k)))
    return F.array(*parts)


def savgol_matrix(size: int, window: int = 7, polyorder: int | None = None, deriv: int = 1) -> np.ndarray:
    """Savitzky-Golay as a size x size matrix; ends take the polynomial of the first or last window. An even window grows by one."""
    window += window % 2 == 0
    polyorder = (2 if deriv == 1 else 3) if polyorder is None else polyorder
    if not polyorder + 2 <= window <= size:
        raise ValueError("window must lie between polyorder + 2 and the number of channels")
    half = window // 2
    fit = np.linalg.pinv(np.vander(np.arange(-half, half + 1.0), polyorder + 1, increasing=True))
    out = np.zeros((size, size))
    for ch in range(size):
        centre = min(max(ch, half), size - 1 - half)
        t = float(ch - centre)
        for p in range(deriv, polyorder + 1):
            out[ch, centre - half : centre + half + 1] += fit[p] * np.prod(np.arange(p - deriv + 1, p + 1.0)) * t ** (p - deriv)
    out[np.abs(out) < 1e-15] = 0
    return out


def savgol(v: Column, size: int, window: int = 7, polyorder: int | None = None, deriv: int = 1) -> Column:
    """The interior by one sliding kernel, the two ends by their own rows."""
    m = savgol_matrix(size, window, polyorder, deriv)
    half = (window + (window % 2 == 0)) // 2
    kernel = F.array(*[F.lit(float(x)) for x in m[half, : 2 * half + 1]])
    inner = F.transform(F.sequence(F.lit(1), F.lit(size - 2 * half)), lambda i: total(F.zip_with(F.slice(v, i, 2 * half + 1), kernel, lambda x, k: x * k)))
    return F.concat(weighted(v, m[:half]), inner, weighted(v, m[size - half :]))


def detrended(v: Column, size: int, degree: int = 1) -> Column:
    """v less its polynomial over the channel number: linear in v, so by an orthonormal basis."""
    basis, _ = np.linalg.qr(np.vander(np.arange(float(size)), degree + 1, increasing=True))
    parts = [F.array(*[F.lit(float(x)) for x in b]) for b in basis.T]
    fitted = F.array(*[total(F.zip_with(v, p, lambda x, k: x * k)) for p in parts])
    table = F.arrays_zip(v.alias("v"), *[p.alias(f"p{i}") for i, p in enumerate(parts)])
    row = F.struct(fitted.alias("c"), table.alias("t"))
    return F.element_at(F.transform(F.array(row), lambda s: F.transform(s["t"], lambda r: r["v"] - sum((s["c"][i] * r[f"p{i}"] for i in range(1, degree + 1)), s["c"][0] * r["p0"]))), 1)


def scatter_corrected(v: Column, reference: list[float]) -> Column:
    """MSC against a reference spectrum: x = a + b * ref, returns (x - a) / b; unchanged where the slope is all but 0."""
    ref = np.array(reference)
    centred = ref - ref.mean()
    if ref.std() < 1e-12:
        return v
    kernel = F.array(*[F.lit(float(x)) for x in centred / (centred @ centred)])
    fit = F.struct(total(F.zip_with(v, kernel, lambda x, k: x * k)).alias("b"), mean(v).alias("m"), v.alias("v"))
    centre = float(ref.mean())
    return F.element_at(F.transform(F.array(fit), lambda s: F.when(F.abs(s["b"]) < 1e-10, s["v"]).otherwise(F.transform(s["v"], lambda x: (x - (s["m"] - s["b"] * centre)) / s["b"]))), 1)


def kept_channels(axis: list[float], ranges: list[tuple[float, float]], invert: bool = False) -> list[int]:
    """Channels outside (or, inverted, inside) inclusive ranges of the axis: decided while planning."""
    inside = [any(a <= w <= b for a, b in ranges) for w in axis]
    return [i for i, x in enumerate(inside) if x == invert]


def chosen(v: Column, channels: list[int]) -> Column:
    return F.transform(F.array(*map(F.lit, channels)), lambda i: v[i])


def resampled(v: Column, axis: list[float], target: list[float]) -> Column:
    """Linear interpolation onto target, extended along the first and last segments."""
    x = np.array(axis)
    at = np.clip(np.searchsorted(x, target, side="right") - 1, 0, len(x) - 2)
    share = (np.array(target) - x[at]) / (x[at + 1] - x[at])
    points = F.array(*[F.struct(F.lit(int(i)).alias("i"), F.lit(float(s)).alias("s")) for i, s in zip(at, share)])
    return F.transform(points, lambda p: v[p["i"]] + p["s"] * (v[p["i"] + 1] - v[p["i"]]))


def roughness(v: Column) -> Column:
    """Mean square of second differences."""
    n = F.size(v) - 2
    return total(F.transform(F.sequence(F.lit(1), n), lambda i: F.pow(v[i + 1] - 2 * v[i] + v[i - 1], 2))) / n


def reciprocal(x: Column) -> Column:
    """Wavenumber in 1/cm from wavelength in nm, or back."""
    return F.lit(1e7) / x
