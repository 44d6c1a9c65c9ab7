"""Readers and writers of spectral files. Readers give sample_id, values and the common axis; a file of text is one record of Spark's text source."""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Endings of the known formats, and names that a sample's column goes by.
FORMATS = {".csv": "csv", ".txt": "csv", ".xlsx": "excel", ".xls": "excel", ".spc": "spc", ".jdx": "jcamp", ".dx": "jcamp", ".jcm": "jcamp", ".asd": "asd", ".sig": "asd", ".dpt": "ascii", ".dat": "ascii", ".asc": "ascii", ".sp": "perkinelmer", ".seq": "agilent", ".dmt": "agilent", ".asp": "agilent", ".bsw": "agilent"}
ID_NAMES = ["specimen_id", "sample_id", "specimen", "sample", "id", "filename", "file", "name"]
LEAST_CHANNELS = 100


def detect_format(path: str) -> str:
    """By ending; all digits after the dot is opus; else unknown."""
    end = os.path.splitext(path)[1].lower()
    return "opus" if end[1:].isdigit() else FORMATS.get(end, "unknown")


def axis_columns(columns: list[str], lo: float = 100.0, hi: float = 10_000.0) -> dict[str, float]:
    """Columns whose names are numbers in [lo, hi], by wavelength."""
    out = {}
    for c in columns:
        try:
            if lo <= (w := float(c)) <= hi:
                out[c] = w
        except ValueError:
            continue
    return dict(sorted(out.items(), key=lambda x: x[1]))


def strictly_rising(axis: list[float], least: int) -> list[float]:
    if len(axis) < least or any(a >= b for a, b in zip(axis, axis[1:])):
        raise ValueError(f"an axis needs {least} or more strictly rising wavelengths; found {len(axis)}")
    return axis


def separator(spark: SparkSession, path: str, least: int = 10) -> str:
    """The first of comma, tab, semicolon and blank that cuts the header into more than `least` columns; else the one that gives most."""
    first = spark.read.text(path).first()
    line = first["value"] if first else ""
    counts = {sep: len(line.split(sep)) for sep in (",", "\t", ";", " ")}
    return next((sep for sep, n in counts.items() if n > least), max(counts, key=counts.get))


# Headers of a single spectrum in long form.
LONG_AXIS, LONG_VALUE = ("wavelength", "wavelength_nm"), ("value", "intensity", "reflectance", "pct_reflect")


def read_long_csv(spark: SparkSession, path: str, sep: str = ",", least: int = LEAST_CHANNELS) -> tuple[DataFrame, list[float]]:
    """A spectrum a file, with a row for each wavelength: sample_id is the file's stem. Wavelengths are rounded to two decimals, the first of equal ones by value stays."""
    df = spark.read.option("header", True).option("sep", sep).csv(path)
    named = {c.strip().lower(): c for c in df.columns}
    wl, value = (next((named[n] for n in names if n in named), None) for names in (LONG_AXIS, LONG_VALUE))
    if not wl or not value:
        raise ValueError(f"a long table needs one of {LONG_AXIS} and one of {LONG_VALUE}")
    stem = F.regexp_extract(F.col("_metadata.file_name"), r"^(.+?)(\.[^.]*)?$", 1)
    rows = df.select(stem.alias("sample_id"), F.round(F.col(f"`{wl}`").try_cast("double"), 2).alias("w"), F.col(f"`{value}`").try_cast("double").alias("v")).dropna()
    points = F.array_sort(F.collect_list(F.struct("w", "v")))
    one = rows.groupBy("sample_id", "w").agg(F.min("v").alias("v")).groupBy("sample_id").agg(points.alias("p"))
    return on_common_axis(one.select("sample_id", F.col("p.w").alias("axis"), F.col("p.v").alias("values")), least)


def read_wide_csv(spark: SparkSession, path: str, sep: str = ",", least: int = LEAST_CHANNELS) -> tuple[DataFrame, list[float]]:
    """First column the sample, numeric headers the axis, other columns left out."""
    df = spark.read.option("header", True).option("sep", sep).csv(path)
    axis = axis_columns(df.columns[1:])
    strictly_rising(list(axis.values()), least)
    return df.select(F.col(f"`{df.columns[0]}`").alias("sample_id"), F.array(*[F.col(f"`{c}`").try_cast("double") for c in axis]).alias("values")), list(axis.values())


def read_combined_csv(spark: SparkSession, path: str, y: str | None = None, sample: str | None = None, sep: str | None = None, least: int = LEAST_CHANNELS) -> tuple[DataFrame, list[float]]:
    """sample_id, values and y from one table: rows with a missing channel or target go; of repeated ids the first in sort order stays. Without y the
    target is found by its name, without sep the separator by the header."""
    df = spark.read.option("header", True).option("sep", sep or separator(spark, path)).csv(path)
    axis = axis_columns(df.columns)
    strictly_rising(list(axis.values()), least)
    if y is None:
        from prismatic.sources.facade import id_column, target_column

        sample = sample or id_column(df, list(axis))
        left = [c for c in df.columns if c not in axis and c != sample]
        # one row: how many numbers each of the few other columns holds
        held = df.agg(*[F.count(F.col(f"`{c}`").try_cast("double")).alias(f"n{k}") for k, c in enumerate(left)]).first() if left else []
        y = target_column(left, {c for c, n in zip(left, held) if n})
    rest = [c for c in df.columns if c not in axis and c != y]
    sample = sample or next((c for n in ID_NAMES for c in rest if c.lower().strip() == n), rest[0] if rest else None)
    key = F.col(f"`{sample}`") if sample else F.concat(F.lit("Sample_"), (F.monotonically_increasing_id() + 1).cast("string"))
    rows = df.select(key.alias("sample_id"), F.array(*[F.col(f"`{c}`").try_cast("double") for c in axis]).alias("values"), F.col(f"`{y}`").try_cast("double").alias("y"))
    good = rows.where(F.col("y").isNotNull() & F.forall("values", lambda v: v.isNotNull()))
    return good.groupBy("sample_id").agg(F.min_by("values", "y").alias("values"), F.min("y").alias("y")), list(axis.values())


def pairs_of(text: str) -> tuple[list[float], list[float]]:
    """First and last number of each line with two or more; comments (# % ;) and other lines are skipped; wavelengths to two decimals, the first of equals."""
    seen: dict[float, float] = {}
    for line in text.splitlines():
        if line.lstrip()[:1] in ("#", "%", ";"):
            continue
        numbers = []
        for token in line.replace(",", " ").replace("\t", " ").replace(";", " ").split():
            try:
                numbers.append(float(token))
            except ValueError:
                pass
        if len(numbers) >= 2:
            seen.setdefault(round(numbers[0], 2), numbers[-1])
    axis = sorted(seen)
    return axis, [seen[w] for w in axis]


def jcamp_of(text: str) -> tuple[list[float], list[float], str]:
    """Axis, values and title of a JCAMP-DX record with XYDATA (X++(Y..Y)) or XYPOINTS in plain numbers."""
    head: dict[str, str] = {}
    axis, values, mode = [], [], ""
    for line in text.splitlines():
        line = line.split("$$")[0].strip()
        if line.startswith("##"):
            k, _, v = line[2:].partition("=")
            head[k.strip().upper()] = v.strip()
            mode = k.strip().upper() if k.strip().upper() in ("XYDATA", "XYPOINTS", "PEAK TABLE") else ""
        elif mode == "XYDATA" and line:
            numbers = [float(x) for x in line.replace(",", " ").split()]
            values += numbers[1:]
        elif mode and line:
            numbers = [float(x) for x in line.replace(",", " ").replace(";", " ").split()]
            axis += numbers[0::2]
            values += numbers[1::2]
    yf, xf = float(head.get("YFACTOR", 1)), float(head.get("XFACTOR", 1))
    if "XYDATA" in head:
        first, last, n = float(head["FIRSTX"]), float(head["LASTX"]), len(values)
        axis = [first + (last - first) * k / max(1, n - 1) for k in range(n)]
    else:
        axis = [x * xf for x in axis]
    order = sorted(range(len(axis)), key=axis.__getitem__)
    return [axis[k] for k in order], [values[k] * yf for k in order], head.get("TITLE", "")


def read_text_spectra(spark: SparkSession, path: str, kind: str = "ascii") -> DataFrame:
    """sample_id (the file's stem), axis and values, one row a file, of ascii, asd (text) or jcamp files under path (a glob). A jcamp file of several records gives
    a row for each, by its title."""

    def records(stem: str, text: str) -> list[tuple]:
        if kind != "jcamp":
            return [(stem, *pairs_of(text))]
        parts = [t + "##END=\n" for t in text.split("##END=") if "##TITLE=" in t] or [text]
        found = [jcamp_of(t) for t in parts]
        return [(title if len(parts) > 1 else stem, axis, values) for axis, values, title in found]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([r for stem, t in zip(b["sample_id"], b["value"]) for r in records(stem, t)], columns=["sample_id", "axis", "values"])

    files = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+?)(\.[^./]*)?$", 1).alias("sample_id"), "value")
    return files.mapInPandas(run, "sample_id string, axis array<double>, values array<double>")


def on_common_axis(read: DataFrame, least: int = LEAST_CHANNELS) -> tuple[DataFrame, list[float]]:
    """Rows of different axes on the union of all; channels a row lacks are null. The axis is small, whatever the rows."""
    axis = strictly_rising(sorted(r["w"] for r in read.select(F.explode("axis").alias("w")).distinct().collect()), least)
    every = np.array(axis)

    @F.pandas_udf("array<double>")
    def placed(own: pd.Series, values: pd.Series) -> pd.Series:
        out = []
        for a, v in zip(own, values):
            row = np.full(len(every), np.nan)
            row[np.searchsorted(every, np.asarray(a, dtype=float))] = np.asarray(v, dtype=float)
            out.append(row)
        return pd.Series(out)

    return read.select("sample_id", F.transform(placed("axis", "values"), lambda v: F.when(~F.isnan(v), v)).alias("values")), axis


def jcamp_text(title: str, axis: list[float], values: list[float], xunits: str = "NANOMETERS", yunits: str = "REFLECTANCE") -> str:
    head = {"TITLE": title, "JCAMP-DX": "4.24", "DATA TYPE": "INFRARED SPECTRUM", "XUNITS": xunits, "YUNITS": yunits, "XFACTOR": "1", "YFACTOR": "1", "FIRSTX": repr(axis[0]), "LASTX": repr(axis[-1]), "NPOINTS": str(len(axis)), "XYPOINTS": "(XY..XY)"}
    return "".join(f"##{k}={v}\n" for k, v in head.items()) + "".join(f"{x!r}, {y!r}\n" for x, y in zip(axis, values)) + "##END=\n"


def write_jcamp(spectra: DataFrame, axis: list[float], path: str) -> None:
    """Records of all samples in text files under path, as many files as partitions; a sample's record follows another's. Text is put together by column functions."""
    head = jcamp_text("{}", axis, [0.0] * len(axis)).split("##TITLE={}\n")[1].split("(XY..XY)\n")[0] + "(XY..XY)"
    points = F.zip_with(F.array(*[F.lit(repr(w)) for w in axis]), "values", lambda w, v: F.concat(w, F.lit(", "), v.cast("string")))
    text = F.concat(F.lit("##TITLE="), F.col("sample_id").cast("string"), F.lit("\n" + head + "\n"), F.array_join(points, "\n"), F.lit("\n##END="))
    spectra.select(text.alias("value")).write.text(path)


def write_csv(spectra: DataFrame, axis: list[float], path: str, decimals: int = 6) -> None:
    spectra.select("sample_id", *[F.round(F.col("values")[k], decimals).alias(str(w)) for k, w in enumerate(axis)]).write.option("header", True).csv(path)
