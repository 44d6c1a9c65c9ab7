"""Instrument makers' binary files by their published layouts: Bruker OPUS, PerkinElmer SP and Agilent images and single spectra. Axes stay in the file's own unit.

OPUS, SP and single Agilent spectra are one record of Spark's binary source each. An Agilent image is a head (.seq, .dmt or .bsp) and its data (.dat beside it, or for a
mosaic the .dmd tiles): every tile becomes one spectrum in its own task, and tiles of an image are added up by channel. Of files with equal stems the last by path stays.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of OPUS: magic, places in the head, and the fields of a block's type: (first bit, bits).
OPUS_MAGIC, OPUS_DIRECTORY, OPUS_BLOCKS = b"\x0a\x0a\xfe\xfe", 12, 20
OPUS_SIDE, OPUS_PARAMETERS, OPUS_KIND = (2, 2), (4, 6), (10, 7)
#: Spectra in order of preference, as (side, kind): absorbance, transmittance, sample, reference.
OPUS_SPECTRA = [(3, 4), (3, 5), (1, 1), (2, 1)]
OPUS_STATUS = 1

# Fixed values of SP: magic, length of the head, the wrapping block, and members of the data set.
SP_MAGIC, SP_HEAD, SP_WRAPPER, SP_RANGE, SP_POINTS, SP_DATA = b"PEPE", 44, 120, -29837, -29834, -29828

# Fixed values of Agilent: places of the axis in an image's head, floats before a tile's data, lines before a single spectrum's values.
AGILENT_STEP, AGILENT_FIRST, AGILENT_CHANNELS, AGILENT_SKIP, ASP_HEAD = 2216, 2228, 2236, 255, 6

OUT = "sample_id string, axis array<double>, values array<double>"


def rising(axis: np.ndarray, values: np.ndarray) -> tuple[list[float], list[float]]:
    """By rising axis, the first of equals."""
    if not len(axis) or len(axis) != len(values):
        raise ValueError(f"{len(axis)} places on the axis for {len(values)} values")
    if axis[0] > axis[-1]:
        axis, values = axis[::-1], values[::-1]
    w, first = np.unique(axis.astype(float), return_index=True)
    return w.tolist(), values.astype(float)[first].tolist()


def opus_parameters(block: bytes) -> dict[str, int | float | str]:
    """Names and values of a block of parameters, up to its END."""
    found, at = {}, 0
    while at + 8 <= len(block) and block[at : at + 3] != b"END":
        kind, half = struct.unpack_from("<HH", block, at + 4)
        raw = block[at + 8 : at + 8 + 2 * half]
        name = block[at : at + 3].decode("latin-1")
        found[name] = struct.unpack_from("<i", raw)[0] if kind == 0 else struct.unpack_from("<d", raw)[0] if kind == 1 else raw.split(b"\0")[0].decode("latin-1")
        at += 8 + 2 * half
    return found


def opus_of(raw: bytes) -> tuple[list[float], list[float]]:
    """Axis and values of the first spectrum by OPUS_SPECTRA."""
    if raw[:4] != OPUS_MAGIC:
        raise ValueError("not an OPUS file")
    at, n = struct.unpack_from("<i", raw, OPUS_DIRECTORY)[0], struct.unpack_from("<i", raw, OPUS_BLOCKS)[0]
    blocks = {}
    for k in range(n):
        kind, words, start = struct.unpack_from("<Iii", raw, at + 12 * k)
        side, parameters, of = ((kind >> first) & ((1 << bits) - 1) for first, bits in (OPUS_SIDE, OPUS_PARAMETERS, OPUS_KIND))
        if start > 0:
            blocks.setdefault((parameters, side, of), raw[start : start + 4 * words])
    for spectrum in OPUS_SPECTRA:
        data, status = blocks.get((0, *spectrum)), blocks.get((OPUS_STATUS, *spectrum))
        if data and status:
            known = opus_parameters(status)
            values = np.frombuffer(data, "<f4", known["NPT"]) * float(known.get("CSF", 1.0))
            return rising(np.linspace(known["FXV"], known["LXV"], known["NPT"]), values)
    raise ValueError("no spectrum in the OPUS file")


def sp_of(raw: bytes) -> tuple[list[float], list[float]]:
    """Axis and values of the first data set."""
    if raw[:4] != SP_MAGIC:
        raise ValueError("not a PerkinElmer SP file")
    at, found = SP_HEAD, {}
    while at + 6 <= len(raw):
        block, size = struct.unpack_from("<hi", raw, at)
        at += 6
        if block == SP_WRAPPER:  # its members follow
            continue
        if block in (SP_RANGE, SP_POINTS, SP_DATA):
            found.setdefault(block, raw[at + 2 : at + size])  # after the code of its own type
        at += max(0, size)
    if len(found) < 3:
        raise ValueError("no spectrum in the SP file")
    (first, last), n = struct.unpack_from("<dd", found[SP_RANGE]), struct.unpack_from("<i", found[SP_POINTS])[0]
    return rising(np.linspace(first, last, n), np.frombuffer(found[SP_DATA], "<f8", struct.unpack_from("<i", found[SP_DATA])[0] // 8, 4))


def asp_of(raw: bytes) -> tuple[list[float], list[float]]:
    """Axis and values of a single Agilent spectrum: number of points, first and last place, three more lines, then values."""
    lines = [float(x) for x in raw.decode("latin-1").split()]
    return rising(np.linspace(lines[1], lines[2], int(lines[0])), np.array(lines[ASP_HEAD:]))


def image_axis(head: bytes) -> list[float]:
    step, first, n = struct.unpack_from("<d", head, AGILENT_STEP)[0], struct.unpack_from("<i", head, AGILENT_FIRST)[0], struct.unpack_from("<i", head, AGILENT_CHANNELS)[0]
    return (step * np.arange(first, first + n)).tolist()


def tile_spectra(data: bytes, n: int) -> np.ndarray:
    """channels x pixels of one tile."""
    pixels = (len(data) // 4 - AGILENT_SKIP) // n
    if pixels < 1:
        raise ValueError("the data of an Agilent image are shorter than its axis")
    return np.frombuffer(data, "<f4", n * pixels, 4 * AGILENT_SKIP).reshape(n, pixels)


#: How single files of each kind are read, and what they, heads and tiles are called: (pattern for listing, then for the path).
READERS = {"opus": (opus_of, ("*.[0-9]*", r"\.[0-9]+$")), "perkinelmer": (sp_of, ("*.[sS][pP]", r"\.[^.]+$")), "agilent": (asp_of, ("*.[aA][sS][pP]", r"\.[^.]+$"))}
HEADS, TILES = ("*.{seq,dmt,bsp,SEQ,DMT,BSP}", r"\.[^.]+$"), ("*.{dat,dmd,DAT,DMD}", r"(?i)(\.dat|(_[0-9]{4}){2}\.dmd)$")
HEAD_ENDINGS = (".seq", ".dmt", ".bsp")
MODES = ("total", "first", "mean")


def last_of_each(read: DataFrame, *columns: str) -> DataFrame:
    return read.groupBy("sample_id").agg(F.max_by(F.struct(*columns), "path").alias("r")).select("sample_id", *[f"r.{c}" for c in columns])


def files(spark: SparkSession, path: str, named: tuple[str, str]) -> DataFrame:
    """path, stem (with the folder) and content; only files that are listed by the pattern are opened."""
    read = spark.read.format("binaryFile").option("pathGlobFilter", named[0]).load(path).where(F.col("path").rlike(named[1]))
    return read.select("path", F.regexp_replace("path", named[1], "").alias("stem"), "content")


def parsed(parse, raw: bytes, path: str):
    """parse(raw); the error for a file that isn't of its kind names it."""
    try:
        return parse(raw)
    except (ValueError, KeyError, IndexError, struct.error) as e:
        raise ValueError(f"{path}: {e}") from e


def read_single_spectra(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """sample_id, axis and values of opus, perkinelmer or agilent (.asp) files: a folder, pattern or file."""
    parse, named = READERS[kind]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [parsed(parse, bytes(c), p) for c, p in zip(b["content"], b["path"])]
            yield pd.DataFrame({"path": b["path"], "sample_id": b["stem"].str.rsplit("/", n=1).str[-1], "axis": [a for a, _ in found], "values": [v for _, v in found]})

    read = files(spark, path, named).mapInPandas(run, "path string, " + OUT)
    return last_of_each(read, "axis", "values")


def read_images(spark: SparkSession, path: str, mode: str = "total") -> DataFrame:
    """A spectrum an image: the sum of its pixels (total), their mean, or the first stored pixel of the first tile (first). path is a folder, or a head's path."""
    if mode not in MODES:
        raise ValueError(f"mode is one of {MODES}")
    head, (own, end) = files(spark, path, HEADS), os.path.splitext(path)
    beside = files(spark, own + "{.dat,.DAT,_[0-9]*.dmd,_[0-9]*.DMD}" if end.lower() in HEAD_ENDINGS else path, TILES)

    def axes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"stem": b["stem"], "head": b["path"], "axis": [parsed(image_axis, bytes(c), p) for c, p in zip(b["content"], b["path"])]})

    def spectra(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            tiles = [parsed(lambda raw, n=len(a): tile_spectra(raw, n), bytes(c), p) for c, a, p in zip(b["content"], b["axis"], b["path"])]
            yield pd.DataFrame({"head": b["head"], "stem": b["stem"], "tile": b["path"], "axis": b["axis"], "n": [t.shape[1] for t in tiles], "v": [(t[:, 0] if mode == "first" else t.sum(axis=1, dtype=float)).astype(float).tolist() for t in tiles]})

    heads = head.mapInPandas(axes, "stem string, head string, axis array<double>")
    tiles = heads.join(beside, "stem").mapInPandas(spectra, "head string, stem string, tile string, axis array<double>, n long, v array<double>")
    if mode == "first":
        whole = tiles.groupBy("head", "stem").agg(F.min_by("v", "tile").alias("values"), F.first("axis").alias("axis"))
    else:
        by_channel = tiles.select("head", "stem", "n", F.posexplode(F.arrays_zip("axis", "v")).alias("k", "p")).groupBy("head", "stem", "k").agg(F.first("p.axis").alias("w"), F.sum("p.v").alias("v"), F.sum("n").alias("n"))
        value = F.col("v") / F.col("n") if mode == "mean" else F.col("v")
        points = by_channel.groupBy("head", "stem").agg(F.array_sort(F.collect_list(F.struct("w", value.alias("v")))).alias("p"))
        whole = points.select("head", "stem", F.col("p.v").alias("values"), F.col("p.w").alias("axis"))
    return last_of_each(whole.select(F.col("head").alias("path"), F.element_at(F.split("stem", "/"), -1).alias("sample_id"), "axis", "values"), "axis", "values")


def read_vendor_spectra(spark: SparkSession, path: str, kind: str, mode: str = "total") -> DataFrame:
    """sample_id, axis and values of a maker's files: a folder, pattern or file."""
    end = os.path.splitext(path)[1].lower()
    if end == ".bsw":
        raise ValueError(f"{path}: a .bsw file holds no spectra; read the .seq or .dmt beside it")
    single = read_single_spectra(spark, path, kind)
    if kind != "agilent" or end == ".asp":
        return single
    return read_images(spark, path, mode) if end in HEAD_ENDINGS else single.unionByName(read_images(spark, path, mode))
