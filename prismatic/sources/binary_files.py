"""Binary spectral files by their published layouts: SPC (new format, little-endian) and ASD. Each file is one record of Spark's binary source."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the layouts: flags and sizes of SPC, offsets of ASD.
SPC_SHORT, SPC_XY_EACH, SPC_X_GIVEN, SPC_HEAD, SPC_SUBHEAD, SPC_NEW = 0x01, 0x40, 0x80, 512, 32, 0x4B
ASD_TYPE, ASD_START, ASD_STEP, ASD_FORMAT, ASD_CHANNELS, ASD_DATA = 186, 191, 195, 199, 204, 484
ASD_NUMBERS = {0: "<f4", 1: "<i4", 2: "<f8"}
#: Bytes between the end of the spectrum and the reference's description, and the revision that first has a reference.
ASD_BEFORE_TEXT, ASD_WITH_REFERENCE = 18, 2


def rounded_axis(axis: np.ndarray, values: np.ndarray) -> tuple[list[float], list[float]]:
    """Rising wavelengths to two decimals, the first of equals."""
    w, first = np.unique(np.round(axis.astype(float), 2), return_index=True)
    return w.tolist(), values.astype(float)[first].tolist()


def spc_of(raw: bytes) -> tuple[list[float], list[float]]:
    """Axis and values of the first subfile."""
    flags, version, _, exponent, n, first, last = struct.unpack_from("<BBBbIdd", raw)
    if version != SPC_NEW:
        raise ValueError(f"unknown SPC version {version:#x}")
    at = SPC_HEAD
    if flags & SPC_X_GIVEN and not flags & SPC_XY_EACH:
        axis, at = np.frombuffer(raw, "<f4", n, at), at + 4 * n
    else:
        axis = np.linspace(first, last, n)
    own, sub_n = struct.unpack_from("<b", raw, at + 1)[0], struct.unpack_from("<I", raw, at + 16)[0]
    exponent, at = own if flags & SPC_XY_EACH or own else exponent, at + SPC_SUBHEAD
    if flags & SPC_XY_EACH:
        n = sub_n
        axis, at = np.frombuffer(raw, "<f4", n, at), at + 4 * n
    if exponent == -128:
        values = np.frombuffer(raw, "<f4", n, at)
    else:
        kind, bits = ("<i2", 16) if flags & SPC_SHORT else ("<i4", 32)
        values = np.frombuffer(raw, kind, n, at) * 2.0 ** (exponent - bits)
    return rounded_axis(axis, values)


def spc_bytes(axis: list[float], values: list[float]) -> bytes:
    """One spectrum in single precision, with its axis written out."""
    n = len(axis)
    head = struct.pack("<BBBbIddI", SPC_X_GIVEN, SPC_NEW, 0, -128, n, axis[0], axis[-1], 1).ljust(SPC_HEAD, b"\0")
    return head + np.array(axis, "<f4").tobytes() + struct.pack("<Bb", 0, -128).ljust(SPC_SUBHEAD, b"\0") + np.array(values, "<f4").tobytes()


def asd_of(raw: bytes) -> tuple[list[float], list[float]]:
    """Axis and reflectance (spectrum over white reference) where the file has a reference, else the spectrum as stored."""
    if raw[:3] not in (b"ASD", *(f"as{k}".encode() for k in range(2, 9))):
        raise ValueError("not an ASD file")
    start, step = struct.unpack_from("<ff", raw, ASD_START)
    n, kind = struct.unpack_from("<H", raw, ASD_CHANNELS)[0], ASD_NUMBERS[raw[ASD_FORMAT]]
    size = np.dtype(kind).itemsize
    values = np.frombuffer(raw, kind, n, ASD_DATA).astype(float)
    at = ASD_DATA + n * size
    if raw[2:3] not in (b"D", b"2", b"3", b"4", b"5") and len(raw) >= at + 2 and struct.unpack_from("<H", raw, at)[0]:
        at += ASD_BEFORE_TEXT
        at += 2 + struct.unpack_from("<H", raw, at)[0]
        white = np.frombuffer(raw, kind, n, at).astype(float)
        values = np.divide(values, white, out=np.full(n, np.nan), where=white != 0)
    return rounded_axis(start + step * np.arange(n), values)


READERS = {"spc": spc_of, "asd": asd_of}


def spectra_of(contents: DataFrame, kind: str) -> DataFrame:
    """sample_id, axis and values from sample_id and content, the bytes of a file."""
    parse = READERS[kind]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [parse(bytes(c)) for c in b["content"]]
            yield pd.DataFrame({"sample_id": b["sample_id"], "axis": [a for a, _ in found], "values": [v for _, v in found]})

    return contents.select(F.col("sample_id").cast("string").alias("sample_id"), "content").mapInPandas(run, "sample_id string, axis array<double>, values array<double>")


def spc_contents(spectra: DataFrame, axis: list[float]) -> DataFrame:
    """sample_id and content: each spectrum as the bytes of an SPC file."""

    @F.pandas_udf("binary")
    def written(values: pd.Series) -> pd.Series:
        return pd.Series([spc_bytes(axis, v) for v in values], dtype=object)

    return spectra.select("sample_id", written("values").alias("content"))


def read_binary_spectra(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """sample_id (the file's stem), axis and values, one row a file, of spc or binary asd files under path (a glob or folder)."""
    files = spark.read.format("binaryFile").load(path).select(F.regexp_extract("path", r"([^/]+?)(\.[^./]*)?$", 1).alias("sample_id"), "content")
    return spectra_of(files, kind)
