"""What several operators of this package need: shared storage, packed arrays, tokens of a batch."""

from __future__ import annotations

import atexit
import struct
import tempfile
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

try:
    import zstandard
except ImportError:  # slower, same contents within a job
    zstandard = None

#: The white space of every contract here.
SPACE = "[\\x20\\x09-\\x0D]"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. A temporary one only where it is unset, as in local tests."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="prismatic-"))
        found = spark.sparkContext.getCheckpointDir()
    return found


def materialize(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: lineage ends here and a lost executor costs nothing already written."""
    path = f"{shared_dir(df.sparkSession)}/prismatic/{name}-{uuid.uuid4().hex}"
    if not WRITTEN:
        atexit.register(discard, df.sparkSession)
    WRITTEN.append(path)
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: What materialize() has written and discard() has not deleted yet.
WRITTEN: list[str] = []


def discard(spark: SparkSession, since: int = 0, upto: int | None = None) -> None:
    """Delete the tables WRITTEN[since:upto]. An operator's result reads its last tables lazily, so this is for who has written the result: the pipeline
    after each stage, components() after each round, and the driver when it ends."""
    gone, WRITTEN[since:upto] = WRITTEN[since:upto], []
    sc = spark.sparkContext
    if not gone or sc._jsc is None or sc._jsc.sc().isStopped():
        return
    for p in gone:
        path = sc._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def ids_and_texts(docs: DataFrame) -> DataFrame:
    """doc_id long and text, a null text as empty; other columns, whatever their names, stay behind."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def input_bytes(docs: DataFrame) -> int:
    """Bytes of (doc_id, text) rows: Catalyst's estimate from the files' sizes, or a sum over the texts where it has none."""
    guess = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return guess if guess < 1 << 50 else docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def shuffle_partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def pack(*parts) -> bytes:
    """Arrays and byte strings as one compressed binary. Arrays are laid out byte by byte of their items: small numbers then cost little."""
    raw, width = [], []
    for p in parts:
        if isinstance(p, bytes):
            raw.append(p)
            width.append(1)
        else:
            p = np.ascontiguousarray(p)
            width.append(p.itemsize)
            raw.append(p.view(np.uint8).reshape(-1, p.itemsize).T.tobytes() if len(p) else b"")
    body = struct.pack(f"<I{len(raw)}Q{len(raw)}B", len(raw), *map(len, raw), *width) + b"".join(raw)
    return b"z" + zstandard.ZstdCompressor(level=9).compress(body) if zstandard else b"d" + zlib.compress(body, 1)


def unpack(blob: bytes) -> list[bytes]:
    body = zstandard.ZstdDecompressor().decompress(blob[1:]) if blob[:1] == b"z" else zlib.decompress(blob[1:])
    n = struct.unpack_from("<I", body)[0]
    lens, width, at, out = struct.unpack_from(f"<{n}Q", body, 4), body[4 + 8 * n : 4 + 9 * n], 4 + 9 * n, []
    for k, w in zip(lens, width):
        part = body[at : at + k]
        out.append(np.frombuffer(part, np.uint8).reshape(w, -1).T.tobytes() if w > 1 and k else part)
        at += k
    return out


def as_array(column) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words [^\\x20\\x09-\\x0D]+ of all texts, A-Z in lower case, in one flat array; and where each text's words start, with the end."""
    texts = texts.take(pa.array(np.arange(len(texts)))).cast(pa.large_string())  # a copy: ascii_lower() errs on a cast slice
    parts = as_array(pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pc.ascii_lower(texts))))
    flat, at = parts.flatten(), np.asarray(parts.offsets).astype(np.int64)
    at = at - at[0]
    keep = np.asarray(pc.greater(pc.binary_length(flat), 0))
    if not keep.all():
        at = np.concatenate([[0], np.cumsum(keep)])[at]
        flat = flat.filter(pa.array(keep))
    return flat, at


def remainder(doc_ids: list, by: int) -> np.ndarray:
    """crc32(doc_id as text) mod by; a null id counts as the empty text."""
    return np.array([zlib.crc32(b"" if i is None else str(i).encode()) % by for i in doc_ids], dtype=np.int64)


def pieces(batch: pa.RecordBatch, chars: int):
    """(ids, texts) of runs of rows of batch with about so many bytes of text; a longer text stands alone."""
    ids, texts = batch.column(0), batch.column(1)
    size, lo, held = np.asarray(pc.binary_length(texts)).astype(np.int64), 0, 0
    for k, n in enumerate(size):
        if held and held + n > chars:
            yield ids.slice(lo, k - lo).to_pylist(), texts.slice(lo, k - lo)
            lo, held = k, 0
        held += int(n) + 1
    if lo < len(size):
        yield ids.slice(lo).to_pylist(), texts.slice(lo)


def gathered(texts: pa.Array, split, chunk: int = 2_000_000) -> tuple[pa.Array, np.ndarray]:
    """split() over texts by parts of about so many bytes, so that no more than a part's tokens are Python strings at a time."""
    flat, at, before = [], [np.zeros(1, dtype=np.int64)], 0
    for _, part in pieces(pa.RecordBatch.from_arrays([pa.nulls(len(texts)), texts], ["id", "text"]), chunk):
        tokens, own = split(part)
        flat.append(tokens)
        at.append(own[1:] + before)
        before += int(own[-1])
    return as_array(pa.chunked_array(flat, pa.large_string())), np.concatenate(at)


def ragged(values: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """values[start[i] : start[i] + length[i]] for each i, end to end."""
    total = int(length.sum())
    if not total:
        return values[:0]
    before = np.cumsum(length) - length
    return values[np.repeat(start - before, length) + np.arange(total)]


def skew_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", share: int = 2000) -> DataFrame:
    """left join right on keys, where a key may hold a large part of left's rows and few of right's.

    Keys with over 1/share of left's rows are at most `share` in number, so their list can come to the driver and be broadcast; their rows are dealt over several
    partitions and right's rows for them are repeated in each. Without such keys it is a plain join. left is read once more for the count by key (its row
    count is in the files' footers) and should be cheap to read. how: inner, left or left_semi.
    """
    most = max(200, left.count() // share)
    counts = left.groupBy(*keys).count().where(F.col("count") > most)
    hot = [(*r[:-1], -(-r[-1] // most)) for r in counts.collect() if None not in r]
    if not hot:
        return left.join(right, keys, how)
    schema = T.StructType([left.schema[k] for k in keys] + [T.StructField("__copies", T.LongType())])
    hot = F.broadcast(left.sparkSession.createDataFrame([tuple(bytes(x) if isinstance(x, bytearray) else x for x in r) for r in hot], schema))
    salted = left.join(hot, keys, "left").withColumn("__salt", F.coalesce(F.pmod(F.xxhash64(*left.columns), F.col("__copies")), F.lit(0).cast("long"))).drop("__copies")
    spread = right.join(hot, keys, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("__copies", F.lit(1).cast("long")) - 1))).drop("__copies")
    return salted.join(spread, [*keys, "__salt"], how).drop("__salt")
