"""Documents in blocks, and the corpus-wide shuffle of each block's distinct tokens.

A block is some megabytes of documents of one task. It is written once, as codes into the list of its own distinct tokens, and that list is dealt by
the token's hash into packs. A bucket task sees every pack with its tokens, computes one value for each distinct token of the corpus, and sends
the values back to the blocks. A frequent token comes once from each block, so no token is hot. Buckets grow in number with the input, so a
bucket's size doesn't; a block sends at most one pack for each bucket and at most one for each of its tokens, so packs grow in proportion to the input.
Tasks of that shuffle stop growing at MOST_TASKS: from there on a task takes several buckets, one after another, and holds one at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import gathered, input_bytes, pack, pieces, shuffle_partitions, unpack

#: kind 0: a block's documents; 1: a pack of its tokens; 2: the values for a pack.
SCHEMA = "kind int, block long, bucket int, data binary"
DOCS, TOKENS, VALUES = 0, 1, 2
BLOCK_BYTES = 32_000_000
#: Input bytes for one bucket.
BUCKET_BYTES = 8_000_000
#: Most tasks that buckets are dealt to. Spark keeps something for each pair of tasks on both sides of a shuffle, so their number has to stop somewhere.
MOST_TASKS = 20_000


def buckets_for(docs: DataFrame) -> int:
    return max(shuffle_partitions(docs), -(-input_bytes(docs) // BUCKET_BYTES))


def record(rows: list[tuple]) -> pa.RecordBatch:
    kind, block, bucket, data = zip(*rows) if rows else ((), (), (), ())
    return pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array(block, pa.int64()), pa.array(bucket, pa.int32()), pa.array(data, pa.binary())], ["kind", "block", "bucket", "data"])


def ranked(flat: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Codes of all tokens and the distinct tokens: the frequent first, those that occur once in alphabetical order. Both compress well so."""
    coded = flat.dictionary_encode()
    codes, words = np.asarray(coded.indices), coded.dictionary
    counts = np.bincount(codes, minlength=len(words))
    once = np.flatnonzero(counts == 1)
    often = np.flatnonzero(counts > 1)
    order = np.concatenate([often[np.argsort(-counts[often], kind="stable")], once[np.asarray(pc.sort_indices(words.take(pa.array(once))))] if len(once) else once]).astype(np.int64)
    rank = np.empty(len(order), dtype=np.uint32)
    rank[order] = np.arange(len(order), dtype=np.uint32)
    return rank[codes], words.take(pa.array(order))


def in_parts(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes as what is above their last 8 bits, and those bits of the frequent and of the other tokens apart: each part compresses by itself."""
    high, low = (codes >> 8).astype(np.uint32), (codes & 255).astype(np.uint8)
    return high, low[high == 0], low[high > 0]


def from_parts(high: bytes, often: bytes, rest: bytes) -> np.ndarray:
    codes = np.frombuffer(high, np.uint32).astype(np.int64)
    frequent, codes = codes == 0, codes << 8
    codes[frequent] = np.frombuffer(often, np.uint8)
    codes[~frequent] |= np.frombuffer(rest, np.uint8)
    return codes


def blocks(docs: DataFrame, split: Callable, hashed: Callable, n_buckets: int, more: Callable | None = None) -> DataFrame:
    """Rows of SCHEMA from (doc_id, text) rows.

    split(texts) gives a flat Arrow array of tokens and each text's start in it; hashed(tokens) a uint64 for each distinct token;
    more(ids, codes, counts, tokens, hashes) further arrays: one for each token of the list (goes with the packs) and one for the block.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 24
        for batch in batches:
            for ids, texts in pieces(batch, BLOCK_BYTES):
                flat, at = gathered(texts, split)
                codes, words = ranked(flat)
                del flat
                counts = np.diff(at).astype(np.uint32)
                hashes = hashed(words)
                per_token, per_block = more(ids, codes, counts, words, hashes) if more else (None, b"")
                null = np.array([i is None for i in ids], dtype=np.uint8)
                rows = [(DOCS, block, -1, pack(np.array([i or 0 for i in ids], dtype=np.int64), null, counts, *in_parts(codes), per_block))]
                del codes
                bucket = ((hashes >> np.uint64(20)) % np.uint64(n_buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                cuts = np.flatnonzero(np.diff(bucket[order])) + 1
                for part in np.split(order, cuts) if len(order) else ():
                    raw = [w.encode() for w in words.take(pa.array(part)).to_pylist()]
                    extra = per_token[part] if per_token is not None else b""
                    rows.append((TOKENS, block, int(bucket[part[0]]), pack(stepped(part), np.array([len(r) for r in raw], dtype=np.uint32), b"".join(raw), extra)))
                    if len(rows) >= 512:
                        yield record(rows)
                        rows = []
                yield record(rows)
                block += 1

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def stepped(codes: np.ndarray) -> np.ndarray:
    return np.diff(codes.astype(np.int64), prepend=0).astype(np.uint32)


def unstepped(part: bytes) -> np.ndarray:
    """Codes from their steps: a pack's codes ascend."""
    return np.cumsum(np.frombuffer(part, np.uint32), dtype=np.int64)


def tokens_of(pack_data: list[bytes]) -> tuple[np.ndarray, pa.Array]:
    """Codes and tokens of a pack."""
    codes, lens = unstepped(pack_data[0]), np.frombuffer(pack_data[1], np.uint32)
    offsets = np.concatenate([[0], np.cumsum(lens, dtype=np.int64)])
    words = pa.Array.from_buffers(pa.large_string(), len(lens), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(pack_data[2])])
    return codes, words


def dealt(table: DataFrame, n_buckets: int) -> DataFrame:
    """The token packs of table, all of a bucket in one partition and there in a row."""
    n, packs = min(n_buckets, MOST_TASKS), table.where(F.col("kind") == TOKENS)
    if n == n_buckets:
        return packs.repartitionById(n, F.col("bucket"))
    return packs.repartitionById(n, F.col("bucket") % n).sortWithinPartitions("bucket")


def by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[int, list[bytes]]]]:
    """(block, pack) of each bucket of a partition that dealt() made."""
    now, held = None, []
    for batch in batches:
        for block, bucket, data in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3)):
            if held and bucket != now:
                yield held
                held = []
            now = bucket
            held.append((block, unpack(data.as_py())))
    if held:
        yield held


def reassembled(table: DataFrame, values: DataFrame, finish: Callable, schema: str) -> DataFrame:
    """Blocks are dealt by the number of the task that made them, so evenly. finish(documents' parts, list of value packs) for each block, streaming: memory holds one block."""
    both = table.where(F.col("kind") == DOCS).unionByName(values.select("kind", "block", "bucket", "data"))
    n = shuffle_partitions(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, doc, got = None, None, []
        for batch in batches:
            for kind, block, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                if block != now:
                    if doc is not None:
                        yield finish(doc, got)
                    now, doc, got = block, None, []
                if kind == DOCS:
                    doc = unpack(data.as_py())
                else:
                    got.append(unpack(data.as_py()))
        if doc is not None:
            yield finish(doc, got)

    return both.select("kind", "block", "data").repartitionById(n, (F.shiftright("block", 24) % n).cast("int")).sortWithinPartitions("block", "kind").mapInArrow(run, schema)


def header(doc: list[bytes]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """doc_id column, tokens of each document, and all codes of a block's documents."""
    ids, null = np.frombuffer(doc[0], np.int64), np.frombuffer(doc[1], np.uint8).astype(bool)
    return pa.array(ids, mask=null), np.frombuffer(doc[2], np.uint32).astype(np.int64), from_parts(*doc[3:6])
