"""Concatenate and cut: fixed windows over the concatenated tokens of all documents.

The first pass encodes every document and writes ids with their start within the task; prefix sums over the tasks' totals (one row a task) give
each document's place in the whole; the second pass cuts at multiples of the window. A sequence is filled from one or more pieces, each a
boundary record; only the very last sequence needs padding.

Null text counts as empty: its document is the end id alone. Texts of any length are cut freely. Rows with equal ids are packed each; an empty
table gives no piece.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import LETTERS, splitter
from .shared import gathered, ids_and_texts, materialize, pieces, ragged

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
CHUNK_BYTES = 32_000_000
#: Distinct pre-tokens that one call encodes, and pre-tokens of the texts put together at once.
AT_ONCE, PART = 2_000, 500_000


def batch_encoder(path: str, pattern: str, end: int):
    """texts -> by parts, flat ids with the end id after each text, and tokens of each text. Each distinct pre-token of the texts is encoded once."""
    from tokenizers import Tokenizer

    tokenizer, split = Tokenizer.from_file(path), splitter(pattern)
    added = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
    size = np.array([len(tokenizer.id_to_token(i)) for i in range(tokenizer.get_vocab_size())])  # of byte-level tokens, a character is a byte
    spaced = re.compile(f" [{LETTERS}]+").fullmatch

    def encode_words(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids end to end, and how many each word has."""
        # words like " abc" are cut apart again by the tokenizer's own pre-tokens when written in a row; others go to it as a list
        row = np.array([spaced(w) is not None for w in words], dtype=bool)
        bytes_of = np.array([len(w.encode()) for w in words], dtype=np.int64)
        order, ids = np.concatenate([np.flatnonzero(row), np.flatnonzero(~row)]), []
        together = int(row.sum())
        for lo in range(0, together, AT_ONCE):
            ids += tokenizer.encode_batch_fast(["".join(words[k] for k in order[lo : min(together, lo + AT_ONCE)].tolist())], add_special_tokens=False)[0].ids
        for lo in range(together, len(words), AT_ONCE):
            ids += tokenizer.encode([words[k] for k in order[lo : lo + AT_ONCE].tolist()], is_pretokenized=True, add_special_tokens=False).ids
        flat = np.array(ids, dtype=np.uint32)
        ends = np.searchsorted(np.cumsum(size[flat]), np.cumsum(bytes_of[order])) + 1 if len(words) else np.zeros(0, dtype=np.int64)
        lens, start = np.zeros(len(words), dtype=np.int64), np.zeros(len(words), dtype=np.int64)
        lens[order], start[order] = np.diff(ends, prepend=0), np.concatenate([[0], ends[:-1]])
        return ragged(flat, start, lens), lens

    def encode(texts: pa.Array):
        whole = {k: t for k, t in enumerate(texts.to_pylist()) if any(x in t for x in added)}
        flat, at = gathered(texts, split)
        coded = flat.dictionary_encode()
        words, codes = coded.dictionary.to_pylist(), np.asarray(coded.indices)
        del flat
        # an added token's string in a text is that token: such a text goes to the tokenizer whole
        values, lens = encode_words(words)
        start = np.cumsum(lens) - lens
        # the end id is one more word after each text
        values, lens, start, last = np.append(values, np.uint32(end)), np.append(lens, 1), np.append(start, len(values)), len(words)
        lo = 0
        while lo < len(at) - 1:
            hi = max(lo + 1, int(np.searchsorted(at, at[lo] + PART, side="right")) - 1)
            own = at[lo : hi + 1] - at[lo]
            order = np.insert(codes[at[lo] : at[hi]].astype(np.int64), own[1:], last)
            token_lens = lens[order]
            sums = np.concatenate([[0], np.cumsum(token_lens)])
            out, counts = ragged(values, start[order], token_lens), np.diff(sums[own + np.arange(hi - lo + 1)])
            if any(lo <= k < hi for k in whole):
                ends = np.concatenate([[0], np.cumsum(counts)])
                parts = [np.append(np.array(tokenizer.encode(whole[lo + k], add_special_tokens=False).ids, dtype=np.uint32), np.uint32(end)) if lo + k in whole else out[ends[k] : ends[k + 1]] for k in range(hi - lo)]
                out, counts = np.concatenate(parts), np.array([len(p) for p in parts], dtype=np.int64)
            yield lo, out, counts
            lo = hi

    return encode


def tokenized(docs: DataFrame, path: str, pattern: str, end: int = 0) -> DataFrame:
    """doc_id, task, local_start, n_tokens and ids (little-endian unsigned 32-bit) of each row, written to the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task, before = batch_encoder(path, pattern, end), TaskContext.get().partitionId(), 0
        for batch in batches:
            for ids, texts in pieces(batch, CHUNK_BYTES):
                for lo, flat, counts in encode(texts):
                    ends = np.concatenate([[0], np.cumsum(counts)])
                    data = pa.Array.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer((ends * 4).astype(np.int64)), pa.py_buffer(flat.astype("<u4"))]).cast(pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(ids[lo : lo + len(counts)], pa.int64()), pa.array(np.full(len(counts), task), pa.int32()), pa.array(before + ends[:-1]), pa.array(counts), data], ["doc_id", "task", "local_start", "n_tokens", "ids"])
                    before += int(ends[-1])

    return materialize(ids_and_texts(docs).mapInArrow(run, "doc_id long, task int, local_start long, n_tokens long, ids binary"), "packing-ids")


def placed(tokens: DataFrame) -> DataFrame:
    """tokens with the global start of each document. The broadcast side has one row for each task of the first pass."""
    totals = tokens.groupBy("task").agg(F.sum("n_tokens").alias("total"))
    w = Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select(F.col("task"), F.coalesce(F.sum("total").over(w), F.lit(0)).alias("base"))
    return tokens.join(F.broadcast(bases), "task").select("doc_id", (F.col("base") + F.col("local_start")).alias("at"), "n_tokens", "ids")


def cut(tokens: DataFrame, window: int = 1024, with_ids: bool = False) -> DataFrame:
    """The boundary records: one row for each piece of a document in a sequence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for doc, at, n, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3)):
                raw, lo = memoryview(data.as_buffer()), 0
                while lo < n:
                    sequence, offset = divmod(at + lo, window)
                    k = min(window - offset, n - lo)
                    part = raw[4 * lo : 4 * (lo + k)]
                    rows.append((doc, lo, k, zlib.crc32(part), n, sequence, offset, *([bytes(part)] if with_ids else [])))
                    lo += k
            kinds = [pa.int64()] * 7 + [pa.binary()] * with_ids
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * len(kinds), kinds)], [x.split()[0] for x in PIECES.split(", ")] + ["ids"] * with_ids)

    return tokens.mapInArrow(run, PIECES + ", ids binary" * with_ids)


def packed(docs: DataFrame, path: str, pattern: str, window: int = 1024, end: int = 0, with_ids: bool = False) -> DataFrame:
    return cut(placed(tokenized(docs, path, pattern, end)), window, with_ids)


def sequences(found: DataFrame, window: int = 1024, pad: int = 0) -> DataFrame:
    """sequence_id, n_tokens and ids (binary) of each sequence from pieces that carry ids; a sequence holds at most `window` pieces. The last one is padded to the
    window with the id `pad`, unless its length is a power of two."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = F.expr("aggregate(transform(parts, p -> p.ids), X'', (a, x) -> a || x)")
    n = F.col("n_tokens")
    short = F.bit_count(n) != 1
    padding = F.expr(f"repeat('{pad.to_bytes(4, 'little').hex()}', cast({window} - n_tokens as int))")
    rows = found.groupBy("sequence_id").agg(parts.alias("parts"), F.sum("length").alias("n_tokens"))
    return rows.select("sequence_id", "n_tokens", F.when(short, F.concat(joined, F.unhex(padding))).otherwise(joined).alias("ids"))
