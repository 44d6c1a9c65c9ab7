"""Substring dedup by sliding sentence spans.

Runs of consecutive sentences are hashed: from each sentence the shortest run with at least `words` words, and to each sentence the shortest one that ends
there. Together they cover every sentence of every repeated run of at least that many words, however long it is and wherever it ends; a sentence of `words`
words is a run by itself. Equal hashes, of 96 bits, join over the whole corpus. The first span, in the document with the smallest doc_id and there at the first place, stays; sentences covered by any other
are removed.

Sentences end after . ! ? … followed by white space, or at a line break; sentences are compared with white space squeezed. What a repeated passage shares of
a sentence whose rest differs stays. Null text counts as empty. A text
with fewer words than a run has no spans and stays as it is. Rows that repeat with the same doc_id and text count as one document: equal spans in them
are all first. Different texts under one doc_id, or under none, are documents of their own, in order of a hash of the text. A null doc_id comes first of all. An empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import ids_and_texts, materialize, skew_join

#: A cut stands after . ! ? or … and the blanks that follow, and after line breaks.
CUT = re.compile(r"[.!?…][ \t]+(?=\S)|\n+")


def sentences_of(text: str) -> list[str]:
    """text cut after each sentence and the white space that follows; joined, they are the text."""
    ends = [0, *(m.end() for m in CUT.finditer(text)), len(text)]
    return [text[a:b] for a, b in zip(ends, ends[1:]) if a < b]


def runs(text: str, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[str]]:
    """Hash (64 bits), 32 bits more of it, first and last sentence of each run by place, and the sentences."""
    own = sentences_of(text)
    tokens = [s.split() for s in own]
    filled = [k for k, t in enumerate(tokens) if t]
    each = [" ".join(tokens[k]) for k in filled]
    n = len(filled)
    total = np.concatenate([[0], np.cumsum(np.array([len(tokens[k]) for k in filled], dtype=np.int64))])
    # the shortest from each start, and the shortest to each end
    start = np.concatenate([np.arange(n), np.searchsorted(total, total[1:] - words, side="right") - 1])
    end = np.concatenate([np.searchsorted(total, total[:-1] + words), np.arange(1, n + 1)])
    start, end = np.divmod(np.unique((start * (n + 1) + end)[(start >= 0) & (end <= n)]), n + 1)
    digests = b"".join(xxhash.xxh3_128_digest("\x1f".join(each[a:b])) for a, b in zip(start.tolist(), end.tolist()))
    h, more = np.frombuffer(digests, np.int64)[::2], np.frombuffer(digests, np.int32)[2::4]
    at = np.array(filled, dtype=np.int64)
    return h, more, at[start] if n else start, at[end - 1] if n else end, own


def spans(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, text_hash, hash, more, again: each hash of a row once; `again` holds whether it recurs there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, hashes, mores, again = [], [], [], []
            for text in batch.column(2).to_pylist():
                h, more, *_ = runs(text, words)
                h, at, n = np.unique(h, return_index=True, return_counts=True)
                sizes.append(len(h))
                hashes.append(h)
                mores.append(more[at])
                again.append(n > 1)
            if sizes:
                row = pa.array(np.repeat(np.arange(len(sizes)), sizes))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(row), batch.column(1).take(row), *(pa.array(np.concatenate(x)) for x in (hashes, mores, again))], ["doc_id", "text_hash", "hash", "more", "again"])

    return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(run, "doc_id long, text_hash long, hash long, more int, again boolean")


def removed(docs: DataFrame, words: int = 15) -> DataFrame:
    """id, text_hash, every (hashes of the spans to remove) and later (hashes whose first span there stays) for each document that loses any."""
    found = materialize(spans(ids_and_texts(docs), words), "sentence-spans")
    keyed = found.select(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("id"), "text_hash", "hash", "more", "again")
    firsts = keyed.groupBy("hash", "more").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n"), F.max("again").alias("some")).where("n > 1 or some").select("hash", "more", "least")
    repeats = materialize(skew_join(keyed, firsts, ["hash", "more"]), "sentence-repeats")
    # of the smallest id's texts, the least hash of text comes first
    own = repeats.where("id = least").select("id", "text_hash", "hash", "more", "again")
    texts = own.groupBy("hash", "more").agg(F.min("text_hash").alias("lead"), F.max("text_hash").alias("most"), F.max("again").alias("some")).where("lead <> most or some").select("hash", "more", "lead")
    tied = skew_join(own, texts, ["hash", "more"]).where("text_hash <> lead or again").select("id", "text_hash", "hash", F.expr("text_hash <> lead").alias("whole"))
    gone = repeats.where("id <> least").select("id", "text_hash", "hash", F.lit(True).alias("whole")).unionByName(tied)
    return gone.groupBy("id", "text_hash").agg(F.collect_set(F.when(F.col("whole"), F.col("hash"))).alias("every"), F.collect_set(F.when(~F.col("whole"), F.col("hash"))).alias("later"))


def deduplicated(docs: DataFrame, words: int = 15) -> DataFrame:
    """doc_id, n_sentences, n_removed, removed_spans ("first-last" sentences, comma-joined) and clean_text for each row."""
    docs = ids_and_texts(docs)
    rows = docs.withColumns({"id": F.coalesce("doc_id", F.lit(-(1 << 63))), "text_hash": F.xxhash64("text")})
    both = rows.join(removed(docs, words), ["id", "text_hash"], "left").select("doc_id", "text", "every", "later")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            count, gone, said, clean = [], [], [], []
            for k, text in enumerate(batch.column(1).to_pylist()):
                if batch.column(2)[k].is_valid:
                    h, _, first, last, own = runs(text, words)
                    every, later = (np.asarray(batch.column(c)[k].values) for c in (2, 3))
                    _, once = np.unique(h, return_index=True)
                    hit = np.isin(h, later)
                    hit[once] = False
                    hit |= np.isin(h, every)
                    dead = np.zeros(len(own) + 1, dtype=np.int64)
                    np.add.at(dead, first[hit], 1)
                    np.add.at(dead, last[hit] + 1, -1)
                    dead = np.cumsum(dead)[: len(own)] > 0
                else:
                    own = sentences_of(text)
                    dead = np.zeros(len(own), dtype=bool)
                edges = np.flatnonzero(np.diff(np.concatenate([[0], dead.astype(np.int8), [0]])))
                count.append(len(own))
                gone.append(int(dead.sum()))
                said.append(",".join(f"{a}-{b - 1}" for a, b in edges.reshape(-1, 2).tolist()))
                clean.append("".join(s for s, d in zip(own, dead.tolist()) if not d))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(count, pa.int64()), pa.array(gone, pa.int64()), pa.array(said, pa.string()), pa.array(clean, pa.string())], ["doc_id", "n_sentences", "n_removed", "removed_spans", "clean_text"])

    return both.mapInArrow(run, "doc_id long, n_sentences long, n_removed long, removed_spans string, clean_text string")
