"""Byte-level BPE by a corpus-wide shuffle of distinct pre-tokens.

Every text is split into pre-tokens with positions (wordblocks), each distinct pre-token of the corpus is encoded once in its bucket's task, the ids
go back to the blocks, and each document is put together by position. Decoding looks ids up in the token-byte table, whose size is the
vocabulary's (some 50,000 rows) whatever the input. Where a character's class may differ between this splitter and the library, the stretch around
it, from one certain boundary to the next, is one pre-token.

Null text counts as empty; an empty text has no ids. A text of any length is encoded whole. Repeated rows each get a row. An empty table gives none.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame

from .shared import as_array, ids_and_texts, materialize, pack, ragged, unpack
from .wordblocks import SCHEMA, VALUES, blocks, buckets_for, by_bucket, dealt, header, reassembled, record, stepped, tokens_of, unstepped

@functools.cache
def stable() -> str:
    """A character class: those whose class (letter, number, space, other) is the same in Unicode 3.2 and in this Python's version. Two libraries, whose tables
    are both later than 3.2, agree on them. Planes past the first, unassigned, private and control characters (but for \\t-\\r) are left out."""
    kind = lambda data, c: {"L": "L", "N": "N", "Z": "Z", "C": ""}.get(data.category(c)[0], "other")
    good = [0x09 <= k <= 0x0D or k >= 0x20 and (a := kind(unicodedata, chr(k))) != "" and a == kind(unicodedata.ucd_3_2_0, chr(k)) for k in range(0x10000)]
    edges = [k for k in range(0x10000) if good[k] != (k > 0 and good[k - 1])] + [0x10000] * good[-1]
    return "".join(f"\\u{a:04x}-\\u{b - 1:04x}" for a, b in zip(edges[::2], edges[1::2]))


#: For texts of these characters alone, the same classes are spelled out for the faster library: letters, and numbers.
PLAIN = "[\t\n\r\x20-\x7e\xa1-\u024f\u2010-\u2027\u2030-\u205e\u20a0-\u20bf]*"
LETTERS, NUMBERS = "a-zA-Z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f", "0-9\xb2\xb3\xb9\xbc-\xbe"


def splitter(pattern: str):
    """texts -> flat pre-tokens and each text's start."""
    find, plain = regex.compile(pattern).findall, re.compile(PLAIN).fullmatch
    doubtful = regex.compile(f"[^{stable()}]").search
    # before a single blank between other characters, all of them stable, a pre-token ends whatever stands elsewhere
    cut = regex.compile(f"(?<=[{stable()}--\\s])\x20(?=[{stable()}--\\s])", regex.V1).finditer
    # only the classes differ from the pattern; both are tested to agree
    spelled = re.sub(r"\[\^\\s\\p\{L\}\\p\{N\}\]", lambda m: f"[^\\s{LETTERS}{NUMBERS}]", pattern).replace(r"\p{L}", f"[{LETTERS}]").replace(r"\p{N}", f"[{NUMBERS}]")
    fast = re.compile(spelled).findall

    def split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        flat: list[str] = []
        at = [0]
        for t in texts.to_pylist():
            if plain(t):
                flat += fast(t)
            elif doubtful(t) is None:
                flat += find(t)
            else:
                # what lies between two cuts and holds a doubtful character goes to the library whole, so that its own tables decide
                ends = [0, *(m.start() for m in cut(t)), len(t)]
                for a, b in zip(ends, ends[1:]):
                    flat += find(t[a:b]) if doubtful(t, a, b) is None else [t[a:b]]
            at.append(len(flat))
        return pa.array(flat, pa.large_string()), np.array(at, dtype=np.int64)

    return split


def hashes(words: pa.Array) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(w) for w in words.to_pylist()], dtype=np.uint64)


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def encoding(path: str, pattern: str):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=load_ranks(path), special_tokens={})


def encode(docs: DataFrame, path: str, pattern: str) -> tuple[DataFrame, DataFrame]:
    """The blocks of docs, and the ids for their tokens: what put_together() needs."""
    docs = ids_and_texts(docs)
    n = buckets_for(docs)

    def split(texts: pa.Array):
        if "split" not in made:
            made["split"] = splitter(pattern)
        return made["split"](texts)

    made: dict = {}
    table = materialize(blocks(docs, split, hashes, n), "bpe-blocks")

    def bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = None
        for packs in by_bucket(batches):
            enc = enc or encoding(path, pattern)
            own = [tokens_of(p) for _, p in packs]
            coded = as_array(pa.chunked_array([w for _, w in own])).dictionary_encode()
            ids = [enc.encode_ordinary(w) for w in coded.dictionary.to_pylist()]
            lens = np.array([len(x) for x in ids], dtype=np.int64)
            flat, start = np.array([y for x in ids for y in x], dtype=np.uint32), np.cumsum(lens) - lens
            which, lo, rows = np.asarray(coded.indices).astype(np.int64), 0, []
            for (block, _), (codes, _) in zip(packs, own):
                w = which[lo : lo + len(codes)]
                lo += len(codes)
                rows.append((VALUES, block, -1, pack(stepped(codes), lens[w].astype(np.uint32), ragged(flat, start[w], lens[w]))))
                if len(rows) >= 512:
                    yield record(rows)
                    rows = []
            yield record(rows)

    return table, dealt(table, n).mapInArrow(bucket, SCHEMA)


def put_together(table: DataFrame, values: DataFrame, path: str, schema: str, finish) -> DataFrame:
    """finish(doc_ids, list of id arrays, token bytes) -> RecordBatch for each block."""
    made: dict = {}

    def block(doc: list[bytes], got: list[list[bytes]]) -> pa.RecordBatch:
        if "table" not in made:
            made["table"] = {v: k for k, v in load_ranks(path).items()}
        ids, counts, codes = header(doc)
        own = [(unstepped(c), np.frombuffer(n, np.uint32).astype(np.int64), np.frombuffer(v, np.uint32)) for c, n, v in got]
        size = sum(len(c) for c, _, _ in own)
        lens, start, at = np.zeros(size, dtype=np.int64), np.zeros(size, dtype=np.int64), 0
        for c, n, v in own:
            lens[c], start[c] = n, np.cumsum(n) - n + at
            at += len(v)
        flat = np.concatenate([v for _, _, v in own]) if own else np.zeros(0, dtype=np.uint32)
        ends = np.concatenate([[0], np.cumsum(counts)])
        each = (ragged(flat, start[c], lens[c]) for c in (codes[a:b] for a, b in zip(ends[:-1], ends[1:])))
        return finish(ids, each, made["table"])

    return reassembled(table, values, block, schema)


def decode(ids: np.ndarray, table: dict[int, bytes]) -> bytes:
    return b"".join(map(table.__getitem__, ids.tolist()))


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 for each row."""

    def digests(ids: pa.Array, each, table: dict[int, bytes]) -> pa.RecordBatch:
        n, a, b = [], [], []
        for x in each:
            n.append(len(x))
            a.append(hashlib.sha256(x.astype("<u4").tobytes()).hexdigest())
            b.append(hashlib.sha256(decode(x, table)).hexdigest())
        return pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    table, values = encode(docs, path, pattern)
    return put_together(table, values, path, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", digests)


def encoded(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and ids, as little-endian unsigned 32-bit integers, for each row."""

    def binary(ids: pa.Array, each, table: dict[int, bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([ids, pa.array([x.astype("<u4").tobytes() for x in each], pa.binary())], ["doc_id", "ids"])

    table, values = encode(docs, path, pattern)
    return put_together(table, values, path, "doc_id long, ids binary", binary)
