"""Exact duplicates by an extendible-hash index on shared files.

Rows go by a 64-bit key of their normalised text. From the number of distinct keys under each prefix of the key the driver builds the directory: it starts with
one bucket, splits whichever holds more than `capacity` keys, and doubles when a bucket is as deep as the directory. Every row is dealt to the task that
owns its bucket, in order of key. The owner chains the texts that collide under a key, comparing their bytes; a text is the same as another when its bytes
are, whatever keys or digests say. It writes the index: an entry for each row with its place in the chain, and a node for each place with
its number of rows and the row that stays.

A key that holds a large part of all rows is spread over several tasks, each with a chain of its own; their nodes, few and with their texts, then go to the
bucket's owner, which compares bytes once more and puts equal ones together. Entries find their node by key, task and place.

Null text counts as empty; empty texts and texts of white space alone are equal. Of equal texts the row with most code points in the original, then
with the smallest doc_id stays; a null doc_id comes after all others. Rows that repeat with the same doc_id count each and share the
decision. Other columns, whatever their names, are not read. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import ids_and_texts, materialize, shuffle_partitions

#: Keys that a bucket holds before it splits, and the greatest depth: the directory has at most 2 ** DEPTH cells.
CAPACITY, DEPTH = 50_000, 16
#: A key with over 1/SHARE of all rows is spread over tasks, so at most SHARE keys are.
SHARE = 2000
ENTRY, NODE = 0, 1
INDEX = "kind int, bucket int, key long, salt int, chain int, doc_id long, row_hash long, size long, n long, digest string, text binary"
FINAL = "key long, salt int, chain int, keep_id long, keep_hash long, group_size long, digest string"


def keyed(docs: DataFrame, hashed: Callable[[Column], Column]) -> DataFrame:
    """doc_id, row_hash (of the original), size (its code points), key and the normalised text."""
    plain = F.translate("text", " \t\n\x0b\x0c\r", "").alias("plain")
    rows = ids_and_texts(docs).select("doc_id", F.xxhash64("text").alias("row_hash"), F.char_length("text").cast("long").alias("size"), plain)
    return rows.withColumn("key", hashed(F.col("plain")))


def prefix(key: str, depth: int):
    """The first depth bits of a 64-bit key, as an integer."""
    return F.shiftrightunsigned(key, 64 - depth).cast("int") if depth else F.lit(0)


def directory(cells: dict[int, int], capacity: int, depth_limit: int) -> tuple[int, list[int]]:
    """Depth g and the bucket of each of 2 ** g prefixes, for the keys under each prefix of depth_limit bits."""
    sums = [0]
    for c in range(1 << depth_limit):
        sums.append(sums[-1] + cells.get(c, 0))

    def held(local: int, at: int) -> int:
        wide = depth_limit - local
        return sums[(at + 1) << wide] - sums[at << wide]

    depth, slots, local = 0, [0], [(0, 0)]  # local: depth and prefix of each bucket
    full = [0] if held(0, 0) > capacity else []
    while full:
        b = full.pop()
        d, at = local[b]
        if d == depth_limit:  # one cell: further keys chain
            continue
        if d == depth:  # double: each cell becomes two that point to the same bucket
            slots, depth = [s for s in slots for _ in (0, 1)], depth + 1
        new, d = len(local), d + 1
        local[b], wide = (d, at << 1), depth - d
        local.append((d, at << 1 | 1))
        first = (at << 1 | 1) << wide
        slots[first : first + (1 << wide)] = [new] * (1 << wide)
        full += [x for x in (b, new) if held(*local[x]) > capacity]
    return depth, slots


def better(a: tuple, b: tuple) -> tuple:
    """Of two rows (size, doc_id, row_hash) the one that stays."""
    order = lambda r: (-r[0], r[1] is None, r[1] or 0, r[2])
    return min(a, b, key=order)


def filed(dealt: DataFrame) -> DataFrame:
    """INDEX rows of an owner's rows (bucket, key, salt, spread, doc_id, row_hash, size, plain), which come in order of key and salt. Memory holds one chain."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, chain, nodes = None, [], []  # chain: [text, rows, the row that stays]

        def close() -> None:
            for place, (raw, n, best) in enumerate(chain):
                bucket, key, salt, spread = now
                nodes.append((NODE, bucket, key, salt, place, best[1], best[2], best[0], n, hashlib.sha256(raw).hexdigest(), raw if spread else None))

        def written() -> pa.RecordBatch:
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*nodes), kinds)], [x.split()[0] for x in INDEX.split(", ")])

        for batch in batches:
            places = []
            bucket, key, salt, spread, doc, row_hash, size = (batch.column(c).to_pylist() for c in range(7))
            for *group, best, plain in zip(bucket, key, salt, spread, zip(size, doc, row_hash), batch.column(7)):
                if group != now:
                    close()
                    now, chain = group, []
                raw = plain.as_buffer().to_pybytes()
                for place, node in enumerate(chain):
                    if node[0] == raw:
                        node[1] += 1
                        node[2] = better(node[2], best)
                        break
                else:
                    place = len(chain)
                    chain.append([raw, 1, best])
                places.append(place)
            n = batch.num_rows
            if n:
                entry = [pa.array([ENTRY] * n, pa.int32()), batch.column(0), batch.column(1), batch.column(2), pa.array(places, pa.int32()), *(batch.column(c) for c in (4, 5, 6)), pa.nulls(n, pa.int64()), pa.nulls(n, pa.string()), pa.nulls(n, pa.binary())]
                yield pa.RecordBatch.from_arrays(entry, [x.split()[0] for x in INDEX.split(", ")])
            if nodes:
                yield written()
                nodes.clear()
        close()
        if nodes:
            yield written()

    return dealt.select("bucket", "key", "salt", "spread", "doc_id", "row_hash", "size", F.col("plain").cast("binary").alias("plain")).mapInArrow(run, INDEX)


def together(nodes: DataFrame) -> DataFrame:
    """FINAL rows of the nodes of spread keys, which come in order of key: equal bytes are one text. A key has few nodes: its distinct texts in each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, texts, places, done = None, [], [], []

        def close() -> None:
            for salt, chain, at in places:
                _, n, best, digest = texts[at]
                done.append((now, salt, chain, best[1], best[2], n, digest))

        def written() -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), kinds)], [x.split()[0] for x in FINAL.split(", ")])

        for batch in batches:
            for key, salt, chain, doc, row_hash, size, n, digest, raw in zip(*(batch.column(c).to_pylist() for c in range(9))):
                if key != now:
                    close()
                    now, texts, places = key, [], []
                for at, text in enumerate(texts):
                    if text[0] == raw:
                        text[1:3] = text[1] + n, better(text[2], (size, doc, row_hash))
                        break
                else:
                    at = len(texts)
                    texts.append([raw, n, (size, doc, row_hash), digest])
                places.append((salt, chain, at))
            if done:
                yield written()
                done.clear()
        close()
        if done:
            yield written()

    return nodes.select("key", "salt", "chain", "doc_id", "row_hash", "size", "n", "digest", "text").mapInArrow(run, FINAL)


def index(docs: DataFrame, capacity: int = CAPACITY, depth_limit: int = DEPTH, share: int = SHARE, hashed: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """The INDEX rows, as written by the owners of the buckets."""
    spark, docs = docs.sparkSession, keyed(docs, hashed)
    keys = materialize(docs.groupBy("key").agg(F.count(F.lit(1)).alias("n")), "dedup-keys")
    cells = keys.groupBy(prefix("key", depth_limit).alias("cell")).agg(F.count(F.lit(1)).alias("keys"), F.sum("n").alias("rows")).collect()  # at most 2 ** depth_limit
    tasks = shuffle_partitions(docs)
    # small tables split further, so that each owner has buckets
    capacity = max(1, min(capacity, sum(r["keys"] for r in cells) // (4 * tasks)))
    depth, slots = directory({r["cell"]: r["keys"] for r in cells}, capacity, depth_limit)
    most = max(200, sum(r["rows"] for r in cells) // share)
    wide = [(r["key"], -(-r["n"] // most)) for r in keys.where(F.col("n") > most).collect()]  # at most `share`
    tasks = max(tasks, min(len(set(slots)), 4 * tasks))
    buckets = spark.createDataFrame(list(enumerate(slots)), "cell int, bucket int")
    copies = spark.createDataFrame(wide, "key long, copies long")
    rows = docs.withColumn("cell", prefix("key", depth)).join(F.broadcast(buckets), "cell").join(F.broadcast(copies), "key", "left")
    salt = F.coalesce(F.pmod(F.xxhash64("doc_id", "row_hash"), F.col("copies")), F.lit(0)).cast("int")
    rows = rows.select("bucket", "key", salt.alias("salt"), F.col("copies").isNotNull().alias("spread"), "doc_id", "row_hash", "size", "plain")
    dealt = rows.repartitionById(tasks, (F.col("bucket") + F.col("salt")) % tasks).sortWithinPartitions("bucket", "key", "salt")
    return materialize(filed(dealt), "dedup-index")


def decided(docs: DataFrame, **options) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256, row_hash (xxhash64 of the original text) and stays (not only the doc_id but the very text stays)
    for each row; options are index()'s."""
    found = index(docs, **options)
    nodes = found.where(F.col("kind") == NODE)
    alone = nodes.where("text is null").select("key", "salt", "chain", F.col("doc_id").alias("keep_id"), F.col("row_hash").alias("keep_hash"), F.col("n").alias("group_size"), "digest")
    tasks = shuffle_partitions(docs)
    spread = together(nodes.where("text is not null").repartitionById(tasks, F.col("bucket") % tasks).sortWithinPartitions("key"))
    entries = found.where(F.col("kind") == ENTRY).select("key", "salt", "chain", "doc_id", "row_hash")
    both = entries.join(alone.unionByName(spread), ["key", "salt", "chain"])
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    return both.select("doc_id", "keep_id", "group_size", kept.alias("kept"), F.col("digest").alias("text_sha256"), "row_hash", (kept & (F.col("row_hash") == F.col("keep_hash"))).alias("stays"))
