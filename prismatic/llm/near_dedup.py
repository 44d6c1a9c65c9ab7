"""MinHash near-duplicates with sequential Bayesian verification.

A document is the set of its distinct w-word shingles (64-bit hashes). Documents with equal sets collapse to one representative. Signatures are cut into
bands; representatives that agree on a band are candidates. Within a band's bucket all are first compared with the bucket's smallest id (a star, so a
bucket of m gives m - 1 pairs). What the star leaves in different components is compared inside bucket tasks, in blocks of bounded size: those emit
only links that join components, never all pairs. Each comparison reads signatures in batches and stops when the posterior probability that
the similarity reaches the threshold falls under MISS; survivors are verified on full sets.

The chance that bands miss a pair at the threshold is under MISS too; it falls fast above it.

Null, empty and white texts have no shingle and link with nothing. A text with fewer than w words has its word sequence as only shingle. A null doc_id
takes no part in links: its component_id is null and the row is kept. Rows that repeat with a doc_id are one document. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import ids_and_texts, materialize, pieces, shuffle_partitions, skew_join, words_of

#: Chance of a miss, of the bands at the threshold and of each early stop.
MISS = 1e-6
ROWS = 5
#: Hashes that one step of a comparison reads.
STEP = 30
#: Members of a bucket in one block: a task holds two blocks.
BLOCK = 512
CHUNK_BYTES = 4_000_000


def bands_for(threshold: float) -> int:
    return math.ceil(math.log(MISS) / math.log(1 - threshold**ROWS))


def least_matches(threshold: float, size: int) -> list[tuple[int, int]]:
    """(n, m): after n hashes, fewer than m matches mean P(similarity >= threshold) < MISS, under an even prior: Beta(m + 1, n - m + 1)."""
    out = []
    for n in [*range(STEP, size, STEP), size]:
        tail = 0.0
        for m in range(n + 1):
            tail += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if tail >= MISS:
                out.append((n, m))
                break
    return out


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: pa.Array, w: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    flat, at = words_of(texts)
    coded = flat.dictionary_encode()
    table = np.array([xxhash.xxh64_intdigest(x) for x in coded.dictionary.to_pylist()], dtype=np.uint64)
    h = table[np.asarray(coded.indices)] if len(table) else np.zeros(0, dtype=np.uint64)
    run = h[: max(0, len(h) - w + 1)]
    for k in range(1, w):
        run = mixed(run) + h[k : k + len(run)]
    run = mixed(run + np.uint64(w))
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        if b - a >= w:
            out.append(np.unique(run[a : b - w + 1]))
        elif b > a:
            one = h[a : a + 1]
            for k in range(a + 1, b):
                one = mixed(one) + h[k : k + 1]
            out.append(mixed(one + np.uint64(b - a)))
        else:
            out.append(h[:0])
    return out


def hash_family(size: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240229)
    return rng.integers(0, 1 << 63, size, dtype=np.uint64) << np.uint64(1) | rng.integers(0, 2, size, dtype=np.uint64), rng.integers(0, 1 << 62, size, dtype=np.uint64) << np.uint64(1) | np.uint64(1)


def signatures(sets: list[np.ndarray], size: int) -> np.ndarray:
    """A row of minima for each set; the sets aren't empty."""
    xor, times = hash_family(size)
    out = np.empty((len(sets), size), dtype=np.uint32)
    lo = 0
    while lo < len(sets):
        hi, held = lo, 0
        while hi < len(sets) and (hi == lo or held + len(sets[hi]) <= 1 << 15):
            held += len(sets[hi])
            hi += 1
        flat = np.concatenate(sets[lo:hi])
        start = np.cumsum([0, *(len(s) for s in sets[lo : hi - 1])])
        for k in range(size):
            out[lo:hi, k] = np.minimum.reduceat((flat ^ xor[k]) * times[k], start) >> np.uint64(32)
        lo = hi
    return out


def set_key(one: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(one.tobytes())


def sketched(docs: DataFrame, w: int, bands: int) -> DataFrame:
    """doc_id, n_shingles, key (of the whole set, null when empty) and a hash for each band."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, texts in pieces(batch, CHUNK_BYTES):
                sets = shingle_sets(texts, w)
                full = [k for k, s in enumerate(sets) if len(s)]
                sig = signatures([sets[k] for k in full], bands * ROWS).astype(np.uint64).reshape(len(full), bands, ROWS)
                h = np.tile(np.arange(1, bands + 1, dtype=np.uint64), (len(full), 1))
                for r in range(ROWS):
                    h = mixed(h) + sig[:, :, r]
                h = mixed(h).view(np.int64)
                keys, rows = [None] * len(sets), [None] * len(sets)
                for k, x in zip(full, h):
                    keys[k], rows[k] = set_key(sets[k]), x
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()), pa.array(rows, pa.list_(pa.int64()))], ["doc_id", "n_shingles", "key", "bands"])

    return docs.mapInArrow(run, "doc_id long, n_shingles long, key binary, bands array<long>")


def sets_of(docs: DataFrame, w: int, size: int) -> DataFrame:
    """node, sig (32-bit minima) and members (sorted 64-bit hashes) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, texts in pieces(batch, CHUNK_BYTES):
                pairs = [(i, s) for i, s in zip(ids, shingle_sets(texts, w)) if len(s)]
                sig = signatures([s for _, s in pairs], size)
                yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in pairs], pa.int64()), pa.array([x.tobytes() for x in sig], pa.binary()), pa.array([s.tobytes() for _, s in pairs], pa.binary())], ["node", "sig", "members"])

    return docs.mapInArrow(run, "node long, sig binary, members binary")


def similar(a: np.ndarray, b: np.ndarray, num: int, den: int) -> bool:
    """den * |a & b| >= num * |a | b|, exactly."""
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if den * len(small) < num * len(large):
        return False
    at = np.searchsorted(large, small)
    at[at == len(large)] = 0
    both = int((large[at] == small).sum())
    return den * both >= num * (len(a) + len(b) - both)


def verified(pairs: DataFrame, num: int, den: int, size: int) -> DataFrame:
    """The pairs (a, b) that link, from rows with both sides' sig and members."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps = least_matches(num / den, size)
        for batch in batches:
            n = batch.num_rows
            sig = [np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint32).reshape(n, size) for c in (2, 4)]
            alive, before, matches = np.arange(n), 0, np.zeros(n, dtype=np.int64)
            for upto, least in steps:
                matches[alive] += (sig[0][alive, before:upto] == sig[1][alive, before:upto]).sum(1)
                alive, before = alive[matches[alive] >= least], upto
            ok = [k for k in alive.tolist() if similar(np.frombuffer(batch.column(3)[k].as_buffer(), np.uint64), np.frombuffer(batch.column(5)[k].as_buffer(), np.uint64), num, den)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(ok, pa.int64())), batch.column(1).take(pa.array(ok, pa.int64()))], ["a", "b"])

    return pairs.select("a", "b", "sig_a", "members_a", "sig_b", "members_b").mapInArrow(run, "a long, b long")


def joined_blocks(members: DataFrame, num: int, den: int, size: int) -> DataFrame:
    """Links that join different components inside each group (bucket, i, j) of members: rows with node, component, side, sig, members, sorted by group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps = least_matches(num / den, size)

        def links(rows: list[tuple]) -> list[tuple[int, int]]:
            node, comp, side = (np.array([r[k] for r in rows]) for k in range(3))
            sig = np.frombuffer(b"".join(r[3] for r in rows), np.uint32).reshape(len(rows), size)
            sets = [np.frombuffer(r[4], np.uint64) for r in rows]
            found, cross = [], len(set(side.tolist())) > 1
            for a in range(len(rows)):
                others = np.flatnonzero(comp[a + 1 :] != comp[a]) + a + 1
                if cross:
                    others = others[side[others] != side[a]]
                before, matches = 0, np.zeros(len(others), dtype=np.int64)
                for upto, least in steps:
                    matches += (sig[others, before:upto] == sig[a, before:upto]).sum(1)
                    keep = matches >= least
                    others, matches, before = others[keep], matches[keep], upto
                for b in others.tolist():
                    if comp[a] != comp[b] and similar(sets[a], sets[b], num, den):
                        found.append((int(node[a]), int(node[b])))
                        comp[comp == comp[b]] = comp[a]
            return found

        now, held = None, []
        for batch in batches:
            done = []
            for group, *row in zip(*(batch.column(c).to_pylist() for c in range(6))):
                if group != now:
                    done += links(held)
                    now, held = group, []
                held.append(row)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*done)], ["a", "b"])
        if held and (done := links(held)):
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*done)], ["a", "b"])

    return members.mapInArrow(run, "a long, b long")


def left_over(buckets: DataFrame, labels: DataFrame) -> DataFrame:
    """bucket, node, component of the buckets that still hold several components; of buckets with the same members, one."""
    members = buckets.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    state = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("component").alias("lo"), F.max("component").alias("hi"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("sum"), F.bit_xor(F.xxhash64("node")).alias("xor"))
    one = state.where("n > 2 and lo <> hi").groupBy("n", "sum", "xor").agg(F.min("bucket").alias("bucket")).select("bucket", "n")
    return skew_join(materialize(members.select("bucket", "node", "component"), "near-members"), one, ["bucket"])


def near_duplicates(docs: DataFrame, w: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for each row."""
    docs = ids_and_texts(docs)
    bands, parts = bands_for(num / den), shuffle_partitions(docs)
    size = bands * ROWS
    sketches = materialize(sketched(docs, w, bands), "near-sketches")
    used = sketches.where("key is not null and doc_id is not null")
    reps = used.groupBy("key").agg(F.min("doc_id").alias("node"))
    own = materialize(skew_join(used.select("doc_id", "key"), reps, ["key"]), "near-representatives")
    banded = used.join(own.where("doc_id = node").select("doc_id", "key").distinct(), ["doc_id", "key"]).select(F.col("doc_id").alias("node"), F.explode("bands").alias("bucket")).distinct()
    banded = materialize(banded, "near-bands")
    leaders = banded.groupBy("bucket").agg(F.min("node").alias("leader"), F.count(F.lit(1)).alias("n")).where("n > 1").select("bucket", "leader")
    buckets = materialize(skew_join(banded, leaders, ["bucket"]), "near-buckets")
    stars = materialize(buckets.where("node <> leader").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct(), "near-pairs")
    involved = buckets.select("node").distinct()
    wanted = docs.join(involved, docs["doc_id"] == involved["node"], "left_semi").select("doc_id", "text")
    sets = materialize(sets_of(wanted, w, size), "near-sets")
    side = lambda x: sets.select(F.col("node").alias(x), F.col("sig").alias(f"sig_{x}"), F.col("members").alias(f"members_{x}"))
    full = skew_join(stars, side("a"), ["a"]).join(side("b"), "b")
    links = materialize(verified(full, num, den, size), "near-links")
    labels = components(links)
    rest = left_over(buckets.select("bucket", "node"), labels)
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    mine = F.pmod(F.xxhash64("node"), F.col("blocks").cast("long")).cast("int")
    split = rest.withColumn("blocks", blocks).withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    grouped = split.select(F.xxhash64("bucket", F.least("mine", "other"), F.greatest("mine", "other")).alias("group"), "node", "component", F.col("mine").alias("side"))
    tasks = grouped.join(sets, "node").repartition(parts, "group").sortWithinPartitions("group", "node")
    more = joined_blocks(tasks.select("group", "node", "component", "side", "sig", "members"), num, den, size)
    more = materialize(more, "near-more-links")
    if more.isEmpty():
        final = labels
    else:
        final = components(links.unionByName(more))
    named = skew_join(own, final, ["node"], "left").select("doc_id", "key", F.coalesce("component", "node").alias("component_id")).distinct()
    rows = sketches.select("doc_id", "n_shingles", "key").join(named, ["doc_id", "key"], "left")
    return rows.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
