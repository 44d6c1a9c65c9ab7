"""Exact top-k search by vector-approximation files.

Exact vectors are written to one shared file, their approximations to another: blocks of rows whose components are one-byte cells, with each cell's smallest and
largest value. A scan reads the approximations alone. Cells bound the inner product with a query from both sides; a row is a candidate unless k rows have a lower
bound above its upper one, in its task first and then over the corpus. Only the candidates' exact vectors are read, in order of their upper
bounds, until the k-th best exact score is above the next bound.

Queries go to every task of the scan in packs: a stated query set against all rows, in blocks; no pair is emitted but candidates. Of equal vectors in a block
only the first k + 1 by vec_id are scanned, as the others can't be among the best k: equal scores rank by smaller vec_id.

Components are floor(64 * x). Vectors that are null, empty, or hold null or non-finite components take no part; vectors of different length aren't compared.
Repeated rows count each: of rows with the same vec_id a query leaves out its own alone; a null vec_id ranks last and asks nothing. Scores are
exact whole numbers; scores past 64 bits are an error. Other columns, whatever their names, are not read. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialize, pack, shuffle_partitions, skew_join, unpack

BLOCK_ROWS = 32_768
#: Blocks that one task of the scan holds, as cells; queries in a pack.
BLOCKS, PACK = 16, 256
CELLS = 256
#: Rows whose bounds are worked out at once.
CHUNK = 8192
#: A null vec_id, which comes after all others.
NO_ID = (1 << 63) - 1
CANDIDATES = "query_row long, row long, low double, high double"


class Block:
    """The approximation of vectors of one length: cells, and the least and the largest value of each component's cells."""

    def __init__(self, rows: np.ndarray, cells: np.ndarray, least: np.ndarray, most: np.ndarray):
        self.rows, self.cells, self.least, self.most = rows, cells, least, most

    @classmethod
    def of(cls, rows: np.ndarray, ids: np.ndarray, exact: np.ndarray, k: int) -> Block:
        order = np.lexsort((rows, ids))
        rows, exact = rows[order], exact[order]
        _, kind = np.unique(exact, axis=0, return_inverse=True)
        by_kind = np.argsort(kind.ravel(), kind="stable")
        start = np.flatnonzero(np.diff(kind.ravel()[by_kind], prepend=-1))
        nth = np.arange(len(rows)) - np.repeat(start, np.diff(np.append(start, len(rows))))
        keep = np.sort(by_kind[nth <= k])
        rows, exact = rows[keep], exact[keep]
        n, d = exact.shape
        cells, least, most = np.empty((n, d), dtype=np.uint8), np.zeros((CELLS, d)), np.zeros((CELLS, d))
        for j in range(d):
            # cells of equal numbers of rows; equal values share one
            values = np.unique(exact[:, j])
            edges = values if len(values) <= CELLS else np.unique(np.sort(exact[:, j])[np.arange(CELLS) * n // CELLS])
            cells[:, j] = np.searchsorted(edges, exact[:, j], side="right") - 1
            least[: len(edges), j] = edges
            most[: len(edges), j] = values[np.searchsorted(values, np.append(edges[1:], np.inf)) - 1]
        return cls(rows, cells, least, most)

    def bounds(self, q: np.ndarray, lo: int) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of the inner products of queries (rows of q) with the rows from lo on, CHUNK of them."""
        cells, at = self.cells[lo : lo + CHUNK], np.arange(self.cells.shape[1])
        least, most = self.least[cells, at], self.most[cells, at]
        middle, half = (least + most) / 2, (most - least) / 2
        size = np.abs(q)
        # sums of doubles may err in their last digits
        wide = size @ half.T + 1e-12 * (size @ np.maximum(np.abs(least), np.abs(most)).T)
        s = q @ middle.T
        return s - wide, s + wide

    def packed(self) -> bytes:
        return pack(self.rows, self.cells.T.copy().ravel(), self.least.ravel(), self.most.ravel())

    @classmethod
    def unpacked(cls, data: bytes) -> Block:
        rows, cells, least, most = unpack(data)
        rows, least, most = np.frombuffer(rows, np.int64), np.frombuffer(least), np.frombuffer(most)
        return cls(rows, np.ascontiguousarray(np.frombuffer(cells, np.uint8).reshape(-1, len(rows)).T), least.reshape(CELLS, -1), most.reshape(CELLS, -1))


def found(blocks: list[Block], asked: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """query_row, row, low and high of the candidates in blocks for queries (rows of q) with row numbers `asked`."""
    best = np.full((len(q), k), -np.inf)  # the k largest lower bounds so far
    held = []
    for block in blocks:
        for lo in range(0, len(block.rows), CHUNK):
            low, high = block.bounds(q, lo)
            rows = block.rows[lo : lo + CHUNK]
            own = np.flatnonzero(np.isin(asked, rows))
            for n in own:
                low[n, rows == asked[n]] = high[n, rows == asked[n]] = -np.inf
            both = np.concatenate([best, low], axis=1)
            best = np.partition(both, both.shape[1] - k, axis=1)[:, -k:]
            n, at = np.nonzero((high >= best.min(1)[:, None]) & (high > -np.inf))
            held.append((n, rows[at], low[n, at], high[n, at]))
    n, rows, low, high = (np.concatenate(x) for x in zip(*held)) if held else (np.zeros(0, dtype=np.int64),) * 4
    keep = high >= best.min(1)[n]
    return asked[n[keep]], rows[keep], low[keep], high[keep]


def whole(vectors: DataFrame) -> DataFrame:
    """The exact file: row, vec_id and the components as floor(64 * x), of the vectors that take part; written once, so that row numbers stay."""
    x = F.col("embedding").cast("array<double>")
    good = x.isNotNull() & (F.size(x) > 0) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    # a double's floor as double: F.floor() gives a long, which large components pass
    scaled = F.transform("embedding", lambda v: v * 64.0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("embedding")).where(F.coalesce(good, F.lit(False))).withColumn("embedding", scaled)
    return materialize(rows.withColumn("row", F.monotonically_increasing_id()).select("row", "vec_id", "embedding"), "va-vectors")


def matrices(batch: pa.RecordBatch, column: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each length of vector: places in batch and a matrix of floors."""
    lists = batch.column(column)
    lens = np.diff(np.asarray(lists.offsets))
    flat, start = np.floor(np.asarray(lists.flatten())), np.asarray(lists.offsets)[:-1] - np.asarray(lists.offsets)[0]
    return {int(d): (at := np.flatnonzero(lens == d), flat[start[at][:, None] + np.arange(d)]) for d in np.unique(lens)}


def approximated(rows: DataFrame, n_blocks: int, k: int) -> DataFrame:
    """The approximation file: block, length of its vectors, and the packed Block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, {}

        def written() -> pa.RecordBatch:
            out = [(now, d, Block.of(*(np.concatenate(x) for x in zip(*parts)), k).packed()) for d, parts in held.items()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.int32(), pa.binary()))], ["block", "length", "data"])

        for batch in batches:
            blocks = np.asarray(batch.column(0))
            cuts = [0, *(np.flatnonzero(np.diff(blocks)) + 1).tolist(), len(blocks)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if blocks[a] != now:
                    if held:
                        yield written()
                    now, held = int(blocks[a]), {}
                part = batch.slice(a, b - a)
                row, ids = np.asarray(part.column(1)), np.asarray(part.column(2))
                for d, (at, matrix) in matrices(part, 3).items():
                    held.setdefault(d, []).append((row[at], ids[at], matrix))
        if held:
            yield written()

    block = F.pmod(F.xxhash64("row"), F.lit(n_blocks)).cast("int")
    ready = rows.select(block.alias("block"), "row", F.coalesce("vec_id", F.lit(NO_ID)).alias("id"), "embedding").repartitionById(max(n_blocks, shuffle_partitions(rows)), F.col("block")).sortWithinPartitions("block")
    return materialize(ready.mapInArrow(run, "block int, length int, data binary"), "va-cells")


def query_packs(asked: DataFrame) -> DataFrame:
    """length and data (row numbers and components) of packs of queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, out = np.asarray(batch.column(0)), []
            for d, (at, matrix) in matrices(batch, 1).items():
                out += [(d, pack(row[at[lo : lo + PACK]], matrix[lo : lo + PACK].ravel())) for lo in range(0, len(at), PACK)]
            yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in out], pa.int32()), pa.array([x for _, x in out], pa.binary())], ["length", "data"])

    return materialize(asked.select("row", "embedding").mapInArrow(run, "length int, data binary"), "va-queries")


def candidates(rows: DataFrame, every: int, k: int) -> DataFrame:
    """CANDIDATES of the corpus: for each query the rows whose upper bound reaches the k-th best lower bound."""
    n_blocks = max(1, -(-rows.count() // BLOCK_ROWS))
    cells = approximated(rows, n_blocks, k)
    packs = query_packs(rows.where(F.col("vec_id") % every == 0))
    tasks = max(min(n_blocks, shuffle_partitions(rows)), -(-n_blocks // BLOCKS))
    data = cells.select((F.col("block") % tasks).alias("task"), F.lit(0).alias("kind"), "length", "data")
    asked = packs.select(F.explode(F.sequence(F.lit(0), F.lit(tasks - 1))).alias("task"), F.lit(1).alias("kind"), "length", "data")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: dict[int, list[Block]] = {}
        for batch in batches:
            for kind, d, data in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3)):
                if kind == 0:
                    blocks.setdefault(d, []).append(Block.unpacked(data.as_py()))
                elif d in blocks:
                    row, q = unpack(data.as_py())
                    got = found(blocks[d], np.frombuffer(row, np.int64), np.frombuffer(q).reshape(-1, d), k)
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in got], [x.split()[0] for x in CANDIDATES.split(", ")])

    local = data.unionByName(asked).repartitionById(tasks, F.col("task")).sortWithinPartitions("kind").mapInArrow(run, CANDIDATES)
    local = materialize(local, "va-candidates")
    # the k-th best lower bound of each query over all tasks, from a group-limited sort
    nth = F.row_number().over(Window.partitionBy("query_row").orderBy(F.desc("low")))
    bar = local.select("query_row", "low").withColumn("nth", nth).where(F.col("nth") <= k).groupBy("query_row").agg(F.count(F.lit(1)).alias("n"), F.min("low").alias("bar"))
    return local.join(bar, "query_row").where((F.col("n") < k) | (F.col("high") >= F.col("bar"))).select("query_row", "row", "high")


def dot(a: np.ndarray, b: np.ndarray) -> int:
    """The exact inner product of whole numbers held as doubles."""
    if np.abs(a).max() * np.abs(b).max() * len(a) < 2**52:
        return int(a @ b)
    return sum(int(x) * int(y) for x, y in zip(a.tolist(), b.tolist()))


def verified(pairs: DataFrame, k: int) -> DataFrame:
    """query_id, vec_id, row and score of candidates, which come by query in order of their upper bounds: read until k scores are above the next bound."""
    out = "query_row long, query_id long, row long, vec_id long, score long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, scores = None, []
        for batch in batches:
            done: list[tuple] = []
            asked, ask_id, row, vec_id, high = (batch.column(c).to_pylist() for c in range(5))
            for n in range(batch.num_rows):
                if asked[n] != now:
                    now, scores = asked[n], []
                    q = np.floor(np.asarray(batch.column(5)[n].values))
                if len(scores) == k and high[n] < scores[-1]:
                    continue
                score = dot(q, np.floor(np.asarray(batch.column(6)[n].values)))
                scores = sorted([*scores, score], reverse=True)[:k]
                done.append((now, ask_id[n], row[n], vec_id[n], score))
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*done)], [x.split()[0] for x in out.split(", ")])

    return pairs.select("query_row", "query_id", "row", "vec_id", "high", "query", "embedding").mapInArrow(run, out)


def top_k(vectors: DataFrame, every: int = 20, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id and score: the best k of all other rows for each row whose vec_id is divisible by `every`."""
    rows = whole(vectors)
    near = materialize(candidates(rows, every, k), "va-near")
    asked = rows.where(F.col("vec_id") % every == 0).select(F.col("row").alias("query_row"), F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    pairs = skew_join(near, rows, ["row"]).join(asked, "query_row")
    scored = verified(pairs.repartition(shuffle_partitions(rows), "query_row").sortWithinPartitions("query_row", F.desc("high"), "row"), k)
    w = Window.partitionBy("query_row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "row")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
