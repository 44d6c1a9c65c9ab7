"""Chat formatting by token-level assembly.

Each turn's header and text are encoded apart, in parallel; reserved ids (above the vocabulary) mark where a turn starts, where its text starts and
where it ends, so no text can forge them. The rendered string shows the reserved ids as control strings, and those occurring in a role or a text get a
backslash before them, as does a backslash itself, so that reading back is exact. The loss mask falls out of prefix sums over turn lengths: it covers
the tokens of assistant texts.

A conversation is folded turn by turn in the order (turn, role, text) of Spark's sort, which spills; memory holds one turn, however long the
conversation. Null text and null role count as empty, a null turn sorts first. Repeated rows are turns of their own. Empty tables give no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import encoding, load_ranks
from .shared import shuffle_partitions

#: Control strings of the rendered form, for the three reserved ids after the vocabulary.
TURN, TEXT, END = "### ", ": ", " </turn>\n"
#: What must not occur bare in a text, and in a role.
IN_TEXT, IN_ROLE = regex.compile(r"\\|###|</turn>"), regex.compile(r"\\|###|</turn>|:")


def escape(text: str, control: regex.Pattern = IN_TEXT) -> str:
    return control.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return regex.sub(r"(?s)\\(.)", r"\1", text)


def turns(conversations: DataFrame) -> DataFrame:
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), text("role").alias("role"), text("text").alias("text"))


def assembled(conversations: DataFrame, path: str, pattern: str) -> DataFrame:
    """conv_id, turn, role, text and the turn's ids, with the place of its text in them. Ids from size on are reserved: size + 0, 1, 2 for TURN, TEXT, END."""
    made: dict = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not made:
            made["enc"], made["size"] = encoding(path, pattern), 1 + max(load_ranks(path).values())
        enc, size = made["enc"], made["size"]
        for batch in batches:
            ids, lo, hi = [], [], []
            for role, text in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                head, body = enc.encode_ordinary(escape(role, IN_ROLE)), enc.encode_ordinary(escape(text))
                turn = [size, *head, size + 1, *body, size + 2]
                lo.append(len(head) + 2)
                hi.append(len(head) + 2 + len(body))
                ids.append(np.array(turn, dtype="<u4").tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.binary()), pa.array(lo, pa.int64()), pa.array(hi, pa.int64())], [*batch.schema.names, "ids", "text_from", "text_to"])

    return turns(conversations).mapInArrow(run, "conv_id long, turn long, role string, text string, ids binary, text_from long, text_to long")


def masked(conversations: DataFrame, path: str, pattern: str, loss_role: str = "assistant") -> DataFrame:
    """One row for each turn: conv_id, position in the conversation's ids (prefix sum of turn lengths), ids, and the stretch of them under the loss mask
    (loss_from = loss_to for roles without loss). Sorted by conversation within partitions."""
    rows = assembled(conversations, path, pattern).repartition(shuffle_partitions(conversations), "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, at, k = object(), 0, 0
        for batch in batches:
            start, number, lo, hi = [], [], [], []
            for conv, role, ids, a, b in zip(*(batch.column(c).to_pylist() for c in (0, 2, 4, 5, 6))):
                if conv != now:
                    now, at, k = conv, 0, 0
                start.append(at)
                number.append(k)
                lo.append(at + a)
                hi.append(at + (b if role == loss_role else a))
                at, k = at + len(ids) // 4, k + 1
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(number, pa.int64()), pa.array(start, pa.int64()), batch.column(4), pa.array(lo, pa.int64()), pa.array(hi, pa.int64())], ["conv_id", "number", "start", "ids", "loss_from", "loss_to"])

    return rows.mapInArrow(run, "conv_id long, number long, start long, ids binary, loss_from long, loss_to long")


class Reader:
    """Reads a conversation back from its turns' ids and masks, one turn at a time."""

    def __init__(self, table: dict[int, bytes]):
        self.table, self.size = table, 1 + max(table)
        self.turns = self.loss_chars = self.chars = 0
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()

    def words(self, ids: list[int]) -> str:
        return b"".join(map(self.table.__getitem__, ids)).decode()

    def read(self, ids: np.ndarray, lo: int, hi: int) -> None:
        where = np.flatnonzero(ids >= self.size)
        if list(ids[where] - self.size) != [0, 1, 2]:
            raise ValueError("a turn's reserved ids are out of order")
        role, text = self.words(ids[1 : where[1]].tolist()), self.words(ids[where[1] + 1 : where[2]].tolist())
        self.chars += len(TURN) + len(role) + len(TEXT) + len(text) + len(END)
        self.all.update(f"{unescape(role)}\n{unescape(text)}\n".encode())
        under = unescape(self.words(ids[lo:hi].tolist()))
        self.loss.update(under.encode())
        self.loss_chars += len(under)
        self.turns += 1


def read_back(formatted: DataFrame, path: str) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256 and formatted_chars, from masked()'s rows alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = {v: k for k, v in load_ranks(path).items()}
        now, reader = None, None

        def row() -> pa.RecordBatch:
            values = [now], [reader.turns], [reader.all.hexdigest()], [reader.loss_chars], [reader.loss.hexdigest()], [reader.chars]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()))], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

        for batch in batches:
            done = []
            for conv, start, ids, lo, hi in zip(*(batch.column(c).to_pylist() for c in (0, 2, 3, 4, 5))):
                if reader is None or conv != now:
                    if reader is not None:
                        done.append(row())
                    now, reader = conv, Reader(table)
                reader.read(np.frombuffer(ids, "<u4").astype(np.int64), lo - start, hi - start)
            if done:
                yield from pa.Table.from_batches(done).combine_chunks().to_batches()
        if reader is not None:
            yield row()

    return formatted.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def rendered(formatted: DataFrame, path: str) -> DataFrame:
    """conv_id, number and the turn's rendered string, control strings in place of reserved ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = {v: k for k, v in load_ranks(path).items()}
        table |= {1 + max(table) + k: s.encode() for k, s in enumerate((TURN, TEXT, END))}
        for batch in batches:
            out = [b"".join(map(table.__getitem__, np.frombuffer(x, "<u4").tolist())).decode() for x in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string())], ["conv_id", "number", "rendered"])

    return formatted.mapInArrow(run, "conv_id long, number long, rendered string")
