"""Packing of tokenised documents into sequences of one size, online and in bounded space.

A partition keeps a fixed number of open windows.  A document takes the window that it
leaves the least room in; documents as long as a sequence fill sequences of their own first.  Where it
fits none, the fullest window is emitted: padded if its room is within ``SLACK``, else
filled with the head of the document, whose rest looks for a window again.  What is still open
at the end of a partition is merged in rounds: the pieces left by up to ``MERGE`` partitions go
to one task, longest first, until one task has all of them.  So no task holds more than its open
windows, or ``MERGE`` times as many, and the last one closes what is left in lengths of powers of two.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortforge.llm.arrowtext import chunks
from cohortforge.llm.shared import materialise, small_batches
from cohortforge.llm.word_ids import encoder

SIZE, OPEN, SLACK, MERGE = 4096, 64, 16, 16
END_ID = 2

_PIECES = "doc_id long, start long, ids binary, doc_tokens long, sequence_id long, offset long, place long, number long"
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("ids", pa.binary()), *((n, pa.int64()) for n in ("doc_tokens", "sequence_id", "offset", "place", "number"))])


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Packer:
    """Open windows of one task.  A piece is (doc_id, start, ids, doc_tokens); closed pieces gather in ``rows``."""

    def __init__(self, first_id: int, size: int, open_windows: int, slack: int):
        self.next_id, self.size, self.open, self.slack = first_id, size, open_windows, slack
        self.rooms: list[tuple[int, int]] = []  # (room, window), sorted
        self.windows: dict[int, list[tuple]] = {}
        self.opened = 0
        self.rows: list[tuple] = []

    def emit(self, pieces: list[tuple]) -> None:
        offset = 0
        for doc_id, start, ids, total in pieces:
            self.rows.append((doc_id, start, ids, total, self.next_id, offset, None, None))
            offset += len(ids) // 4
        self.next_id += 1

    def add(self, piece: tuple) -> None:
        """Place a piece of any length."""
        doc_id, start, ids, total = piece
        while len(ids) >= 4 * self.size:
            self.emit([(doc_id, start, ids[: 4 * self.size], total)])
            start, ids = start + self.size, ids[4 * self.size :]
        while ids:
            n = len(ids) // 4
            at = bisect_left(self.rooms, (n, -1))
            if at < len(self.rooms):
                room, window = self.rooms.pop(at)
                self.windows[window].append((doc_id, start, ids, total))
                self._close_or_keep(window, room - n)
                return
            if len(self.rooms) < self.open:
                self.opened += 1
                self.windows[self.opened] = [(doc_id, start, ids, total)]
                self._close_or_keep(self.opened, self.size - n)
                return
            room, window = self.rooms.pop(0)
            pieces = self.windows.pop(window)
            if room > self.slack:
                pieces.append((doc_id, start, ids[: 4 * room], total))
                start, ids = start + room, ids[4 * room :]
            self.emit(pieces)

    def _close_or_keep(self, window: int, room: int) -> None:
        if room:
            insort(self.rooms, (room, window))
        else:
            self.emit(self.windows.pop(window))

    def left(self) -> list[tuple]:
        """The pieces of the open windows."""
        return list(chain.from_iterable(self.windows.values()))

    def finish(self) -> None:
        """Close what is open: whole sequences, then lengths of powers of two, none padded."""
        pieces, self.windows, self.rooms = self.left(), {}, []
        rest = sum(len(p[2]) // 4 for p in pieces)
        held = iter(pieces)
        doc_id = start = total = None
        ids = b""
        while rest:
            want = self.size if rest >= self.size else 1 << (rest.bit_length() - 1)
            rest -= want
            group = []
            while want:
                if not ids:
                    doc_id, start, ids, total = next(held)
                n = min(want, len(ids) // 4)
                group.append((doc_id, start, ids[: 4 * n], total))
                start, ids, want = start + n, ids[4 * n :], want - n
            self.emit(group)

    def take(self) -> pa.RecordBatch:
        """The closed pieces since the last call."""
        rows, self.rows = self.rows, []
        return _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in _SCHEMA]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _SCHEMA, strict=True)], schema=_SCHEMA)


def _open_rows(packer: Packer, place: int) -> pa.RecordBatch:
    return _batch([(*p, None, None, place, i) for i, p in enumerate(packer.left())])


def pack(docs: DataFrame, tokenizer_file: str | None = None, size: int = SIZE, open_windows: int = OPEN, slack: int = SLACK, end_id: int = END_ID) -> DataFrame:
    """doc_id, start, ids, doc_tokens, sequence_id and offset of every piece of every document.

    A document is the ids of its whole text and ``end_id``; null and empty texts are the latter
    alone.  ``ids``: little-endian unsigned 32-bit numbers; each id lies in one piece, and pieces
    of a sequence follow each other without a gap.  Sequences hold at most ``size`` ids and are padded to that by
    those that read them, but for those whose length is a power of two.  Rows that repeat and rows without a doc_id are packed each for
    itself; other columns are not looked at.  An empty table gives no piece.
    """
    spark = docs.sparkSession
    small_batches(spark)
    with open(tokenizer_file or default_tokenizer(), encoding="utf-8") as f:
        held = spark.sparkContext.broadcast(f.read())
    end = np.array([end_id], "<u4").tobytes()

    def first(batches):
        words = encoder(held.value)
        place = TaskContext.get().partitionId()
        packer = Packer(place << 28, size, open_windows, slack)
        for batch in chunks(batches, 2 << 20):
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), words.encode(batch.column("text").to_pylist()), strict=True):
                packer.add((doc_id, 0, ids.astype("<u4").tobytes() + end, len(ids) + 1))
            yield packer.take()
        yield _open_rows(packer, place)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    tables = [materialise(rows.mapInArrow(first, _PIECES))]
    most = tables[0].agg(F.max("place")).first()[0]
    level = 0
    while most is not None:
        level, most = level + 1, most // MERGE
        tables.append(materialise(_merged(tables[-1], level, most == 0, size, open_windows, slack)))
        most = most or None
    closed = [t.where("sequence_id is not null").drop("place", "number") for t in tables]
    return reduce(DataFrame.unionByName, closed)


def _merged(table: DataFrame, level: int, last: bool, size: int, open_windows: int, slack: int) -> DataFrame:
    """One round: the open pieces of ``MERGE`` neighbouring places are packed together, longest first."""

    def merge(key, group):
        place = key[0].as_py()
        packer = Packer(level << 58 | place << 28, size, open_windows, slack)
        pieces = group.select(["ids", "place", "number", "doc_id", "start", "doc_tokens"]).to_pylist()
        for p in sorted(pieces, key=lambda p: (-len(p["ids"]), p["place"], p["number"])):
            packer.add((p["doc_id"], p["start"], p["ids"], p["doc_tokens"]))
        if last:
            packer.finish()
        return pa.Table.from_batches([packer.take(), _open_rows(packer, place)])

    return table.where("sequence_id is null").groupBy(F.expr(f"place div {MERGE}")).applyInArrow(merge, _PIECES)  # MERGE times the open windows


def sequences(packed: DataFrame, size: int = SIZE, pad_id: int = 0) -> DataFrame:
    """sequence_id, ids, n_tokens and n_padding of every sequence: its pieces in order, padded to ``size`` unless its length is a power of two."""
    whole = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("pieces"))  # ``size`` ids at most
    joined = whole.select("sequence_id", F.aggregate("pieces", F.lit(b""), lambda a, p: F.concat(a, p["ids"])).alias("ids"))
    n = (F.length("ids") / 4).cast("int")
    counted = joined.select("sequence_id", "ids", n.alias("n_tokens"), F.when(F.bit_count(n) == 1, 0).otherwise(size - n).alias("n_padding"))
    pad = F.unhex(F.repeat(F.lit(np.array([pad_id], "<u4").tobytes().hex()), F.col("n_padding")))
    return counted.select("sequence_id", F.concat("ids", pad).alias("ids"), "n_tokens", "n_padding")


def digests(packed: DataFrame) -> DataFrame:
    """Pieces with the length and CRC-32 of their ids in place of these."""
    return packed.select("doc_id", "start", (F.length("ids") / 4).cast("long").alias("length"), F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
