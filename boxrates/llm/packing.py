"""Bounded-space online packing of token ids into sequences.

Each partition keeps a fixed number of open windows. A piece goes to the window that it
fills best; when it fits in none, the fullest window is emitted. What is open at a
partition's end is merged with the leftovers of other partitions, best fit by falling
length.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxrates.llm.common import stored, text_of
from boxrates.llm.pieces import word_encoder

WINDOW = 4096
OPEN = 64
SLACK = 32
GROUP = 16
END = 2
_PART = 33  # bits of a sequence number within a partition

PIECE = (
    "doc_id {id}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, "
    "sequence_id bigint, offset bigint, part bigint, open boolean"
)


class Windows:
    """Open windows by their free room; each holds pieces in the order they came."""

    def __init__(self, size: int, most: int):
        self.size = size
        self.most = most
        self.windows: list[tuple[int, int]] = []  # (free, number), ascending
        self.pieces: dict[int, list] = {}
        self.next = 0

    def best(self, length: int) -> int | None:
        """Place of the window that ``length`` fills best."""
        i = bisect.bisect_left(self.windows, (length, -1))
        return i if i < len(self.windows) else None

    def put(self, i: int | None, length: int, piece) -> list | None:
        """Add a piece to window ``i`` (None: a new one); a window that is full comes back."""
        if i is None:
            free, number = self.size, self.next
            self.next += 1
            self.pieces[number] = []
        else:
            free, number = self.windows.pop(i)
        self.pieces[number].append((piece, self.size - free))
        if free == length:
            return self.pieces.pop(number)
        bisect.insort(self.windows, (free - length, number))
        return None

    def fullest(self) -> list:
        """Take out the window with the least room."""
        return self.pieces.pop(self.windows.pop(0)[1])

    def room(self) -> int:
        return self.windows[0][0]


def _pack(tokenizer: str, window: int, most: int, slack: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_encoder(tokenizer)
        end = END.to_bytes(4, "little")
        windows, out = Windows(window, most), []
        part, sequence, kind = 0, 0, None

        def emit(pieces: list, is_open: bool = False) -> None:
            nonlocal sequence
            number = (part << _PART) + sequence
            sequence += 1
            out.extend((*piece, number, offset, part, is_open) for piece, offset in pieces)

        def place(doc_id, ids: bytes, start: int, length: int, total: int) -> None:
            i = windows.best(length)
            if i is None and len(windows.windows) >= most:
                room = windows.room()
                if room > slack:  # fill the fullest window with the piece's head
                    full = windows.put(0, room, cut(doc_id, ids, start, room, total))
                    emit(full)
                    return place(doc_id, ids, start + room, length - room, total)
                emit(windows.fullest())
            if (full := windows.put(i, length, cut(doc_id, ids, start, length, total))) is not None:
                emit(full)

        def cut(doc_id, ids: bytes, start: int, length: int, total: int) -> tuple:
            crc = zlib.crc32(memoryview(ids)[4 * start : 4 * (start + length)])
            return doc_id, start, length, crc, total

        for batch in batches:
            kind = batch.schema.field("doc_id").type
            columns = [batch.column(name).to_pylist() for name in ("part", "doc_id", "text")]
            for part, doc_id, text in zip(*columns, strict=True):
                ids = encoder.encode(text) + end
                total = len(ids) // 4
                for start in range(0, total - window + 1, window):
                    emit([(cut(doc_id, ids, start, window, total), 0)])
                if rest := total % window:
                    place(doc_id, ids, total - rest, rest, total)
            yield from _table(out, kind).to_batches()
            out = []
        while windows.windows:
            emit(windows.fullest(), True)
        if out:
            yield from _table(out, kind).to_batches()

    return pack


_NAMES = [p.split(" ")[0] for p in PIECE.split(", ")]


def _table(rows: list, kind: pa.DataType) -> pa.Table:
    types = [kind, *[pa.int64()] * 7, pa.bool_()]
    columns = list(zip(*rows, strict=True)) or [[] for _ in types]
    return pa.table({n: pa.array(c, t) for n, c, t in zip(_NAMES, columns, types, strict=True)})


def _merge(window: int):
    def merge(pieces: pa.Table) -> pa.Table:
        """Best fit of pieces, longest first; the pieces are those of one group."""
        kind = pieces.schema.field("doc_id").type
        rows = list(zip(*[pieces.column(n).to_pylist() for n in _NAMES], strict=True))
        rows.sort(key=lambda r: (-r[2], r[5], r[6]))
        windows, out = Windows(window, len(rows)), []
        number = min(r[7] for r in rows) << _PART | 1 << (_PART - 1)

        def emit(done: list) -> None:
            nonlocal number
            out.extend((*row[:5], number, offset, row[7], False) for row, offset in done)
            number += 1

        for row in rows:
            if (full := windows.put(windows.best(row[2]), row[2], row)) is not None:
                emit(full)
        while windows.windows:
            emit(windows.fullest())
        return _table(out, kind)

    return merge


def packed(
    docs: DataFrame,
    tokenizer: str,
    *,
    window: int = WINDOW,
    open_windows: int = OPEN,
    slack: int = SLACK,
    group: int = GROUP,
) -> DataFrame:
    """Pieces of all documents, placed in sequences of at most ``window`` ids.

    Output per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``.
    A document is the ids of its text and the end id. Documents longer than a window fill
    whole windows of their own, and the rest is placed like a short document. With
    ``open_windows`` windows open and none that a piece fits in, the fullest is emitted if it
    lacks at most ``slack`` ids, and else filled with the piece's head. Leftovers of
    ``group`` partitions are merged in one task, which holds ``group * open_windows``
    windows at most.

    - NULL and empty texts are the end id alone. NULL ids stay NULL.
    - Repeated rows are packed each; within the result their pieces look alike.
    - Other columns are ignored. An empty table gives an empty table.
    - A task that is run again makes the same sequences.
    """
    rows = docs.select("doc_id", text_of().alias("text"), F.spark_partition_id().alias("part"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = PIECE.format(id=kind)
    # Stored, as leftovers and full windows must come from one run of the packing.
    pieces = stored(rows.mapInArrow(_pack(tokenizer, window, open_windows, slack), schema), "pieces")
    left = pieces.filter("open")
    merged = left.groupBy(F.floor(F.col("part") / group).alias("_group")).applyInArrow(
        _merge(window), schema
    )
    return pieces.filter("not open").unionByName(merged).drop("part", "open")
