"""Sum-of-squares packing: each piece goes to the fill level that keeps the squared level counts least.

Every task packs the rows of its own partition, so nothing is shuffled; a sequence never spans two partitions. At its
end the open windows are settled: pieces of the emptiest are cut into the gaps of the fullest, and the last window is
dealt into sequences whose lengths are powers of two, so no sequence needs padding. A task that holds ``OPEN`` open
windows settles them at once. Null and empty texts are one end id. Null doc_ids and repeated rows are packed like any other row.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from flowsight.llm import text as T
from flowsight.llm.vocabulary import default_path, unit_encoder

WINDOW = 1024
END_ID = 0
SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
)
# sequences of one partition are numbered from partition * NUMBERS
NUMBERS = 1 << 40
# open windows that a task holds at most, 4 KB each
OPEN = 4096
# texts encoded at once: the encoder's arrays take about 100 times as much
BYTES = 400_000


class Levels:
    """Open windows by fill level; ``counts[h]`` is how many stand at level ``h``."""

    def __init__(self, window: int = WINDOW) -> None:
        self.window = window
        self.counts = np.zeros(window + 1, np.int64)
        self.open: list[list[int]] = [[] for _ in range(window + 1)]
        self.numbers = 0

    def place(self, size: int) -> tuple[int, int]:
        """(sequence, offset) of a piece of at most one window; the least fill level wins ties, a new window last."""
        levels = np.flatnonzero(self.counts[: self.window - size + 1])
        best, cost = 0, 2 * self.counts[size] + 1 if size < self.window else 0
        if len(levels):
            to = levels + size
            # leaving level h and reaching level h + size changes the sum of squares by this much
            change = -2 * self.counts[levels] + 1 + np.where(to < self.window, 2 * self.counts[to] + 1, 0)
            least = int(np.argmin(change))
            if change[least] <= cost:
                best = int(levels[least])
        if best:
            sequence = self.open[best].pop()
            self.counts[best] -= 1
        else:
            sequence, self.numbers = self.numbers, self.numbers + 1
        if best + size < self.window:
            self.open[best + size].append(sequence)
            self.counts[best + size] += 1
        return sequence, best

    def restart(self, fill: int) -> int:
        """Forgets all open windows but a new one that holds ``fill`` ids (0: none), whose number is returned."""
        self.counts[:] = 0
        self.open = [[] for _ in range(self.window + 1)]
        sequence, self.numbers = self.numbers, self.numbers + 1
        if fill:
            self.open[fill].append(sequence)
            self.counts[fill] = 1
        return sequence


@dataclass(frozen=True)
class Piece:
    """Part of a document: its row and number of ids, the first id's place in it, the ids."""

    doc_id: int | None
    doc_tokens: int
    start: int
    ids: np.ndarray

    def cut(self, size: int) -> tuple[Piece, Piece]:
        """The first ``size`` ids and the rest."""
        return replace(self, ids=self.ids[:size]), replace(self, start=self.start + size, ids=self.ids[size:])


def _fill(pieces: list[Piece]) -> int:
    return sum(len(p.ids) for p in pieces)


def _take(pieces: list[Piece], size: int) -> list[Piece]:
    """Takes ``size`` ids off the end of ``pieces``."""
    taken = []
    while size:
        last = pieces.pop()
        if len(last.ids) > size:
            rest, last = last.cut(len(last.ids) - size)
            pieces.append(rest)
        taken.append(last)
        size -= len(last.ids)
    return taken


def settle(windows: list[list[Piece]], window: int = WINDOW) -> tuple[list[list[Piece]], list[Piece]]:
    """Full windows made of the ids of open ones, and the pieces that are left, fewer ids than one window."""
    windows = sorted(windows, key=_fill)
    full = []
    while len(windows) > 1:
        gap = window - _fill(windows[-1])
        while gap and len(windows) > 1:
            size = min(gap, _fill(windows[0]))
            windows[-1].extend(_take(windows[0], size))
            gap -= size
            if not windows[0]:
                windows.pop(0)
        if not gap:
            full.append(windows.pop())
    return full, windows[0] if windows else []


def powers(pieces: list[Piece]) -> Iterator[list[Piece]]:
    """``pieces`` in sequences whose lengths are different powers of two."""
    size = _fill(pieces)
    for bit in range(size.bit_length()):
        if size >> bit & 1:
            yield _take(pieces, 1 << bit)


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """One row per piece. Full windows of a long document stand alone; what is left over is placed by level."""
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        levels, tokens = Levels(), unit_encoder(path)
        base = TaskContext.get().partitionId() * NUMBERS
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        held: dict[int, list[Piece]] = {}
        rows: list[tuple] = []

        def emit(sequence: int, pieces: list[Piece]) -> None:
            offset = 0
            for p in pieces:
                crc = zlib.crc32(p.ids)
                rows.append((p.doc_id, p.start, len(p.ids), crc, p.doc_tokens, base + sequence, offset))
                offset += len(p.ids)

        def settled() -> list[Piece]:
            full, left = settle(list(held.values()))
            held.clear()
            for pieces in full:
                emit(levels.numbers, pieces)
                levels.numbers += 1
            return left

        def add(doc: int | None, ids: np.ndarray) -> None:
            for start in range(0, len(ids), WINDOW):
                piece = Piece(doc, len(ids), start, ids[start : start + WINDOW].copy())
                sequence, offset = levels.place(len(piece.ids))
                pieces = held.setdefault(sequence, [])
                pieces.append(piece)
                if offset + len(piece.ids) == WINDOW:
                    emit(sequence, held.pop(sequence))
            if len(held) >= OPEN:
                left = settled()
                sequence = levels.restart(_fill(left))
                if left:
                    held[sequence] = left

        def answer() -> Iterator[pa.RecordBatch]:
            if rows:
                columns = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)]
                rows.clear()
                yield pa.RecordBatch.from_arrays(columns, names)

        for batch in batches:
            docs_here = batch.column(0).to_pylist()
            for at, to, slab in T.slabs(batch.column(1), BYTES):
                ids, first = tokens.encode(slab.data, slab.offsets)
                for doc, a, b in zip(docs_here[at:to], first[:-1].tolist(), first[1:].tolist(), strict=True):
                    add(doc, np.append(ids[a:b], np.uint32(END_ID)).astype("<u4"))
            yield from answer()
        for pieces in powers(settled()):
            emit(levels.numbers, pieces)
            levels.numbers += 1
        yield from answer()

    return T.id_and_text(docs, id_col, text_col).mapInArrow(run, SCHEMA)


def op6_packing(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
