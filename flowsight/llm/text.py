"""Numpy helpers over Arrow text batches: words, lines, span hashes and repeats, without Python objects per word.

A *slab* is a run of whole texts laid end to end as UTF-8 bytes. All helpers work on byte positions of a slab, so a
task holds a few numpy arrays over a few MB, whatever the length of the table; a single longer text makes its own slab.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SLAB_BYTES = 2_000_000
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))

# words are runs of anything but \x20 and \x09-\x0D
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_FLIP = np.arange(256, dtype=np.uint8)
_FLIP[65:91] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: spreads every input bit over the word."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * BASE)
_BYTE2 = mix(_BYTE + BASE)


class _Powers:
    """Powers of the hash base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, 2 * len(self.up))
            with np.errstate(over="ignore"):
                self.up = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, BASE)]).astype(np.uint64))
                self.down = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, _INVERSE)]).astype(np.uint64))
        return self.up, self.down


_POWERS = _Powers()


def prefix_sums(values: np.ndarray) -> np.ndarray:
    """``S`` with ``S[i] = sum(values[j] * BASE**j for j < i)`` modulo 2**64."""
    up, _ = _POWERS.get(len(values) + 1)
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=out[1:])
    return out


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of every span; equal contents hash alike wherever they stand."""
    _, down = _POWERS.get(len(sums) + 1)
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def byte_sums(data: np.ndarray, second: bool = False) -> np.ndarray:
    return prefix_sums((_BYTE2 if second else _BYTE)[data])


def ascii_lower(data: np.ndarray) -> np.ndarray:
    return _FLIP[data]


class Slab:
    """Whole texts end to end: ``data`` bytes, ``offsets`` of the texts, and their words."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray) -> None:
        self.data, self.offsets = data, offsets.astype(np.int64)

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def split(self, space: np.ndarray = SPACE) -> None:
        """Sets word starts and ends, the text of each word and the first word of each text."""
        n = len(self.data)
        edge = np.zeros(n + 1, bool)
        edge[self.offsets] = True
        blank = space[self.data]
        before = np.ones(n, bool)
        before[1:] = blank[:-1]
        self.starts = np.flatnonzero(~blank & (before | edge[:n]))
        after = np.ones(n, bool)
        after[:-1] = blank[1:]
        self.ends = np.flatnonzero(~blank & (after | edge[1:])) + 1
        self.first = np.searchsorted(self.starts, self.offsets)
        self.text_of = np.repeat(np.arange(len(self)), np.diff(self.first))

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        r"""Starts, ends and texts of the ``\n``-split lines; every text has one line at least."""
        cuts = np.flatnonzero(self.data == 10)
        starts = np.concatenate([self.offsets[:-1], cuts + 1])
        ends_text = np.concatenate([np.arange(len(self)), np.searchsorted(self.offsets, cuts, "right") - 1])
        order = np.lexsort((starts, ends_text))
        starts, text = starts[order], ends_text[order]
        ends = np.empty_like(starts)
        ends[:-1] = starts[1:] - 1
        last = np.flatnonzero(np.append(text[1:] != text[:-1], True))
        ends[last] = self.offsets[1:][text[last]]
        return starts, ends, text


def slabs(column: pa.Array, limit: int = SLAB_BYTES) -> Iterator[tuple[int, int, Slab]]:
    """Runs of texts of about ``limit`` bytes, as (first row, last row + 1, slab); null is the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield at, to, Slab(data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at])
        at = to


def counts_per_text(offsets: np.ndarray, flags: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def repeats(hashes: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each hash: whether its group holds it twice or more, and whether it stood there earlier."""
    if not len(hashes):
        return np.zeros(0, bool), np.zeros(0, bool)
    keys = mix(hashes + mix(group.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(keys, kind="stable")
    same = np.zeros(len(keys) + 1, bool)
    same[1:-1] = keys[order][1:] == keys[order][:-1]
    later, twice = np.empty(len(keys), bool), np.empty(len(keys), bool)
    later[order] = same[:-1]
    twice[order] = same[:-1] | same[1:]
    return twice, later


def covered(flags: np.ndarray, length: int, size: int) -> np.ndarray:
    """Which of ``size`` units lie in a flagged window of ``length`` units (window ``i`` starts at unit ``i``)."""
    at = np.flatnonzero(flags)
    steps = np.zeros(size + 1, np.int64)
    steps[at] += 1
    np.subtract.at(steps, np.minimum(at + length, size), 1)
    return np.cumsum(steps[:size]) > 0


def windows(slab: Slab, word_hashes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts (word numbers in the slab) and hashes of all windows of ``length`` words within one text."""
    n = len(word_hashes)
    at = np.arange(max(0, n - length + 1))
    if len(at):
        at = at[slab.text_of[at] == slab.text_of[at + length - 1]]
    return at, span_hashes(prefix_sums(word_hashes), at, at + length)


def map_batches(df: DataFrame, make: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` over batches; ``make`` turns one batch into any number of batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in batches:
                yield from make(batch)

    return df.mapInArrow(run, schema)


def id_and_text(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the two columns an operator reads, renamed so that nothing else in the table can clash."""
    return df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
