"""Suffix-array dedup: bytes of strings of ``LENGTH`` bytes that start at two places or more are removed.

Every string of ``length`` bytes is named by the least hash of the grams of ``length // 4`` bytes in it (its anchor, the
leftmost of equals), so equal strings meet under one anchor, at the same distance from it. Neighbouring strings of one
anchor make a *fragment*, under twice ``length`` long; equal fragments are one class. An enhanced suffix array over the
classes of an anchor (several anchors at a time) is scanned with a stack: it gives the tree of common-prefix intervals of
``length`` bytes or more, and those whose suffixes are preceded by unlike bytes (or by a fragment's edge) are the repeat
groups. An occurrence is listed under its longest group and a group names its parent, so all occurrences of a group are
those of its subtree, and the output grows with the occurrences, not with their pairs. A repeat longer than a fragment is
a chain of overlapping groups, which become one span of the document.

An anchor with over ``CLASSES`` unlike fragments (the edges of a passage that stands in very many texts) is not sorted in
one task: its strings meet under 128 bits of hash of the whole string instead, which is exact too and splits it evenly.

Null and empty texts have no bytes; texts shorter than ``length`` stay whole. Rows of equal doc_id and text are one document
and get the same answer; a null doc_id is an id like any other. Equal 128-bit hashes of fragments are taken as equal.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowsight.llm import text as T
from flowsight.session import broadcast_if_small, scratch_folder

LENGTH = 400
CLASSES = 1_000
BATCH_BYTES = 500_000
SLAB_BYTES = 400_000
_LOW32 = np.uint64(0xFFFFFFFF)
_SYMBOLS = 7

GROUPS = "f1 long, f2 long, at long, to long, repeat long, parent long, parent_length long"


def _sliding_least(keys: np.ndarray, width: int) -> np.ndarray:
    """Least of every ``width`` neighbours, from running minima within blocks of that width."""
    n = len(keys)
    blocks = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    blocks[:n] = keys
    blocks = blocks.reshape(-1, width)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: n - width + 1], left[width - 1 : n])


def _fragments(slab: T.Slab, length: int) -> tuple[np.ndarray, ...]:
    """Anchor hash, two fragment hashes, text, place and number of strings of every fragment."""
    gram, n = max(length // 4, 1), len(slab.data)
    if n < length:
        return tuple(np.zeros(0, np.int64) for _ in range(6))
    sums, more = T.byte_sums(slab.data), T.byte_sums(slab.data, True)
    place = np.arange(n - gram + 1)
    grams = T.span_hashes(sums, place, place + gram)
    anchors = (_sliding_least((grams & ~_LOW32) | place.astype(np.uint64), length - gram + 1) & _LOW32).astype(np.int64)
    text = np.repeat(np.arange(len(slab)), np.diff(slab.offsets))
    starts = np.flatnonzero(text[: n - length + 1] == text[length - 1 :])
    anchors = anchors[starts]
    first = np.flatnonzero(np.append(True, anchors[1:] != anchors[:-1])) if len(starts) else np.zeros(0, np.int64)
    strings = np.diff(np.append(first, len(starts)))
    at = starts[first]
    to = at + strings - 1 + length
    hashes = [grams[anchors[first]], T.span_hashes(sums, at, to), T.span_hashes(more, at, to)]
    return (*(x.view(np.int64) for x in hashes), text[at], at - slab.offsets[text[at]], strings)


def _sort(data: np.ndarray, offsets: np.ndarray, longest: int) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
    """Ranks of all suffixes (a fragment's end sorts before any byte) for each doubled depth, the last one final."""
    # seven symbols of nine bits; byte + 1, and 0 at the end of every fragment
    n = len(data) + len(offsets) - 1
    symbols = np.zeros(n + _SYMBOLS, np.int64)
    symbols[np.arange(len(data)) + np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))] = data.astype(np.int64) + 1
    keys = np.zeros(n, np.int64)
    for i in range(_SYMBOLS):
        keys = (keys << 9) | symbols[i : i + n]
    depth, levels = _SYMBOLS, []
    while True:
        order = np.argsort(keys)
        change = np.zeros(n, np.int64)
        change[1:] = keys[order][1:] != keys[order][:-1]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(change)
        levels.append((depth, rank.astype(np.int32)))
        if depth > longest or rank[order[-1]] == n - 1:
            return symbols, levels
        follow = np.zeros(n, np.int64)
        follow[: max(n - depth, 0)] = rank[depth:] + 1
        keys = rank * (n + 1) + follow
        depth *= 2


def _common(p: np.ndarray, q: np.ndarray, symbols: np.ndarray, levels: list[tuple[int, np.ndarray]]) -> np.ndarray:
    """Length of the common prefix of suffixes ``p`` and ``q``, from the deepest equal rank downwards."""
    p, q, n = p.copy(), q.copy(), len(symbols) - _SYMBOLS
    total = np.zeros(len(p), np.int64)
    for depth, rank in reversed(levels):
        inside = (p < n) & (q < n)
        same = inside & (rank[np.minimum(p, n - 1)] == rank[np.minimum(q, n - 1)])
        step = depth * same
        total, p, q = total + step, p + step, q + step
    going = np.ones(len(p), bool)
    for i in range(_SYMBOLS):
        going &= symbols[np.minimum(p + i, len(symbols) - 1)] == symbols[np.minimum(q + i, len(symbols) - 1)]
        total += going
    return total


def _next_free(free: list[int], i: int) -> int:
    while free[i] != i:
        free[i] = free[free[i]]
        i = free[i]
    return i


def _intervals(depths: list[int]) -> Iterator[tuple[int, int, int]]:
    """(left, right, depth) of the intervals of a block, children first; ``depths[i]`` joins suffixes i and i + 1."""
    stack = []
    for i, depth in enumerate([*depths, 0]):
        left = i
        while stack and stack[-1][1] > depth:
            left, d = stack.pop()
            yield left, i, d
        if depth and (not stack or stack[-1][1] < depth):
            stack.append((left, depth))


def _groups(data: np.ndarray, offsets: np.ndarray, repeated: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Fragment, start, end, group, parent and the parent's length of every occurrence, under its longest group."""
    sizes = np.diff(offsets)
    symbols, levels = _sort(data, offsets, int(sizes.max()))
    starts = offsets[:-1] + np.arange(len(sizes))
    owner = np.repeat(np.arange(len(sizes)), sizes - length + 1)
    places = np.concatenate([np.arange(s - length + 1) for s in sizes])
    suffix = starts[owner] + places
    order = np.argsort(levels[-1][1][suffix], kind="stable")
    owner, places, suffix = owner[order], places[order], suffix[order]
    left = sizes[owner] - places
    common = np.minimum(_common(suffix[:-1], suffix[1:], symbols, levels), np.minimum(left[:-1], left[1:]))
    edge, before = places == 0, symbols[suffix - 1]
    unlike = edge[:-1] | edge[1:] | (before[:-1] != before[1:])
    joined = common >= length
    diverse = np.concatenate([[0], np.cumsum(unlike & joined)])

    # the longest group of each suffix and the length of the group around it; a class of two or more is one by itself
    best = np.where(edge & repeated[owner], left, 0)
    above = np.zeros(len(suffix), np.int64)
    bounds = np.flatnonzero(np.diff(np.concatenate([[False], joined, [False]]).astype(np.int8)))
    firsts, lasts = bounds[::2], bounds[1::2]
    use = diverse[lasts] > diverse[firsts]
    for first, last in zip(firsts[use].tolist(), lasts[use].tolist(), strict=True):
        free = list(range(last - first + 2))
        inner: list[tuple[int, list[int]]] = []
        for lo, hi, depth in _intervals(common[first:last].tolist()):
            if diverse[first + hi] == diverse[first + lo]:
                continue
            # groups found within this one have it as parent
            while inner and inner[-1][0] >= lo:
                above[inner.pop()[1]] = depth
            mine, i = [], _next_free(free, lo)
            while i <= hi:
                at = first + i
                if best[at] > depth:
                    above[at] = depth
                else:
                    best[at] = depth
                    mine.append(at)
                free[i] = i + 1
                i = _next_free(free, i + 1)
            inner.append((lo, mine))
    found = np.flatnonzero(best)
    at, to, text = places[found], places[found] + best[found], owner[found]
    sums = T.byte_sums(data)
    begin = offsets[text] + at
    names = T.span_hashes(sums, begin, begin + best[found]).view(np.int64)
    parents = T.span_hashes(sums, begin, begin + above[found]).view(np.int64)
    return text, at, to, names, parents, above[found]


def _scan(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Groups of the fragments, sorted by (h, f1, f2); whole anchors are taken until there are enough bytes."""
    held: list[pa.RecordBatch] = []
    held_bytes = 0

    def answer(table: pa.Table) -> pa.RecordBatch:
        h, f1, f2 = (table.column(c).to_numpy() for c in ("h", "f1", "f2"))
        # repeated rows of one document bring a class twice
        new = np.append(True, (h[1:] != h[:-1]) | (f1[1:] != f1[:-1]) | (f2[1:] != f2[:-1]))
        table = table.filter(pa.array(new))
        body = table.column("body").combine_chunks().cast(pa.large_binary())
        offsets = np.frombuffer(body.buffers()[1], np.int64)[body.offset : body.offset + len(body) + 1]
        data = np.frombuffer(body.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
        repeated = table.column("repeated").to_numpy()
        text, *columns = _groups(data, offsets - offsets[0], repeated, length)
        keys = [table.column(c).combine_chunks().take(pa.array(text)) for c in ("f1", "f2")]
        return pa.RecordBatch.from_arrays(
            [*keys, *(pa.array(c) for c in columns)], ["f1", "f2", "at", "to", "repeat", "parent", "parent_length"]
        )

    def pieces(table: pa.Table) -> Iterator[pa.RecordBatch]:
        """Answers for runs of whole anchors of about ``BATCH_BYTES``: an Arrow batch may hold many of them."""
        h = table.column("h").to_numpy()
        edges = np.append(np.flatnonzero(np.append(True, h[1:] != h[:-1])), len(h))
        ends = np.cumsum(pa.compute.binary_length(table.column("body")).to_numpy().astype(np.int64))
        at = 0
        while at < len(h):
            to = np.searchsorted(ends, (ends[at - 1] if at else 0) + BATCH_BYTES)
            to = int(edges[min(np.searchsorted(edges, max(to, at + 1)), len(edges) - 1)])
            yield answer(table.slice(at, to - at))
            at = to

    with np.errstate(over="ignore"):
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            held_bytes += batch.nbytes
            if held_bytes < BATCH_BYTES:
                continue
            table = pa.Table.from_batches(held)
            h = table.column("h").to_numpy()
            cut = int(np.searchsorted(h, h[-1]))
            if cut:
                yield from pieces(table.slice(0, cut))
                # copied, so that the rows answered are let go
                held = table.slice(cut).take(pa.array(np.arange(len(h) - cut))).to_batches()
                held_bytes = sum(b.nbytes for b in held)
        if held:
            yield from pieces(pa.Table.from_batches(held))


def _strings(batch: pa.RecordBatch, length: int) -> Iterator[pa.RecordBatch]:
    """Every string of ``length`` bytes of a fragment, by 128 bits of hash."""
    for row in range(batch.num_rows):
        data = np.frombuffer(batch.column("body")[row].as_py(), np.uint8)
        at = np.arange(len(data) - length + 1)
        columns = [T.span_hashes(T.byte_sums(data, s), at, at + length).view(np.int64) for s in (False, True)]
        same = [pa.array([batch.column(c)[row].as_py()] * len(at), batch.column(c).type) for c in ("f1", "f2", "repeated")]
        arrays = [pa.array(c) for c in columns] + same + [pa.array(at)]
        yield pa.RecordBatch.from_arrays(arrays, ["w1", "w2", "f1", "f2", "repeated", "at"])


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    rows = T.id_and_text(docs, id_col, text_col).withColumn("text", F.coalesce("text", F.lit("")))
    return rows.withColumn("r", F.expr("xxhash64(doc_id, xxhash64(text))"))


def _found(docs: DataFrame, length: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Repeat groups of the fragment classes, and the places (f1, f2, r, place) of all fragments."""
    spark, folder = docs.sparkSession, scratch_folder(docs.sparkSession)

    def anchors(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        rows = batch.column("r").to_numpy(zero_copy_only=False)
        for start, _, slab in T.slabs(batch.column("text"), SLAB_BYTES):
            h, f1, f2, text, place, strings = _fragments(slab, length)
            columns = [h, f1, f2, rows[start + text], place, strings]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["h", "f1", "f2", "r", "place", "strings"])

    def bodies(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for row in range(batch.num_rows):
            wanted = batch.column("wanted")[row].values
            raw = batch.column("text")[row].as_py().encode()
            cuts = zip(wanted.field("place").to_pylist(), wanted.field("strings").to_pylist(), strict=True)
            body = pa.array([raw[p : p + n - 1 + length] for p, n in cuts], pa.binary())
            names = ["h", "f1", "f2", "repeated", "crowded"]
            yield pa.RecordBatch.from_arrays([*(wanted.field(n) for n in names), body], [*names, "body"])

    rows = _rows(docs, id_col, text_col)
    schema = "h long, f1 long, f2 long, r long, place long, strings long"
    T.map_batches(rows.select("r", "text"), anchors, schema).write.parquet(f"{folder}/places")
    places = spark.read.parquet(f"{folder}/places")
    # an anchor at one place alone holds no repeat; the places of the others are few
    spot = F.xxhash64("r", "place")
    several = places.groupBy("h").agg(F.min(spot).alias("one"), F.max(spot).alias("other")).where("one <> other")
    several.select("h").write.parquet(f"{folder}/several")
    several = spark.read.parquet(f"{folder}/several")
    # joined to a table and not grouped by h again, so that the join on a hot h can be split
    classes = places.join(several, "h").groupBy("f1", "f2").agg(
        F.first("h").alias("h"),
        F.min(F.struct("r", "place")).alias("one"), F.max(F.struct("r", "place")).alias("other"),
        F.first("strings").alias("strings"),
    ).selectExpr("h", "f1", "f2", "one.r", "one.place", "strings", "one <> other as repeated")
    classes.write.parquet(f"{folder}/classes")
    classes = spark.read.parquet(f"{folder}/classes")
    crowded = classes.groupBy("h").agg(F.count("*").alias("n")).where(f"n > {CLASSES}")
    crowded = broadcast_if_small(crowded.selectExpr("h", "true as crowded"))
    wanted = classes.join(crowded, "h", "left").groupBy("r").agg(
        F.collect_list(
            F.expr("struct(h, f1, f2, repeated, coalesce(crowded, false) as crowded, place, strings)")
        ).alias("wanted")
    )
    body_schema = "h long, f1 long, f2 long, repeated boolean, crowded boolean, body binary"
    T.map_batches(rows.select("r", "text").join(wanted, "r"), bodies, body_schema).write.parquet(f"{folder}/bodies")
    bodies_read = spark.read.parquet(f"{folder}/bodies")

    sorted_ = bodies_read.where("not crowded").drop("crowded").repartition("h").sortWithinPartitions("h", "f1", "f2")
    groups = sorted_.mapInArrow(lambda batches: _scan(batches, length), GROUPS)
    strings = T.map_batches(
        bodies_read.where("crowded"), lambda batch: _strings(batch, length),
        "w1 long, w2 long, f1 long, f2 long, repeated boolean, at long",
    )
    # within an anchor, one class holds a string once: two classes, or a repeated one, make a repeat
    twice = strings.groupBy("w1", "w2").agg(
        F.min(F.struct("f1", "f2")).alias("one"), F.max(F.struct("f1", "f2")).alias("other"), F.max("repeated").alias("any")
    ).where("one <> other or any").select("w1", "w2")
    rest = strings.join(twice, ["w1", "w2"]).selectExpr(
        "f1", "f2", "at", f"at + {length} as to", "w1 as repeat", "cast(0 as bigint) as parent", "cast(0 as bigint) as parent_length"
    )
    groups.union(rest).write.parquet(f"{folder}/groups")
    return spark.read.parquet(f"{folder}/groups"), places.select("f1", "f2", "r", "place")


def maximal_repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All occurrences of the repeat groups: repeat, parent, parent_length, doc_id, start, end (bytes, end exclusive).

    ``repeat`` is a hash of the repeated string. Each occurrence stands under its longest group; those of a parent are
    its own and, at the same starts, those of its children. A group without a parent has parent_length 0.
    """
    groups, places = _found(docs, length, id_col, text_col)
    ids = _rows(docs, id_col, text_col).select("r", "doc_id").distinct()
    found = groups.join(places, ["f1", "f2"]).join(ids, "r")
    return found.selectExpr(
        "repeat", "parent", "parent_length", "doc_id", "place + at as start", "place + to as end"
    ).distinct()


def _cut(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    spans = batch.column("spans")
    for start, to, slab in T.slabs(batch.column("text"), SLAB_BYTES):
        part = spans.slice(start, to - start)
        lengths = part.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        flat, base = part.flatten(), np.repeat(slab.offsets[:-1], lengths)
        steps = np.zeros(len(slab.data) + 1, np.int64)
        np.add.at(steps, flat.field("at").to_numpy(zero_copy_only=False) + base, 1)
        np.subtract.at(steps, flat.field("to").to_numpy(zero_copy_only=False) + base, 1)
        gone = np.cumsum(steps[:-1]) > 0
        heads = gone.copy()
        heads[1:] &= ~gone[:-1]
        inner = slab.offsets[:-1][slab.offsets[:-1] < len(gone)]
        heads[inner] = gone[inner]
        kept = [
            slab.data[a:b][~gone[a:b]].tobytes()
            for a, b in zip(slab.offsets[:-1].tolist(), slab.offsets[1:].tolist(), strict=True)
        ]
        columns = [batch.column("doc_id").slice(start, to - start), pa.array(np.diff(slab.offsets))]
        columns += [pa.array(T.counts_per_text(slab.offsets, x)) for x in (gone, heads)]
        columns.append(pa.array(kept, pa.binary()))
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])


def remove_repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_removed, n_spans and ``kept``, its remaining bytes."""
    groups, places = _found(docs, length, id_col, text_col)
    spans = groups.select("f1", "f2", "at", "to").join(places, ["f1", "f2"])
    spans = spans.groupBy("r").agg(F.collect_list(F.expr("struct(place + at as at, place + to as to)")).alias("spans"))
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"
    return T.map_batches(_rows(docs, id_col, text_col).join(spans, "r", "left").select("doc_id", "text", "spans"), _cut, schema)


def op8_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    found = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.selectExpr("doc_id", "n_bytes", "n_removed", "n_spans", "sha2(kept, 256) as kept_sha256")
