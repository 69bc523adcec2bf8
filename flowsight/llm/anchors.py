"""Substring dedup by fixed-block anchors: words of passages that stand earlier elsewhere are removed.

Equal texts are first reduced to the one of least doc_id. The non-overlapping blocks of ``BLOCK`` words of every text are
the index and every rolling window of ``BLOCK`` words probes it. A window of ``WINDOW`` words holds a whole block
wherever it stands, so every repeat leaves a hit at both of its places. Hits are extended to all windows of ``WINDOW``
words around them; of equal windows (128 bits of hash over 64-bit word hashes) all but the earliest are removed, and
together they are the maximal repeats. Runs of equal window hashes are read as a stream, however long they are.

Texts are shuffled once, by row, and that shuffle is read three times. Blocks meet packed: the blocks of a slab that
share a bucket are one row, each by ``_NAME`` bytes of its hash and its step from the block before it; what shares a
bucket and those bytes by chance is only a hit more, whose windows are told apart by 128 bits. The hits go back to their
slab, whose list of texts turns them into places.

Earlier is by doc_id (null last), then the hash of the text, then the place. Rows of equal doc_id and text are one
document and get the same answer. Null and empty texts have no words.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowsight.llm import text as T
from flowsight.session import scratch_folder

WINDOW = 20
BLOCK = 10
BUCKETS = 2048
_NAME = 4
_PHASE = 40
_PROBES = "bucket int, slab long, names binary, near binary, far binary, rows array<long>, first array<long>"
_HITS = "slab long, places array<int>, rows array<long>, first array<long>"


def _word_hashes(slab: T.Slab, second: bool = False) -> np.ndarray:
    slab.split()
    return T.span_hashes(T.byte_sums(slab.data, second), slab.starts, slab.ends)


def _lists(values: np.ndarray, edges: np.ndarray, kind: pa.DataType = pa.int64()) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(values, kind))


def _bytes(values: np.ndarray, edges: np.ndarray) -> pa.Array:
    """Rows ``edges[i] : edges[i + 1]`` of ``values`` as bytes, one string each."""
    offsets = (edges * values.shape[1]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(edges) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(values.tobytes())])


def _once(df: DataFrame, make: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``make`` over the rows of ``df``, sorted by ``r``, without those that come again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        with np.errstate(over="ignore"):
            for batch in batches:
                r = batch.column("r").to_numpy(zero_copy_only=False)
                if not len(r):
                    continue
                new = np.append(r[0] != last, r[1:] != r[:-1])
                last = r[-1]
                yield from make(batch if new.all() else batch.filter(pa.array(new)))

    return df.mapInArrow(run, schema)


def _probes(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Every rolling block, a row for each bucket of a slab; and a row with the texts of the slab."""
    rows = batch.column("r").to_numpy(zero_copy_only=False)
    for start, to, slab in T.slabs(batch.column("text")):
        at, hashes = T.windows(slab, _word_hashes(slab), BLOCK)
        if not len(at):
            continue
        rolling = (at - slab.first[slab.text_of[at]]) % BLOCK != 0
        buckets = (hashes % np.uint64(BUCKETS)).astype(np.int16)
        order = np.argsort(buckets, kind="stable")
        buckets, number = buckets[order], (at << 1 | rolling)[order]
        heads = np.flatnonzero(np.append(True, buckets[1:] != buckets[:-1]))
        edges, n = np.append(heads, len(buckets)), len(heads)
        steps = np.diff(number, prepend=0)
        steps[heads] = number[heads]
        names = (hashes[order] >> np.uint64(64 - 8 * _NAME)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :_NAME]
        near, far = ((steps >> s & 0xFFFF).astype("<u2").view(np.uint8).reshape(-1, 2) for s in (0, 16))
        own = rows[start:to]
        # the same texts in the same order make the same name, however often a task is run
        name = int(T.mix(np.sum(T.mix(own.view(np.uint64) + np.arange(len(own), dtype=np.uint64) * T.BASE))).view(np.int64))
        columns = [pa.array(buckets[heads].astype(np.int32)), pa.array(np.full(n, name))]
        columns += [_bytes(x, edges) for x in (names, near, far)] + [pa.nulls(n, pa.list_(pa.int64()))] * 2
        yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in _PROBES.split(", ")])
        columns = [pa.array([name % BUCKETS], pa.int32()), pa.array([name])] + [pa.nulls(1, pa.binary())] * 3
        columns += [_lists(x, np.array([0, len(x)])) for x in (own, slab.first)]
        yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in _PROBES.split(", ")])


def _hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of runs of equal hash that hold two rows and an index block; only one row waits between batches."""
    held, indexed = None, False
    for batch in batches:
        hashes, r, at = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        n = len(hashes)
        if not n:
            continue
        follows = held is not None and hashes[0] == held[0]
        edges = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1], [True]]))
        sizes = np.diff(edges)
        block = (at[edges[:-1]] >> _PHASE) == 0
        many = sizes > 1
        if follows:
            block[0], many[0] = indexed, True
        keep = np.repeat(block & many, sizes)
        out_r, out_at = r[keep], at[keep]
        if follows and indexed and held[1] is not None:
            out_r, out_at = np.append(out_r, held[1]), np.append(out_at, held[2])
        indexed = bool(block[-1])
        waits = sizes[-1] == 1 and not (follows and len(sizes) == 1)
        held = (hashes[-1], r[-1], at[-1]) if waits else (hashes[-1], None, None)
        place = out_at & ((1 << _PHASE) - 1)
        yield pa.RecordBatch.from_arrays([pa.array(out_r), pa.array(place)], ["r", "place"])


def _raw(column: pa.Array, width: int) -> np.ndarray:
    """The bytes of all strings of a column, in rows of ``width``."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].reshape(-1, width)


def _met(table: pa.Table) -> Iterator[pa.RecordBatch]:
    """The hits of whole buckets, a row for each slab; the rows with the texts of a slab are passed on."""
    names = [c.split()[0] for c in _HITS.split(", ")]
    texts = table.filter(table.column("rows").is_valid()).combine_chunks().to_batches()
    for batch in texts:
        columns = [batch.column("slab"), pa.nulls(batch.num_rows, pa.list_(pa.int32())), batch.column("rows"), batch.column("first")]
        yield pa.RecordBatch.from_arrays(columns, names)
    table = table.filter(table.column("names").is_valid()).combine_chunks()
    if not table.num_rows:
        return
    parts = [_raw(table.column(c).combine_chunks(), w) for c, w in (("names", _NAME), ("near", 2), ("far", 2))]
    sizes = pa.compute.binary_length(table.column("near")).to_numpy().astype(np.int64) // 2
    steps = parts[1].view("<u2")[:, 0].astype(np.int64) | parts[2].view("<u2")[:, 0].astype(np.int64) << 16
    total = np.cumsum(steps)
    heads = np.cumsum(sizes) - sizes
    number = total - np.repeat(total[heads] - steps[heads], sizes)
    name = np.zeros((len(number), 8), np.uint8)
    name[:, :_NAME] = parts[0]
    name = name.view("<i8")[:, 0] | np.repeat(table.column("bucket").to_numpy().astype(np.int64), sizes) << 8 * _NAME
    order = np.argsort(name << 1 | number & 1)
    row = np.repeat(np.arange(len(sizes)), sizes)[order]
    number = number[order]
    columns = [name[order], row, (number & 1) << _PHASE | number >> 1]
    found = next(_hits(iter([pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["hash", "r", "at"])])))
    row, place = (c.to_numpy() for c in found.columns)
    slab = table.column("slab").to_numpy()[row]
    order = np.argsort(slab, kind="stable")
    slab, place = slab[order], place[order]
    heads = np.flatnonzero(np.append(True, slab[1:] != slab[:-1])) if len(slab) else np.zeros(0, np.int64)
    none = pa.nulls(len(heads), pa.list_(pa.int64()))
    yield pa.RecordBatch.from_arrays([pa.array(slab[heads]), _lists(place, np.append(heads, len(slab)), pa.int32()), none, none], names)


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hits of the probes, sorted by bucket; the last bucket of a batch waits for the next one."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        bucket = batch.column("bucket").to_numpy()
        cut = int(np.searchsorted(bucket, bucket[-1]))
        if cut or held and held[-1].column("bucket")[0].as_py() != bucket[-1]:
            yield from _met(pa.Table.from_batches([*held, batch.slice(0, cut)]))
            held = []
        held.append(batch.slice(cut))
    if held:
        yield from _met(pa.Table.from_batches(held))


def _places(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The hits of each text, from those of its slab."""
    for i in range(batch.num_rows):
        place, rows, first = (batch.column(c)[i].values.to_numpy(zero_copy_only=False) for c in ("places", "rows", "first"))
        place = np.sort(place).astype(np.int64)
        text = np.searchsorted(first[:-1], place, "right") - 1
        heads = np.flatnonzero(np.append(True, text[1:] != text[:-1])) if len(text) else np.zeros(0, np.int64)
        columns = [pa.array(rows[text[heads]]), _lists(place - first[text], np.append(heads, len(text)))]
        yield pa.RecordBatch.from_arrays(columns, ["r", "places"])


def _candidates(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Windows around the hits of each text, with 128 bits of hash; ``place`` is inverted if the slab holds an earlier one."""
    places, ids, ks = (batch.column(c) for c in ("places", "doc_id", "k1"))
    r = batch.column("r").to_numpy(zero_copy_only=False)
    for start, to, slab in T.slabs(batch.column("text")):
        first, second = _word_hashes(slab), _word_hashes(slab, True)
        part = places.slice(start, to - start)
        text = np.repeat(np.arange(to - start), part.value_lengths().to_numpy(zero_copy_only=False))
        hit = part.flatten().to_numpy(zero_copy_only=False) + slab.first[text]
        near = np.zeros(len(first) + 1, np.int64)
        np.add.at(near, np.maximum(hit - (WINDOW - BLOCK), slab.first[text]), 1)
        np.add.at(near, hit + 1, -1)
        at, low = T.windows(slab, first, WINDOW)
        _, high = T.windows(slab, second, WINDOW)
        use = np.cumsum(near)[at] > 0
        at, low, high = at[use], low[use].view(np.int64), high[use].view(np.int64)
        text = slab.text_of[at]
        own, k = ids.slice(start, to - start), ks.slice(start, to - start).to_numpy(zero_copy_only=False)
        rank = np.empty(to - start, np.int64)
        numbers = own.fill_null(0).to_numpy(zero_copy_only=False)
        rank[np.lexsort((k, numbers, own.is_null().to_numpy(zero_copy_only=False)))] = np.arange(to - start)
        order = np.lexsort((at, rank[text], high, low))
        known = np.zeros(len(at), bool)
        known[order[1:]] = (low[order][1:] == low[order][:-1]) & (high[order][1:] == high[order][:-1])
        place = at - slab.first[text]
        # windows known to be later need not meet the others, so a frequent one sends a row from each slab
        low, high, place = np.where(known, r[start + text], low), np.where(known, 0, high), np.where(known, ~place, place)
        rows = pa.array(text)
        columns = [pa.array(low), pa.array(high), own.take(rows), pa.array(k[text]), pa.array(place)]
        yield pa.RecordBatch.from_arrays(columns, ["low", "high", "doc_id", "k1", "place"])


def _later(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All rows but the first of each run of equal (low, high), and those known to be later."""
    last = None
    for batch in batches:
        place = batch.column("place").to_numpy(zero_copy_only=False)
        known = pa.array(place < 0)
        found = batch.select(["doc_id", "k1"]).filter(known)
        yield pa.RecordBatch.from_arrays([*found.columns, pa.array(~place[place < 0])], ["doc_id", "k1", "place"])
        batch = batch.filter(pa.array(place >= 0))
        low, high = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(2))
        if not len(low):
            continue
        same = np.zeros(len(low), bool)
        same[1:] = (low[1:] == low[:-1]) & (high[1:] == high[:-1])
        same[0] = last == (low[0], high[0])
        last = (low[-1], high[-1])
        yield batch.select(["doc_id", "k1", "place"]).filter(pa.array(same))


def _cut(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    places = batch.column("places")
    for start, to, slab in T.slabs(batch.column("text")):
        slab.split()
        n = len(slab.starts)
        part = places.slice(start, to - start)
        lengths = part.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        flags = np.zeros(n, bool)
        flags[part.flatten().to_numpy(zero_copy_only=False) + np.repeat(slab.first[:-1], lengths)] = True
        gone = T.covered(flags, WINDOW, n)
        kept = []
        for t in range(to - start):
            a, b = slab.first[t], slab.first[t + 1]
            spans = zip(slab.starts[a:b][~gone[a:b]].tolist(), slab.ends[a:b][~gone[a:b]].tolist(), strict=True)
            kept.append(b" ".join([slab.data[s:e].tobytes() for s, e in spans]).decode())
        columns = [batch.column(c).slice(start, to - start) for c in ("doc_id", "copy")]
        columns += [pa.array(np.diff(slab.first)), pa.array(T.counts_per_text(slab.first, gone)), pa.array(kept)]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "copy", "n_words", "n_removed", "kept"])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_removed and ``kept``, its remaining words joined by one space."""
    spark, folder = docs.sparkSession, scratch_folder(docs.sparkSession)
    rows = T.id_and_text(docs, id_col, text_col).withColumn("text", F.coalesce("text", F.lit("")))
    rows = rows.selectExpr("*", "xxhash64(text) as k1", "xxhash64(concat('#', text)) as k2")
    rows = rows.withColumn("r", F.xxhash64("doc_id", "k1"))
    least = rows.groupBy("k1", "k2").agg(F.min("doc_id").alias("least"))
    copies = rows.select("doc_id", "k1", "k2", "r").join(least, ["k1", "k2"]).where("not (doc_id <=> least)")
    copies.select("r").distinct().write.parquet(f"{folder}/copies")
    copies = spark.read.parquet(f"{folder}/copies").withColumn("copy", F.lit(True))

    # every step reads all these columns, so that Spark finds one shuffle for the three
    texts = rows.select("r", "doc_id", "k1", "text").repartition("r")
    firsts = texts.join(copies, "r", "left").where("copy is null").sortWithinPartitions("r")
    probes = _once(firsts, _probes, _PROBES).repartition("bucket").sortWithinPartitions("bucket")
    hits = probes.mapInArrow(_meet, _HITS).groupBy("slab").agg(
        F.flatten(F.collect_list("places")).alias("places"), F.first("rows", True).alias("rows"), F.first("first", True).alias("first")
    )
    hits = T.map_batches(hits, _places, "r long, places array<long>")
    windows = _once(
        texts.join(hits, "r").sortWithinPartitions("r"),
        _candidates,
        "low long, high long, doc_id long, k1 long, place long",
    )
    order = [F.col("low"), F.col("high"), F.asc_nulls_last("doc_id"), F.col("k1"), F.col("place")]
    later = windows.repartition("low", "high").sortWithinPartitions(*order)
    later = later.mapInArrow(_later, "doc_id long, k1 long, place long").withColumn("r", F.xxhash64("doc_id", "k1"))
    later = later.groupBy("r").agg(F.collect_list("place").alias("places"))
    schema = "doc_id long, copy boolean, n_words long, n_removed long, kept string"
    cut = T.map_batches(texts.join(later, "r", "left").join(copies, "r", "left"), _cut, schema)
    copy = F.expr(f"copy and n_words >= {WINDOW}")
    return cut.select(
        "doc_id",
        "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.col("n_removed")).alias("n_removed"),
        F.when(copy, F.lit("")).otherwise(F.col("kept")).alias("kept"),
    )


def op4_substring_dedup(spark, sf_dir: str) -> DataFrame:
    found = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.selectExpr("doc_id", "n_words", "n_removed", "sha2(kept, 256) as kept_sha256")
