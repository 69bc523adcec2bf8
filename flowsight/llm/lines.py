"""Line dedup by an exact set-similarity join: later lines whose words are alike to 0.8 or more go.

A line is the set of its words. Each word has a rank by its frequency over all documents, counted in a table of fixed
size; two sets of Jaccard 0.8 share a word among the rarest of each (the prefix). Sets meet under their prefix words; a
pair is a candidate only if lengths, positions and sketches leave room for the overlap, and its whole sets are compared.

A sketch has a bit for every 256th, 128th or 64th of all hashes, set if the set has an odd number of words there: bits that
differ are words that are not shared. Sets carry their place in the order of lines as one number and no words but the
prefix; under their words they meet packed, and the words of the sets in a candidate pair are split from the texts again.

First each set is tried against the first one under each of its words, which settles groups of near copies with one
link a line; the rest is then tried against all earlier sets. A very frequent word is cut into pairs of parts.

Lines are separated by ``\\n``. Every line with a word is compared, unless a greater ``min_words`` spares lines of fewer
distinct words: up to three words 0.8 means equal sets, which one grouping by set_id finds without the join. "Earlier" is by doc_id
(null first), then the hash of the text, then the line number. Rows of equal doc_id and text are one document and
get the same answer. Null text has no lines and stays null. Sets are judged on the input, not on what is left.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowsight.llm import text as T
from flowsight.llm.runs import SAMPLE, pack, unpack
from flowsight.session import at_most, broadcast_if_small, scratch_folder, shuffles_dropped

MIN_WORDS = 1
# sets of fewer words are alike only if equal
JOIN_WORDS = 4
COUNTERS = 1 << 20
# texts split at once: the arrays over them take about 50 times as much
BYTES = 500_000
# the counters travel in so many parts
_PARTS = 16
WORD_ROWS = 20_000
# heads of one task: some where there are few, and so many that a task holds them easily; packed at once
FEW_HEADS, TASK_HEADS, PACK_HEADS = 4_000, 250_000, 500_000
# sets whose texts are found by a broadcast
WANTED_ROWS = 300_000
ORDER = ["doc_id", "k", "line"]
_KEYED = "doc_id long, k long, "
_SKETCH = 4
_HEAD = {"key": "u8", "set_id": "i8", "n": "u4", "pos": "u4", "settled": "?"} | {f"s{j}": "u8" for j in range(_SKETCH)}
_PAIR = "later long, earlier long"
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return T.id_and_text(docs, id_col, text_col).withColumn("k", F.expr("xxhash64(text)"))


def _word_ranks(rows: DataFrame) -> np.ndarray:
    """Places of ``COUNTERS`` hash classes by how often their words occur in all rows; 4 MB whatever the input."""

    def packed(total: np.ndarray, first: int = 0) -> pa.RecordBatch:
        parts = [pack([x]) for x in total]
        return pa.RecordBatch.from_arrays([pa.array(range(first, first + len(parts)), pa.int32()), pa.array(parts, pa.binary())], ["part", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS, np.int64)
        with np.errstate(over="ignore"):
            for batch in batches:
                for _, _, slab in T.slabs(batch.column(0), BYTES):
                    slab.split()
                    hashes = T.span_hashes(T.byte_sums(slab.data), slab.starts, slab.ends)
                    np.add.at(total, (hashes % np.uint64(COUNTERS)).astype(np.int64), 1)
        yield packed(total.reshape(_PARTS, -1))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, n in zip(batch.column("part").to_pylist(), batch.column("n").to_pylist(), strict=True):
                sums[part] = sums.get(part, 0) + unpack(n, ["i8"])[0]
        for part, n in sums.items():
            yield packed(n[None], part)

    sums = rows.select("text").mapInArrow(count, "part int, n binary").repartition("part")
    total = np.zeros((_PARTS, COUNTERS // _PARTS), np.int64)
    for r in sums.mapInArrow(add, "part int, n binary").collect():
        total[r["part"]] = unpack(r["n"], ["i8"])[0]
    ranks = np.empty(COUNTERS, np.int32)
    ranks[np.argsort(total.ravel(), kind="stable")] = np.arange(COUNTERS, dtype=np.int32)
    return ranks


def _line_sets(slab: T.Slab, ranks: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """Text, number within it, distinct words (hash, line) of the lines of a slab; lines sorted, words by line and rank."""
    slab.split()
    starts, _, text = slab.lines()
    number = np.arange(len(text)) - np.searchsorted(text, text)
    hashes = T.span_hashes(T.byte_sums(slab.data), slab.starts, slab.ends)
    # an empty line starts where the next text or line does: the last line that starts at or before a word holds it
    line = np.searchsorted(starts, slab.starts, "right") - 1
    rank = hashes >> np.uint64(44)
    if ranks is not None:
        rank = ranks[(hashes % np.uint64(COUNTERS)).astype(np.int64)].astype(np.uint64)
    # line, rank and bits of the hash as one number; words that only other bits tell apart are sorted by all
    few = hashes >> np.uint64(20 if ranks is None else 40) & np.uint64(0xFFFFFF)
    keys = line.astype(np.uint64) << np.uint64(44) | rank << np.uint64(24) | few
    order = np.argsort(keys)
    keys, sorted_hashes = keys[order], hashes[order]
    if len(text) >> 20 or np.any((keys[1:] == keys[:-1]) & (sorted_hashes[1:] != sorted_hashes[:-1])):
        order = np.lexsort((hashes, rank, line))
        sorted_hashes = hashes[order]
    hashes, line = sorted_hashes, line[order]
    new = np.ones(len(line), bool)
    new[1:] = (line[1:] != line[:-1]) | (hashes[1:] != hashes[:-1])
    return text, number, hashes[new], line[new]


def _width(n: np.ndarray) -> np.ndarray:
    """Numbers of 64 bits in the sketch of a set of ``n`` words: a fifth of the words differ in less than a third of the bits up to 500."""
    return np.where(n < 64, 1, np.where(n < 192, 2, _SKETCH))


def _bodies(hashes: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Sketch and prefix of each set of words (rarest first) as bytes; nothing for sets that are not joined."""
    n = np.diff(offsets)
    joined = n >= JOIN_WORDS
    width = np.where(joined, _width(n), 0)
    heads = np.where(joined, n - (4 * n + 4) // 5 + 1, 0)
    out_at = np.concatenate([[0], np.cumsum(width + heads)])
    out = np.zeros(out_at[-1], np.uint64)
    row = np.repeat(np.arange(len(n)), n)
    pos = np.arange(len(hashes)) - offsets[row]
    head = np.flatnonzero(pos < heads[row])
    out[(out_at[:-1] + width)[row[head]] + pos[head]] = hashes[head]
    bit = T.mix(hashes) >> np.uint64(56)
    slot, bit = (bit >> np.uint64(6)).astype(np.int64) & np.maximum(width - 1, 0)[row], np.uint64(1) << (bit & np.uint64(63))
    for j in range(int(width.max(initial=0))):
        odd = np.bitwise_xor.reduceat(np.where(slot == j, bit, np.uint64(0)), offsets[:-1])
        has = width > j
        out[out_at[:-1][has] + j] = odd[has]
    buffers = [None, pa.py_buffer((out_at * 8).astype(np.int32)), pa.py_buffer(out.tobytes())]
    return pa.Array.from_buffers(pa.binary(), len(n), buffers)


def line_sets(rows: DataFrame, ranks, min_words: int = MIN_WORDS) -> DataFrame:
    """Every line of ``min_words`` distinct words or more: doc_id, k, line, set_id, n, body (sketch and rarest words)."""

    def make(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids, texts, ks = (batch.column(n) for n in ("doc_id", "text", "k"))
        for at, _, slab in T.slabs(texts, BYTES):
            text, number, hashes, line = _line_sets(slab, ranks.value)
            sizes = np.bincount(line, minlength=len(text))
            use = sizes >= max(1, min_words)
            if not use.any():
                continue
            hashes = hashes[use[line]]
            offsets = np.concatenate([[0], np.cumsum(sizes[use])])
            # the mixed sum of its words names a set
            sums = np.concatenate([[np.uint64(0)], np.cumsum(T.mix(hashes + T.BASE), dtype=np.uint64)])
            names = T.mix(sums[offsets[1:]] - sums[offsets[:-1]] + sizes[use].astype(np.uint64))
            rows_at = pa.array(text[use] + at)
            columns = [ids.take(rows_at), ks.take(rows_at), pa.array(number[use]), pa.array(names.view(np.int64))]
            columns += [pa.array(sizes[use]), _bodies(hashes, offsets)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "k", "line", "set_id", "n", "body"])

    return T.map_batches(rows, make, _KEYED + "line long, set_id long, n long, body binary")


def _differ(table: dict, one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """How many bits of their sketches differ, the wider one folded to the narrower: no more than words they do not share."""
    s = [table[f"s{j}"][one] ^ table[f"s{j}"][other] for j in range(_SKETCH)]
    least = np.minimum(_width(table["n"][one]), _width(table["n"][other]))
    halves = np.bitwise_count(s[0] ^ s[2]).astype(np.int64) + np.bitwise_count(s[1] ^ s[3])
    whole = sum(np.bitwise_count(x).astype(np.int64) for x in s)
    folded = np.bitwise_count(s[0] ^ s[1] ^ s[2] ^ s[3])
    return np.where(least == 1, folded, np.where(least == 2, halves, whole))


def _room(table: dict, one: np.ndarray, other: np.ndarray, rarest: bool = False) -> np.ndarray:
    """Which pairs of rows have lengths and positions of the shared word that leave room for Jaccard 0.8.

    With ``rarest`` only if that word is the first they share. The table may have a map of the words or sketches too.
    """
    n, m = table["n"][one], table["n"][other]
    left = np.flatnonzero((5 * n >= 4 * m) & (5 * m >= 4 * n))
    one, other, n, m = one[left], other[left], n[left], m[left]
    i, j = table["pos"][one], table["pos"][other]
    most = np.minimum(n - i, m - j)
    if not rarest:
        most = most + np.minimum(i, j)
    ok = 9 * most >= 4 * (n + m)
    left, one, other, n, m = left[ok], one[ok], other[ok], n[ok], m[ok]
    if "bits" in table:
        # a bit of one set that the other lacks is a word that they do not share
        x, y = table["bits"][one].view(np.uint64), table["bits"][other].view(np.uint64)
        most = np.minimum(n - np.bitwise_count(x & ~y), m - np.bitwise_count(y & ~x))
        ok = 9 * most >= 4 * (n + m)
        left, one, other, n, m = left[ok], one[ok], other[ok], n[ok], m[ok]
    if "s0" in table:
        left = left[9 * _differ(table, one, other) <= n + m]
    return left


def _first_links(table: dict, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    later = np.flatnonzero(place)
    first = later - place[later]
    ok = _room(table, first, later)
    return table["set_id"][later[ok]], table["set_id"][first[ok]]


def _all_links(table: dict, place: np.ndarray, rarest: bool = False) -> tuple[np.ndarray, np.ndarray]:
    later, earlier = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    n, run = table["n"][: len(place)], np.cumsum(place == 0)
    # by length, so that each row meets those within a quarter of its own alone
    order = np.lexsort((n, run))
    rows, lag = np.arange(len(place)), 1
    while len(rows):
        # each row with the one that stands ``lag`` after it in its run
        rows = rows[: np.searchsorted(rows, len(place) - lag)]
        one, other = order[rows], order[rows + lag]
        near = (run[one] == run[other]) & (4 * n[other] <= 5 * n[one])
        rows, one, other = rows[near], one[near], other[near]
        last, first = np.maximum(one, other), np.minimum(one, other)
        open_ = ~table["settled"][last]
        last, first = last[open_], first[open_]
        ok = _room(table, first, last, rarest)
        later.append(table["set_id"][last[ok]])
        earlier.append(table["set_id"][first[ok]])
        lag += 1
    return np.concatenate(later), np.concatenate(earlier)


def _unfolded(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """Sketches of the sets of a batch; word, row and position of their heads."""
    body = batch.column("body").cast(pa.large_binary())
    at = np.frombuffer(body.buffers()[1], np.int64)[body.offset : body.offset + len(body) + 1] // 8
    data = np.frombuffer(body.buffers()[2], np.uint8)[: at[-1] * 8].view(np.uint64)
    width = _width(batch.column("n").to_numpy())
    sketch = np.zeros((_SKETCH, len(body)), np.uint64)
    for j in range(_SKETCH):
        sketch[j, width > j] = data[at[:-1][width > j] + j]
    heads = np.diff(at) - width
    row = np.repeat(np.arange(len(body)), heads)
    pos = np.arange(len(row)) - np.repeat(np.cumsum(heads) - heads, heads)
    return sketch, data[(at[:-1] + width)[row] + pos], row, pos


def _hot(sets: DataFrame, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Words of more than ``limit`` heads, sorted, and in how many parts each is cut; by a sample, which decides nothing else."""

    def sample(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        if batch.num_rows:
            _, word, row, _ = _unfolded(batch)
            ids = batch.column("id").to_numpy().view(np.uint64)
            drawn = word[T.mix(word ^ T.mix(ids + T.BASE)[row]) < np.uint64(int(SAMPLE * 2**64))]
            yield pa.RecordBatch.from_arrays([pa.array(drawn.view(np.int64))], ["word"])

    words = T.map_batches(sets, sample, "word long").groupBy("word").count().where(F.col("count") > limit * SAMPLE)
    found = words.collect()
    found = np.array([(r["word"], -(-r["count"] // (limit * SAMPLE))) for r in found], np.int64).reshape(-1, 2)
    word, parts = found[:, 0].copy().view(np.uint64), found[:, 1]
    order = np.argsort(word)
    return word[order], parts[order]


def _dealt(word: np.ndarray, ids: np.ndarray, hot: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Which head and under which key: any two heads of one word meet under some key, those of hot words under pairs of parts."""
    words, parts = hot
    times = np.ones(len(word), np.int64)
    if len(words):
        at = np.minimum(np.searchsorted(words, word), len(words) - 1)
        times = np.where(words[at] == word, parts[at], 1)
    head = np.repeat(np.arange(len(word)), times)
    other = np.arange(len(head)) - np.repeat(np.cumsum(times) - times, times)
    part = (T.mix(ids[head].view(np.uint64) + T.BASE) % times[head].astype(np.uint64)).astype(np.int64)
    cell = np.minimum(part, other) << 32 | np.maximum(part, other)
    return head, T.mix(word[head] + T.mix(cell.astype(np.uint64) + T.BASE))


def _links(sets: DataFrame, hot, buckets: int, find: Callable[..., tuple]) -> DataFrame:
    """Candidate pairs (later, earlier) among ``sets``: id, n, body, settled. Heads travel sorted and packed by bucket of keys."""

    def packed(held: list[tuple]) -> pa.RecordBatch:
        ids, n, settled = (np.concatenate([h[0][c] for h in held]) for c in range(3))
        sketch = np.concatenate([h[1] for h in held], axis=1)
        key, pos = (np.concatenate([h[c] for h in held]) for c in (2, 4))
        before = np.cumsum([0, *(len(h[0][0]) for h in held)])
        row = np.concatenate([h[3] + b for h, b in zip(held, before[:-1], strict=True)])
        order = np.argsort(key)
        key, pos, row = key[order], pos[order], row[order]
        bucket = ((key >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int32)
        cut = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
        out = []
        for a, b in zip(cut, np.append(cut[1:], len(key)), strict=True):
            r = row[a:b]
            # 48 bits of a key; keys that are the same in these only meet for nothing
            columns = [key[a:b] >> np.uint64(16), ids[r], n[r], pos[a:b], settled[r], *(x[r] for x in sketch)]
            out.append(pack([c.astype(kind) for c, kind in zip(columns, _HEAD.values(), strict=True)]))
        return pa.RecordBatch.from_arrays([pa.array(bucket[cut]), pa.array(out, pa.binary())], ["bucket", "heads"])

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        with np.errstate(over="ignore"):
            for batch in batches:
                if not batch.num_rows:
                    continue
                sketch, word, row, pos = _unfolded(batch)
                own = tuple(batch.column(c).to_numpy(zero_copy_only=False) for c in ("id", "n", "settled"))
                head, key = _dealt(word, own[0][row], hot.value)
                held.append((own, sketch, key, row[head], pos[head]))
                size += len(head)
                if size >= PACK_HEADS:
                    yield packed(held)
                    held, size = [], 0
            if size:
                yield packed(held)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [unpack(x, list(_HEAD.values())) for batch in batches for x in batch.column("heads").to_pylist()]
        if not parts:
            return
        table = {c: np.concatenate([p[i] for p in parts]) for i, c in enumerate(_HEAD)}
        parts.clear()
        order = np.lexsort((table["set_id"], table["key"]))
        table = {c: v[order].astype(np.int64) if c in ("n", "pos") else v[order] for c, v in table.items()}
        at = np.flatnonzero(np.append(True, table["key"][1:] != table["key"][:-1]))
        found = find(table, np.arange(len(order)) - np.repeat(at, np.diff(np.append(at, len(order)))))
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in found], ["later", "earlier"])

    met = sets.mapInArrow(heads, "bucket int, heads binary").repartitionById(buckets, F.col("bucket"))
    return met.select("heads").mapInArrow(meet, _PAIR)


def _words(rows: DataFrame, sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """(set_id, words) of the sets in ``pairs``, split from the texts of their lines."""
    ids = pairs.selectExpr("later as id").union(pairs.selectExpr("earlier as id")).distinct()
    small = at_most(ids, WANTED_ROWS)
    wanted = sets.select("id", *ORDER).join(F.broadcast(ids) if small else ids, "id", "left_semi")
    wanted = wanted.groupBy("doc_id", "k").agg(F.collect_list(F.struct("line", "id")).alias("wanted"))
    texts = rows.alias("r").join((F.broadcast(wanted) if small else wanted).alias("w"), F.expr("r.doc_id <=> w.doc_id and r.k = w.k"))

    def split(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        lists = batch.column("wanted")
        offsets, values = lists.offsets.to_numpy(), lists.values
        numbers, ids = (values.field(c).to_numpy() for c in ("line", "id"))
        for at, to, slab in T.slabs(batch.column("text"), BYTES):
            text, _, hashes, line = _line_sets(slab)
            ends = np.concatenate([[0], np.cumsum(np.bincount(line, minlength=len(text)))])
            here = slice(offsets[at], offsets[to])
            lines = np.repeat(np.searchsorted(text, np.arange(to - at)), np.diff(offsets[at : to + 1])) + numbers[here]
            sizes = ends[lines + 1] - ends[lines]
            cuts = np.concatenate([[0], np.cumsum(sizes)])
            picked = np.repeat(ends[lines] - cuts[:-1], sizes) + np.arange(cuts[-1])
            words = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(hashes[picked].view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(ids[here]), words], ["set_id", "words"])

    found = T.map_batches(texts.select("r.text", "w.wanted"), split, "set_id long, words array<long>")
    # rows that come twice give their words twice
    return found.groupBy("set_id").agg(F.first("words").alias("words"))


def _alike(pairs: DataFrame, sets: DataFrame, folder: str) -> DataFrame:
    """Sets of ``pairs(later, earlier)`` whose words are alike."""
    pairs.where("later <> earlier").distinct().write.parquet(folder)
    both = sets.sparkSession.read.parquet(folder)
    # most sets are in no pair: their words stay where they are
    paired = both.selectExpr("later as set_id").union(both.selectExpr("earlier as set_id")).distinct()
    words = sets.select("set_id", "words").join(broadcast_if_small(paired), "set_id", "left_semi")
    both = both.join(words.select(F.col("set_id").alias("later"), F.col("words").alias("x")), "later")
    both = both.join(words.select(F.col("set_id").alias("earlier"), F.col("words").alias("y")), "earlier")
    return both.where("9 * size(array_intersect(x, y)) >= 4 * (size(x) + size(y))").select(F.col("later").alias("set_id")).distinct()


def _kept_lines(docs: DataFrame, id_col: str, text_col: str, min_words: int) -> DataFrame:
    """(doc_id, k, kept): the numbers of the compared lines that stay."""
    spark, folder = docs.sparkSession, scratch_folder(docs.sparkSession)
    with shuffles_dropped(spark):
        return _judged(_keyed(docs, id_col, text_col), folder, min_words)


def _judged(rows: DataFrame, folder: str, min_words: int) -> DataFrame:
    spark = rows.sparkSession
    ranks = spark.sparkContext.broadcast(_word_ranks(rows))

    def written(df: DataFrame, name: str) -> DataFrame:
        # words come again and again, which the default codec does not find
        df.write.option("compression", "zstd").parquet(f"{folder}/{name}")
        return spark.read.parquet(f"{folder}/{name}")

    # one row per distinct set, at its first line; ids follow the order of these lines
    sets = line_sets(rows, ranks, min_words).groupBy("set_id").agg(
        F.min(F.struct(*ORDER)).alias("at"), F.first("n").alias("n"), F.first("body").alias("body")
    )
    sets = sets.select("at.*", "n", "body").orderBy(*ORDER).withColumn("id", F.monotonically_increasing_id())
    sets = written(sets, "sets")

    joined = sets.where(f"n >= {JOIN_WORDS}").select("id", "n", "body")
    heads = joined.agg(F.sum(F.expr("n div 5 + 1"))).first()[0] or 0
    shuffles = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(1, min(shuffles, heads // FEW_HEADS), heads // TASK_HEADS)
    hot = spark.sparkContext.broadcast(_hot(joined, WORD_ROWS))

    def alike(marked: DataFrame, find: Callable[..., tuple], name: str) -> DataFrame:
        pairs = written(_links(marked, hot, buckets, find).distinct(), f"{name}-found")
        words = written(_words(rows, sets, pairs), f"{name}-words")
        return written(_alike(pairs, words, f"{folder}/{name}-pairs"), name)

    settled = alike(joined.withColumn("settled", F.lit(False)), _first_links, "first")
    marked = joined.join(broadcast_if_small(settled.select(F.col("set_id").alias("id"), F.lit(True).alias("settled"))), "id", "left")
    marked = marked.withColumn("settled", F.coalesce("settled", F.lit(False)))
    rest = alike(marked.select(*joined.columns, "settled"), partial(_all_links, rarest=True), "rest")
    gone = settled.union(rest).withColumnRenamed("set_id", "id")
    kept = sets.select("id", *ORDER).join(gone, "id", "left_anti")
    return kept.groupBy("doc_id", "k").agg(F.collect_list("line").alias("kept"))


def _apply(texts: pa.Array, kept: pa.Array, min_words: int) -> pa.Array:
    out = []
    for text, stay in zip(texts.to_pylist(), kept.to_pylist(), strict=True):
        if text is None:
            out.append((None, 0, 0))
            continue
        stay = set(stay or ())
        lines = text.split("\n")
        left = [x for i, x in enumerate(lines) if i in stay or len({*_WORD.findall(x)}) < max(1, min_words)]
        out.append(("\n".join(left), len(lines), len(lines) - len(left)))
    columns = [pa.array([x[i] for x in out], kind) for i, kind in enumerate((pa.string(), pa.int64(), pa.int64()))]
    return pa.StructArray.from_arrays(columns, ["text", "n_lines", "n_removed"])


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` as a struct ``row`` with its new ``text``, ``n_lines`` and ``n_removed`` in a struct ``lines``."""

    def apply(texts, kept):
        # some rows at a time become Python objects
        return pa.concat_arrays([_apply(texts[i : i + 256], kept[i : i + 256], min_words) for i in range(0, max(1, len(texts)), 256)])

    apply.__annotations__ = {"texts": pa.Array, "kept": pa.Array, "return": pa.Array}
    # a filter on its result must not run it again, in two more workers of each task
    cut = F.arrow_udf(apply, "text string, n_lines long, n_removed long").asNondeterministic()
    body, key = F.col(f"`{text_col}`").cast("string"), F.col(f"`{id_col}`").cast("long")
    rows = docs.select(F.struct("*").alias("row"), key.alias("doc_id"), F.xxhash64(body).alias("k"))
    found = rows.alias("d").join(
        _kept_lines(docs, id_col, text_col, min_words).alias("s"), F.expr("d.doc_id <=> s.doc_id and d.k = s.k"), "left"
    )
    # the text that stands in the row is the only one that is shuffled
    return found.select("row", cut(F.col(f"row.`{text_col}`").cast("string"), F.col("kept")).alias("lines"))


def replace_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with the remaining lines as text; a row that loses its every word goes, others stay."""
    found = dedup_lines(docs, id_col, text_col, min_words)
    found = found.where(r"lines.n_removed = 0 or regexp_like(lines.text, '[^\\x20\\x09-\\x0D]')")
    same = [F.col(f"row.`{c}`").alias(c) for c in docs.columns]
    at = docs.columns.index(text_col)
    same[at] = F.col("lines.text").alias(text_col)
    return found.select(*same)


def op10_line_dedup(spark, sf_dir: str) -> DataFrame:
    found = dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"), min_words=1)
    return found.selectExpr(
        "row.doc_id", "lines.n_lines", "lines.n_removed", "sha2(coalesce(lines.text, ''), 256) as kept_sha256"
    )
