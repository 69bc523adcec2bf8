"""SimHash near-duplicates: segment popcounts place fingerprints in a grid, Manhattan distance bounds, bits decide.

A fingerprint's 32 segments of two bits become their bit counts. The Manhattan distance of two such vectors is never
above the Hamming distance, so with at most 4 differing bits at least 4 of 8 groups of segments have equal counts: the
pair shares one of the 70 grid cells spanned by 4 groups. Within a cell a component grows from each member over those not
yet reached, so a dense group costs about its size and gives at most its size in links.

Null and empty texts have fingerprint zero. Rows of one doc_id are separate rows; a null doc_id is in a component, but
names it only if no member has an id.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowsight.llm import text as T
from flowsight.llm.runs import connected, map_runs, split_hot
from flowsight.session import scratch_folder

SHINGLE = 4
SEED = 42
MAX_BITS = 4
CELL_ROWS = 5_000
_LOW = np.uint64(0x5555555555555555)
_ONE = np.uint64(1)
_SIDES = [np.array(c) for c in combinations(range(8), 4)]


def shingle_hashes(slab: T.Slab, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of a slab, and how many each text has."""
    from xxhash import xxh64_intdigest

    slab.split()
    data, lengths = T.ascii_lower(slab.data), slab.ends - slab.starts
    # words of the slab with one space after each
    at = np.cumsum(lengths + 1) - lengths - 1
    joined = np.full(int(lengths.sum()) + len(lengths), 32, np.uint8)
    kept = data[~T.SPACE[data]]
    joined[np.arange(len(kept)) + np.repeat(np.arange(len(lengths)), lengths)] = kept
    buffer, stops = joined.tobytes(), at + lengths

    words = np.diff(slab.first)
    counts = np.where(words >= size, words - size + 1, np.minimum(words, 1))
    offsets = np.concatenate([[0], np.cumsum(counts)])
    heads = np.arange(offsets[-1]) - np.repeat(offsets[:-1] - slab.first[:-1], counts)
    tails = heads + np.repeat(np.minimum(words, size) - 1, counts)
    spans = zip(at[heads].tolist(), stops[tails].tolist(), strict=True)
    return np.fromiter((xxh64_intdigest(buffer[s:e], SEED) for s, e in spans), np.uint64, len(heads)), counts


def majority(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The fingerprint of every text: bits set in over half of its hashes."""
    offsets = np.concatenate([[0], np.cumsum(counts)])
    out = np.zeros(len(counts), np.uint64)
    for bit in range(64):
        ones = T.counts_per_text(offsets, (hashes >> np.uint64(bit)) & _ONE)
        out |= (2 * ones > counts).astype(np.uint64) << np.uint64(bit)
    return out.view(np.int64)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint) of every row; the fingerprint is a signed long."""

    def make(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for at, to, slab in T.slabs(batch.column(1)):
            columns = [batch.column(0).slice(at, to - at), pa.array(majority(*shingle_hashes(slab, SHINGLE)))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "fingerprint"])

    return T.map_batches(T.id_and_text(docs, id_col, text_col), make, "doc_id long, fingerprint long")


def segment_counts(prints: np.ndarray) -> np.ndarray:
    """Bit counts of the two-bit segments in unary, so that differing bits add up to the Manhattan distance."""
    some = (prints | (prints >> _ONE)) & _LOW
    both = prints & (prints >> _ONE) & _LOW
    return some | (both << _ONE)


def _cells(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    prints = batch.column(0).to_numpy(zero_copy_only=False)
    step = 20_000
    for i in range(0, len(prints), step):
        part = prints[i : i + step]
        groups = segment_counts(part.view(np.uint64)).view(np.uint8).reshape(-1, 8).astype(np.int64)
        keys = [
            (n << 32) | (groups[:, s[0]] << 24) | (groups[:, s[1]] << 16) | (groups[:, s[2]] << 8) | groups[:, s[3]]
            for n, s in enumerate(_SIDES)
        ]
        columns = [pa.array(np.concatenate(keys)), pa.array(np.tile(part, len(_SIDES)))]
        yield pa.RecordBatch.from_arrays(columns, ["cell", "fingerprint"])


def _links(table: dict, at: int, to: int) -> tuple[np.ndarray, np.ndarray]:
    """A tree of links for each component within one cell."""
    prints = np.unique(table["fingerprint"][at:to].view(np.uint64))
    bounds = segment_counts(prints)
    left, heads, tails = np.arange(len(prints)), [], []
    while len(left):
        front, left = [left[0]], left[1:]
        while front and len(left):
            x = front.pop()
            near = np.bitwise_count(bounds[left] ^ bounds[x]) <= MAX_BITS
            near[near] = np.bitwise_count(prints[left[near]] ^ prints[x]) <= MAX_BITS
            new, left = left[near], left[~near]
            heads.append(np.full(len(new), prints[x]))
            tails.append(prints[new])
            front.extend(new.tolist())
    if not heads:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(heads).view(np.int64), np.concatenate(tails).view(np.int64)


def components(prints: DataFrame) -> DataFrame:
    """Adds ``component_id``, the least doc_id reachable, to every row of ``prints(doc_id, fingerprint)``."""
    groups = prints.groupBy("fingerprint").agg(F.min("doc_id").alias("least"))
    cells = T.map_batches(groups.select("fingerprint"), _cells, "cell long, fingerprint long")
    cells = split_hot(cells, "cell", "fingerprint", CELL_ROWS)
    links = map_runs(cells, ["cell", "a", "b"], [], _links, "a long, b long")
    tied = connected(links)
    ids = groups.join(tied.withColumnRenamed("node", "fingerprint"), "fingerprint", "left")
    ids = ids.select("fingerprint", "least", F.coalesce("root", "fingerprint").alias("root"))
    names = ids.groupBy("root").agg(F.min("least").alias("component_id"))
    return prints.join(ids.join(names, "root").select("fingerprint", "component_id"), "fingerprint")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (16 hex digits) and component_id."""
    spark, folder = docs.sparkSession, scratch_folder(docs.sparkSession)
    fingerprints(docs, id_col, text_col).write.parquet(f"{folder}/prints")
    found = components(spark.read.parquet(f"{folder}/prints"))
    return found.selectExpr("doc_id", "lpad(lower(hex(fingerprint)), 16, '0') as fingerprint", "component_id")


def one_of_each(docs: DataFrame, group, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of ``group(rows(n, text), folder) -> (n, component_id)``: that of the least id, null ids
    last; of equal ids, any one row."""
    spark, folder = docs.sparkSession, scratch_folder(docs.sparkSession)
    # ids may be null or repeated, so rows are told apart by a number that is written once
    docs.select(F.struct("*").alias("row"), F.monotonically_increasing_id().alias("n")).write.parquet(f"{folder}/rows")
    rows = spark.read.parquet(f"{folder}/rows")
    own, body = F.col(f"row.`{id_col}`").cast("long"), F.col(f"row.`{text_col}`")
    found = group(rows.select("n", body.alias("text")), folder)
    places = found.join(rows.select("n", own.alias("id")), "n")
    stays = places.groupBy("component_id").agg(F.min(F.struct(F.expr("id is null as absent"), "id", "n")).alias("least"))
    return rows.join(stays.selectExpr("least.n as n"), "n", "left_semi").select("row.*")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component of fingerprints, chosen as in ``one_of_each``."""

    def group(rows: DataFrame, folder: str) -> DataFrame:
        fingerprints(rows, "n").write.parquet(f"{folder}/prints")
        found = components(rows.sparkSession.read.parquet(f"{folder}/prints"))
        return found.selectExpr("doc_id as n", "component_id")

    return one_of_each(docs, group, id_col, text_col)


def op5_simhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
