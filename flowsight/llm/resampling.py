"""Importance resampling of documents towards a target: hashed word n-grams, log-ratio gains, Gumbel top-k.

Words come from an untrained ``Split`` pre-tokeniser over ASCII-lowered text, which returns them with their offsets.
A feature is a window of 1 to 3 consecutive words, given as a pair of offsets (start of its first word, end of its
last); the crc32 of its bytes, words joined by one space, names its bucket. Bucket counts of both tables give a gain
per bucket, a document's weight is the sum of its gains, and the highest of weight plus noise are drawn.

Defined results: a null or empty text has no words, weight 0, and is never drawn; a document of fewer than
``MIN_WORDS`` words is scored but not drawn. Repeated rows are rows of their own: ties of score go to the smaller
doc_id (null last), then to the earlier row. Empty tables give empty results or gains of an empty side. Only the two
named columns of a table are read, so others cannot clash. A very long text is read in pieces that end between words.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowsight.llm import text as T
from flowsight.llm.ranks import with_rank
from flowsight.session import scratch_folder

BUCKETS = 10_000
LONGEST = 3
MIN_WORDS = 20
PERCENT = 5
SEED = 42
PIECE_BYTES = 1_000_000
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


@lru_cache(maxsize=1)
def splitter():
    """The pre-tokeniser of this Python worker: words between runs of ASCII characters that are no letter or digit."""
    from tokenizers import Regex
    from tokenizers.pre_tokenizers import Split

    return Split(Regex(GAP), "removed")


def _pieces(raw: bytes, limit: int) -> Iterator[bytes]:
    """``raw`` cut after a space or line end about every ``limit`` bytes, so no word is divided."""
    at = 0
    while len(raw) - at > limit:
        to = max(raw.rfind(b" ", at, at + limit), raw.rfind(b"\n", at, at + limit)) + 1
        if not to:
            later = [p for p in (raw.find(b" ", at + limit), raw.find(b"\n", at + limit)) if p >= 0]
            to = min(later) + 1 if later else len(raw)
        yield raw[at:to]
        at = to
    yield raw[at:]


def _windows(words: list[str], known: int, longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, memoryview]]:
    """Offset pairs (n, starts, ends) on the joined words of all windows that end behind the first ``known`` words."""
    line = " ".join(words).encode()
    gaps = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
    starts, ends = np.concatenate([[0], gaps + 1]), np.append(gaps, len(line))
    for n in range(1, longest + 1):
        first = max(0, known - n + 1)
        if len(words) >= first + n:
            yield n, starts[first : len(words) - n + 1], ends[first + n - 1 :], memoryview(line)


def text_buckets(raw: bytes, buckets: int, longest: int, limit: int = PIECE_BYTES) -> tuple[int, np.ndarray]:
    """Number of words and the bucket of every feature of one text."""
    found, carried, total = [], [], 0
    for piece in _pieces(raw, limit):
        words = [w for w, _ in splitter().pre_tokenize_str(piece.translate(_LOWER).decode())]
        total += len(words)
        known, words = len(carried), carried + words
        if not words:
            continue
        for _, starts, ends, line in _windows(words, known, longest):
            spans = map(slice, starts.tolist(), ends.tolist())
            found.append(np.fromiter(map(crc32, map(line.__getitem__, spans)), np.uint32, len(starts)) % buckets)
        carried = words[-(longest - 1) :] if longest > 1 else []
    return total, np.concatenate(found) if found else np.zeros(0, np.uint32)


def feature_windows(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS, longest: int = LONGEST
) -> DataFrame:
    """One row per feature: doc_id, n (words), start and end in the text (code points, end exclusive), bucket."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            lower = (text or "").encode().translate(_LOWER).decode()
            split = splitter().pre_tokenize_str(lower)
            if not split:
                continue
            places = np.array([at for _, at in split], np.int64)
            for n, starts, ends, line in _windows([w for w, _ in split], 0, longest):
                spans = map(slice, starts.tolist(), ends.tolist())
                bucket = np.fromiter(map(crc32, map(line.__getitem__, spans)), np.uint32, len(starts)) % buckets
                columns = [
                    pa.array([doc_id] * len(bucket), pa.int64()), pa.array(np.full(len(bucket), n, np.int32)),
                    pa.array(places[: len(bucket), 0]), pa.array(places[n - 1 :, 1]), pa.array(bucket.astype(np.int32)),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "start", "end", "bucket"])

    schema = "doc_id long, n int, start long, end long, bucket int"
    return T.map_batches(T.id_and_text(docs, id_col, text_col), run, schema)


def _code(buckets: int) -> type:
    return np.uint16 if buckets <= 1 << 16 else np.uint32


def hashed(docs: DataFrame, id_col: str, text_col: str, buckets: int = BUCKETS, longest: int = LONGEST) -> DataFrame:
    """doc_id, n_words and the buckets of all features (little-endian numbers in one binary) of every row."""
    code = _code(buckets)

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        texts = batch.column(1).cast(pa.large_binary())
        counts, packed = [], []
        for value in texts:
            n, found = text_buckets(value.as_py() or b"", buckets, longest)
            counts.append(n)
            packed.append(found.astype(code).tobytes())
        columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(packed, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "packed"])

    return T.map_batches(T.id_and_text(docs, id_col, text_col), run, "doc_id long, n_words long, packed binary")


def _flat(column: pa.Array, code: type) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of a binary column end to end, and where each row's begin (with the end)."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    width = np.dtype(code).itemsize
    return np.frombuffer(data[offsets[0] : offsets[-1]].tobytes(), code), (offsets - offsets[0]) // width


def bucket_counts(features: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Features per bucket over the whole table; every task adds its own up first, so ``buckets`` rows a task leave it."""
    code = _code(buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            total += np.bincount(_flat(batch.column(0), code)[0], minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["bucket", "n"])

    sums = features.select("packed").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    counts = np.zeros(buckets, np.int64)
    for bucket, n in sums.collect():  # at most ``buckets`` rows
        counts[bucket] = n
    return counts


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the smoothed log ratio of target to source share, rounded down, per bucket."""
    size = len(source)
    s_all, t_all = float(source.sum() + size), float(target.sum() + size)
    return np.array(
        [
            math.floor(1000 * math.log((t + 1.0) * s_all / ((s + 1.0) * t_all)))
            for s, t in zip(source.tolist(), target.tolist(), strict=True)
        ],
        np.int64,
    )


def noise(doc_id: int | None, seed: int) -> int:
    """Thousandths of a Gumbel draw set by the id alone, rounded down; a null id counts as the empty text."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(features: DataFrame, gains: np.ndarray, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight and score of every row."""
    code = _code(len(gains))

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        flat, offsets = _flat(batch.column(2), code)
        total = np.concatenate([[0], np.cumsum(gains[flat])])
        weight = total[offsets[1:]] - total[offsets[:-1]]
        extra = np.array([noise(i, seed) for i in batch.column(0).to_pylist()], np.int64)
        columns = [batch.column(0), batch.column(1), *map(pa.array, (np.diff(offsets), weight, weight + extra))]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_features", "weight", "score"])

    schema = "doc_id long, n_words long, n_features long, weight long, score long"
    return T.map_batches(features.select("doc_id", "n_words", "packed"), run, schema)


def resample(
    docs: DataFrame,
    target: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_text_col: str = "text",
    percent: int = PERCENT,
    min_words: int = MIN_WORDS,
    buckets: int = BUCKETS,
    longest: int = LONGEST,
    seed: int = SEED,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_features, weight, score and rank (null unless drawn).

    Texts are read once: the buckets of their features are written as two bytes each, counted, and summed from there.
    """
    spark = docs.sparkSession
    folder = scratch_folder(spark)
    hashed(docs, id_col, text_col, buckets, longest).write.parquet(f"{folder}/features")
    features = spark.read.parquet(f"{folder}/features")
    wanted = hashed(target.withColumn("_none", F.lit(None).cast("long")), "_none", target_text_col, buckets, longest)
    gains = bucket_gains(bucket_counts(features, buckets), bucket_counts(wanted, buckets))
    rows = scored(features, gains, seed).withColumn("row", F.monotonically_increasing_id())
    rows.write.parquet(f"{folder}/scored")
    rows = spark.read.parquet(f"{folder}/scored")
    able = rows.where(F.col("n_words") >= min_words)
    drawn = able.count() * percent // 100
    placed = with_rank(able, [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("row")])
    placed = placed.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    rest = rows.where(F.col("n_words") < min_words).withColumn("rank", F.lit(None).cast("long"))
    return placed.unionByName(rest).select("doc_id", "n_features", "weight", "score", "rank")


def op11_resampling(spark, sf_dir: str) -> DataFrame:
    return resample(
        spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    )
