"""Document quality by a regularised quadratic discriminant over transformed document statistics.

Each text gives a few counts (numpy over Arrow batches), each count a smoothed share or logarithm, so that the
statistics of a short text stay near the middle. Per class, Spark adds up the moments of the labelled training rows;
the class covariance is shrunk towards the pooled one and towards a multiple of the identity, and its Cholesky factor
is kept. A score is the logistic of the difference of the two log densities (Mahalanobis distance, determinant, prior).

Defined results: a null or empty text is scored like any text, from its zero counts. Repeated rows are rows of their
own. Rows of the label table that repeat an id with the same label count once; an id with both labels trains neither. A
null id is held out by no rule, is not labelled, and is scored. Training with fewer than ``MIN_ROWS`` rows of a class
fails with a message; an empty document table gives no rows. Only the named columns are read, so others cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowsight.llm import text as T
from flowsight.session import scratch_folder

LIMIT = 0.3
FOLDS = 5
# share of a class covariance that is replaced by the pooled one, then by its mean variance
POOLED, ROUND = 0.1, 0.02
MIN_ROWS = 3

STATISTICS = [
    "log_words", "log_word_length", "upper", "digits", "symbols", "marks", "bars", "word_marks",
    "repeated_words", "same_neighbours", "repeated_pairs", "repeated_lines", "log_line_words", "short_lines",
]

_CODES = np.arange(256)
_UPPER = (_CODES >= 65) & (_CODES <= 90)
_LETTER = _UPPER | ((_CODES >= 97) & (_CODES <= 122)) | (_CODES >= 128)
_DIGIT = (_CODES >= 48) & (_CODES <= 57)
_SYMBOL = np.isin(_CODES, [ord(c) for c in "#*$%&@^~=+_<>\\/[]{}"])
_MARK = np.isin(_CODES, [ord(c) for c in "!?"])
_BAR = _CODES == ord("|")
_ODD = ~_LETTER & ~_DIGIT & ~np.isin(_CODES, [ord(c) for c in ".,;:'\"-()"]) & ~T.SPACE


def _share(part: np.ndarray, whole: np.ndarray, usual: float, weight: float) -> np.ndarray:
    """Log odds of a share, as if ``weight`` more units of the ``usual`` share had been seen."""
    p = (part + usual * weight) / (whole + weight)
    return np.log(p) - np.log1p(-p)


def _statistics(slab: T.Slab) -> np.ndarray:
    """One row of ``STATISTICS`` per text of the slab."""
    slab.split()
    data, size = slab.data, len(slab)
    heads = (data & 0xC0) != 0x80
    chars = heads & ~T.SPACE[data]
    per_text = lambda flags: T.counts_per_text(slab.offsets, flags).astype(float)
    n_chars, n_words = per_text(chars), np.diff(slab.first).astype(float)
    letters = per_text(heads & _LETTER[data])

    sums = T.byte_sums(T.ascii_lower(data))
    hashes = T.span_hashes(sums, slab.starts, slab.ends)
    _, again = T.repeats(hashes, slab.text_of)
    same = np.zeros(len(hashes), bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (slab.text_of[1:] == slab.text_of[:-1])
    at, pairs = T.windows(slab, hashes, 2)
    _, pair_again = T.repeats(pairs, slab.text_of[at])
    pairs_again = np.bincount(slab.text_of[at[pair_again]], minlength=size).astype(float)
    last = np.zeros(len(hashes), bool)
    last[:] = _ODD[data[slab.ends - 1]] if len(hashes) else False

    starts, ends, text = slab.lines()
    char_sums = np.concatenate([[0], np.cumsum(chars)])
    filled = char_sums[ends] > char_sums[starts]
    starts, ends, text = starts[filled], ends[filled], text[filled]
    _, line_again = T.repeats(T.span_hashes(sums, starts, ends), text)
    line_chars = char_sums[ends] - char_sums[starts]
    n_lines = np.bincount(text, minlength=size).astype(float)

    count = lambda flags: T.counts_per_text(slab.first, flags).astype(float)
    return np.column_stack([
        np.log1p(n_words),
        np.log((n_chars + 50.0) / (n_words + 10.0)),
        _share(per_text(_UPPER[data]), letters, 0.03, 60.0),
        _share(per_text(_DIGIT[data]), n_chars, 0.005, 100.0),
        _share(per_text(_SYMBOL[data]), n_chars, 0.002, 100.0),
        _share(per_text(_MARK[data]), n_chars, 0.002, 100.0),
        _share(per_text(_BAR[data]), n_chars, 0.002, 100.0),
        _share(count(last), n_words, 0.01, 20.0),
        _share(count(again), n_words, 0.2, 20.0),
        _share(count(same), n_words, 0.005, 20.0),
        _share(pairs_again, n_words, 0.02, 20.0),
        _share(np.bincount(text[line_again], line_chars[line_again], size), n_chars, 0.01, 100.0),
        np.log((n_words + 30.0) / (n_lines + 2.0)),
        _share(np.bincount(text[line_chars < 20], minlength=size).astype(float), n_lines, 0.1, 5.0),
    ])


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ``STATISTICS`` (doubles) of every row of ``docs``; each row is read alone, nothing is shuffled."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for at, to, slab in T.slabs(batch.column(1)):
            values = _statistics(slab)
            columns = [batch.column(0).slice(at, to - at), *(pa.array(np.ascontiguousarray(c)) for c in values.T)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", *STATISTICS])

    schema = ", ".join(["doc_id long", *(f"{c} double" for c in STATISTICS)])
    return T.map_batches(T.id_and_text(docs, id_col, text_col), run, schema)


@dataclass
class Discriminant:
    """Two Gaussian classes (0 and 1): means, Cholesky factors of their covariances and logs of their weights."""

    means: np.ndarray
    factors: np.ndarray
    offsets: np.ndarray

    def densities(self, rows: np.ndarray) -> np.ndarray:
        """Log density plus log prior of every row in each class, but for a constant they share."""
        out = []
        for mean, factor, offset in zip(self.means, self.factors, self.offsets, strict=True):
            z = np.linalg.solve(factor, (rows - mean).T)
            out.append(offset - np.log(np.diag(factor)).sum() - 0.5 * (z * z).sum(0))
        return np.column_stack(out)

    def scores(self, rows: np.ndarray) -> np.ndarray:
        """Chance of class 1, from 0 to 1."""
        d = self.densities(rows)
        gap = np.clip(d[:, 0] - d[:, 1], -700, 700)
        return 1.0 / (1.0 + np.exp(gap))


def moments(rows: DataFrame, label: str = "label") -> dict[int, tuple[int, np.ndarray, np.ndarray]]:
    """Per class: rows, sums and sums of products of ``STATISTICS``; each task adds up its own, a few numbers leave it."""
    k = len(STATISTICS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 1 + k + k * k))
        for batch in batches:
            x = np.column_stack([batch.column(i).to_numpy() for i in range(k)])
            y = batch.column(k).to_numpy()
            for c in (0, 1):
                some = x[y == c]
                total[c] += np.concatenate([[len(some)], some.sum(0), (some.T @ some).ravel()])
        n = total.shape[1]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat([0, 1], n)), pa.array(np.tile(np.arange(n), 2)), pa.array(total.ravel())],
            ["label", "place", "total"],
        )

    chosen = rows.select(*STATISTICS, F.col(label).cast("long").alias("label"))
    sums = chosen.mapInArrow(run, "label long, place long, total double").groupBy("label", "place").agg(F.sum("total"))
    table = np.zeros((2, 1 + k + k * k))
    for c, place, total in sums.collect():  # two rows of fixed width
        table[c, place] = total
    return {c: (int(table[c, 0]), table[c, 1 : 1 + k], table[c, 1 + k :].reshape(k, k)) for c in (0, 1)}


def fit(found: dict[int, tuple[int, np.ndarray, np.ndarray]], pooled: float = POOLED, rounding: float = ROUND) -> Discriminant:
    """The discriminant of the given moments, its covariances shrunk by ``pooled`` and ``rounding``."""
    for c, (n, _, _) in found.items():
        if n < MIN_ROWS:
            raise ValueError(f"{n} labelled training rows of class {c}; {MIN_ROWS} are needed")
    rows = np.array([found[c][0] for c in (0, 1)], float)
    means = np.array([found[c][1] / found[c][0] for c in (0, 1)])
    spreads = np.array([found[c][2] / found[c][0] - np.outer(means[c], means[c]) for c in (0, 1)])
    common = (rows[:, None, None] * spreads).sum(0) / rows.sum()
    # variances on the scale of the pooled spread, so that shrinking treats all statistics alike
    scale = np.sqrt(np.maximum(np.diag(common), 1e-6))
    units = np.outer(scale, scale)
    factors = []
    for spread in spreads:
        mixed = ((1 - pooled) * spread + pooled * common) / units
        mixed = (1 - rounding) * mixed + rounding * max(np.trace(mixed) / len(scale), 0.1) * np.eye(len(scale))
        factors.append(np.linalg.cholesky(mixed * units))
    return Discriminant(means, np.array(factors), np.log(rows / rows.sum()))


def with_scores(rows: DataFrame, model: Discriminant, limit: float = LIMIT) -> DataFrame:
    """``doc_id``, score and predicted of every row of statistics."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        x = np.column_stack([batch.column(i + 1).to_numpy() for i in range(len(STATISTICS))])
        score = model.scores(x)
        columns = [batch.column(0), pa.array(score), pa.array((score >= limit).astype(np.int32))]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "score", "predicted"])

    return T.map_batches(rows.select("doc_id", *STATISTICS), run, "doc_id long, score double, predicted int")


def held_out(doc_id: str = "doc_id") -> F.Column:
    """Whether crc32 of the id's text leaves no remainder by ``FOLDS``; false for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def training_rows(rows: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality") -> DataFrame:
    """The statistics of labelled rows that are not held out, with their label."""
    known = labels.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{label_col}`").cast("int").alias("label"))
    known = known.where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
    known = known.groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("most"))
    return rows.join(known.where("label = most").drop("most"), "doc_id")


def classify(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    limit: float = LIMIT,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score and predicted. Texts are read once."""
    spark = docs.sparkSession
    folder = scratch_folder(spark)
    statistics(docs, id_col, text_col).write.parquet(f"{folder}/statistics")
    rows = spark.read.parquet(f"{folder}/statistics")
    if rows.isEmpty():
        return rows.selectExpr("doc_id", "false as held_out", "0.0D as score", "0 as predicted")
    model = fit(moments(training_rows(rows, labels, id_col, label_col)))
    return with_scores(rows, model, limit).select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op13_quality_classifier(spark, sf_dir: str) -> DataFrame:
    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
