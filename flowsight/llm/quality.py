"""Repetition rules: characters inside repeated word n-grams and repeated lines, by rolling hashes in numpy.

Null text has no words. Empty texts, texts of one very long word and repeated rows are ordinary input: every row
of the table gets one row of the result, judged on its own text alone, so no shuffle is needed at any size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowsight.llm import text as T

MIN_WORDS = 20
BASE_WINDOW = 8
BASE_SHARE = 30
# share of word characters that may lie in later copies of an n-gram of so many words
NGRAM_LIMITS = {5: 0.30, 10: 0.25}
LINE_LIMIT = 0.30
# texts measured at once: the arrays over them take about 100 times as much
BYTES = 500_000

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True

SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "dup_line_chars long, "
    + ", ".join(f"dup_{n}gram_chars long" for n in NGRAM_LIMITS)
    + ", base_failed boolean, kept boolean"
)


def _measure(slab: T.Slab) -> list[np.ndarray]:
    slab.split()
    data, words = slab.data, len(slab.starts)
    heads = (data & 0xC0) != 0x80
    chars = heads & ~T.SPACE[data]
    char_sums = np.concatenate([[0], np.cumsum(chars)])
    n_words = np.diff(slab.first)
    word_chars = char_sums[slab.offsets[1:]] - char_sums[slab.offsets[:-1]]
    n_symbols = T.counts_per_text(slab.offsets, _SYMBOL[data])

    sums = T.byte_sums(data)
    starts, ends, text = slab.lines()
    filled = char_sums[ends] > char_sums[starts]
    starts, ends, text = starts[filled], ends[filled], text[filled]
    _, later = T.repeats(T.span_hashes(sums, starts, ends), text)
    size = len(slab)
    n_dup_lines = np.bincount(text[later], minlength=size)
    dup_line_chars = np.bincount(text[later], (char_sums[ends] - char_sums[starts])[later], size).astype(np.int64)

    hashes = T.span_hashes(sums, slab.starts, slab.ends)
    lengths = char_sums[slab.ends] - char_sums[slab.starts]

    def inside(n: int, first_too: bool) -> np.ndarray:
        at, grams = T.windows(slab, hashes, n)
        twice, again = T.repeats(grams, slab.text_of[at])
        flags = np.zeros(words, bool)
        flags[at[twice if first_too else again]] = True
        return T.covered(flags, n, words)

    n_repeat = T.counts_per_text(slab.first, inside(BASE_WINDOW, True))
    shares = [np.bincount(slab.text_of, inside(n, False) * lengths, size).astype(np.int64) for n in NGRAM_LIMITS]
    failed = (n_words < MIN_WORDS) | (100 * n_repeat > BASE_SHARE * n_words)
    kept = ~failed & (dup_line_chars <= LINE_LIMIT * word_chars)
    for share, most in zip(shares, NGRAM_LIMITS.values(), strict=True):
        kept &= share <= most * word_chars
    return [n_words, word_chars, n_symbols, n_dup_lines, n_repeat, dup_line_chars, *shares, failed, kept]


def repetition(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: its counts, ``base_failed`` and the verdict ``kept``."""

    def measure(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids = batch.column(0)
        for at, to, slab in T.slabs(batch.column(1), BYTES):
            columns = [ids.slice(at, to - at), *(pa.array(c) for c in _measure(slab))]
            names = [c.split()[0] for c in SCHEMA.split(", ")]
            yield pa.RecordBatch.from_arrays(columns, names)

    return T.map_batches(T.id_and_text(docs, id_col, text_col), measure, SCHEMA)


def keep_good(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that pass, with all their columns; each row is judged where it stands."""

    def passes(texts):
        with np.errstate(over="ignore"):
            return pa.array(np.concatenate([np.zeros(0, bool), *(_measure(s)[-1] for _, _, s in T.slabs(texts, BYTES))]))

    # Arrow columns as they are: pandas would make an object of every text of a batch
    passes.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return docs.where(F.arrow_udf(passes, "boolean")(F.col(f"`{text_col}`").cast("string")))


def op7_repetition(spark, sf_dir: str) -> DataFrame:
    return repetition(spark.read.parquet(f"{sf_dir}/documents.parquet"))
