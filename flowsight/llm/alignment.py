"""Alignment of two tokenisations of the same text through token-byte incidence matrices.

Texts are laid end to end as bytes, a space before each. Each tokenisation is a sparse 0/1 matrix of tokens by bytes
in compressed rows (CSR). Gustavson's row product A·Bᵀ gives the tokens that share a byte (overlap links). Places
where both tokenisations end a token cut the bytes into groups; products of the group incidences give the tokens
that share a group. Numpy does this for about a megabyte of text at once, inside Spark tasks.

A text that is null or empty, or whose token bytes differ from space + text on either side, has no tokens: its counts
are zero. Repeated rows are rows of their own and count each time. An empty table gives no rows. Only the two named
columns are read, so others cannot clash. A row is known by its number in a written table, so null or equal ids do
not mix rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowsight.llm import text as T
from flowsight.llm.vocabulary import gather, unit_encoder
from flowsight.session import at_most, scratch_folder

CHUNK_BYTES = 1_000_000
BLOCK = 4_000_000
MARKS = ",|;"
# a pair of ids, its count and a flag: under 64 bytes a row in a broadcast hash table
PAIR_ROWS = 1_000_000


def default_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


# -- matrices ------------------------------------------------------------------


@dataclass
class Csr:
    """Compressed sparse rows: row ``i`` holds the columns ``indices[indptr[i]:indptr[i + 1]]`` with ``data``."""

    indptr: np.ndarray
    indices: np.ndarray
    data: np.ndarray
    columns: int

    @property
    def rows(self) -> int:
        return len(self.indptr) - 1

    def transpose(self) -> Csr:
        order = np.argsort(self.indices, kind="stable")
        row_of = np.repeat(np.arange(self.rows), np.diff(self.indptr))
        indptr = np.zeros(self.columns + 1, np.int64)
        np.cumsum(np.bincount(self.indices, minlength=self.columns), out=indptr[1:])
        return Csr(indptr, row_of[order], self.data[order], self.rows)

    def times(self, vector: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(self.data * vector[self.indices])])
        return total[self.indptr[1:]] - total[self.indptr[:-1]]


def incidence(bounds: np.ndarray) -> Csr:
    """Rows are consecutive spans, ``bounds`` their starts and the last end; columns are the units they cover."""
    size = int(bounds[-1])
    return Csr(bounds.astype(np.int64), np.arange(size), np.ones(size, np.int64), size)


def product_blocks(a: Csr, b: Csr, block: int = BLOCK) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Gustavson's product: row ``i`` of the result adds up the rows of ``b`` that row ``i`` of ``a`` names.

    Yields (row, column, value) sorted by row and column, whole rows at a time, about ``block`` terms in memory.
    """
    terms = np.diff(b.indptr)[a.indices]
    ends = np.concatenate([[0], np.cumsum(terms)])[a.indptr]
    at = 0
    while at < a.rows:
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + block, "right")) - 1)
        some = slice(int(a.indptr[at]), int(a.indptr[to]))
        picked, n = a.indices[some], terms[some]
        total = int(n.sum())
        if total:
            first = np.cumsum(n) - n
            inner = np.repeat(b.indptr[picked] - first, n) + np.arange(total)
            row = np.repeat(np.repeat(np.arange(at, to), np.diff(a.indptr[at : to + 1])), n)
            key = row * b.columns + b.indices[inner]
            value = np.repeat(a.data[some], n) * b.data[inner]
            order = np.argsort(key, kind="stable")
            key = key[order]
            new = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            yield key[new] // b.columns, key[new] % b.columns, np.add.reduceat(value[order], new)
        at = to


# -- tokenisers ----------------------------------------------------------------


class ByteTokens:
    """Byte-level BPE of the ``tokenizers`` library; special strings inside texts are plain text."""

    def __init__(self, path: str) -> None:
        self.encoder = unit_encoder(path, plain=True)
        self.model = self.encoder.model
        size = self.model.get_vocab_size()
        byte_of = _byte_characters()
        self.bytes = [b""] * size
        for token, number in self.model.get_vocab(with_added_tokens=True).items():
            if all(c in byte_of for c in token):
                self.bytes[number] = bytes(byte_of[c] for c in token)
        self._finish()

    def _finish(self) -> None:
        self.lengths = np.array([len(b) for b in self.bytes], np.int64)
        self.raw = np.frombuffer(b"".join(self.bytes), np.uint8)
        self.raw_at = np.cumsum(self.lengths) - self.lengths
        # every id as text before each of the marks , | ;
        self.text = np.array([f"{i}{mark}" for mark in MARKS for i in range(len(self.bytes))], object)

    def encode(self, texts: list[str], data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end and the first id of each (with the end); ``data``: space + text of all."""
        return self.encoder.encode(data, offsets)

    def spelt(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of all tokens, end to end."""
        return self.raw[gather(self.raw_at[ids], self.lengths[ids])]


class PieceTokens(ByteTokens):
    """BPE of the ``sentencepiece`` library, which adds the space before a text itself."""

    def __init__(self, path: str) -> None:
        from sentencepiece import SentencePieceProcessor

        self.model = m = SentencePieceProcessor(model_file=path)
        pieces = [m.id_to_piece(i) for i in range(m.get_piece_size())]
        self.bytes = [
            bytes([int(p[3:5], 16)]) if m.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)
        ]
        self._finish()

    def encode(self, texts: list[str], data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        found = self.model.encode(texts, num_threads=1) if texts else []
        first = np.zeros(len(texts) + 1, np.int64)
        np.cumsum([len(f) for f in found], out=first[1:])
        return np.fromiter(chain.from_iterable(found), np.int64, int(first[-1])), first


def _byte_characters() -> dict[str, int]:
    """Byte of each character of a byte-level vocabulary: printable Latin-1 stands for itself, the rest is moved up."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    moved = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(moved)}


@lru_cache(maxsize=1)
def tokenisers(a_path: str, b_path: str) -> tuple[ByteTokens, PieceTokens]:
    """Both tokenisers of this Python worker."""
    return ByteTokens(a_path), PieceTokens(b_path)


# -- alignment of a run of texts -------------------------------------------------


class Aligned:
    """Both tokenisations of a run of texts with their groups; only texts that both spell out take part."""

    def __init__(self, texts: list[str], a: ByteTokens, b: ByteTokens) -> None:
        body = [b" " + t.encode() for t in texts]
        offsets = np.zeros(len(texts) + 1, np.int64)
        np.cumsum([len(x) for x in body], out=offsets[1:])
        data = np.frombuffer(b"".join(body), np.uint8)
        sides = [s.encode(texts, data, offsets) for s in (a, b)]
        self.kept = np.diff(offsets) > 1
        for s, (ids, first) in zip((a, b), sides, strict=True):
            self.kept &= self._spells(s, ids, first, data, offsets)
        self.ids, self.bounds, self.first = [], [], []
        for s, (ids, first) in zip((a, b), sides, strict=True):
            counts = np.diff(first)
            ids = ids[np.repeat(self.kept, counts)].astype(np.int64)
            self.ids.append(ids)
            self.first.append(np.concatenate([[0], np.cumsum(counts[self.kept])]))
            self.bounds.append(np.concatenate([[0], np.cumsum(s.lengths[ids])]))
        ends = np.zeros(int(self.bounds[0][-1]) + 1, np.int8)
        for bound in self.bounds:
            ends[bound[1:]] += 1
        self.cuts = np.flatnonzero(ends == 2)
        self.text_ends = self.bounds[0][self.first[0][1:]]
        self.groups = [self._group_incidence(side) for side in (0, 1)]

    @staticmethod
    def _spells(s: ByteTokens, ids: np.ndarray, first: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Per text, whether the bytes of its tokens are its own bytes."""
        sizes = np.concatenate([[0], np.cumsum(s.lengths[ids])])[first]
        fine = np.diff(sizes) == np.diff(offsets)
        some = ids if fine.all() else ids[np.repeat(fine, np.diff(first))]
        want = data if fine.all() else data[np.repeat(fine, np.diff(offsets))]
        wrong = np.concatenate([[0], np.cumsum(s.spelt(some) != want)])
        at = np.concatenate([[0], np.cumsum(np.diff(offsets)[fine])])
        fine[fine] = wrong[at[1:]] == wrong[at[:-1]]
        return fine

    def overlaps(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A token, B token and shared bytes of every overlap link: the product of A by bytes and bytes by B."""
        a, b = incidence(self.bounds[0]), incidence(self.bounds[1])
        parts = list(product_blocks(a, b.transpose()))
        none = np.zeros(0, np.int64)
        return tuple(np.concatenate([p[i] for p in parts]) if parts else none for i in range(3))

    def _group_incidence(self, side: int) -> Csr:
        """Groups by tokens of one side: a token lies in exactly one group."""
        ends = np.searchsorted(self.bounds[side], self.cuts)
        return incidence(np.concatenate([[0], ends]))

    def shared_groups(self, block: int = BLOCK) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Blocks of (A token, B token, 1) of all pairs in a common group: tokens by groups times groups by tokens."""
        return product_blocks(self.groups[0].transpose(), self.groups[1], block)

    def group_links(self) -> np.ndarray:
        """How many B tokens each A token shares its group with, without the pairs themselves."""
        return self.groups[0].transpose().times(np.diff(self.groups[1].indptr))

    def texts_of(self, side: int) -> np.ndarray:
        """Number among the kept texts of every token of one side."""
        return np.repeat(np.arange(len(self.text_ends)), np.diff(self.first[side]))

    def spelled_groups(self, a: ByteTokens, b: ByteTokens) -> list[str]:
        """``a1,a2|b1;a3|b2,b3`` of every kept text."""
        sizes = [np.diff(g.indptr) for g in self.groups]
        # tokens of a group stand together, those of A first, each before a comma but for the last of its side
        begin = np.cumsum(sizes[0] + sizes[1]) - sizes[0] - sizes[1]
        parts = np.empty(len(self.ids[0]) + len(self.ids[1]), object)
        for side, s in ((0, a), (1, b)):
            at = gather(begin + side * sizes[0], sizes[side])
            mark = np.zeros(len(at), np.int64)
            mark[self.groups[side].indptr[1:] - 1] = side + 1
            parts[at] = s.text[self.ids[side] + mark * len(s.bytes)]
        bounds, flat = self.first[0] + self.first[1], parts.tolist()
        return ["".join(flat[x:y])[:-1] for x, y in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]


def _runs(column: pa.Array, limit: int) -> Iterator[tuple[int, list[str]]]:
    """First row and texts of runs of about ``limit`` bytes; null is the empty text."""
    texts = [t or "" for t in column.to_pylist()]
    at = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= limit or i + 1 == len(texts):
            yield at, texts[at : i + 1]
            at, size = i + 1, 0


COUNTS = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_group_links long, groups_sha256 string"
_PAIRS = "pairs array<long>, times array<int>"


def align(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", paths: tuple[str, str] | None = None
) -> DataFrame:
    """One row per row of ``docs``: its counts, the digest of its groups and its linked id pairs.

    ``pairs`` holds each pair of ids once, as A id * 2**32 + B id in rising order, ``times`` how often it is linked.
    """
    a_path, b_path = paths or default_paths()

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        a, b = tokenisers(a_path, b_path)
        for first, texts in _runs(batch.column(1), CHUNK_BYTES):
            x = Aligned(texts, a, b)
            size, n = len(texts), len(x.text_ends)
            at = np.flatnonzero(x.kept)
            left, right, _ = x.overlaps()
            text = x.texts_of(0)

            def spread(values: np.ndarray, at=at, size=size) -> pa.Array:
                out = np.zeros(size, np.int64)
                out[at] = values
                return pa.array(out)

            text_of_cut = np.searchsorted(x.text_ends, x.cuts)
            digests = [""] * size
            for i, s in zip(at.tolist(), x.spelled_groups(a, b), strict=True):
                digests[i] = hashlib.sha256(s.encode()).hexdigest()
            key = (x.ids[0][left] << 32) | x.ids[1][right]
            order = np.lexsort((key, text[left]))
            key, owner = key[order], text[left][order]
            new = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (owner[1:] != owner[:-1]))[: len(key)])
            times = np.diff(np.append(new, len(key))).astype(np.int32)
            lists = np.zeros(size + 1, np.int32)
            lists[1:][at] = np.bincount(owner[new], minlength=n)
            offsets = pa.array(np.cumsum(lists).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(first, size),
                    spread(np.diff(x.first[0])),
                    spread(np.diff(x.first[1])),
                    spread(np.bincount(text_of_cut, minlength=n)),
                    spread(np.bincount(text[left], minlength=n)),
                    spread(np.bincount(text, x.group_links(), n).astype(np.int64)),
                    pa.array(digests, pa.string()),
                    pa.ListArray.from_arrays(offsets, pa.array(key[new])),
                    pa.ListArray.from_arrays(offsets, pa.array(times)),
                ],
                [c.split()[0] for c in f"{COUNTS}, {_PAIRS}".split(", ")],
            )

    return T.map_batches(T.id_and_text(docs, id_col, text_col), run, f"{COUNTS}, {_PAIRS}")


def links(
    docs: DataFrame,
    kind: str = "overlap",
    id_col: str = "doc_id",
    text_col: str = "text",
    paths: tuple[str, str] | None = None,
) -> DataFrame:
    """One row per link: doc_id, a_at and b_at (token numbers in the text), a_id, b_id and weight.

    ``kind`` is "overlap" (weight: shared bytes) or "group" (all pairs of a common group, weight 1), which leaves a
    task in bounded blocks.
    """
    if kind not in ("overlap", "group"):
        raise ValueError(f"unknown kind of link: {kind}")
    a_path, b_path = paths or default_paths()

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        a, b = tokenisers(a_path, b_path)
        for first, texts in _runs(batch.column(1), CHUNK_BYTES):
            x = Aligned(texts, a, b)
            ids = batch.column(0).slice(first, len(texts)).take(pa.array(np.flatnonzero(x.kept)))
            text = x.texts_of(0)
            for left, right, weight in [x.overlaps()] if kind == "overlap" else x.shared_groups():
                owner = text[left]
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.take(pa.array(owner)),
                        *map(pa.array, (left - x.first[0][owner], right - x.first[1][owner])),
                        *map(pa.array, (x.ids[0][left], x.ids[1][right], weight)),
                    ],
                    ["doc_id", "a_at", "b_at", "a_id", "b_id", "weight"],
                )

    schema = "doc_id long, a_at long, b_at long, a_id long, b_id long, weight long"
    return T.map_batches(T.id_and_text(docs, id_col, text_col), run, schema)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """pair, n (links in the whole corpus) and best (no A id is linked to the pair's B id more often)."""
    each = aligned.select(F.explode(F.arrays_zip("pairs", "times")).alias("p")).select("p.pairs", "p.times")
    counts = each.groupBy(F.col("pairs").alias("pair")).agg(F.sum("times").alias("n"))
    return counts.withColumn("b_id", F.expr("pair & 4294967295L"))


def aligned_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", paths: tuple[str, str] | None = None
) -> DataFrame:
    """One row per row of ``docs``: its counts, how many links are the best of their B id, and the sum of link counts."""
    spark = docs.sparkSession
    folder = scratch_folder(spark)
    rows = align(docs, id_col, text_col, paths).withColumn("row", F.monotonically_increasing_id())
    rows.write.option("compression", "zstd").parquet(f"{folder}/aligned")
    rows = spark.read.parquet(f"{folder}/aligned")
    pair_counts(rows).write.parquet(f"{folder}/pairs")
    pairs = spark.read.parquet(f"{folder}/pairs")
    # one row per B id, so at most a vocabulary
    most = pairs.groupBy("b_id").agg(F.max("n").alias("most"))
    # a pair linked once is left out: a link without an entry has count 1, the best if nothing of its B id has more
    known = pairs.where("n > 1").join(F.broadcast(most), "b_id").selectExpr("pair", "n", "n = most as best")
    known = F.broadcast(known) if at_most(pairs.where("n > 1"), PAIR_ROWS) else known
    often = F.broadcast(most.where("most > 1").selectExpr("b_id as common"))
    each = rows.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("p"))
    each = each.selectExpr("row", "p.pairs as pair", "p.times as times", "p.pairs & 4294967295L as b_id")
    each = each.join(known, "pair", "left").join(often, F.col("b_id") == F.col("common"), "left")
    sums = each.groupBy("row").agg(
        F.expr("sum(if(coalesce(best, common is null), times, 0))").alias("n_best"),
        F.expr("sum(times * coalesce(n, 1L))").alias("count_sum"),
    )
    names = [c.split()[0] for c in COUNTS.split(", ")]
    return rows.select("row", *names).join(sums, "row", "left").selectExpr(
        *names, "coalesce(n_best, 0L) as n_best", "coalesce(count_sum, 0L) as count_sum"
    )


def op12_alignment(spark, sf_dir: str) -> DataFrame:
    return aligned_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
