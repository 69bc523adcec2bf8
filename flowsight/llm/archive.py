"""Token ids in files of independent zstandard frames with a trailing seek table and a checksum per frame.

File layout, all integers little-endian: data frames (each the unsigned 32-bit ids of whole documents), one index
frame (doc_ids as 64-bit integers, token counts as 64-bit integers, then a byte per document: 1 if it has no id), then a skippable frame (magic 0x184D2A5E)
whose content is one entry per frame - compressed size, raw size, low 32 bits of XXH64 of the raw bytes - and a
footer of the number of frames, a descriptor byte 0x80 and the magic 0x8F92EAB1. Any zstandard tool decodes a whole
file; a reader of one document reads the seek table, the index and the one frame that holds it.

Null and empty texts are one end id. Rows of one doc_id keep together, in order of a hash of their text and then of the text; null doc_ids come first.
Ranges are cut by doc_id and that hash, so many rows of one doc_id, or of none, are dealt over several files.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowsight.llm import text as T
from flowsight.llm.vocabulary import default_path, unit_encoder
from flowsight.session import scratch_folder

END_ID = 2
FRAME_BYTES = 1 << 18
FILE_BYTES = 32 << 20
# files whose token counts are added up by one task when their places are found
BLOCK_FILES = 1024
# fixed values of the seekable zstandard format
SKIPPABLE, SEEKABLE, CHECKSUMS = 0x184D2A5E, 0x8F92EAB1, 0x80


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class Writer:
    """Writes one file; it appears under its name only when complete, so a repeated task changes nothing."""

    def __init__(self, path: str) -> None:
        import zstandard

        self.store, self.path = _open(path)
        self.temporary = f"{self.path}.{uuid.uuid4().hex}"
        self.store.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.out = self.store.open_output_stream(self.temporary)
        self.codec = zstandard.ZstdCompressor(level=3)
        self.entries: list[tuple[int, int, int]] = []
        self.pending: list[bytes] = []
        self.held = 0
        self.ids: list[int] = []
        self.absent: list[int] = []
        self.counts: list[int] = []

    def _frame(self, raw: bytes) -> None:
        import xxhash

        packed = self.codec.compress(raw)
        self.out.write(packed)
        self.entries.append((len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.ids.append(doc_id or 0)
        self.absent.append(doc_id is None)
        self.counts.append(len(ids))
        self.pending.append(ids.astype("<u4").tobytes())
        self.held += 4 * len(ids)
        if self.held >= FRAME_BYTES:
            self._flush()

    def _flush(self) -> None:
        if self.pending:
            self._frame(b"".join(self.pending))
            self.pending, self.held = [], 0

    def close(self) -> int:
        self._flush()
        self._frame(np.array(self.ids, "<i8").tobytes() + np.array(self.counts, "<i8").tobytes() + bytes(self.absent))
        table = b"".join(struct.pack("<III", *e) for e in self.entries)
        table += struct.pack("<IBI", len(self.entries), CHECKSUMS, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(table)) + table)
        self.out.close()
        self.store.move(self.temporary, self.path)
        return sum(self.counts)


class Reader:
    """Reads documents of one file, decompressing only the frames they lie in."""

    def __init__(self, path: str) -> None:
        store, path = _open(path)
        self.file = store.open_input_file(path)
        size = self.file.size()
        n, flags, magic = struct.unpack("<IBI", self.file.read_at(9, size - 9))
        if magic != SEEKABLE or flags != CHECKSUMS:
            raise ValueError(f"{path} has no seek table")
        entries = self.file.read_at(12 * n, size - 9 - 12 * n)
        self.entries = [struct.unpack_from("<III", entries, 12 * i) for i in range(n)]
        self.places = np.concatenate([[0], np.cumsum([e[0] for e in self.entries])])
        self.raw = np.concatenate([[0], np.cumsum([e[1] for e in self.entries[:-1]])])
        index = self.frame(n - 1)
        size = len(index) // 17
        self.ids, self.counts = np.frombuffer(index, "<i8", size), np.frombuffer(index, "<i8", size, 8 * size)
        self.absent = np.frombuffer(index, np.uint8, size, 16 * size) == 1
        self.starts = np.concatenate([[0], np.cumsum(self.counts)])
        self.last: tuple[int, bytes] = (-1, b"")

    def frame(self, k: int) -> bytes:
        import xxhash
        import zstandard

        packed, size, check = self.entries[k]
        data = self.file.read_at(packed, int(self.places[k]))
        raw = zstandard.ZstdDecompressor().decompress(data, max_output_size=size)
        if xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != check:
            raise ValueError(f"frame {k} is damaged")
        return raw

    def document(self, i: int) -> np.ndarray:
        at = 4 * int(self.starts[i])
        k = bisect_right(self.raw, at) - 1
        if self.last[0] != k:
            self.last = (k, self.frame(k))
        return np.frombuffer(self.last[1], "<u4", int(self.counts[i]), at - int(self.raw[k]))


def write_archive(
    docs: DataFrame, folder: str, files: int, id_col: str = "doc_id", text_col: str = "text", path: str | None = None
) -> DataFrame:
    """Writes ``files`` files in ascending doc_id and returns their manifest (file, name, n_tokens), unevaluated."""
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, writer, tokens = TaskContext.get().partitionId(), None, unit_encoder(path)
        name = f"{folder}/part-{number:06d}.zst"
        for batch in batches:
            docs_here = batch.column(0).to_pylist()
            for at, to, slab in T.slabs(batch.column(1)):
                writer = writer or Writer(name)
                ids, first = tokens.encode(slab.data, slab.offsets)
                for doc, a, b in zip(docs_here[at:to], first[:-1].tolist(), first[1:].tolist(), strict=True):
                    writer.add(doc, np.append(ids[a:b], np.uint32(END_ID)))
        if writer:
            row = [pa.array([number]), pa.array([name]), pa.array([writer.close()], pa.int64())]
            yield pa.RecordBatch.from_arrays(row, ["file", "name", "n_tokens"])

    rows = T.id_and_text(docs, id_col, text_col).withColumn("k", F.expr("xxhash64(coalesce(text, ''))"))
    ordered = rows.repartitionByRange(files, "doc_id", "k").sortWithinPartitions("doc_id", "k", "text")
    return ordered.select("doc_id", "text").mapInArrow(run, "file long, name string, n_tokens long")


def read_archive(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files; the manifest has a row per file."""
    upto = "rows between unbounded preceding and 1 preceding"
    blocks = manifest.withColumn("block", F.expr(f"file div {BLOCK_FILES}"))
    sums = blocks.groupBy("block").agg(F.sum("n_tokens").alias("n"))
    sums = sums.selectExpr("block", f"coalesce(sum(n) over (order by block {upto}), 0L) as earlier")
    before = f"coalesce(sum(n_tokens) over (partition by block order by file {upto}), 0L)"
    placed = blocks.join(sums, "block").selectExpr("name", f"earlier + {before} as before")
    files = max(1, manifest.count())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                reader = Reader(name)
                crc = [zlib.crc32(reader.document(i).tobytes()) for i in range(len(reader.ids))]
                columns = [
                    pa.array(reader.ids, pa.int64(), mask=reader.absent),
                    pa.array(start + reader.starts[:-1], pa.int64()),
                    pa.array(reader.counts, pa.int64()),
                    pa.array(crc, pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32"])

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    # with a number given, adaptive execution does not put all files into one task
    return placed.repartition(files, "name").mapInArrow(run, schema)


def qualified(spark, folder: str) -> str:
    """``folder`` with the scheme of the store that Spark writes it to, as the executors' Python must open the same one."""
    if "://" in folder:
        return folder
    spark.range(1).write.parquet(f"{folder}/store")
    return spark.read.parquet(f"{folder}/store").inputFiles()[0].rpartition("/store/")[0]


def op9_token_archive(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    folder = qualified(spark, scratch_folder(spark))
    manifest = write_archive(docs, f"{folder}/ids", files=1 + size // FILE_BYTES)
    # the manifest is written once, so reading it again never encodes again
    manifest.write.parquet(f"{folder}/manifest")
    return read_archive(spark.read.parquet(f"{folder}/manifest"))
