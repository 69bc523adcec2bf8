import zlib

import numpy as np
import pytest

from tests.llm.test_rows import CASES


def test_folder_has_the_scheme_of_its_store(spark, tmp_path):
    from flowsight.llm.archive import qualified

    name = qualified(spark, str(tmp_path / "a b"))
    assert name.startswith("file:") and qualified(spark, "hdfs://x/y") == "hdfs://x/y"


def test_ids_at_the_edge_and_none(spark, tmp_path, monkeypatch):
    from flowsight.llm import archive

    least = -(1 << 63)
    rows = [(least, "a b"), (None, "c"), (None, "c"), (None, None), (0, "d"), (1, "e f g"), (2, "h")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    archive.write_archive(docs, str(tmp_path / "a"), 4).write.parquet(str(tmp_path / "m"))
    monkeypatch.setattr(archive, "BLOCK_FILES", 2)
    out = archive.read_archive(spark.read.parquet(str(tmp_path / "m"))).orderBy("start").collect()
    assert [r.doc_id for r in out] == [None, None, None, least, 0, 1, 2]
    assert [r.start for r in out] == [sum(r.n_tokens for r in out[:i]) for i in range(len(out))]


def test_round_trip(spark, tmp_path):
    from tokenizers import Tokenizer

    from flowsight.llm.archive import Reader, read_archive, write_archive
    from flowsight.llm.vocabulary import default_path

    table = spark.createDataFrame([(d, t, 1) for d, t in CASES], "doc_id long, text string, name int").repartition(3)
    manifest = write_archive(table, str(tmp_path / "a"), 3)
    manifest.write.parquet(str(tmp_path / "m"))
    manifest = spark.read.parquet(str(tmp_path / "m"))
    rows = read_archive(manifest).collect()
    tokenizer = Tokenizer.from_file(default_path())
    start, want = 0, []
    for doc, text in sorted(CASES, key=lambda c: (c[0] is not None, c[0] or 0)):
        ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        want.append((doc, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    got = sorted((tuple(r) for r in rows), key=lambda r: r[1])
    # rows of equal doc_id stand in any order
    assert sorted((d or 0, n, c) for d, _, n, c in got) == sorted((d or 0, n, c) for d, _, n, c in want)
    assert [r[0] for r in got] == [w[0] for w in want]
    assert [r[1] for r in got] == [sum(r[2] for r in got[:i]) for i in range(len(got))]

    name = manifest.orderBy("file").first().name
    whole = bytearray(open(name, "rb").read())
    whole[6] ^= 255
    open(name, "wb").write(whole)
    with pytest.raises(Exception):  # noqa: B017  the codec or the checksum notices
        Reader(name).document(0)
    empty = write_archive(table.limit(0), str(tmp_path / "b"), 2)
    assert read_archive(empty).count() == 0
