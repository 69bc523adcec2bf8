import random
import re

import pytest


def brute(rows):
    """Later lines alike to an earlier one, in order of doc_id."""
    seen, out = [], {}
    for doc, text in sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0)):
        kept = []
        for line in (text or "").split("\n") if text is not None else []:
            words = frozenset(re.findall(r"[^\x20\x09-\x0D]+", line))
            gone = any(5 * len(words & s) >= 4 * len(words | s) for s in seen)
            if words:
                seen.append(words)
            if not gone:
                kept.append(line)
        out[doc, text] = None if text is None else "\n".join(kept)
    return out


def rows():
    r = random.Random(5)
    words = [f"w{i}" for i in range(60)] + ["ä", "Ö"]
    pool = [[r.choice(words) for _ in range(r.choice([1, 4, 5, 9, 10, 15, 40]))] for _ in range(50)]
    out = [(1, None), (2, ""), (3, "\n\n"), (4, "a b c d e\n\na b c d e"), (None, "a b c d e f g h i j")]
    for d in range(60):
        lines = []
        for _ in range(r.randrange(1, 8)):
            line = list(r.choice(pool))
            for _ in range(r.choice([0, 0, 1, 2])):
                line[r.randrange(len(line))] = r.choice(words)
            lines.append(r.choice([" ", "\t", "  "]).join(line) + r.choice(["", "\r"]))
        out.append((10 + d, "\n".join(lines)))
    return [*out, out[-1], (900, "longword" * 9000 + "\n" + " ".join(f"u{i}" for i in range(4000)))]


@pytest.mark.parametrize("limit", [20_000, 9])
def test_against_brute_force(spark, monkeypatch, limit):
    from flowsight.llm import lines

    monkeypatch.setattr(lines, "WORD_ROWS", limit)
    docs = spark.createDataFrame([(*x, 1) for x in rows()], "doc_id long, text string, k int")
    want = brute(rows())
    got = lines.dedup_lines(docs).select("row.doc_id", "row.text", "lines.*").toDF("doc_id", "old", "text", "n", "gone")
    got = got.collect()
    assert len(got) == len(rows())
    for r in got:
        assert r.text == want[r.doc_id, r.old], r
        if r.text is not None:
            assert (r.n, r.gone) == (r.old.count("\n") + 1, r.old.count("\n") - r.text.count("\n") if r.text or not r.gone else r.n)
    empty = docs.limit(0)
    assert lines.dedup_lines(empty).count() == 0
    left = lines.replace_lines(docs)
    assert left.columns == docs.columns
    assert {r.doc_id for r in left.collect()} == {
        d for (d, t), new in want.items() if new == t or re.search(r"[^\x20\x09-\x0D]", new or "")
    }


def test_only_words_of_paired_sets_are_joined(spark, tmp_path):
    from flowsight.llm.lines import _alike

    sets = [(1, list(range(10))), (2, list(range(1, 11))), (3, list(range(5, 15))), (4, [77]), (5, [77, 78])]
    sets = spark.createDataFrame(sets, "set_id long, words array<long>")
    pairs = spark.createDataFrame([(2, 1), (2, 1), (3, 1), (3, 2), (1, 1)], "later long, earlier long")
    found = _alike(pairs, sets, f"{tmp_path}/pairs")
    assert [r.set_id for r in found.collect()] == [2]
    assert spark.read.parquet(f"{tmp_path}/pairs").count() == 3
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join LeftSemi") == 2


def test_shuffles_go_with_their_step(spark):
    from flowsight.llm.lines import _kept_lines

    def files():
        disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
        return {f for f in disk.getAllFiles().mkString("\n").split("\n") if "shuffle_" in f}

    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    setting, before = spark.conf.get(name, None), files()
    found = _kept_lines(spark.createDataFrame(rows(), "doc_id long, text string"), "doc_id", "text", 1)
    # every step is written and read again, so nothing of a finished one is needed
    assert not files() - before
    assert spark.conf.get(name, None) == setting
    assert found.count() > 50


def test_links_of_many_runs_at_once():
    import numpy as np

    from flowsight.llm.lines import _all_links, _first_links, _room

    r = np.random.default_rng(7)
    runs = [1, 2, 1, 30, 5, 1, 70]
    n = sum(runs)
    table = {"set_id": np.arange(n) * 10, "n": r.integers(4, 12, n), "pos": r.integers(0, 3, n), "settled": r.random(n) < 0.3}
    table["bits"] = (1 << r.integers(0, 12, n)) | 0xFF000
    place = np.concatenate([np.arange(x) for x in runs])

    def room(i, j):
        a, b = (int(table["n"][x]) for x in (i, j))
        p, q = (int(table["pos"][x]) for x in (i, j))
        x, y = (int(table["bits"][k]) for k in (i, j))
        most = min(min(p, q) + min(a - p, b - q), a - (x & ~y).bit_count(), b - (y & ~x).bit_count())
        return 5 * a >= 4 * b and 5 * b >= 4 * a and 9 * most >= 4 * (a + b)

    start = np.arange(n) - place
    pairs = {(j, i) for j in range(n) for i in range(start[j], j) if room(i, j)}
    got = lambda f: sorted((int(a) // 10, int(b) // 10) for a, b in zip(*f(table, place), strict=True))
    assert got(_first_links) == sorted(p for p in pairs if p[1] == start[p[0]])
    assert got(_all_links) == sorted(p for p in pairs if not table["settled"][p[0]])
    assert len(pairs) > 100 and len(_room(table, np.zeros(0, int), np.zeros(0, int))) == 0
