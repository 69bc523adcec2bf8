import random
from itertools import combinations
from pathlib import Path

import numpy as np


def rows():
    """Lines of 70 to 250 words: frequent ones, that any two lines share, and rare ones; some lines are copies with other words."""
    r = random.Random(11)
    often, rare, out, lines = [f"often{i}" for i in range(90)], [f"rare{i}" for i in range(6000)], [], []
    for d in range(300):
        text = []
        for _ in range(4):
            n = r.randrange(70, 250)
            line = r.sample(often, n // 3) + r.sample(rare, n - n // 3)
            if lines and r.random() < 0.2:
                line = list(r.choice(lines))
                for at in r.sample(range(len(line)), r.choice([0, 3, len(line) // 10, len(line) // 7])):
                    line[at] = r.choice(rare)
            r.shuffle(line)
            lines.append(line)
            text.append(" ".join(line))
        out.append((d if d % 50 else None, "\n".join(text)))
    return out


def test_scratch_files_are_few_and_unlike_lines_are_no_candidates(spark, monkeypatch, tmp_path):
    from flowsight.llm import lines
    from tests.llm.test_lines import brute

    own = [(d, t) for d, t in rows() if d is not None]
    docs = spark.createDataFrame(own, "doc_id long, text string")
    folder = tmp_path / "scratch"
    monkeypatch.setattr(lines, "scratch_folder", lambda spark: str(folder))
    got = {r.doc_id: r.text for r in lines.dedup_lines(docs).select("row.doc_id", "lines.text").collect()}
    want = brute(own)
    assert got == {d: t for (d, _), t in want.items()}
    gone = sum(old.count("\n") - new.count("\n") for (_, old), new in want.items())
    assert gone > 50
    # neither all words of all sets nor pairs of unlike lines are written
    assert sum(f.stat().st_size for f in Path(folder).rglob("*.parquet")) < 0.55 * sum(len(t) for _, t in own)
    assert spark.read.parquet(f"{folder}/rest-pairs").count() < 4 * gone


def test_sketches_never_differ_in_more_bits_than_sets_in_words():
    from flowsight.llm import lines

    r = np.random.default_rng(3)
    sets = []
    for n in [4, 30, 60, 63, 64, 70, 150, 190, 192, 230, 400, 500]:
        base = r.integers(0, 2**64, n, np.uint64)
        other = base.copy()
        other[: max(1, n // 9)] = r.integers(0, 2**64, max(1, n // 9), np.uint64)
        sets += [base, other, np.append(base, r.integers(0, 2**64, n // 5, np.uint64)), r.integers(0, 2**64, n, np.uint64)]
    offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    with np.errstate(over="ignore"):
        body = lines._bodies(np.concatenate(sets), offsets)
    batch = lines.pa.RecordBatch.from_arrays([body, lines.pa.array(np.diff(offsets))], ["body", "n"])
    sketch, word, row, pos = lines._unfolded(batch)
    for i, s in enumerate(sets):
        heads = len(s) - (4 * len(s) + 4) // 5 + 1
        assert (word[row == i] == s[:heads]).all() and (pos[row == i] == np.arange(heads)).all()
    table = {"n": np.diff(offsets), **{f"s{j}": sketch[j] for j in range(len(sketch))}}
    pairs = np.array([p for p in combinations(range(len(sets)), 2) if 0.8 <= len(sets[p[0]]) / len(sets[p[1]]) <= 1.25])
    bits = lines._differ(table, pairs[:, 0], pairs[:, 1])
    unlike = [0, 0]
    for (a, b), x in zip(pairs.tolist(), bits, strict=True):
        shared = len(np.intersect1d(sets[a], sets[b]))
        n = len(sets[a]) + len(sets[b])
        assert x <= n - 2 * shared
        if n >= 30 and not shared:
            unlike[int(9 * x > n)] += 1
    assert unlike[1] > 50 and unlike[0] <= 0.02 * unlike[1]


def test_hot_words_meet_once_under_some_key():
    from flowsight.llm import lines

    word = np.repeat(np.array([5, 6, 7], np.uint64), [40, 30, 1])
    ids = np.arange(len(word)) * 3
    head, key = lines._dealt(word, ids, (np.array([6], np.uint64), np.array([4])))
    assert np.bincount(head).tolist() == [1] * 40 + [4] * 30 + [1]
    under = {(h, k) for h, k in zip(head.tolist(), key.tolist(), strict=True)}
    keys = [{k for h, k in under if h == i} for i in range(len(word))]
    for a, b in combinations(range(len(word)), 2):
        assert bool(keys[a] & keys[b]) == (word[a] == word[b])


def test_packed_columns_come_back():
    from flowsight.llm.runs import pack, unpack

    r = np.random.default_rng(1)
    columns = [r.integers(0, 2**64, 99, np.uint64), r.integers(-9, 9, 99), r.integers(0, 300, 99).astype("u4"), r.random(99) < 0.5]
    kinds = [c.dtype.str for c in columns]
    for part in (slice(None), slice(5, 6), slice(0, 0)):
        back = unpack(pack([c[part].copy() for c in columns]), kinds)
        assert all((x == c[part]).all() and x.dtype == c.dtype for x, c in zip(back, columns, strict=True))
    same = [np.full(1000, 7, np.uint64)]
    assert len(pack(same)) < 100


def test_a_filter_on_the_result_does_not_cut_texts_again(spark):
    from flowsight.llm.lines import replace_lines

    docs = spark.createDataFrame([(1, "a b c d e\na b c d e"), (2, "a b c d e"), (3, None), (4, "")], "doc_id long, text string")
    left = replace_lines(docs)
    plan = left._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
    assert sorted((r.doc_id, r.text) for r in left.collect()) == [(1, "a b c d e"), (3, None), (4, "")]


def test_batches_of_no_rows_pass(spark):
    from flowsight.llm.quality import keep_good

    good = " ".join(f"w{i}" for i in range(30))
    docs = spark.createDataFrame([(1, None), (2, good), (3, "w " * 50), (4, "")], "doc_id long, text string")
    assert [r.doc_id for r in keep_good(docs).collect()] == [2]
    assert keep_good(docs.limit(0)).count() == 0
