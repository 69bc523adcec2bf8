import random
from collections import Counter, defaultdict

import numpy as np
import pytest


def brute(rows, length):
    texts = {(d, t or "") for d, t in rows}
    seen = Counter()
    for _, t in texts:
        b = t.encode()
        seen.update(b[i : i + length] for i in range(len(b) - length + 1))
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = True
        spans = int((gone[:-1] & ~np.concatenate([[False], gone[:-2]])).sum()) if len(b) else 0
        kept = bytes(x for x, g in zip(b, gone, strict=False) if not g)
        out.append((d, len(b), int(gone.sum()), spans, kept))
    return sorted(out, key=str)


def table(r, length):
    text = lambda n: "".join(r.choice("abÄ ") for _ in range(n))
    passages = [text(n) for n in (length - 1, length, length + 3, 3 * length, 8 * length)]
    rows = [(1, None), (2, ""), (3, "x"), (None, text(3 * length)), (4, "x" * 5 * length), (5, "abcab" * 2 * length)]
    for i in range(80):
        parts = [r.choice(passages) if r.random() < 0.4 else text(r.randrange(length)) for _ in range(r.randrange(6))]
        rows.append((100 - i, "".join(parts)))
    return rows + [(200 + i, rows[20 + i % 3][1]) for i in range(9)] + [rows[30]] * 3


@pytest.mark.parametrize(("length", "classes"), [(24, 1_000), (24, 3), (400, 1_000)])
def test_against_brute_force(spark, monkeypatch, length, classes):
    from flowsight.llm import suffixes

    monkeypatch.setattr(suffixes, "CLASSES", classes)
    monkeypatch.setattr(suffixes, "BATCH_BYTES", 3_000)
    rows = table(random.Random(3), length)
    docs = spark.createDataFrame([(*x, 0) for x in rows], "doc_id long, text string, r int")
    found = sorted(((a, b, c, d, bytes(e)) for a, b, c, d, e in suffixes.remove_repeats(docs, length).collect()), key=str)
    assert found == brute(rows, length)
    if length == 400:
        assert suffixes.remove_repeats(docs.limit(0)).count() == 0


def test_groups_hold_all_occurrences(spark):
    from flowsight.llm.suffixes import maximal_repeats

    # the second passage holds the first, so its group is a child
    core = "the quick brown fox jumps over"
    texts = {1: "1" + core + "2", 2: "3" + core + "4", 3: "5" + core + " it6", 4: "7" + core + " it8"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    found = maximal_repeats(docs, 24).collect()
    held = defaultdict(set)
    for x in found:
        held[x.repeat].add(texts[x.doc_id][x.start : x.end])
        assert x.parent_length < x.end - x.start
    assert all(len(x) == 1 for x in held.values())
    assert {s for x in held.values() for s in x} >= {core, core + " it"}
    assert {x.doc_id for x in found if x.end - x.start == len(core)} == {1, 2}
    child = {(x.doc_id, x.parent_length) for x in found if x.end - x.start == len(core) + 3}
    assert child == {(3, len(core)), (4, len(core))}


def test_sorted_suffixes_and_common_prefixes():
    from flowsight.llm.suffixes import _common, _sort

    r = np.random.default_rng(1)
    parts = [bytes(r.integers(97, 99, n, np.uint8)) for n in (1, 5, 40, 40, 90)] + [b"a" * 30, b"\0" * 9]
    data, offsets = np.frombuffer(b"".join(parts), np.uint8), np.cumsum([0] + [len(p) for p in parts])
    symbols, levels = _sort(data, offsets, 90)
    suffixes = {int(offsets[i]) + i + j: p[j:] for i, p in enumerate(parts) for j in range(len(p))}
    order = sorted(suffixes, key=lambda x: levels[-1][1][x])
    assert [suffixes[x] for x in order] == sorted(suffixes.values())
    p, q = np.array(order[:-1]), np.array(order[1:])
    for a, b, n in zip(p, q, _common(p, q, symbols, levels), strict=True):
        x, y = suffixes[int(a)], suffixes[int(b)]
        want = next((i for i in range(min(len(x), len(y))) if x[i] != y[i]), min(len(x), len(y)))
        assert min(n, len(x), len(y)) == want
