import random
import re

import pytest
from xxhash import xxh64_intdigest


def brute(rows):
    prints = []
    for doc, text in rows:
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        words = re.findall(r"[^\x20\x09-\x0D]+", lower)
        grams = [words[i : i + 4] for i in range(len(words) - 3)] or ([words] if words else [])
        hashes = [xxh64_intdigest(" ".join(g).encode(), 42) for g in grams]
        prints.append((doc, sum((2 * sum(h >> b & 1 for h in hashes) > len(hashes)) << b for b in range(64))))
    left, out = list(range(len(rows))), []
    while left:
        group, front = [], [left.pop()]
        while front:
            x = front.pop()
            group.append(x)
            new = [y for y in left if (prints[x][1] ^ prints[y][1]).bit_count() <= 4]
            left = [y for y in left if y not in new]
            front += new
        least = min((prints[x][0] for x in group if prints[x][0] is not None), default=None)
        out += [(prints[x][0], f"{prints[x][1]:016x}", least) for x in group]
    return sorted(out, key=str)


def rows():
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdeÄÖ") for _ in range(4))
    out = [(1, None), (2, ""), (3, " \n\t"), (4, "One two"), (5, "one  TWO"), (None, "lone text"), (9, "ÄB ÄB ÄB ÄB ÄB " * 900)]
    for g in range(12):
        base = [word() for _ in range(r.choice([30, 200, 400]))]
        for _ in range(r.choice([1, 3, 25])):
            copy = list(base)
            for _ in range(r.choice([0, 1, 3])):
                copy[r.randrange(len(copy))] = word()
            out.append((100 + len(out), r.choice([" ", "\n", "  "]).join(copy)))
    return out + [out[-1]]


@pytest.mark.parametrize("limit", [5_000, 7])
def test_against_brute_force(spark, monkeypatch, limit):
    from flowsight.llm import simhash

    monkeypatch.setattr(simhash, "CELL_ROWS", limit)
    docs = spark.createDataFrame([(*x, 1) for x in rows()], "doc_id long, text string, fingerprint int")
    got = sorted(map(tuple, simhash.near_duplicates(docs).collect()), key=str)
    assert got == brute(rows())
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(ids, key=str) == sorted({c for _, _, c in brute(rows())}, key=str)
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_one_row_of_repeated_and_absent_ids(spark):
    from flowsight.llm.simhash import keep_one

    text, other = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    third = " ".join(f"c{i}" for i in range(60))
    cases = [(1, text)] * 3 + [(None, other)] * 3 + [(1, third), (None, text), (9, third), (7, None), (6, "")]
    docs = spark.createDataFrame([(*c, i) for i, c in enumerate(cases)], "doc_id long, text string, n int").repartition(3)
    kept = keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted(
        [(1, text), (None, other), (1, third), (6, "")], key=str
    )
    assert keep_one(docs.limit(0)).count() == 0


def test_chain_and_star(spark):
    from flowsight.llm.runs import connected

    pairs = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(-5, 200), (200, 300)]
    got = {r.node: r.root for r in connected(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 140)}, -5: -5, 200: -5, 300: -5}
    assert connected(spark.createDataFrame(pairs, "a long, b long").limit(0)).count() == 0
