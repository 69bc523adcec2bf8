import random
import re


def brute(rows):
    first, docs = {}, {}
    for doc, text in sorted(set(rows), key=lambda x: (x[0] is None, x[0] or 0)):
        words = docs[doc, text] = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        for i in range(len(words) - 19):
            first.setdefault(tuple(words[i : i + 20]), (doc, text, i))
    out = []
    for doc, text in rows:
        words, gone = docs[doc, text], set()
        for i in range(len(words) - 19):
            if first[tuple(words[i : i + 20])] != (doc, text, i):
                gone |= set(range(i, i + 20))
        out.append((doc, len(words), len(gone), " ".join(w for i, w in enumerate(words) if i not in gone)))
    return sorted(out, key=str)


def test_against_brute_force(spark):
    from flowsight.llm.anchors import remove_repeats

    r = random.Random(2)
    word = lambda: "".join(r.choice("abcdeÄÖ") for _ in range(4))
    text = lambda n: " ".join(word() for _ in range(n))
    passages = [text(n) for n in (19, 20, 21, 33, 60)]
    rows = [(1, None), (2, ""), (3, "one"), (None, text(50)), (4, "x " * 70), (5, "a b c " * 30), (6, "long" * 30_000)]
    for i in range(80):
        parts = [r.choice(passages) if r.random() < 0.4 else text(r.randrange(25)) for _ in range(r.randrange(6))]
        rows.append((100 - i, r.choice([" ", "\n", " \t"]).join(parts)))
    rows += [(200 + i, rows[20 + i % 3][1]) for i in range(9)] + [rows[30]] * 3
    docs = spark.createDataFrame([(*x, 0) for x in rows], "doc_id long, text string, r int")
    assert sorted(map(tuple, remove_repeats(docs).collect()), key=str) == brute(rows)
    assert remove_repeats(docs.limit(0)).count() == 0


def test_hits_across_batches():
    import numpy as np
    import pyarrow as pa

    from flowsight.llm.anchors import _hits

    rows = [(1, 0), (1, 3 << 40), (2, 0), (3, 1 << 40), (3, 1 << 40), (4, 0), (4, 0), (4, 5 << 40), (5, 0)]
    want = [0, 1, 5, 6, 7]
    for size in range(1, 10):
        batches = []
        for at in range(0, len(rows), size):
            h, p = (np.array(c, np.int64) for c in zip(*rows[at : at + size], strict=True))
            ids = np.arange(at, at + len(h))
            batches.append(pa.RecordBatch.from_arrays([pa.array(h), pa.array(ids), pa.array(p)], ["hash", "r", "at"]))
        assert sorted(x for b in _hits(iter(batches)) for x in b.column(0).to_pylist()) == want


def test_packed_blocks_meet():
    import numpy as np
    import pyarrow as pa

    from flowsight.llm import anchors

    r = random.Random(4)
    texts = [" ".join(r.choices("abcdefghijklmnopqrst", k=r.choice([0, 5, 30, 200]))) for _ in range(40)]
    passage = " ".join(f"w{i}" for i in range(40))
    texts += [f"{passage} x{i} y z {passage}" for i in range(30)] + ["x y " * 60]
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(len(texts)) * 7), pa.array(texts)], ["r", "text"])
    where, index, want = {}, set(), set()
    for t, text in enumerate(texts):
        words = text.split()
        for i in range(len(words) - 9):
            block = tuple(words[i : i + 10])
            where.setdefault(block, []).append((7 * t, i))
            index |= {block} if i % 10 == 0 else set()
    for block, places in where.items():
        want |= set(places) if block in index and len(places) > 1 else set()
    with np.errstate(over="ignore"):
        probes = [p for at in range(0, len(texts), 9) for p in anchors._probes(batch.slice(at, 9))]
    # a row for each bucket of a slab, not one for each block
    assert sum(p.num_rows for p in probes) < sum(len(x) for x in where.values()) * 0.9
    table = pa.Table.from_batches(probes)
    table = table.take(np.argsort(table.column("bucket").to_numpy(), kind="stable"))
    for size in (1, 3, 1000):
        found = pa.Table.from_batches(list(anchors._meet(iter(table.combine_chunks().to_batches(max_chunksize=size)))))
        slabs = {}
        for row in found.to_pylist():
            places, texts_of = slabs.setdefault(row["slab"], ([], []))
            places += row["places"] or []
            texts_of += [row["rows"], row["first"]] if row["rows"] else []
        lists = [[x[0] for x in slabs.values()], *([x[1][i] for x in slabs.values()] for i in range(2))]
        kinds = [pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64())]
        hits = pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(lists, kinds, strict=True)], ["places", "rows", "first"])
        got = [(row["r"], p) for b in anchors._places(hits) for row in b.to_pylist() for p in row["places"]]
        assert len(got) == len(want) and set(got) == want


def test_texts_are_shuffled_once(spark):
    from flowsight.llm.anchors import remove_repeats

    text = " ".join(f"w{i}" for i in range(50))
    rows = [(3, text), (3, text), (None, text), (None, text), (2, "x " + text), (None, "y " + text), (5, "z")] + [(9, text)] * 5
    found = remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, found.collect()), key=str) == brute(rows)
    plan = found._jdf.queryExecution().executedPlan().toString()
    final = plan.split("== Initial Plan ==")[0]
    lines = [x for x in final.split("\n") if re.search(r"Exchange hashpartitioning\(r#\d+L, \d+\), REPARTITION_BY_COL", x)]
    assert sorted("ReusedExchange" in x for x in lines) == [False, True, True]
