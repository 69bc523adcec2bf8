import random

from tests.llm import test_lines, test_nearcopies
from tests.llm.test_contamination import words
from tests.llm.test_rows import _check_packing


def test_run_against_brute_force(spark, tmp_path):
    import corpus_pipeline
    from flowsight.llm.quality import repetition

    r = random.Random(11)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    text = lambda n: "\n".join(" ".join(word() for _ in range(12)) for _ in range(n))
    items = [(i, " ".join(word() for _ in range(25))) for i in range(3)]
    rows = [(i, text(r.choice([3, 8, 20]))) for i in range(30)]
    rows += [(40, rows[3][1]), (41, rows[4][1].replace("a", "b", 2)), (42, text(2) + "\n" + rows[5][1].split("\n")[1])]
    rows += [(43, text(3) + "\n" + items[1][1]), (44, "spam spam " * 50), (45, None), (46, ""), (47, "short")]
    # the words of another document in one line: no line is alike, the documents are
    rows += [(48, rows[6][1].replace("\n", " "))]
    docs = spark.createDataFrame([(*x, "en", "s", 1) for x in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    good = {x.doc_id for x in repetition(docs).collect() if x.kept}
    assert good == {d for d, _ in rows} - {44, 45, 46, 47}
    left = {d: t for (d, _), t in test_lines.brute([x for x in rows if x[0] in good]).items() if t.strip()}
    assert 40 not in left
    ordered = sorted(left.items())
    groups = test_nearcopies.brute(ordered)
    one = {ordered[i][0] for i in set(groups.values())}
    assert 48 in left and 48 not in one
    spans = {tuple(words(t)[i : i + 10]) for _, t in items for i in range(16)}
    clean = {d for d in one if not any(tuple(words(left[d])[i : i + 10]) in spans for i in range(len(words(left[d]))))}
    assert one - clean == {43}
    # where pieces are cut depends on the partitions; their ids, places and sequences do not
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {x.doc_id for x in out} == clean
    _check_packing(spark, out, [(d, left[d]) for d in clean])

    docs.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/none/benchmark.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
