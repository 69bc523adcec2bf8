import random
import zlib

import numpy as np
import pytest
from tests.llm.test_rows import CASES

from flowsight.llm import discriminant as D

SF = "/root/testdata/sf0.01"


def corpus(n, seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("aeioulnrst") for _ in range(r.randint(2, 8)))
    rows, labels = [], []
    for i in range(n):
        words = [word() for _ in range(r.randint(15, 200))]
        good = i % 4 != 0
        if not good:
            kind = r.randrange(3)
            words = [w + "$$$" for w in words] if kind == 0 else words[:2] * 40 if kind == 1 else [w.upper() + "!!" for w in words]
        rows.append((i, ". ".join(" ".join(words[j : j + 9]) for j in range(0, len(words), 9))))
        labels.append((i, int(good)))
    return rows, labels


def test_held_out_accuracy_and_odd_rows(spark):
    rows, known = corpus(400, 5)
    odd = [(None if d is None else 5000 + d, t) for d, t in CASES]
    docs = spark.createDataFrame([(*r, "x", 1.0) for r in rows + odd + rows[:3]], "doc_id long, text string, label string, score double")
    labels = spark.createDataFrame(
        [(*x, "y") for x in known] + [(known[0][0], known[0][1], "y"), (None, 1, "y"), (5001, None, "y")], "doc_id long, quality int, text string"
    )
    out = D.classify(docs.repartition(4), labels)
    assert out.columns == ["doc_id", "held_out", "score", "predicted"]
    got = out.collect()
    assert len(got) == 400 + len(odd) + 3
    truth = dict(known)
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(held) > 50 and np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.95
    assert len({r.score for r in got if r.doc_id == 1}) == 1
    assert D.classify(docs.limit(0), labels).collect() == []
    with pytest.raises(ValueError, match="training rows"):
        D.classify(docs, labels.limit(0)).collect()


def test_held_out_labels_never_train(spark):
    rows, known = corpus(200, 9)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    flip = [(d, 1 - y if zlib.crc32(str(d).encode()) % 5 == 0 else y) for d, y in known]
    first, second = (
        {r.doc_id: r.score for r in D.classify(docs, spark.createDataFrame(x, "doc_id long, quality int")).collect()}
        for x in (known, flip)
    )
    assert first == second


def test_moments_and_densities_against_numpy(spark):
    rows, known = corpus(120, 3)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    table = D.statistics(docs).toPandas().set_index("doc_id").loc[[d for d, _ in rows]].to_numpy()
    y = np.array([v for _, v in known])
    labelled = D.statistics(docs).join(spark.createDataFrame(known, "doc_id long, label int"), "doc_id").repartition(5)
    found = D.moments(labelled)
    for c in (0, 1):
        x = table[y == c]
        assert found[c][0] == len(x)
        np.testing.assert_allclose(found[c][1], x.sum(0))
        np.testing.assert_allclose(found[c][2], x.T @ x)
    model = D.fit(found)
    for c in (0, 1):
        cov = model.factors[c] @ model.factors[c].T
        gap = table - table[y == c].mean(0)
        want = np.log((y == c).mean()) - 0.5 * np.linalg.slogdet(cov)[1] - 0.5 * np.einsum("ij,ij->i", gap @ np.linalg.inv(cov), gap)
        np.testing.assert_allclose(model.densities(table)[:, c], want, rtol=1e-6, atol=1e-6)
    # next to no shrinkage: the factor is that of the class covariance itself
    raw = D.fit(found, 0.0, 1e-6)
    np.testing.assert_allclose(raw.factors[1] @ raw.factors[1].T, np.cov(table[y == 1].T, bias=True), atol=1e-4)


def test_statistics_of_a_text():
    text = "One two two TWO\n$$ #x | y!\nOne two two TWO\n"
    slab = D.T.Slab(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text)]))
    with np.errstate(over="ignore"):
        row = dict(zip(D.STATISTICS, D._statistics(slab)[0], strict=True))
    share = lambda part, whole, usual, weight: np.log((x := (part + usual * weight) / (whole + weight)) / (1 - x))
    assert row["log_words"] == pytest.approx(np.log(13))
    assert row["upper"] == pytest.approx(share(8, 26, 0.03, 60))
    assert row["symbols"] == pytest.approx(share(3, 31, 0.002, 100))
    assert row["bars"] == pytest.approx(share(1, 31, 0.002, 100))
    assert row["marks"] == pytest.approx(share(1, 31, 0.002, 100))
    assert row["same_neighbours"] == pytest.approx(share(4, 12, 0.005, 20))
    assert row["repeated_words"] == pytest.approx(share(6, 12, 0.2, 20))
    assert row["repeated_lines"] == pytest.approx(share(12, 31, 0.01, 100))
