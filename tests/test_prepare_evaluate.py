import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from flowsight.operators import evaluate as E
from flowsight.operators import prepare as P
from flowsight.operators.hunt import port_sweep
from flowsight.operators.moving import group_members, moving_groups
from flowsight.operators.ranking import number_rows, running_totals


def rows(spark, n=3000):
    return spark.range(n).selectExpr(
        "id as flow_id", "case when id < 7 then 3 when id % 3 = 0 then 1 else 0 end as label", "cast(id as double) as a", "1.5D as b"
    )


def test_split_is_exact_per_class_and_repeatable(spark):
    s = P.stratified_split(rows(spark))
    got = {(r.label, r.split): r["count"] for r in s.groupBy("label", "split").count().collect()}
    for label, n in [(0, 1996), (1, 997)]:
        held = math.floor(n * 0.3 + 0.5)
        assert got[(label, "test")] == math.ceil(held / 2)
        assert got[(label, "val")] == held - math.ceil(held / 2)
        assert got[(label, "train")] == n - held
    assert got[(3, "train")] == 7 and (3, "val") not in got
    again = P.stratified_split(rows(spark).repartition(7)).join(s.withColumnRenamed("split", "other"), "flow_id")
    assert again.filter("split = other").count() == 3000


def test_cleaning_and_scaling(spark):
    df = spark.createDataFrame([(1.0, 1.0), (float("nan"), 1.0), (float("inf"), 1.0), (None, 1.0), (3.0, 1.0)], "a double, b double")
    c = P.clean(df, ["a", "b"])
    assert [r.a for r in c.collect()] == [1.0, 3.0]
    fit = {r.feature: (r.mean, r["std"]) for r in P.fit_normaliser(c, ["a", "b"]).collect()}
    assert fit == {"a": (2.0, 1.0), "b": (1.0, 1.0)}  # population spread; a flat column counts as 1
    assert tuple(P.clipped_cells(c, [0.0, 1.0], [1.0, 1.0], 2.0, ["a", "b"]).first()) == (1, 4)


def test_weights(spark):
    w = {r.label: r.weight for r in P.class_weights(rows(spark, 1000)).collect()}
    assert len(w) == 16 and w[5] == 0 and w[3] == pytest.approx(1000 / (16 * 7))
    counts = spark.createDataFrame([(c,) for c, n in [(0, 1000), (1, 500), (2, 1)] for _ in range(n)], "label int")
    s = {r.label: r.weight for r in P.sampling_weights(counts, factor=50.0).collect()}
    assert s == {0: 1 / 1000, 1: 1 / 500, 2: pytest.approx(50 / 500)}


def scored(spark):
    data = [(0, 0, 0.9), (0, 1, 0.6), (1, 1, 0.8), (1, 0, 0.95), (2, 2, 0.4), (2, 0, 0.7)]
    out = [(t, p, [c if i == p else (1 - c) / 15 for i in range(16)]) for t, p, c in data]
    return spark.createDataFrame(out, "y_true int, y_pred int, probabilities array<double>")


def test_confusion_and_report(spark):
    s = scored(spark)
    grid = {(r.y_true, r.y_pred): (r.n, r.share) for r in E.confusion(s).collect()}
    assert len(grid) == 256 and grid[(2, 0)] == (1, 0.5) and grid[(9, 9)] == (0, 0.0)
    m = {r.label: r for r in E.class_metrics(s).collect()}
    assert (m[0].precision, m[0].recall, m[0].f1, m[0].grade) == (pytest.approx(1 / 3), 0.5, 0.4, "BAD")
    assert (m[7].precision, m[7].support) == (0.0, 0)
    r = E.classification_report(s).first()
    assert r.accuracy == 0.5 == E.accuracy(s).first()[0] and r.macro_recall == pytest.approx(1.5 / 16)
    b = E.binary_metrics(s).first()
    assert (b.false_negatives, b.false_positives, b.recall, b.precision) == (2, 1, 0.5, pytest.approx(2 / 3))


def test_auc_against_all_pairs(spark):
    s = scored(spark)
    got = {r.label: r.auc for r in E.roc_auc(s).collect()}
    data = [(r.y_true, r.probabilities) for r in s.collect()]
    for label in (0, 1, 2):
        pos = [p[label] for t, p in data if t == label]
        neg = [p[label] for t, p in data if t != label]
        want = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))
        assert got[label] == pytest.approx(want)
    last = E.roc_points(s).filter("label = 1").orderBy("score").first()
    assert (last.tpr, last.fpr) == (1.0, 1.0)


def test_numbers_and_totals_against_plain_python(spark):
    # one value fills most of the table: ranges divide it by the row's place
    df = spark.range(5000).selectExpr("id", "id % 3 as g", "cast(if(id % 10 < 7, 4, (id * 7919) % 5003) as long) as v")
    rows = df.repartition(7)
    got = sorted((r.number, r.v) for r in number_rows(rows, ["v"]).collect())
    assert [n for n, _ in got] == list(range(1, 5001)) and [v for _, v in got] == sorted(v for _, v in got)
    assert number_rows(rows, ["v"]).columns == ["id", "g", "v", "number"]
    down = {r.id: r.number for r in number_rows(rows, ["g", F.desc("id")]).collect()}
    assert down[4998] == 1 and down[1] == 3334 and down[2] == 5000
    once = df.groupBy("g", "v").agg(F.count("*").alias("n"), F.sum("id").alias("ids"))
    table = [tuple(r) for r in once.collect()]
    want = {(g, v): tuple(sum(r[i] for r in table if r[0] == g and r[1] > v) for i in (2, 3)) for g, v, _, _ in table}
    out = running_totals(once.repartition(5), "g", "v", ["n", "ids"])
    assert {(r.g, r.v): (r.before_n, r.before_ids) for r in out.collect()} == want
    assert number_rows(df.limit(0), ["v"]).count() == running_totals(once.limit(0), "g", "v", ["n"]).count() == 0


def test_totals_read_their_input_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def tap(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    df = spark.range(300).selectExpr("id", "id % 2 as g").mapInArrow(tap, "id long, g long")
    assert running_totals(df, "g", "id", ["id"]).count() == 300 and seen.value == 300
    assert number_rows(df, ["id"]).count() == 300 and seen.value == 600


def moving(rows, window):
    """Most distinct values in any window that ends at a sighting, per key: (first time of 3, most, when)."""
    out = {}
    for k in {r[0] for r in rows}:
        own = sorted((t, v) for key, v, t in rows if key == k)
        at = [(t, len({v for s, v in own if t - window < s <= t})) for t in sorted({t for t, _ in own})]
        hits = [(t, n) for t, n in at if n >= 3]
        if hits:
            most = max(n for _, n in hits)
            out[k] = (hits[0][0], most, next(t for t, n in hits if n == most))
    return out


@pytest.mark.parametrize("seed", range(4))
def test_moving_windows_against_brute_force(spark, seed):
    r = random.Random(seed)
    rows = [(r.choice("ab"), r.randrange(9), r.randrange(0, 900, r.choice([1, 10]))) for _ in range(250)] + [("c", 1, 5)] * 4
    df = spark.createDataFrame(rows, "src_ip string, port int, start_us long")
    for window in (7, 40, 300):
        got = moving_groups(df, ["src_ip"], "port", window, 3)
        assert {g.src_ip: (g.first_us, g.most, g.most_us) for g in got.collect()} == moving(rows, window)
        members = group_members(df, got, ["src_ip"], window).collect()
        for k, (first, _, _) in moving(rows, window).items():
            assert sorted((m.port, m.start_us) for m in members if m.src_ip == k) == sorted(
                (v, t) for key, v, t in rows if key == k and first - window < t <= first
            )
    alone = moving_groups(df, [], "port", 40, 3).collect()
    assert [(g.first_us, g.most, g.most_us) for g in alone] == list(moving([("", v, t) for _, v, t in rows], 40).values())


def test_a_burst_across_a_window_edge_is_found(spark):
    edge = 300_000_000
    df = spark.createDataFrame([("s", p, edge - 2 + p, p) for p in range(4)], "src_ip string, dst_port int, start_us long, flow_id int")
    (hit,) = moving_groups(df, ["src_ip"], "dst_port", edge, 4).collect()
    assert (hit.first_us, hit.most) == (edge + 1, 4)
    assert port_sweep(df, edge, 4).count() == 0  # fixed windows cut it in two
    assert moving_groups(df, ["src_ip"], "dst_port", 3, 4).count() == 0  # (t - 3, t] holds three of them
    empty = df.limit(0)
    assert moving_groups(empty, [], "dst_port", edge, 1).count() == 0
    nulls = df.selectExpr("src_ip", "if(dst_port = 1, null, dst_port) as dst_port", "if(dst_port = 2, null, start_us) as start_us")
    assert moving_groups(nulls, ["src_ip"], "dst_port", edge, 1).first().most == 2


def test_confidence_and_confusions(spark):
    s = scored(spark)
    c = E.confidence_analysis(s).first()
    assert (c.total, c.correct, c.sure_errors, c.unsure_hits) == (6, 3, 1, 1)
    assert c.mean_correct == pytest.approx(0.7)
    missed = {r.y_true: (r.as_benign, r.total, r.flagged) for r in E.missed_attacks(s).collect()}
    assert missed == {1: (1, 2, True), 2: (1, 2, True)}
    assert [(r.y_true, r.y_pred, r.error_pct) for r in E.top_confusions(s).orderBy("y_true").collect()] == [(0, 1, 100.0), (1, 0, 100.0), (2, 0, 100.0)]


def test_statistics(spark):
    df = rows(spark, 100)
    st = {r.feature: r for r in E.feature_statistics(df, ["a", "b"]).collect()}
    assert st["a"].mean == 49.5 and st["b"]["std"] == 0 and st["b"].skew == 0 and st["a"].kurtosis == pytest.approx(-1.2002, abs=1e-3)
    bins = E.feature_histograms(df, ["a", "b"], k=1, bins=10).collect()
    assert sorted((r.feature, r.bin, r.n) for r in bins) == [("a", i, 10) for i in range(10)]
    both = df.selectExpr("a", "a * 2 + 1 as c", "b")
    assert [(r.a, r.b) for r in E.correlated_pairs(both, ["a", "c", "b"]).collect()] == [("a", "c")]
    assert E.best_temperature(scored(spark), [0.5, 1.0, 2.0, 4.0]).first().temperature in (0.5, 1.0, 2.0, 4.0)


def test_confusion_leaves_unknown_classes_out(spark):
    from flowsight.operators.evaluate import confusion

    rows = [(0, 16), (1, 0), (1, 0), (16, 3), (None, 1), (2, None)]
    cells = confusion(spark.createDataFrame(rows, "y_true int, y_pred int")).filter("n > 0").collect()
    assert [(c.y_true, c.y_pred, c.n, c.share) for c in cells] == [(1, 0, 2, 1.0)]


def test_split_keeps_null_labels(spark):
    from flowsight.operators.prepare import stratified_split

    rows = spark.range(100).selectExpr("id as flow_id", "if(id % 2 = 0, null, 1) as label")
    out = stratified_split(rows)
    assert out.columns == ["flow_id", "label", "split"]
    assert out.select("flow_id").distinct().count() == out.count() == 100


def test_class_weight_keeps_rows_outside_the_table(spark):
    from flowsight.operators.train import with_class_weight

    rows = spark.createDataFrame([(1,), (99,), (None,)], "label int")
    out = with_class_weight(rows, spark.createDataFrame([(1, 2.5)], "label int, weight double"))
    assert sorted(((r.label or 0), r.weight) for r in out.collect()) == [(0, 1.0), (1, 2.5), (99, 1.0)]


def test_correlation_of_gaps_and_constants(spark):
    from flowsight.operators.evaluate import correlated_pairs

    rows = [(1.0, 2.0, 5.0), (2.0, 4.0, 5.0), (3.0, 6.0, 5.0), (None, 1.0, 5.0), (float("nan"), 9.0, 5.0)]
    data = spark.createDataFrame(rows, "a double, b double, c double")
    found = {(r.a, r.b): r.r for r in correlated_pairs(data, ["a", "b", "c"], None).collect()}
    assert abs(found["a", "b"] - 1.0) < 1e-9 and found["a", "c"] is None and found["b", "c"] is None
    assert [(r.a, r.b) for r in correlated_pairs(data, ["a", "b", "c"]).collect()] == [("a", "b")]


def test_a_gap_touches_only_its_own_pairs(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(1e6, 1.0, (400, 4))
    x[:, 1] += x[:, 0]
    plain = pd.DataFrame(x, columns=list("abcd"))
    gaps = plain.copy()
    gaps.loc[gaps.index % 3 == 0, "a"] = np.nan
    want = gaps.corr()
    found = {}
    for name, data in (("plain", plain), ("gaps", gaps)):
        df = spark.createDataFrame(data).repartition(5)
        found[name] = {(r.a, r.b): (r.r, r.n) for r in E.correlated_pairs(df, list("abcd"), None).collect()}
    for (a, b), (r, n) in found["gaps"].items():
        assert r == pytest.approx(want.loc[a, b], rel=1e-6) and n == (266 if a == "a" else 400)
        if a != "a":
            assert r == pytest.approx(found["plain"][a, b][0], rel=1e-12) and n == found["plain"][a, b][1]
