"""Classifier evaluation and data-set audits.

Input is ``scored``: y_true, y_pred and, where confidence matters, probabilities. Everything per class is
derived from a confusion table of at most classes * classes rows, counted with map-side combine.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowsight.operators.prepare import feature_name, unpivot
from flowsight.operators.ranking import running_totals
from flowsight.schema import CLIP_VALUE, FEATURE_COLUMNS, N_CLASSES, NEAR_ZERO_STD

# rows whose average gives the shift of co-moments
SHIFT_ROWS = 1_000


def confusion(scored: DataFrame, n_classes: int = N_CLASSES) -> DataFrame:
    """(y_true, y_pred, n, share) for every pair of classes; share is of the true class, 0 if absent.

    A row whose true or predicted class lies outside 0 .. n_classes - 1 (such as the unknown class) or is null
    belongs to no cell and is left out of the grid.
    """
    known = " and ".join(f"{c} between 0 and {n_classes - 1}" for c in ("y_true", "y_pred"))
    counted = scored.filter(known).groupBy("y_true", "y_pred").agg(F.count(F.lit(1)).alias("n"))
    cell = f"y_true * {n_classes} + y_pred"
    gathered = counted.agg(
        F.map_from_entries(F.collect_list(F.expr(f"struct({cell}, n)"))).alias("cells")
    )
    grid = gathered.selectExpr(
        "cells", f"explode(sequence(0, {n_classes * n_classes - 1})) as cell"
    ).selectExpr(
        f"cast(cell div {n_classes} as int) as y_true",
        f"cast(cell % {n_classes} as int) as y_pred",
        "coalesce(try_element_at(cells, cell), 0L) as n",
    )
    total = "sum(n) over (partition by y_true)"
    return grid.selectExpr(
        "*", f"case when {total} > 0 then n / cast({total} as double) else 0.0D end as share"
    )


def _per_class(cells: DataFrame) -> DataFrame:
    sides = (
        "inline(array(named_struct('label', y_true, 'support', n, 'predicted', 0L, 'hits',"
        " case when y_true = y_pred then n else 0L end),"
        " named_struct('label', y_pred, 'support', 0L, 'predicted', n, 'hits', 0L)))"
    )
    return (
        cells.selectExpr(sides)
        .groupBy("label")
        .agg(
            F.sum("support").alias("support"),
            F.sum("predicted").alias("predicted"),
            F.sum("hits").alias("hits"),
        )
    )


def class_metrics(scored: DataFrame, n_classes: int = N_CLASSES) -> DataFrame:
    """(label, support, precision, recall, f1, grade); a zero denominator gives 0."""
    ratio = "case when {d} > 0 then {n} / cast({d} as double) else 0.0D end"
    base = _per_class(confusion(scored, n_classes)).selectExpr(
        "label",
        "support",
        f"{ratio.format(n='hits', d='predicted')} as precision",
        f"{ratio.format(n='hits', d='support')} as recall",
        f"{ratio.format(n='2 * hits', d='(support + predicted)')} as f1",
    )
    return base.selectExpr("*", f"{f1_grade('f1')} as grade")


def f1_grade(f1: str) -> str:
    """SQL text. Below 0.5 BAD, below 0.8 WEAK, else GOOD."""
    return f"case when {f1} < 0.5 then 'BAD' when {f1} < 0.8 then 'WEAK' else 'GOOD' end"


def classification_report(scored: DataFrame, n_classes: int = N_CLASSES) -> DataFrame:
    """Macro and support-weighted averages over all classes, with accuracy: one row."""
    per = class_metrics(scored, n_classes)
    hits = F.sum(F.col("recall") * F.col("support"))
    total = F.sum("support")
    weighted = [
        (F.sum(F.col(m) * F.col("support")) / total).alias(f"weighted_{m}")
        for m in ("precision", "recall", "f1")
    ]
    macro = [F.avg(m).alias(f"macro_{m}") for m in ("precision", "recall", "f1")]
    return per.agg(*macro, *weighted, (hits / total).alias("accuracy"), total.alias("support"))


def accuracy(scored: DataFrame) -> DataFrame:
    return scored.agg(F.avg(F.expr("cast(y_true = y_pred as double)")).alias("accuracy"))


def _score_counts(scored: DataFrame, n_classes: int) -> DataFrame:
    """(label, score, pos, neg) per class and distinct score, combined map-side."""
    each = scored.selectExpr("y_true", "posexplode(probabilities) as (label, score)")
    return (
        each.filter(F.col("label") < n_classes)
        .groupBy("label", "score")
        .agg(
            F.count_if(F.col("y_true") == F.col("label")).alias("pos"),
            F.count_if(F.col("y_true") != F.col("label")).alias("neg"),
        )
    )


def _with_totals(counts: DataFrame) -> DataFrame:
    totals = counts.groupBy("label").agg(
        F.sum("pos").alias("all_pos"), F.sum("neg").alias("all_neg")
    )
    return counts.join(F.broadcast(totals), "label")  # one row per class


def roc_points(scored: DataFrame, n_classes: int = N_CLASSES) -> DataFrame:
    """One-vs-rest curve points (label, score, tpr, fpr) of the classes that occur, one per score."""
    ranked = running_totals(_score_counts(scored, n_classes), "label", "score", ["pos", "neg"])
    return (
        _with_totals(ranked)
        .filter("all_pos > 0")
        .selectExpr(
            "label",
            "score",
            "(before_pos + pos) / cast(all_pos as double) as tpr",
            "case when all_neg > 0 then (before_neg + neg) / cast(all_neg as double) else 0.0D end as fpr",
        )
    )


def roc_auc(scored: DataFrame, n_classes: int = N_CLASSES) -> DataFrame:
    """(label, auc) of the classes that occur; ties count one half.

    Pairs are summed exactly in whole half-pairs as DECIMAL, so the result does not depend on order.
    """
    ranked = running_totals(_score_counts(scored, n_classes), "label", "score", ["pos"])
    halves = "cast(neg as decimal(19, 0)) * cast(2 * before_pos + pos as decimal(19, 0))"
    wins = ranked.groupBy("label").agg(
        F.sum(F.expr(halves)).alias("halves"),
        F.sum("pos").alias("all_pos"),
        F.sum("neg").alias("all_neg"),
    )
    return wins.filter("all_pos > 0 and all_neg > 0").selectExpr(
        "label", "cast(halves as double) / (2.0D * all_pos * all_neg) as auc"
    )


def macro_auc(scored: DataFrame, n_classes: int = N_CLASSES) -> DataFrame:
    return roc_auc(scored, n_classes).agg(F.avg("auc").alias("macro_auc"))


def binary_metrics(scored: DataFrame) -> DataFrame:
    """Any attack against benign: missed, false alarms, recall, precision."""
    counts = scored.agg(
        F.count_if(F.expr("y_true > 0 and y_pred = 0")).alias("false_negatives"),
        F.count_if(F.expr("y_true = 0 and y_pred > 0")).alias("false_positives"),
        F.count_if(F.expr("y_true > 0 and y_pred > 0")).alias("hits"),
    )
    share = "case when hits + {m} > 0 then hits / cast(hits + {m} as double) else 0.0D end"
    return counts.selectExpr(
        "false_negatives",
        "false_positives",
        f"{share.format(m='false_negatives')} as recall",
        f"{share.format(m='false_positives')} as precision",
    )


def confidence_analysis(scored: DataFrame) -> DataFrame:
    """Mean confidence when right and wrong, sure errors (> 0.9), unsure hits (< 0.5): one row."""
    with_conf = scored.selectExpr(
        "y_true = y_pred as right", "array_max(probabilities) as confidence"
    )
    right, conf = F.col("right"), F.col("confidence")
    return with_conf.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(right).alias("correct"),
        F.count_if(~right).alias("incorrect"),
        F.coalesce(F.avg(F.when(right, conf)), F.lit(0.0)).alias("mean_correct"),
        F.coalesce(F.avg(F.when(~right, conf)), F.lit(0.0)).alias("mean_incorrect"),
        F.count_if(~right & (conf > 0.9)).alias("sure_errors"),
        F.count_if(right & (conf < 0.5)).alias("unsure_hits"),
    )


def confidence_histogram(scored: DataFrame, bins: int = 50) -> DataFrame:
    """(correct, bin, n) of the confidence over 0..1; the last bin includes 1."""
    slot = f"cast(least({bins - 1}, floor(array_max(probabilities) * {bins})) as int)"
    return (
        scored.selectExpr("y_true = y_pred as correct", f"{slot} as bin")
        .groupBy("correct", "bin")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def missed_attacks(scored: DataFrame, limit: float = 0.1) -> DataFrame:
    """Per attack class present: how often it reads as benign, and whether that exceeds ``limit``."""
    counts = (
        scored.filter("y_true > 0")
        .groupBy("y_true")
        .agg(
            F.count_if(F.col("y_pred") == 0).alias("as_benign"), F.count(F.lit(1)).alias("total")
        )
    )
    return counts.selectExpr("*", "as_benign / cast(total as double) as fn_rate").selectExpr(
        "*", f"fn_rate > {limit!r}D as flagged"
    )


def top_confusions(scored: DataFrame, k: int = 3) -> DataFrame:
    """The ``k`` most frequent wrong classes of each class, with their share of its errors."""
    wrong = (
        scored.filter("y_true <> y_pred")
        .groupBy("y_true", "y_pred")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    ranked = wrong.selectExpr(
        "*",
        "row_number() over (partition by y_true order by n desc, y_pred) as place",
        "100.0D * n / sum(n) over (partition by y_true) as error_pct",
    )
    return ranked.filter(F.col("place") <= k)


# -- data-set audits ---------------------------------------------------------


def class_distribution(
    data: DataFrame,
    label: str = "label",
    splits: Sequence[str] = ("train", "val", "test"),
    n_classes: int = N_CLASSES,
) -> DataFrame:
    """Per class: count and percentage in each split, absent classes included."""
    counts = data.groupBy(label, "split").agg(F.count(F.lit(1)).alias("n"))
    gathered = counts.agg(
        F.collect_list(F.struct(F.col(label).alias("label"), "split", "n")).alias("rows")
    )
    each = gathered.selectExpr("rows", f"explode(sequence(0, {n_classes - 1})) as label")
    out = ["label"]
    for s in splits:
        total = f"aggregate(filter(rows, r -> r.split = '{s}'), 0L, (a, r) -> a + r.n)"
        mine = f"aggregate(filter(rows, r -> r.split = '{s}' and r.label = label), 0L, (a, r) -> a + r.n)"
        out += [
            f"{mine} as {s}_n",
            f"case when {total} > 0 then 100.0D * {mine} / {total} else 0.0D end as {s}_pct",
        ]
    return each.selectExpr(*out)


def imbalance(data: DataFrame, label: str = "label") -> DataFrame:
    """Largest class over smallest non-empty class, and classes under 100 rows: one row."""
    counts = data.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(
        (F.max("n") / F.min("n").cast("double")).alias("ratio"),
        F.count_if(F.col("n") < 100).alias("small_classes"),
    )


def quality_audit(
    data: DataFrame,
    columns: Sequence[str] = FEATURE_COLUMNS,
    clip: float = CLIP_VALUE,
    by: str = "split",
) -> DataFrame:
    """Per split: NaN cells, infinite cells, cells beyond +-clip, zero-variance columns. One pass."""
    per = unpivot(data, columns, by).groupBy(by, "pos").agg(
        F.count_if(F.isnan("x")).alias("nan_cells"),
        F.count_if(F.expr("abs(x) = double('Infinity')")).alias("inf_cells"),
        F.count_if(F.expr(f"abs(x) > {float(clip)!r}D and not isnan(x)")).alias("beyond_cells"),
        F.stddev_pop("x").alias("std"),
    )
    # splits * features rows
    return per.groupBy(by).agg(
        *[F.sum(c).alias(c) for c in ("nan_cells", "inf_cells", "beyond_cells")],
        F.expr(f"cast(count_if(std < {NEAR_ZERO_STD}D) as int) as flat_columns"),
    )


def feature_statistics(data: DataFrame, columns: Sequence[str] = FEATURE_COLUMNS) -> DataFrame:
    """(pos, feature, mean, std, min, max, skew, kurtosis); population moments, excess kurtosis."""
    moments = unpivot(data, columns).groupBy("pos").agg(
        F.avg("x").alias("mean"),
        F.stddev_pop("x").alias("std"),
        F.min("x").alias("min"),
        F.max("x").alias("max"),
        F.skewness("x").alias("skew"),
        F.kurtosis("x").alias("kurtosis"),
    )
    return moments.selectExpr(
        "pos",
        f"{feature_name(columns)} as feature",
        "mean",
        "std",
        "min",
        "max",
        "case when std > 0 then skew else 0.0D end as skew",
        "case when std > 0 then kurtosis else -3.0D end as kurtosis",
    )


def top_features(stats: DataFrame, k: int = 10, largest: bool = True) -> DataFrame:
    """The ``k`` features of largest (or smallest) spread."""
    order = F.desc("std") if largest else F.asc("std")
    return stats.orderBy(order, "pos").limit(k)


def skewed_features(stats: DataFrame, limit: float = 2.0) -> DataFrame:
    return stats.filter(F.abs("skew") > limit)


def feature_histograms(
    data: DataFrame, columns: Sequence[str] = FEATURE_COLUMNS, k: int = 12, bins: int = 80
) -> DataFrame:
    """(feature, bin, n) over the range of each of the ``k`` features of largest variance.

    The first pass brings k rows of ranges to the driver; the second counts, combined map-side.
    """
    stats = feature_statistics(data, columns)
    picked = top_features(stats, k).select("feature", "min", "max").collect()
    slots = []
    for r in picked:
        lo, width = r["min"], r["max"] - r["min"]
        place = f"floor(({r['feature']} - {lo!r}D) * {bins} / {width!r}D)" if width > 0 else "0"
        slots.append(
            f"named_struct('feature', '{r['feature']}',"
            f" 'bin', cast(greatest(0, least({bins - 1}, {place})) as int))"
        )
    each = data.selectExpr(f"inline(array({', '.join(slots)}))")
    return each.groupBy("feature", "bin").agg(F.count(F.lit(1)).alias("n"))


def correlated_pairs(
    data: DataFrame, columns: Sequence[str] = FEATURE_COLUMNS, limit: float | None = 0.95
) -> DataFrame:
    """(a, b, r, n) of feature pairs with abs(r) above ``limit``; n rows have a number in both columns.

    Each pair is judged on its own complete rows: a null or NaN in one column touches only the pairs of that column.
    Every task adds up co-moments of all pairs by matrix products, one row per pair leaves it, and these are summed. A
    pair of fewer than two rows, or with a column constant on them, has no r; with ``limit=None`` it is returned with a
    null r.
    """
    columns = list(columns)
    k = len(columns)
    numbers = data.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)])
    # any shift near the data keeps the sums small; it does not change r
    near = numbers.limit(SHIFT_ROWS).agg(*[F.avg(F.nanvl(c, F.lit(None))).alias(c) for c in numbers.columns]).first()
    shift = np.array([0.0 if x is None else x for x in near])
    left, right = np.triu_indices(k, 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((6, k, k))
        for batch in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]) - shift
            there = (~np.isnan(x)).astype(float)
            x = np.nan_to_num(x, nan=0.0)
            square = x * x
            # rows of both, sum and squares of the left where the right is there and the other way round, products
            sums += [there.T @ there, x.T @ there, there.T @ x, square.T @ there, there.T @ square, x.T @ x]
        parts = [pa.array(s[left, right]) for s in sums]
        yield pa.RecordBatch.from_arrays(
            [pa.array(left.astype(np.int32)), pa.array(right.astype(np.int32)), *parts],
            ["i", "j", "n", "sx", "sy", "sxx", "syy", "sxy"],
        )

    total = numbers.mapInArrow(
        run, "i int, j int, n double, sx double, sy double, sxx double, syy double, sxy double"
    ).groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "sx", "sy", "sxx", "syy", "sxy")])
    spread = {c: f"(s{c}{c} - s{c} * s{c} / n)" for c in "xy"}
    # what is left of a constant column is rounding
    moves = " and ".join(f"{v} > 1e-12D * s{c}{c}" for c, v in spread.items())
    bare = f"(sxy - sx * sy / n) / sqrt({spread['x']} * {spread['y']})"
    r = f"case when n > 1 and {moves} then greatest(-1.0D, least(1.0D, {bare})) end"
    names = f"array({', '.join(repr(c) for c in columns)})"
    pairs = total.selectExpr(
        f"{names}[i] as a", f"{names}[j] as b", f"{r} as r", "cast(n as bigint) as n"
    )
    return pairs if limit is None else pairs.where(f"abs(r) > {float(limit)!r}D")


def temperature_scan(scored: DataFrame, temperatures: Sequence[float]) -> DataFrame:
    """(temperature, log_loss): mean negative log-likelihood after dividing log-probabilities by it."""
    listed = ", ".join(f"{float(t)!r}D" for t in temperatures)
    each = scored.selectExpr(
        "y_true",
        "transform(probabilities, p -> ln(greatest(p, 1e-12D))) as logits",
        f"explode(array({listed})) as temperature",
    )
    total = "aggregate(logits, 0.0D, (a, x) -> a + exp((x - array_max(logits)) / temperature))"
    loss = f"ln({total}) - (logits[y_true] - array_max(logits)) / temperature"
    return each.groupBy("temperature").agg(F.avg(F.expr(loss)).alias("log_loss"))


def best_temperature(scored: DataFrame, temperatures: Sequence[float]) -> DataFrame:
    return temperature_scan(scored, temperatures).orderBy("log_loss", "temperature").limit(1)
