"""Fusing classifier, threat feeds and rules into one verdict, score and source."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowsight.operators.rules import Rule, with_rule_signals
from flowsight.operators.scoring import attach_predictions
from flowsight.operators.threats import Lookup, with_threat_signals
from flowsight.schema import (
    BENIGN,
    CONFIDENCE_THRESHOLD,
    ESCALATION_SEVERITY,
    UNKNOWN,
    WEIGHT_ML,
    WEIGHT_RULES,
    WEIGHT_THREAT,
)
from flowsight.session import BROADCAST_ROWS

ATTACK = f"(classification not in ({BENIGN}, {UNKNOWN}))"
HAS_TI, HAS_RULE = "has_ti", "has_rule"


def combined_score(ml="{}D", threat="{}D", rules="{}D") -> str:
    """SQL text of the weighted score, clamped to 0..1. Weights are literals or column names."""
    ml_part = (
        f"case when {ATTACK} then confidence when classification = {BENIGN} then 1 - confidence"
        " else 0.0D end"
    )
    total = (
        f"{ml} * ({ml_part}) + {threat} * (case when {HAS_TI} then 1.0D else 0.0D end)"
        f" + {rules} * max_severity"
    )
    return f"least(1.0D, greatest(0.0D, {total}))"


def final_verdict(threshold: str) -> str:
    """SQL text. Attack stands; Benign escalates to Unknown on a feed match, or on a severe rule when
    the classifier is unsure; Unknown stays."""
    severe = f"{HAS_RULE} and max_severity >= {ESCALATION_SEVERITY}D and confidence < {threshold}"
    return (
        f"case when {ATTACK} then classification"
        f" when classification = {BENIGN} and not {HAS_TI} and not ({severe}) then {BENIGN}"
        f" else {UNKNOWN} end"
    )


def detection_source() -> str:
    return (
        f"case when {ATTACK} and {HAS_TI} and {HAS_RULE} then 'Ensemble'"
        f" when {ATTACK} and {HAS_TI} then 'MlPlusThreatIntel'"
        f" when {ATTACK} and {HAS_RULE} then 'MlPlusHeuristic'"
        f" when {ATTACK} then 'MlOnly'"
        f" when {HAS_TI} then 'ThreatIntel'"
        f" when {HAS_RULE} then 'HeuristicRule'"
        " else 'None' end"
    )


def signals_of(detections: DataFrame) -> DataFrame:
    """has_ti, has_rule and max_severity from stored match arrays."""
    keep = [c for c in detections.columns if c not in ("has_ti", "has_rule", "max_severity")]
    return detections.selectExpr(
        *keep,
        "size(ti_matches) > 0 as has_ti",
        "size(rule_matches) > 0 as has_rule",
        "coalesce(array_max(transform(rule_matches, r -> r.severity)), 0.0D) as max_severity",
    )


def fuse(
    signals: DataFrame,
    weights: tuple[float, float, float] = (WEIGHT_ML, WEIGHT_THREAT, WEIGHT_RULES),
    threshold: float = CONFIDENCE_THRESHOLD,
) -> DataFrame:
    """Add verdict, combined_score, source and is_flagged to rows with a classification, confidence,
    has_ti, has_rule and max_severity. Narrow."""
    ml, threat, rules = (f"{float(w)}D" for w in weights)
    return signals.selectExpr(
        "*",
        f"{final_verdict(f'{float(threshold)}D')} as verdict",
        f"{combined_score(ml, threat, rules)} as combined_score",
        f"{detection_source()} as source",
        f"({ATTACK} or {HAS_TI} or {HAS_RULE}) as is_flagged",
    )


def detect(
    flows: DataFrame,
    feeds: DataFrame | Lookup | None = None,
    predictions: DataFrame | None = None,
    *,
    rules: bool | list[Rule] = True,
    combine: bool = True,
    weights: tuple[float, float, float] = (WEIGHT_ML, WEIGHT_THREAT, WEIGHT_RULES),
    threshold: float = CONFIDENCE_THRESHOLD,
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Flows -> detections.

    ``predictions`` (by flow_id) is joined when given; otherwise the flows must already carry
    classification, confidence and probabilities, which needs no join at all. ``rules=False`` fuses
    feeds only; ``combine=False`` reports the classifier alone (score 0).
    """
    scored = flows if predictions is None else attach_predictions(flows, predictions)
    matched = with_threat_signals(scored, feeds, broadcast_rows)
    chosen = {True: None, False: []}[rules] if isinstance(rules, bool) else rules
    signals = with_rule_signals(matched, chosen)
    if combine:
        return fuse(signals, weights, threshold)
    return signals.selectExpr(
        "*",
        "classification as verdict",
        "0.0D as combined_score",
        "'MlOnly' as source",
        f"({ATTACK} or {HAS_TI} or {HAS_RULE}) as is_flagged",
    )


def sweep(signals: DataFrame, settings: list[tuple[float, float, float, float]]) -> DataFrame:
    """Verdicts under several (ml, threat, rules, threshold) settings, counted per setting.

    The settings are exploded from one array literal inside each row, then counted map-side; signals
    (detections, or rows with the columns ``fuse`` needs) are read once and never joined.
    """
    rows = ", ".join(
        f"named_struct('w_ml', {m}D, 'w_threat', {t}D, 'w_rules', {r}D, 'threshold', {c}D)"
        for m, t, r, c in (tuple(map(float, s)) for s in settings)
    )
    each = signals.selectExpr(
        "classification", "confidence", "has_ti", "has_rule", "max_severity", f"inline(array({rows}))"
    )
    return (
        each.selectExpr(
            "w_ml",
            "w_threat",
            "w_rules",
            "threshold",
            f"{final_verdict('threshold')} as verdict",
            f"{combined_score('w_ml', 'w_threat', 'w_rules')} as combined_score",
        )
        .groupBy("w_ml", "w_threat", "w_rules", "threshold", "verdict")
        .agg(
            F.count(F.lit(1)).alias("flows"),
            F.sum("combined_score").alias("score_sum"),
            F.max("combined_score").alias("score_max"),
        )
    )
