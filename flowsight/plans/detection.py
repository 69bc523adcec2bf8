"""End-to-end batch plans: one lazy DataFrame from packets to detections or to a training set."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from flowsight.operators.assemble import assemble_flows
from flowsight.operators.fusion import detect
from flowsight.operators.scoring import normalise, without_model


def analyse(
    packets: DataFrame,
    feeds: DataFrame | None = None,
    score: Callable[[DataFrame], DataFrame] | None = None,
    norm: tuple[list[float], list[float], float] | None = None,
    assemble: dict | None = None,
    **fusion,
) -> DataFrame:
    """Packets -> flows -> scaled -> scored -> matched -> ruled -> fused.

    ``score`` adds classification, confidence and probabilities to flows; without one every flow is
    Unknown. Scoring travels with the flow row, so nothing after assembly is shuffled.
    """
    flows = assemble_flows(packets, **(assemble or {}))
    if norm:
        flows = normalise(flows, *norm)
    scored = score(flows) if score else without_model(flows)
    return detect(scored, feeds, **fusion)


def reanalyse(
    stored_flows: DataFrame,
    feeds: DataFrame | None = None,
    score: Callable[[DataFrame], DataFrame] | None = None,
    **fusion,
) -> DataFrame:
    """Run detection again on stored flows with other feeds, rules, model or weights."""
    old = {
        "classification",
        "confidence",
        "probabilities",
        "ti_matches",
        "rule_matches",
        "max_severity",
        "has_ti",
        "has_rule",
        "verdict",
        "combined_score",
        "source",
        "is_flagged",
    }
    if score is None:
        old -= {"classification", "confidence", "probabilities"}
    fresh = stored_flows.drop(*[c for c in stored_flows.columns if c in old])
    if score is not None:
        fresh = score(fresh)
    elif "classification" not in fresh.columns:
        fresh = without_model(fresh)
    return detect(fresh, feeds, **fusion)
