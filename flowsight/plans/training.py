"""Training-set plan: labelled packet exports -> split, scaled rows and their parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowsight.operators.assemble import assemble_flows
from flowsight.operators.prepare import (
    LABELS,
    class_weights,
    clean,
    fit_normaliser,
    stratified_split,
    with_label,
)
from flowsight.operators.scoring import normalise
from flowsight.schema import FEATURE_COLUMNS
from flowsight.session import cut_lineage
from flowsight.sources.feeds import norm_lists
from flowsight.sources.packets import parse_packet_rows
from flowsight.sources.sinks import write_training_set


def labelled_flows(rows: DataFrame, root: str) -> DataFrame:
    """Export rows -> flows with a class code. Flows never span files; a file has one label."""
    labelled = with_label(rows, root)
    packets = parse_packet_rows(labelled, "path", "label_code")
    return assemble_flows(packets, scope=["path", "label_code"]).withColumnRenamed(
        "label_code", "label"
    )


def build_training_set(rows: DataFrame, root: str, out: str | None = None) -> dict:
    """Split, scale and weigh; write when ``out`` is given. Flows are cut from their lineage once,
    because splitting, fitting and writing each read them."""
    flows = cut_lineage(clean(labelled_flows(rows, root)))
    split = stratified_split(flows, order="xxhash64(path, flow_id, 42)", key=("path", "flow_id"))
    train = split.filter("split = 'train'")
    norm = fit_normaliser(train)
    means, stds = norm_lists(norm)
    data = normalise(split, means, stds).select("label", "split", *FEATURE_COLUMNS)
    weights = class_weights(train)
    meta = write_training_set(data, norm, weights, out, LABELS) if out else None
    return {"data": data, "norm": norm, "weights": weights.orderBy(F.col("label")), "meta": meta}
