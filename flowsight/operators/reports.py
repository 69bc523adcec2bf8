"""Display views and session summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowsight.functions.names import attack_name, protocol_name, source_name, with_application
from flowsight.functions.scalar import risk_band, shown
from flowsight.operators.ranking import number_rows
from flowsight.schema import ATTACK_NAMES, N_CLASSES


def flow_report(detections: DataFrame) -> DataFrame:
    """The ten display columns, numbered by flow id, plus the risk band."""
    # only what is shown goes through the ranking
    views = detections.select(
        "flow_id",
        "src_ip",
        "src_port",
        "dst_ip",
        "dst_port",
        protocol_name("protocol").alias("protocol"),
        attack_name("verdict").alias("verdict"),
        F.format_string("%.1f%%", shown("confidence") * 100).alias("ml_confidence"),
        F.format_string("%.3f", shown("combined_score")).alias("combined_score"),
        source_name("source").alias("detection_source"),
        risk_band("combined_score", "is_flagged").alias("risk"),
    )
    numbered = number_rows(views, ["flow_id"])
    return numbered.select("number", *[c for c in views.columns if c != "flow_id"])


def packet_report(packets: DataFrame, interface: str = "") -> DataFrame:
    """Number, interface, protocol, application, addresses; a zero port shows as "-"."""
    port = lambda c: F.when(F.col(c) != 0, F.col(c).cast("string")).otherwise("-")
    views = with_application(packets).select(
        "ts_us",
        "pkt_id",
        F.lit(interface).alias("interface"),
        protocol_name("protocol").alias("protocol"),
        "application",
        "src_ip",
        port("src_port").alias("src_port"),
        "dst_ip",
        port("dst_port").alias("dst_port"),
    )
    numbered = number_rows(views, ["ts_us", "pkt_id"])
    return numbered.select("number", *[c for c in views.columns if c not in ("ts_us", "pkt_id")])


def explode_probabilities(detections: DataFrame) -> DataFrame:
    """One row per flow and class, with the percentage text."""
    each = detections.selectExpr("flow_id", "posexplode(probabilities) as (class, probability)")
    return each.filter(F.col("class") < N_CLASSES).select(
        "flow_id",
        "class",
        attack_name("class").alias("name"),
        "probability",
        F.format_string("%.2f%%", shown("probability") * 100).alias("percentage"),
    )


def explode_ti(detections: DataFrame) -> DataFrame:
    return detections.selectExpr("flow_id", "inline(ti_matches)").selectExpr(
        "flow_id",
        "ip",
        "feed_name",
        "case when is_source then 'Source' else 'Destination' end as direction",
    )


def explode_rules(detections: DataFrame) -> DataFrame:
    return detections.selectExpr("flow_id", "inline(rule_matches)").select(
        "flow_id",
        "rule_name",
        F.format_string("%.2f", shown("severity")).alias("severity"),
        "description",
    )


def session_counts(detections: DataFrame, *by: str) -> DataFrame:
    """Total, flagged and clean flows, overall or by columns such as a session id."""
    return detections.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if("is_flagged").alias("flagged"),
        F.count_if(~F.col("is_flagged")).alias("clean"),
    )


def verdict_histogram(detections: DataFrame) -> DataFrame:
    return (
        detections.groupBy("verdict")
        .agg(F.count(F.lit(1)).alias("flows"), F.count_if("is_flagged").alias("flagged"))
        .select(attack_name("verdict").alias("verdict"), "flows", "flagged")
    )


def analysis_summary(detections: DataFrame) -> DataFrame:
    """One row: flows analysed, flagged, and a map of attack class -> count.

    Counted per class first, so the map is built from at most 17 rows.
    """
    names = ", ".join(f"'{n}'" for n in ATTACK_NAMES)
    per = detections.groupBy("verdict").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("is_flagged").alias("f")
    )
    entry = f"struct(element_at(array({names}), verdict + 1) as name, n)"
    return per.agg(
        F.sum("n").alias("total_analyzed"),
        F.sum("f").alias("flagged_count"),
        F.expr(f"map_from_entries(collect_list({entry}))").alias("attack_counts"),
    )
