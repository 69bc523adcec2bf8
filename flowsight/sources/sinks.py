"""Event, alert and training-set sinks."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowsight.functions.names import attack_name, protocol_name, source_name
from flowsight.functions.scalar import binary_verdict, shown
from flowsight.schema import CLIP_VALUE, FLOW_INFO_COLUMNS

# -- events ------------------------------------------------------------------


def to_events(detections: DataFrame) -> DataFrame:
    """Detections -> nested events: flow, classification, matches, verdict, score, source."""
    flow = [
        protocol_name("protocol").alias("protocol") if c == "protocol" else F.col(c)
        for c in FLOW_INFO_COLUMNS
    ]
    ti = F.transform(
        "ti_matches",
        lambda m: F.struct(
            m["ip"].alias("matched_ip"),
            m["feed_name"].alias("feed_name"),
            F.when(m["is_source"], "source").otherwise("destination").alias("direction"),
        ),
    )
    return detections.select(
        F.col("flow_id").alias("flow_index"),
        F.struct(*flow).alias("flow"),
        attack_name("classification").alias("ml_classification"),
        F.col("confidence").alias("ml_confidence"),
        F.col("probabilities").alias("ml_probabilities"),
        ti.alias("ti_matches"),
        "rule_matches",
        binary_verdict("verdict").alias("verdict"),
        "combined_score",
        "source",
    )


def to_json_lines(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct("*")).alias("value"))


# -- alerts ------------------------------------------------------------------


def filter_alerts(detections: DataFrame, mode: str = "flagged") -> DataFrame:
    """"all", "flagged" or "clean"."""
    if mode == "all":
        return detections
    if mode == "flagged":
        return detections.filter("is_flagged")
    if mode == "clean":
        return detections.filter("not is_flagged")
    raise ValueError(f"unknown alert filter: {mode}")


def alert_line():
    """One text line per detection; flagged and clean flows read differently."""
    verdict, source = attack_name("verdict"), source_name("source")
    ends = ["flow_id", "src_ip", "src_port", "dst_ip", "dst_port"]
    return F.when(
        F.col("is_flagged"),
        F.format_string(
            "ALERT flow #%d: %s:%d -> %s:%d verdict=%s confidence=%.3f source=%s",
            *ends,
            verdict,
            shown("confidence"),
            source,
        ),
    ).otherwise(
        F.format_string(
            "CLEAN flow #%d: %s:%d -> %s:%d [%s] confidence=%.3f", *ends, verdict, shown("confidence")
        )
    )


def alert_json(detections: DataFrame) -> DataFrame:
    """One JSON document per alert: timestamp, flow, detection."""
    ti = F.transform(
        "ti_matches",
        lambda m: F.struct(
            m["ip"].alias("ip"),
            m["feed_name"].alias("feed"),
            F.when(m["is_source"], "source").otherwise("destination").alias("direction"),
        ),
    )
    rules = F.transform(
        "rule_matches",
        lambda r: F.struct(r["rule_name"].alias("name"), r["severity"].alias("severity")),
    )
    utc = F.to_utc_timestamp(F.timestamp_micros("end_us"), F.current_timezone())
    stamp = F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    flow = F.struct(
        F.col("src_ip").alias("srcIp"),
        F.col("dst_ip").alias("dstIp"),
        F.col("src_port").alias("srcPort"),
        F.col("dst_port").alias("dstPort"),
        "protocol",
        protocol_name("protocol").alias("protocolName"),
        (F.col("fwd_packets") + F.col("bwd_packets")).alias("packetCount"),
        F.round(F.col("avg_packet_size") * (F.col("fwd_packets") + F.col("bwd_packets")))
        .cast("long")
        .alias("byteCount"),
        F.floor(F.col("duration_us") / 1000).alias("durationMs"),
    )
    detection = F.struct(
        attack_name("verdict").alias("finalVerdict"),
        F.col("combined_score").alias("combinedScore"),
        F.col("source").alias("detectionSource"),
        F.struct(
            attack_name("classification").alias("classification"), "confidence", "probabilities"
        ).alias("ml"),
        ti.alias("threatIntel"),
        rules.alias("heuristicRules"),
    )
    doc = F.struct(stamp.alias("timestamp"), flow.alias("flow"), detection.alias("detection"))
    return detections.select(F.to_json(doc).alias("value"))


def _joined(array: str, field: str):
    return F.array_join(F.transform(array, lambda m: m[field]), ",")


def _escape(c, *marks: str):
    c = F.replace(c, F.lit("\\"), F.lit("\\\\"))
    for mark in marks:
        c = F.replace(c, F.lit(mark), F.lit("\\" + mark))
    return c


def severity_ten(score="combined_score"):
    """Score 0..1 -> 0..10."""
    return F.round(F.col(score) * 10).cast("int")


def syslog_severity(score="combined_score"):
    # Score bands 0.3 / 0.5 / 0.7 / 0.85 -> syslog levels 6..2.
    c = F.col(score)
    return F.when(c < 0.3, 6).when(c < 0.5, 5).when(c < 0.7, 4).when(c < 0.85, 3).otherwise(2)


def _summary():
    return F.format_string(
        "%s detected with %.0f%% ML confidence", attack_name("verdict"), F.col("confidence") * 100
    )


def cef_line(vendor: str = "flowsight", product: str = "flowsight", version: str = "1.0"):
    """Common Event Format line."""
    head = F.concat_ws(
        "|",
        F.lit("CEF:0"),
        F.lit(vendor),
        F.lit(product),
        F.lit(version),
        F.concat(F.lit(f"{vendor}-"), F.col("source"), F.lit("-"), F.col("verdict").cast("string")),
        _escape(attack_name("verdict"), "|"),
        severity_ten().cast("string"),
    )
    pairs = [
        ("src", F.col("src_ip")),
        ("dst", F.col("dst_ip")),
        ("spt", F.col("src_port").cast("string")),
        ("dpt", F.col("dst_port").cast("string")),
        ("proto", F.col("protocol").cast("string")),
        ("cs1", F.format_string("%.2f", shown("confidence"))),
        ("cs1Label", F.lit("mlConfidence")),
        ("cs2", F.col("source")),
        ("cs2Label", F.lit("detectionSource")),
        ("cs3", _escape(_joined("ti_matches", "feed_name"), "=")),
        ("cs3Label", F.lit("threatIntelFeeds")),
        ("cs4", _escape(_joined("rule_matches", "rule_name"), "=")),
        ("cs4Label", F.lit("heuristicRules")),
        ("cn1", F.round(F.col("combined_score") * 100).cast("int").cast("string")),
        ("cn1Label", F.lit("combinedScore")),
        ("msg", _escape(_summary(), "=")),
    ]
    tail = F.concat_ws(" ", *[F.concat(F.lit(k + "="), v) for k, v in pairs])
    return F.concat_ws("|", head, tail)


def leef_line(vendor: str = "flowsight", product: str = "flowsight", version: str = "1.0"):
    """Log Event Extended Format line, tab-separated pairs."""
    head = F.concat_ws(
        "|",
        F.lit("LEEF:2.0"),
        F.lit(vendor),
        F.lit(product),
        F.lit(version),
        F.concat(F.col("source"), F.lit("-"), F.col("verdict").cast("string")),
    )
    pairs = [
        ("src", F.col("src_ip")),
        ("dst", F.col("dst_ip")),
        ("srcPort", F.col("src_port").cast("string")),
        ("dstPort", F.col("dst_port").cast("string")),
        ("proto", protocol_name("protocol")),
        ("sev", F.greatest(severity_ten(), F.lit(1)).cast("string")),
        ("cat", attack_name("verdict")),
        ("reason", _summary()),
    ]
    tail = F.concat_ws("\t", *[F.concat(F.lit(k + "="), v) for k, v in pairs])
    return F.concat_ws("|", head, tail)


# -- streams -----------------------------------------------------------------


def fan_out(stream: DataFrame, writers: Sequence[Callable[[DataFrame, int], None]], checkpoint: str):
    """Start one query that computes each micro-batch once and hands it to every writer."""

    def each(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            for write in writers:
                write(batch, batch_id)
        finally:
            batch.unpersist()

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)


# -- training sets -----------------------------------------------------------


def write_training_set(
    data: DataFrame,
    norm: DataFrame,
    weights: DataFrame,
    out: str,
    labels: dict[str, int],
    clip: float = CLIP_VALUE,
) -> dict:
    """Rows partitioned by split, and one metadata document of bounded size beside them.

    ``norm`` has a row per feature and ``weights`` a row per class; only those reach the driver.
    """
    data.write.mode("overwrite").partitionBy("split").parquet(f"{out}/data")
    params = norm.orderBy("pos").collect()
    sizes = {r["split"]: r["count"] for r in data.groupBy("split").count().collect()}
    meta = {
        "n_classes": len(labels),
        "n_features": len(params),
        "feature_names": [r["feature"] for r in params],
        "normalization": {
            "method": "standard_scaler",
            "means": [r["mean"] for r in params],
            "stds": [r["std"] for r in params],
            "clip_value": clip,
        },
        "label_map": labels,
        "index_to_label": {str(v): k for k, v in labels.items()},
        "class_weights": {
            str(r["label"]): round(r["weight"], 6) for r in weights.orderBy("label").collect()
        },
        "split_sizes": sizes,
    }
    spark = data.sparkSession
    spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.mode(
        "overwrite"
    ).text(f"{out}/metadata")
    return meta
