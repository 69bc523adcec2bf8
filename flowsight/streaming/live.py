"""Live detection: packets in, detections in every sink exactly once; and rules that only a stream can time."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowsight.operators.fusion import detect
from flowsight.operators.scoring import without_model
from flowsight.operators.threats import Lookup, prepare_lookup
from flowsight.streaming.sessions import flush_sessions, hand_out, stream_flows

Writer = Callable[[DataFrame, int | str], None]
FLUSH = "flush"


class TableSink:
    """A table of one folder per micro-batch. A batch that is run again overwrites its own folder, so rows are there once."""

    def __init__(self, path: str, shape: Callable[[DataFrame], DataFrame] | None = None) -> None:
        self.path, self.shape = path.rstrip("/"), shape

    def __call__(self, df: DataFrame, batch_id: int | str) -> None:
        out = self.shape(df) if self.shape else df
        out.write.mode("overwrite").parquet(f"{self.path}/batch={batch_id}")

    def read(self, spark: SparkSession) -> DataFrame:
        return spark.read.option("basePath", self.path).parquet(f"{self.path}/batch=*").drop("batch")


class LiveDetection:
    """Packet stream -> sessions -> scores -> detections -> sinks.

    Feeds are prepared once, before the first batch, and every batch probes that table. Sinks are called one after the
    other with the batch id; if one fails the query fails, and the restarted query runs the same batch again for all of
    them. A sink that keeps one result per batch id, such as ``TableSink``, therefore holds each flow exactly once.
    """

    def __init__(
        self,
        sinks: Sequence[Writer],
        checkpoint: str,
        feeds: DataFrame | None = None,
        score: Callable[[DataFrame], DataFrame] = without_model,
        watermark: str = "5 seconds",
        fusion: dict | None = None,
        **limits,
    ) -> None:
        self.sinks, self.checkpoint, self.watermark, self.limits = list(sinks), checkpoint, watermark, limits
        self.score, self.fusion = score, fusion or {}
        self.lookup: Lookup | None = prepare_lookup(feeds, keep=True) if feeds is not None else None

    def enrich(self, flows: DataFrame) -> DataFrame:
        return detect(self.score(flows), self.lookup, **self.fusion)

    def writer(self, packets: DataFrame):
        """The query over ``packets`` (with event time ``ts``), to be started with a trigger."""
        return stream_flows(
            packets, self.sinks, self.checkpoint, self.enrich, watermark=self.watermark, **self.limits
        )

    def flush(self, spark: SparkSession) -> None:
        """After the query has stopped: close what was open and hand it to every sink under the batch id ``flush``."""
        hand_out(flush_sessions(spark, self.checkpoint, **self.limits), self.sinks, FLUSH, self.enrich)


def stream_port_scan(
    flows: DataFrame,
    window: str = "5 minutes",
    threshold: int = 20,
    time: str = "ts",
    watermark: str | None = "1 minute",
) -> DataFrame:
    """Sources that reach many destination ports inside a window, as (window_start, src_ip, distinct_ports, severity).

    Two stages of state, both of fixed-size rows: distinct (window, source, port), then their count. On a stream a
    window is reported once, when the watermark has passed its end; rows that come later are dropped and counted by
    Spark. A table (``watermark=None``) gives every window.
    """
    timed = flows.withWatermark(time, watermark) if watermark else flows
    ports = timed.groupBy(F.window(time, window).alias("window"), "src_ip", "dst_port").agg(F.count("*").alias("n"))
    found = ports.groupBy("window", "src_ip").agg(F.count("dst_port").alias("distinct_ports"))
    return found.filter(F.col("distinct_ports") >= threshold).selectExpr(
        "window.start as window_start",
        "src_ip",
        "distinct_ports",
        f"least(1.0D, distinct_ports / {float(threshold * 3)}D) as severity",
    )
