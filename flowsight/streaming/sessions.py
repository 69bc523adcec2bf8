"""Stateful sessionisation of a packet stream, in state whose parts are read only when they are due.

State per canonical 5-tuple: the packets that the watermark has not passed, in blocks of at most ``BLOCK_ROWS`` keyed
by time bucket, and one ``OpenFlow`` of constant size. A timer stands at the end of every bucket that holds packets:
when the watermark reaches it, that bucket alone is read, ordered and fed to the open flow. A micro-batch that only
adds packets reads none. Idle flows end by a timer as well, at the first bucket end past the idle timeout.

When a session stops, ``flush_sessions`` reads what is left from the state store and closes it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from flowsight.operators.assemble import KEY, REASONS, keyed_packets
from flowsight.operators.features import flows_from_aggregates
from flowsight.schema import IDLE_THRESHOLD_US, LIVE_MAX_DURATION_US, LIVE_TIMEOUT_US, MAX_PACKETS
from flowsight.streaming.accumulate import (
    PACKET,
    PACKET_FIELDS,
    Limits,
    OpenFlow,
    advance,
    closed_flow_schema,
    closed_frame,
    expire,
    finish,
)

BUCKET_MS = 1_000
BLOCK_ROWS = 512
# packets of one 5-tuple that are put in order at once before they go to their buckets; 45 bytes each
HELD_ROWS = 400_000
_KEY_TYPES = "lo_ip string, lo_port int, hi_ip string, hi_port int, protocol int"


def _packed(pdf: pd.DataFrame) -> np.ndarray:
    out = np.empty(len(pdf), PACKET)
    for name in PACKET_FIELDS:
        out[name] = pdf[name].to_numpy()
    return out


class FlowSessions(StatefulProcessor):
    """Packets wait in buckets behind the watermark; due buckets go into the open flow of their 5-tuple."""

    def __init__(self, limits: Limits, bucket_ms: int = BUCKET_MS, block_rows: int = BLOCK_ROWS):
        self.limits, self.bucket_ms, self.block_rows = limits, bucket_ms, block_rows

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.blocks = handle.getMapState("blocks", "bucket bigint", "n int")
        self.waiting = handle.getMapState("waiting", "bucket bigint, block int", "packets binary")
        self.open = handle.getValueState("open", "flow binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        # a call to the store costs more than a packet, so frames are gathered: one call a bucket and not one a frame
        held, n = [], 0
        for pdf in rows:
            held.append(_packed(pdf))
            n += len(pdf)
            if n >= HELD_ROWS:
                self._sort_out(np.concatenate(held))
                held, n = [], 0
        if n:
            self._sort_out(np.concatenate(held))
        return iter(())

    def _sort_out(self, packets: np.ndarray) -> None:
        bucket = packets["ts_us"] // (self.bucket_ms * 1000)
        order = np.argsort(bucket, kind="stable")
        packets, bucket = packets[order], bucket[order]
        cuts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
        for at, to in zip(cuts, np.append(cuts[1:], len(bucket)), strict=True):
            self._wait(int(bucket[at]), packets[at:to])

    def _wait(self, bucket: int, packets: np.ndarray) -> None:
        known = self.blocks.containsKey((bucket,))
        n = self.blocks.getValue((bucket,))[0] if known else 0
        for at in range(0, len(packets), self.block_rows):
            self.waiting.updateValue((bucket, n), (packets[at : at + self.block_rows].tobytes(),))
            n += 1
        self.blocks.updateValue((bucket,), (n,))
        if not known:
            self.handle.registerTimer((bucket + 1) * self.bucket_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now_ms = expiredTimerInfo.getExpiryTimeInMs()
        flow = OpenFlow.from_bytes(self.open.get()[0]) if self.open.exists() else OpenFlow()
        done = list(advance(flow, self._due(now_ms // self.bucket_ms - 1), tuple(key), self.limits))
        done += expire(flow, tuple(key), now_ms * 1000, self.limits)
        if flow.seg["live"]:
            if flow.seg["timer_ms"] <= now_ms:
                # at a bucket end, so that every packet before it has been seen by then
                last = flow.seg["last_ts"] + self.limits.timeout_us
                flow.seg["timer_ms"] = (last // (self.bucket_ms * 1000) + 1) * self.bucket_ms
                self.handle.registerTimer(flow.seg["timer_ms"])
            self.open.update((flow.to_bytes(),))
        elif self.open.exists():
            self.open.clear()
        if done:
            yield closed_frame(done)

    def _due(self, bucket: int) -> np.ndarray:
        if not self.blocks.containsKey((bucket,)):
            return np.zeros(0, PACKET)
        parts = []
        for block in range(self.blocks.getValue((bucket,))[0]):
            parts.append(np.frombuffer(self.waiting.getValue((bucket, block))[0], PACKET))
            self.waiting.removeKey((bucket, block))
        self.blocks.removeKey((bucket,))
        return np.concatenate(parts)

    def close(self) -> None:
        pass


def closed_flow_stream(
    packets: DataFrame, limits: Limits, watermark: str = "5 seconds", bucket_ms: int = BUCKET_MS
) -> DataFrame:
    """Packet stream (with event time ``ts``) -> aggregates of closed flows.

    Packets wait until the watermark passes their bucket, so arrival order inside it does not matter; later ones are
    dropped and counted by Spark. Needs the RocksDB state store.
    """
    keyed = keyed_packets(packets.withWatermark("ts", watermark), ["ts"])
    return keyed.groupBy(*KEY).transformWithStateInPandas(
        statefulProcessor=FlowSessions(limits, bucket_ms),
        outputStructType=closed_flow_schema(),
        outputMode="Append",
        timeMode="EventTime",
    )


def session_limits(
    timeout_us: int = LIVE_TIMEOUT_US,
    max_packets: int = MAX_PACKETS,
    max_duration_us: int | None = LIVE_MAX_DURATION_US,
    idle_threshold_us: int = IDLE_THRESHOLD_US,
) -> Limits:
    return Limits(timeout_us, max_packets, max_duration_us, idle_threshold_us)


def flows_of(closed: DataFrame, true_active_periods: bool = False) -> DataFrame:
    """Aggregates of closed flows -> flows with metadata and features, by the expressions of the batch route."""
    return flows_from_aggregates(closed, REASONS, true_active_periods)


def stream_flows(
    packets: DataFrame,
    on_flows: Sequence[Callable[[DataFrame, int], None]],
    checkpoint: str,
    enrich: Callable[[DataFrame], DataFrame] | None = None,
    watermark: str = "5 seconds",
    true_active_periods: bool = False,
    bucket_ms: int = BUCKET_MS,
    **limits,
):
    """Writer of a live session: flows of each micro-batch, enriched, to every sink in ``on_flows``.

    ``enrich`` is any batch DataFrame -> DataFrame, such as scoring followed by ``detect``. Start it with
    ``.trigger(...).start()``. Sinks get the batch id, so a repeated batch can overwrite itself.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        hand_out(flows_of(batch, true_active_periods), on_flows, batch_id, enrich)

    closed = closed_flow_stream(packets, session_limits(**limits), watermark, bucket_ms)
    return closed.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)


def hand_out(
    flows: DataFrame,
    writers: Sequence[Callable[[DataFrame, int], None]],
    batch_id: int,
    enrich: Callable[[DataFrame], DataFrame] | None = None,
) -> None:
    """Compute the flows of one batch once and give them to every writer."""
    out = (enrich(flows) if enrich else flows).persist()
    try:
        for write in writers:
            write(out, batch_id)
    finally:
        out.unpersist()


# -- the end of a session ------------------------------------------------------


def _state(spark: SparkSession, checkpoint: str, name: str) -> DataFrame:
    reader = spark.read.format("statestore").option("path", checkpoint)
    return reader.option("stateVarName", name).load()


def flush_sessions(
    spark: SparkSession, checkpoint: str, true_active_periods: bool = False, **limits
) -> DataFrame:
    """Flows that were open, or whose packets were waiting, when the query over ``checkpoint`` stopped.

    The query must be at rest. Waiting packets are taken in order and whatever is open in the end closes as
    ``finalize``. Blocks of one 5-tuple are read one bucket after another, so memory holds one bucket. The state itself
    stays as it is: after a flush, begin the next session with a new checkpoint.
    """
    rules = session_limits(**limits)
    keys = [F.col(f"key.{c}").alias(c) for c in KEY]
    held = _state(spark, checkpoint, "open").select(
        *keys, F.lit(None).cast("bigint").alias("bucket"), F.lit(0).alias("block"), F.col("value.flow").alias("body")
    )
    left = _state(spark, checkpoint, "waiting").select(
        *keys, "user_map_key.bucket", "user_map_key.block", F.col("user_map_value.packets").alias("body")
    )

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, flow, bucket, parts = None, OpenFlow(), None, []

        def through() -> list[tuple]:
            done = list(advance(flow, np.concatenate(parts), key, rules)) if parts else []
            parts.clear()
            return done

        for frame in frames:
            done = []
            for *now, number, _, body in frame.astype(object).itertuples(index=False, name=None):
                now = tuple(now)
                if now != key:
                    if key is not None:
                        done += [*through(), *finish(flow, key)]
                    key, flow, bucket = now, OpenFlow(), None
                if pd.isna(number):
                    flow = OpenFlow.from_bytes(body)
                    continue
                if number != bucket:
                    done += through()
                    bucket = number
                parts.append(np.frombuffer(body, PACKET))
            if done:
                yield closed_frame(done)
        if key is not None:
            yield closed_frame([*through(), *finish(flow, key)])

    both = held.unionByName(left).repartition(*KEY).sortWithinPartitions(*KEY, F.asc_nulls_first("bucket"), "block")
    return flows_of(both.mapInPandas(run, closed_flow_schema()), true_active_periods)
