"""Sessionisation: packets -> packets labelled with the flow they belong to -> flows.

Every packet carries, after labelling, the number of the first packet of its flow, the direction that
flow calls forward, the previous packet of its segment and - on the last packet of a flow - why it closed.
A *segment* is what idle timeout and FIN/RST cut; a *flow* is a piece of at most ``max_packets`` of it.

Two physical routes give the same labels:

* ordinary keys: windows over the canonical key. One shuffle, one sort, any number of window functions.
* hot keys (a flood can put a third of all packets on one 5-tuple): the key is cut by (time, packet id) into
  blocks of about equal depth, each block is labelled alone, and a summary of one row per block - a bounded table -
  carries the open segment from block to block. The packets are then regrouped by flow, at most
  ``max_packets`` rows each, so that no task ever holds a whole hot key.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowsight.operators.features import BEFORE, UPTO, aggregate_flows, flow_measures, over
from flowsight.schema import (
    BATCH_TIMEOUT_US,
    IDLE_THRESHOLD_US,
    MAX_PACKETS,
    TCP,
    TCP_FLAG_BITS,
)

KEY = ["lo_ip", "lo_port", "hi_ip", "hi_port", "protocol"]
USABLE = (
    "src_ip is not null and dst_ip is not null and ts_us is not null and protocol is not null"
)

# close-reason codes; integers keep the flow aggregation in a hash aggregate
REASONS = ["fin_rst", "max_pkts", "timeout", "duration", "finalize"]
FIN_RST, MAX_PKTS, TIMEOUT, DURATION, FINALIZE = range(len(REASONS))

# A key is hot when one task should not hold it: above this many rows, or 1/10,000 of a larger input.
HOT_ROWS = 2_000_000
HOT_SHARE = 10_000
SAMPLE_ROWS = 10_000_000
# cuts of one key that its rows may carry along
LISTED_CUTS = 64
_NO_ID = -(2**63)


def _flow_key() -> list[str]:
    from_lo = "(src_ip < dst_ip or (src_ip = dst_ip and src_port <= dst_port))"
    return [
        f"case when {from_lo} then src_ip else dst_ip end as lo_ip",
        f"case when {from_lo} then src_port else dst_port end as lo_port",
        f"case when {from_lo} then dst_ip else src_ip end as hi_ip",
        f"case when {from_lo} then dst_port else src_port end as hi_port",
        "protocol",
        f"{from_lo} as from_lo",
    ]


def with_flow_key(packets: DataFrame) -> DataFrame:
    """Canonical (unordered) endpoint pair plus ``from_lo``: the packet left the lower endpoint."""
    return packets.selectExpr("*", *[e for e in _flow_key() if e != "protocol"])


def keyed_packets(packets: DataFrame, scope: Sequence[str]) -> DataFrame:
    """Only what assembly reads, so that the shuffle carries nothing else."""
    ends = TCP_FLAG_BITS["fin"] | TCP_FLAG_BITS["rst"]
    return packets.filter(USABLE).selectExpr(
        *scope,
        *_flow_key(),
        "ts_us",
        "pkt_id",
        "ip_header_len + transport_header_len as header_bytes",
        "total_len",
        "greatest(total_len - ip_header_len - transport_header_len, 0) as payload_size",
        "tcp_flags",
        "tcp_window",
        f"protocol = {TCP} and (tcp_flags & {ends}) <> 0 as closes",
    )


# ---------------------------------------------------------------------------
# Hot keys
# ---------------------------------------------------------------------------

_PLACE = "struct<ts_us: bigint, pkt_id: bigint>"


@dataclass(frozen=True)
class HotKeys:
    """Keys too large for one task, each with the (time, packet id) places that cut it into blocks."""

    columns: list[str]
    rows: list[tuple]  # key values + sorted list of the places where blocks start

    def table(self, df: DataFrame) -> DataFrame:
        """Cuts in two levels, so that finding a block costs two short array scans."""
        spark, fields = df.sparkSession, df.schema
        out = []
        for *key, cuts in self.rows:
            width = max(1, math.isqrt(len(cuts)))
            groups = [cuts[i : i + width] for i in range(0, len(cuts), width)]
            out.append((*key, [g[0] for g in groups], groups, width))
        types = ", ".join(f"`{c}` {fields[c].dataType.simpleString()}" for c in self.columns)
        return spark.createDataFrame(
            out, f"{types}, heads array<{_PLACE}>, cuts array<array<{_PLACE}>>, width int"
        )

    def names(self, df: DataFrame) -> DataFrame:
        """The keys alone, each with its number."""
        types = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in self.columns)
        rows = [(*r[:-1], i) for i, r in enumerate(self.rows)]
        return df.sparkSession.createDataFrame(rows, f"{types}, hot_key bigint")

    def n_cuts(self) -> int:
        return sum(len(r[-1]) for r in self.rows)

    def with_block(self, keyed: DataFrame) -> DataFrame:
        """Packets of hot keys with their ``block``. Short lists of cuts travel with their key; long ones would be
        copied and scanned for every packet, so they are searched where the packets are."""
        if max(len(r[-1]) for r in self.rows) <= LISTED_CUTS:
            return keyed.join(F.broadcast(self.table(keyed)), self.columns).withColumn("block", _block())
        # in the order of packets a missing number comes first
        number = F.coalesce("pkt_id", F.lit(_NO_ID))
        block = _searched_block([r[-1] for r in self.rows])("hot_key", "ts_us", number)
        return keyed.join(F.broadcast(self.names(keyed)), self.columns).withColumn("block", block).drop("hot_key")


def find_hot_keys(
    keyed: DataFrame, columns: Sequence[str], hot_rows: int | None = None
) -> HotKeys | None:
    """Keys above the hot limit, with equal-depth cut times; None when there is none.

    The row count alone (file footers, for a parquet scan) settles small inputs. Larger ones are sampled
    to *find* the keys; labels do not depend on which keys are found or where they are cut. At most
    HOT_SHARE keys and 2 * HOT_SHARE blocks can come back, whatever the input size. Cuts fall between
    packets in (time, packet id) order, so packets of one key and one time are divided too.
    """
    columns = list(columns)
    total = keyed.count()
    limit = hot_rows or max(HOT_ROWS, total // HOT_SHARE)
    if total <= limit:
        return None
    share = min(1.0, SAMPLE_ROWS / total)
    probe = keyed.select(*columns, "ts_us", "pkt_id")
    if share < 1.0:
        probe = probe.sample(fraction=share, seed=7)
    counts = probe.groupBy(*columns).count().filter(F.col("count") > limit * share)
    hot = [(*(r[c] for c in columns), r["count"] / math.ceil(r["count"] / (limit * share))) for r in counts.collect()]
    if not hot:
        return None
    types = [f"`{f.name}` {f.dataType.simpleString()}" for f in probe.select(*columns).schema]
    depths = probe.sparkSession.createDataFrame(hot, ", ".join([*types, "depth double"]))
    order = over(columns)
    cuts = (
        probe.join(F.broadcast(depths), columns)
        .selectExpr(*columns, "struct(ts_us, pkt_id) as place", "depth", f"row_number() {order} - 1 as n")
        .filter("n > 0 and floor(n / depth) > floor((n - 1) / depth)")
        .groupBy(*columns)
        .agg(F.sort_array(F.collect_set("place")).alias("places"))
    )
    rows = [
        (*(r[c] for c in columns), [(x["ts_us"], x["pkt_id"]) for x in r["places"]]) for r in cuts.collect()
    ]
    return HotKeys(columns, rows)


def _block() -> Column:
    own = F.struct("ts_us", "pkt_id")
    group = F.size(F.filter("heads", lambda h: h <= own))
    inside = F.size(F.filter(F.element_at("cuts", group), lambda c: c <= own))
    return F.when(group == 0, F.lit(0)).otherwise((group - 1) * F.col("width") + inside)


def _searched_block(cuts: Sequence[Sequence[tuple]]) -> Callable:
    """(number of the key, ts_us, pkt_id) -> how many cuts of that key lie at or before the packet, by halving."""
    ends = np.cumsum([len(c) for c in cuts])
    firsts = ends - [len(c) for c in cuts]
    times = np.array([c[0] for key in cuts for c in key], "int64")
    ids = np.array([_NO_ID if c[1] is None else c[1] for key in cuts for c in key], "int64")

    def search(key: pd.Series, ts_us: pd.Series, pkt_id: pd.Series) -> pd.Series:
        key, ts, own = key.to_numpy("int64"), ts_us.to_numpy("int64"), pkt_id.to_numpy("int64")
        low, high = firsts[key], ends[key]
        while (open_ := low < high).any():
            middle = np.where(open_, (low + high) // 2, 0)
            passed = (times[middle] < ts) | ((times[middle] == ts) & (ids[middle] <= own))
            low = np.where(open_ & passed, middle + 1, low)
            high = np.where(open_ & ~passed, middle, high)
        return pd.Series(low - firsts[key])

    # types as objects: this module's annotations are strings that Spark need not resolve
    search.__annotations__ = dict.fromkeys(("key", "ts_us", "pkt_id", "return"), pd.Series)
    return F.pandas_udf(search, "bigint")


# ---------------------------------------------------------------------------
# Labels
# ---------------------------------------------------------------------------


def _near(keyed: DataFrame, place: Sequence[str], keep: Sequence[str], opens: str) -> DataFrame:
    """Neighbours in arrival order, segment starts, and the running segment head.

    The head packs the number of a segment's first packet and its direction into one LONG.
    """
    w = over(place)
    step = keyed.selectExpr(
        *keep,
        f"cast(row_number() {w} as bigint) as rn",
        f"lag(ts_us) {w} as prev_ts",
        f"lag(closes) {w} as prev_closes",
        f"lead(ts_us) {w} as next_ts",
    ).selectExpr("*", f"{opens} as opens")
    head = "case when opens then rn * 2 + cast(from_lo as bigint) end"
    return step.selectExpr("*", f"max({head}) {over(place, UPTO)} as head")


def _label_by_key(keyed: DataFrame, keys: list[str], timeout_us: int) -> DataFrame:
    opens = f"prev_ts is null or prev_closes or ts_us - prev_ts > {timeout_us}"
    return _near(keyed, keys, keyed.columns, opens)


def _label_by_block(
    keyed: DataFrame, hot: HotKeys, keys: list[str], timeout_us: int
) -> DataFrame:
    """Same columns as ``_label_by_key`` for hot keys, no task holding more than one block."""
    place = [*keys, "block"]
    rows = hot.with_block(keyed)
    opens = f"prev_ts is not null and (prev_closes or ts_us - prev_ts > {timeout_us})"
    local = _near(rows, place, [*keyed.columns, "block"], opens)

    blocks = local.groupBy(*place).agg(
        F.expr("count(1) as n"),
        F.expr("max(case when prev_ts is null then ts_us end) as first_ts"),
        F.expr("max(case when prev_ts is null then cast(from_lo as bigint) end) as first_lo"),
        F.expr("max(case when next_ts is null then ts_us end) as last_ts"),
        F.expr("max(case when next_ts is null then closes end) as last_closes"),
        F.expr("max(head) as last_head"),
    )
    w = f"over (partition by {', '.join(keys)} order by block"
    blocks = (
        blocks.selectExpr(
            "*",
            f"coalesce(sum(n) {w} {BEFORE}), 0L) as offset",
            f"lag(last_ts) {w}) as came_ts",
            f"lag(last_closes) {w}) as came_closes",
            f"lead(first_ts) {w}) as goes_ts",
        )
        .selectExpr(
            "*", f"came_ts is null or came_closes or first_ts - came_ts > {timeout_us} as starts"
        )
        .selectExpr("*", "case when starts then (offset + 1) * 2 + first_lo end as own_head")
        .selectExpr(
            *place,
            "offset",
            "came_ts",
            "goes_ts",
            "starts",
            "coalesce(own_head, "
            f"max(coalesce(offset * 2 + last_head, own_head)) {w} {BEFORE})) as entry",
        )
    )
    # one row per block: at most 2 * HOT_SHARE of them, unless a lower limit was asked for
    joined = local.join(F.broadcast(blocks) if hot.n_cuts() <= 2 * HOT_SHARE else blocks, place)
    return joined.selectExpr(
        *keyed.columns,
        "rn + offset as rn",
        "coalesce(prev_ts, came_ts) as prev_ts",
        "coalesce(next_ts, goes_ts) as next_ts",
        "case when prev_ts is null then starts else opens end as opens",
        "coalesce(offset * 2 + head, entry) as head",
    )


def _finish_labels(
    near: DataFrame, columns: list[str], timeout_us: int, max_packets: int
) -> DataFrame:
    """Positions, size splits and close reasons from the segment head. Narrow."""
    step = near.selectExpr(
        "*",
        f"(rn - shiftright(head, 1)) % {max_packets} as place",
        f"case when next_ts is null then {FINALIZE}"
        f" when next_ts - ts_us > {timeout_us} then {TIMEOUT} end as idle_end",
    )
    full = f"place = {max_packets - 1}"
    return step.selectExpr(
        *[c for c in columns if c != "closes"],
        "rn",
        "from_lo = ((head & 1) = 1) as fwd",
        "rn - place as flow_rn",
        "case when not opens then prev_ts end as seg_prev_ts",
        f"case when closes then {FIN_RST} when {full} then {MAX_PKTS} else idle_end end as reason",
        # a full flow that nothing follows leaves an empty successor behind
        f"case when not closes and {full} then idle_end end as tail_reason",
    )


def label_packets(
    packets: DataFrame,
    *,
    timeout_us: int = BATCH_TIMEOUT_US,
    max_packets: int = MAX_PACKETS,
    max_duration_us: int | None = None,
    scope: Sequence[str] = (),
    hot_rows: int | None = None,
    hot_keys: HotKeys | None = None,
    find_hot: bool = True,
) -> list[tuple[DataFrame, list[str]]]:
    """Labelled packets, as (frame, clustering) pairs: ordinary keys first, hot keys when present.

    ``clustering`` names the columns by which the frame's flows are whole within a partition group.
    """
    keys = [*scope, *KEY]
    keyed = keyed_packets(packets, scope)
    hot = hot_keys or (find_hot_keys(keyed, keys, hot_rows) if find_hot else None)

    def finish(near: DataFrame) -> DataFrame:
        return _finish_labels(near, keyed.columns, timeout_us, max_packets)

    if hot is None:
        parts = [(finish(_label_by_key(keyed, keys, timeout_us)), keys)]
    else:
        names = hot.names(keyed)
        cold = keyed.join(F.broadcast(names), keys, "left_anti")
        parts = [
            (finish(_label_by_key(cold, keys, timeout_us)), keys),
            (finish(_label_by_block(keyed, hot, keys, timeout_us)), [*keys, "flow_rn"]),
        ]
    if max_duration_us:
        from flowsight.operators.duration import split_by_duration

        parts = [
            (
                split_by_duration(df, keys, max_duration_us, max_packets, hot=i > 0),
                [*keys, "flow_rn"],
            )
            for i, (df, _) in enumerate(parts)
        ]
    return parts


def assemble_flows(
    packets: DataFrame,
    *,
    timeout_us: int = BATCH_TIMEOUT_US,
    max_packets: int = MAX_PACKETS,
    idle_threshold_us: int = IDLE_THRESHOLD_US,
    max_duration_us: int | None = None,
    emit_empty_tail: bool = False,
    true_active_periods: bool = False,
    scope: Sequence[str] = (),
    hot_rows: int | None = None,
    hot_keys: HotKeys | None = None,
    find_hot: bool = True,
) -> DataFrame:
    """Packets -> one row per flow: metadata, close reason and the 77 features.

    ``flow_id`` is the packet id of the flow's first packet: unique, and the same on every run.
    ``scope`` adds key columns (a session, a source file) inside which flows are assembled on their own.
    """
    parts = label_packets(
        packets,
        timeout_us=timeout_us,
        max_packets=max_packets,
        max_duration_us=max_duration_us,
        scope=scope,
        hot_rows=hot_rows,
        hot_keys=hot_keys,
        find_hot=find_hot,
    )
    flows = None
    for labelled, clustering in parts:
        measured = flow_measures(labelled, clustering, idle_threshold_us)
        part = aggregate_flows(
            measured, [*scope, *KEY], REASONS, scope, emit_empty_tail, true_active_periods
        )
        flows = part if flows is None else flows.unionByName(part)
    return flows


def flow_diagnostics(flows: DataFrame, received: DataFrame | None = None) -> DataFrame:
    """Counts by close reason; with ``received``, also packets received / parsed / skipped.

    ``received`` is the packet table before unusable rows are dropped.
    """
    reasons = flows.groupBy(F.concat(F.lit("flows_"), F.col("reason")).alias("counter")).agg(
        F.count(F.lit(1)).alias("value")
    )
    if received is None:
        return reasons
    usable = F.expr(USABLE)
    packets = received.agg(
        F.count(F.lit(1)).alias("packets_received"),
        F.count(F.when(usable, 1)).alias("packets_parsed"),
        F.count(F.when(~usable, 1)).alias("packets_skipped"),
    ).unpivot([], ["packets_received", "packets_parsed", "packets_skipped"], "counter", "value")
    return reasons.unionByName(packets)
