"""Hunting over stored flows and detections: search, indicators, correlation, timeline, baseline."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowsight.functions.scalar import in_network
from flowsight.operators.threats import with_threat_signals
from flowsight.session import broadcast_if_small
from flowsight.sources.feeds import parse_feed_lines

WINDOW_US = 300_000_000
MIN_FLOWS = 3
# Private IPv4 blocks 10/8, 172.16/12 and 192.168/16.
PRIVATE = r"^(10|192\.168|172\.(1[6-9]|2[0-9]|3[01]))\."


# -- search ------------------------------------------------------------------


def search_filter(
    start_us: int | None = None,
    end_us: int | None = None,
    src_ip: str | None = None,
    dst_ip: str | None = None,
    any_ip: str | None = None,
    src_port: int | None = None,
    dst_port: int | None = None,
    any_port: int | None = None,
    protocol: int | None = None,
    verdict: int | None = None,
    flagged: bool = False,
    min_score: float | None = None,
    source: str | None = None,
) -> Column:
    """Conjunction of the given criteria; address criteria take single addresses or CIDR blocks."""
    c, parts = F.col, []
    if start_us is not None:
        parts.append(c("start_us") >= start_us)
    if end_us is not None:
        parts.append(c("start_us") <= end_us)
    if src_ip:
        parts.append(in_network("src_ip", src_ip))
    if dst_ip:
        parts.append(in_network("dst_ip", dst_ip))
    if any_ip:
        parts.append(in_network("src_ip", any_ip) | in_network("dst_ip", any_ip))
    if src_port is not None:
        parts.append(c("src_port") == src_port)
    if dst_port is not None:
        parts.append(c("dst_port") == dst_port)
    if any_port is not None:
        parts.append((c("src_port") == any_port) | (c("dst_port") == any_port))
    if protocol is not None:
        parts.append(c("protocol") == protocol)
    if verdict is not None:
        parts.append(c("verdict") == verdict)
    if flagged:
        parts.append(c("is_flagged"))
    if min_score is not None:
        parts.append(c("combined_score") >= min_score)
    if source:
        parts.append(c("source") == source)
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def search(
    flows: DataFrame,
    order_by: Sequence[str] = ("start_us desc", "flow_id"),
    limit: int | None = None,
    offset: int = 0,
    **criteria,
) -> DataFrame:
    """Matching flows in order; ``limit`` makes it one page, a top-k per partition and one merge."""
    found = flows.filter(search_filter(**criteria))
    found = found.orderBy(*[F.expr(o.split()[0]).desc() if o.endswith("desc") else F.expr(o) for o in order_by])
    found = found.offset(offset) if offset else found
    return found if limit is None else found.limit(limit)


def distinct_values(flows: DataFrame, field: str, limit: int | None = None) -> DataFrame:
    """All values of a field, the most frequent first; ``limit`` makes it a report of so many rows."""
    counted = flows.groupBy(field).agg(F.count(F.lit(1)).alias("flows")).orderBy(F.desc("flows"), field)
    return counted if limit is None else counted.limit(limit)


def field_summary(flows: DataFrame, field: str, *by: str) -> DataFrame:
    """Count, minimum, maximum, total and average of a numeric field."""
    return flows.groupBy(*by).agg(
        F.count(field).alias("n"),
        F.min(field).alias("least"),
        F.max(field).alias("most"),
        F.sum(field).alias("total"),
        F.avg(field).alias("average"),
    )


def indicator_search(
    flows: DataFrame,
    indicators: DataFrame | None = None,
    ports: Sequence[int] = (),
    start_us: int | None = None,
    end_us: int | None = None,
    side: str = "any",
) -> DataFrame:
    """Flows that touch an indicator: addresses and blocks in ``indicators(line)``, or a listed port.

    The time range is applied before the lookup, so it prunes what is scanned.
    """
    if side not in ("any", "src", "dst"):
        raise ValueError(f"unknown side: {side}")
    within = flows.filter(search_filter(start_us=start_us, end_us=end_us))
    listed = ", ".join(map(str, ports)) or "null"
    tests = {"src": f"src_port in ({listed})", "dst": f"dst_port in ({listed})"}
    hit = {
        "src": "exists(ti_matches, m -> m.is_source)",
        "dst": "exists(ti_matches, m -> not m.is_source)",
    }
    sides = ["src", "dst"] if side == "any" else [side]
    feeds = None
    if indicators is not None:
        feeds = parse_feed_lines(indicators.selectExpr("'indicator' as feed_name", "line"))
    matched = with_threat_signals(within, feeds)
    where = " or ".join([f"coalesce({tests[s]}, false)" for s in sides] + [hit[s] for s in sides])
    return matched.filter(where).select(*flows.columns)


# -- correlation -------------------------------------------------------------


def _private(ip: str) -> Column:
    return F.col(ip).rlike(PRIVATE)


def _windowed(flows: DataFrame, window_us: int) -> DataFrame:
    return flows.withColumn("window_us", F.expr(f"start_us - start_us % {window_us}"))


def _grouped(flows: DataFrame, by: Sequence[str], window_us: int, min_flows: int) -> DataFrame:
    groups = _windowed(flows, window_us).groupBy("window_us", *by)
    return groups.agg(F.count(F.lit(1)).alias("flows")).filter(F.col("flows") >= min_flows)


def same_source(flows: DataFrame, window_us: int = WINDOW_US, min_flows: int = MIN_FLOWS):
    return _grouped(flows, ["src_ip"], window_us, min_flows)


def same_target(flows: DataFrame, window_us: int = WINDOW_US, min_flows: int = MIN_FLOWS):
    return _grouped(flows, ["dst_ip"], window_us, min_flows)


def close_in_time(flows: DataFrame, window_us: int = WINDOW_US, min_flows: int = MIN_FLOWS):
    return _grouped(flows, [], window_us, min_flows)


def _swept(flows: DataFrame, field: str, window_us: int, least: int) -> DataFrame:
    """Distinct values per source and window: pairs are made distinct map-side before counting."""
    pairs = (
        _windowed(flows, window_us)
        .groupBy("window_us", "src_ip", field)
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return (
        pairs.groupBy("window_us", "src_ip")
        .agg(F.count(F.lit(1)).alias("targets"), F.sum("n").alias("flows"))
        .filter(F.col("targets") >= least)
    )


def port_sweep(flows: DataFrame, window_us: int = WINDOW_US, least: int = MIN_FLOWS) -> DataFrame:
    return _swept(flows, "dst_port", window_us, least)


def network_sweep(flows: DataFrame, window_us: int = WINDOW_US, least: int = MIN_FLOWS) -> DataFrame:
    return _swept(flows, "dst_ip", window_us, least)


def lateral_movement(
    detections: DataFrame, window_us: int = WINDOW_US, internal=_private
) -> DataFrame:
    """Internal flows whose source was the target of a flagged outside flow in the preceding window.

    Attacks shrink to (host, slot, first, last) with map-side combine. A flow at t needs an attack in
    [t - window, t]: the first one of its own slot, or the last one of the slot before, settles it -
    an equi-join without a range condition and without multiplying rows.
    """
    attacks = (
        detections.filter(F.col("is_flagged") & ~internal("src_ip") & internal("dst_ip"))
        .withColumn("slot", F.expr(f"start_us div {window_us}"))
        .groupBy(F.col("dst_ip").alias("host"), "slot")
        .agg(F.min("start_us").alias("first_us"), F.max("start_us").alias("last_us"))
    )
    attacks = broadcast_if_small(attacks)
    inside = detections.filter(internal("src_ip") & internal("dst_ip")).withColumn(
        "slot", F.expr(f"start_us div {window_us}")
    )
    own = attacks.selectExpr("host as src_ip", "slot", "first_us")
    before = attacks.selectExpr("host as src_ip", "slot + 1 as slot", "last_us")
    joined = inside.join(own, ["src_ip", "slot"], "left").join(before, ["src_ip", "slot"], "left")
    hit = f"first_us <= start_us or last_us >= start_us - {window_us}"
    return joined.filter(hit).select(*detections.columns)


def timeline(
    detections: DataFrame,
    window_us: int = WINDOW_US,
    exfiltration_bytes: int = 10_000_000,
    sweep: int = 20,
    repeats: int = 3,
    internal=_private,
) -> DataFrame:
    """(src_ip, at_us, event, detail) of the six event kinds; order by src_ip, at_us to read it."""
    first = detections.groupBy("src_ip").agg(F.min("start_us").alias("at_us"))
    size = "fwd_packets * avg_packet_size"
    windows = _windowed(detections, window_us).groupBy("src_ip", "dst_ip", "window_us").agg(
        F.min("start_us").alias("at_us")
    )
    repeated = windows.groupBy("src_ip", "dst_ip").agg(
        F.count(F.lit(1)).alias("n"), F.min("at_us").alias("at_us")
    )
    parts = [
        first.selectExpr("src_ip", "at_us", "'FirstContact' as event", "'' as detail"),
        port_sweep(detections, window_us, sweep).selectExpr(
            "src_ip",
            "window_us as at_us",
            "'Reconnaissance' as event",
            "concat(targets, ' ports') as detail",
        ),
        detections.filter("classification not in (0, 16)").selectExpr(
            "src_ip", "start_us as at_us", "'Exploitation' as event", "dst_ip as detail"
        ),
        lateral_movement(detections, window_us, internal).selectExpr(
            "src_ip", "start_us as at_us", "'LateralMovement' as event", "dst_ip as detail"
        ),
        detections.filter(internal("src_ip") & ~internal("dst_ip"))
        .filter(f"{size} >= {exfiltration_bytes}")
        .selectExpr("src_ip", "start_us as at_us", "'Exfiltration' as event", "dst_ip as detail"),
        repeated.filter(F.col("n") >= repeats).selectExpr(
            "src_ip", "at_us", "'Persistence' as event", "dst_ip as detail"
        ),
    ]
    return reduce(DataFrame.unionByName, parts)


# -- baseline ----------------------------------------------------------------

MINUTE_US = 60_000_000


def per_minute(flows: DataFrame) -> DataFrame:
    return flows.groupBy(F.expr(f"start_us div {MINUTE_US}").alias("minute")).agg(
        F.count(F.lit(1)).alias("flows"),
        F.sum(F.expr("fwd_packets + bwd_packets")).alias("packets"),
        F.sum(F.expr("(fwd_packets + bwd_packets) * avg_packet_size")).alias("bytes"),
    )


def traffic_baseline(flows: DataFrame) -> DataFrame:
    """One row: per-minute means and deviations over active minutes, mean and deviation of duration."""
    volume = per_minute(flows).agg(
        *[F.avg(c).alias(f"{c}_mean") for c in ("flows", "packets", "bytes")],
        *[F.stddev_pop(c).alias(f"{c}_std") for c in ("flows", "packets", "bytes")],
    )
    duration = flows.agg(
        F.avg("duration_us").alias("duration_mean"), F.stddev_pop("duration_us").alias("duration_std")
    )
    both = volume.withColumn("one", F.lit(1)).join(duration.withColumn("one", F.lit(1)), "one")
    return both.drop("one")


def value_frequency(flows: DataFrame, field: str) -> DataFrame:
    """(value, flows): how often each port, address or protocol occurs."""
    return flows.groupBy(F.col(field).cast("string").alias("value")).agg(
        F.count(F.lit(1)).alias("flows")
    )


def volume_anomalies(current: DataFrame, baseline: DataFrame, sigma: float = 3.0) -> DataFrame:
    """Minutes of ``current`` whose volume lies at least ``sigma`` deviations above the baseline."""
    base = baseline.first()
    rows = []
    for c in ("flows", "packets", "bytes"):
        mean, std = base[f"{c}_mean"], base[f"{c}_std"]
        if std:
            rows.append(
                f"named_struct('metric', '{c}', 'observed', cast({c} as double), 'expected', {mean!r}D,"
                f" 'sigma', (cast({c} as double) - {mean!r}D) / {std!r}D)"
            )
    if not rows:
        rows = ["named_struct('metric', '', 'observed', 0D, 'expected', 0D, 'sigma', -1D)"]
    each = per_minute(current).selectExpr("minute", f"inline(array({', '.join(rows)}))")
    return each.filter(F.col("sigma") >= sigma)


def duration_anomalies(current: DataFrame, baseline: DataFrame, sigma: float = 3.0) -> DataFrame:
    base = baseline.first()
    mean, std = base["duration_mean"], base["duration_std"]
    score = f"(duration_us - {mean!r}D) / {std!r}D" if std else "0.0D"
    return current.selectExpr("flow_id", "duration_us", f"{score} as sigma").filter(
        F.abs("sigma") >= sigma
    )


def new_values(current: DataFrame, history: DataFrame, field: str) -> DataFrame:
    """Ports, addresses or protocols never seen in ``history``, with their flow counts."""
    seen = history.select(field).distinct()
    fresh = current.groupBy(field).agg(F.count(F.lit(1)).alias("flows"))
    return fresh.join(seen, field, "left_anti")


def byte_ratio_anomalies(
    current: DataFrame,
    ratio: float = 10.0,
    sent: str = "total_length_of_fwd_packets",
    received: str = "total_length_of_bwd_packets",
) -> DataFrame:
    """Flows that send at least ``ratio`` times the bytes they receive; a one-way flow counts as receiving one byte."""
    return current.filter(f"{sent} > 0 and {sent} >= {float(ratio)!r}D * greatest(coalesce({received}, 0), 1)").select(
        "flow_id", sent, received
    )
