"""Per-packet measures inside a flow and the one aggregation that yields metadata and 77 features.

Expressions are SQL text: a flow needs about sixty aggregates, and handing Spark one string each keeps
the plan quick to build from Python.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowsight.schema import (
    FEATURE_COLUMNS,
    FEATURE_NAMES,
    FLOW_INFO_COLUMNS,
    MIN_BULK_PACKETS,
    TCP,
    TCP_FLAG_BITS,
)


def over(clustering: Sequence[str], frame: str = "") -> str:
    """Window text: packets of one clustering group in arrival order."""
    return f"over (partition by {', '.join(clustering)} order by ts_us, pkt_id {frame})"


UPTO = "rows between unbounded preceding and current row"
BEFORE = "rows between unbounded preceding and 1 preceding"


def flow_measures(
    labelled: DataFrame, clustering: Sequence[str], idle_threshold_us: int
) -> DataFrame:
    """Gaps and bulk runs of each packet. Windows partition by ``clustering``: no shuffle of its own.

    A bulk run is carried by its last packet, which knows the packet number and the running byte total
    at the run's start, so runs need neither a self join nor a second grouping.
    """
    w, upto, before = over(clustering), over(clustering, UPTO), over(clustering, BEFORE)
    keep = labelled.columns
    step = labelled.selectExpr(
        *keep,
        "rn = flow_rn as opens",
        "ts_us - seg_prev_ts as gap",
        f"sum(total_len) {upto} as bytes_upto",
        f"last(case when fwd then struct(rn, ts_us) end, true) {before} as last_fwd",
        f"last(case when not fwd then struct(rn, ts_us) end, true) {before} as last_bwd",
        f"lag(fwd) {w} as prev_fwd",
        f"lead(fwd) {w} as next_fwd",
    )
    run_start = (
        "case when opens or prev_fwd <> fwd then struct(rn, bytes_upto - total_len as bytes) end"
    )
    step = step.selectExpr(
        *keep,
        "opens",
        "gap",
        "bytes_upto",
        "reason is not null or next_fwd <> fwd as run_ends",
        "case when fwd then last_fwd else last_bwd end as same",
        f"last({run_start}, true) {upto} as run",
    )
    bulk = f"run_ends and rn - run.rn + 1 >= {MIN_BULK_PACKETS}"
    return step.selectExpr(
        *keep,
        "opens",
        "case when same.rn >= flow_rn then ts_us - same.ts_us end as dir_gap",
        f"case when gap > {idle_threshold_us} then gap end as idle_gap",
        "case when gap > 0 then gap end as flow_gap",
        f"case when {bulk} then rn - run.rn + 1 end as bulk_packets",
        f"case when {bulk} then bytes_upto - run.bytes end as bulk_bytes",
    )


def _moments(prefix: str, value: str) -> list[str]:
    return [
        f"count({value}) as {prefix}_n",
        f"sum({value}) as {prefix}_sum",
        f"max({value}) as {prefix}_max",
        f"min({value}) as {prefix}_min",
        f"var_samp({value}) as {prefix}_var",
    ]


def _of(direction: str, value: str) -> str:
    return f"case when {direction} then {value} end"


def _has(flag: str, extra: str = "true") -> str:
    return f"count_if(protocol = {TCP} and {extra} and (tcp_flags & {TCP_FLAG_BITS[flag]}) <> 0)"


def _aggregates(direction_names=(("f", "fwd"), ("b", "not fwd"))) -> list[str]:
    out = [
        "max(case when opens then pkt_id end) as flow_id",
        "max(case when opens then coalesce(seg_prev_ts, ts_us) end) as start_us",
        "max(ts_us) as end_us",
        "max(case when reason is not null then pkt_id end) as last_pkt_id",
        "max(from_lo = fwd) as lo_is_src",
        "max(reason) as reason",
        "max(tail_reason) as tail_reason",
        "var_samp(total_len) as al_var",
        *_moments("gap", "flow_gap"),
        *_moments("idle", "idle_gap"),
        *[f"{_has(f)} as n_{f}" for f in ("fin", "syn", "rst", "ack", "cwr", "ece")],
    ]
    for p, cond in direction_names:
        # the first non-zero window: smallest packet number, window in the low 16 bits
        window = f"case when {cond} and protocol = {TCP} and tcp_window > 0 then rn * 65536 + tcp_window end"
        out += [
            *_moments(f"{p}l", _of(cond, "cast(total_len as bigint)")),
            *_moments(f"{p}gap", _of(cond, "dir_gap")),
            f"sum({_of(cond, 'header_bytes')}) as {p}_header",
            f"{_has('psh', cond)} as {p}_psh",
            f"{_has('urg', cond)} as {p}_urg",
            f"count({_of(cond, 'bulk_packets')}) as {p}_bulks",
            f"sum({_of(cond, 'bulk_packets')}) as {p}_bulk_packets",
            f"sum({_of(cond, 'bulk_bytes')}) as {p}_bulk_bytes",
            f"min({window}) as {p}_window",
        ]
    data = f"fwd and protocol = {TCP} and payload_size > 0"
    return [
        *out,
        f"count_if({data}) as f_data",
        f"min(case when {data} then payload_size end) as f_min_payload",
    ]


def aggregate_flows(
    measured: DataFrame,
    keys: Sequence[str],
    reasons: Sequence[str],
    scope: Sequence[str] = (),
    emit_empty_tail: bool = False,
    true_active_periods: bool = False,
) -> DataFrame:
    """One hash aggregation per flow. Every buffer is a fixed-width number, so it never sorts."""
    aggs = _aggregates()
    if true_active_periods:
        measured = _with_bursts(measured, keys)
        aggs += _moments("burst", "burst")
    flat = measured.groupBy(*keys, "flow_rn").agg(*map(F.expr, aggs))
    if emit_empty_tail:
        flat = _with_empty_tails(flat, keys)
    return _describe(flat, reasons, scope, true_active_periods)


def _with_bursts(measured: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Length of each busy period that an idle gap ends (opt-in; the default reports zeros)."""
    before = over([*keys, "flow_rn"], BEFORE)
    began = (
        "last(case when idle_gap is not null then ts_us when opens then coalesce(seg_prev_ts, ts_us) end, true)"
    )
    return measured.selectExpr(
        "*",
        f"case when idle_gap is not null and not opens then seg_prev_ts - {began} {before} end as burst",
    )


def _with_empty_tails(flat: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Add the packet-less flow left after a full flow that nothing follows, in the same pass."""
    both = flat.selectExpr(
        "*",
        "explode(case when tail_reason is null then array(false) else array(false, true) end) as is_tail",
    )
    shared = {*keys, "flow_rn", "lo_is_src", "end_us", "tail_reason", "last_pkt_id"}
    special = {
        "flow_id": "-1 - last_pkt_id",
        "start_us": "end_us",
        "reason": "tail_reason",
    }
    zeroed = ("_n", "_psh", "_urg", "_bulks", "_data")
    columns = []
    for name in flat.columns:
        if name in shared:
            columns.append(name)
        elif name in special:
            columns.append(f"case when is_tail then {special[name]} else {name} end as {name}")
        elif name.startswith("n_") or name.endswith(zeroed):
            columns.append(f"case when is_tail then 0L else {name} end as {name}")
        else:
            columns.append(f"case when not is_tail then {name} end as {name}")
    return both.selectExpr(*columns)


def _ratio(n: str, d: str) -> str:
    return f"case when {d} > 0 then cast({n} as double) / {d} else 0.0D end"


def _rate(n: str) -> str:
    return f"case when duration > 0 then {n} / (duration / 1e6D) else 0.0D end"


def _or0(name: str) -> str:
    return f"coalesce({name}, 0)"


def _std(p: str) -> str:
    return f"sqrt(coalesce({p}_var, 0.0D))"


def _mean(p: str) -> str:
    return _ratio(f"{p}_sum", f"{p}_n")


def _period(p: str) -> list[str]:
    """mean, std, max, min; zeros when nothing was measured."""
    return [_mean(p), _std(p), _or0(f"{p}_max"), _or0(f"{p}_min")]


def _bulk(p: str) -> list[str]:
    return [
        _ratio(f"{p}_bulk_bytes", f"{p}_bulks"),
        _ratio(f"{p}_bulk_packets", f"{p}_bulks"),
        f"case when {p}_bulks > 0 then {_rate(f'{p}_bulk_bytes')} else 0.0D end",
    ]


def _describe(
    flat: DataFrame, reasons: Sequence[str], scope: Sequence[str], true_active_periods: bool
) -> DataFrame:
    flat = flat.selectExpr(
        "*",
        "greatest(end_us - start_us, 0L) as duration",
        "fl_n + bl_n as n",
        "coalesce(fl_sum, 0L) + coalesce(bl_sum, 0L) as size",
        "coalesce(fl_sum, 0L) as f_bytes",
        "coalesce(bl_sum, 0L) as b_bytes",
        "coalesce(f_header, 0L) as f_head",
        "coalesce(b_header, 0L) as b_head",
        "case when lo_is_src then hi_port else lo_port end as dst_port",
    )
    values = [
        "dst_port",
        "duration",
        "fl_n",
        "bl_n",
        "f_bytes",
        "b_bytes",
        *[_or0("fl_max"), _or0("fl_min"), _mean("fl"), _std("fl")],
        *[_or0("bl_max"), _or0("bl_min"), _mean("bl"), _std("bl")],
        _rate("size"),
        _rate("n"),
        *_period("gap"),
        _or0("fgap_sum"),
        *_period("fgap"),
        _or0("bgap_sum"),
        *_period("bgap"),
        *["f_psh", "b_psh", "f_urg", "b_urg"],
        "f_head",
        "b_head",
        _rate("fl_n"),
        _rate("bl_n"),
        "coalesce(least(fl_min, bl_min), 0)",
        "coalesce(greatest(fl_max, bl_max), 0)",
        _ratio("size", "n"),
        _std("al"),
        "case when n > 1 then al_var * (n - 1) / n else 0.0D end",
        *["n_fin", "n_syn", "n_rst", "f_psh + b_psh", "n_ack", "f_urg + b_urg", "n_cwr", "n_ece"],
        _ratio("bl_n", "fl_n"),
        _ratio("size", "n"),
        _ratio("(f_bytes - f_head)", "fl_n"),
        _ratio("(b_bytes - b_head)", "bl_n"),
        *_bulk("f"),
        *_bulk("b"),
        "fl_n",
        "f_bytes",
        "bl_n",
        "b_bytes",
        "coalesce(f_window % 65536, 0)",
        "coalesce(b_window % 65536, 0)",
        "f_data",
        _or0("f_min_payload"),
        *(_period("burst") if true_active_periods else ["0"] * 4),
        *_period("idle"),
    ]
    assert len(values) == len(FEATURE_NAMES)
    names = ", ".join(f"'{r}'" for r in reasons)
    return flat.selectExpr(
        *scope,
        "flow_id",
        "case when lo_is_src then lo_ip else hi_ip end as src_ip",
        "case when lo_is_src then hi_ip else lo_ip end as dst_ip",
        "case when lo_is_src then lo_port else hi_port end as src_port",
        "dst_port",
        "protocol",
        "fl_n as fwd_packets",
        "bl_n as bwd_packets",
        "duration as duration_us",
        f"{_rate('fl_n')} as fwd_pps",
        f"{_rate('bl_n')} as bwd_pps",
        "n_syn as syn_count",
        "n_ack as ack_count",
        "n_rst as rst_count",
        "n_fin as fin_count",
        f"{_ratio('size', 'n')} as avg_packet_size",
        "start_us",
        "end_us",
        f"element_at(array({names}), reason + 1) as reason",
        *[f"cast({v} as double) as {name}" for v, name in zip(values, FEATURE_COLUMNS)],
    )


def flows_from_aggregates(flat: DataFrame, reasons: Sequence[str], true_active_periods: bool = False) -> DataFrame:
    """Metadata and features of flows whose aggregates are there already, as a stream keeps them."""
    return _describe(flat, reasons, (), true_active_periods)


def flow_info(flows: DataFrame, *extra: str) -> DataFrame:
    """The 15 metadata columns (plus the id) of assembled flows."""
    return flows.select("flow_id", *extra, *FLOW_INFO_COLUMNS)


def feature_vector(flows: DataFrame, name: str = "features") -> DataFrame:
    """Pack the 77 columns, in order, into one array<float>."""
    vector = f"array({', '.join(f'cast({c} as float)' for c in FEATURE_COLUMNS)}) as {name}"
    kept = [c for c in flows.columns if c not in set(FEATURE_COLUMNS)]
    return flows.selectExpr(*kept, vector)
