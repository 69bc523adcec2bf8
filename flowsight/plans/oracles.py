"""The same answers in plain SQL, written from the semantics and not from the Spark plans."""

from __future__ import annotations

from flowsight.functions.names import SERVICES, SOURCE_NAMES
from flowsight.operators import prepare as P
from flowsight.operators.rules import AUTH_SERVICES, SUSPICIOUS_PORTS
from flowsight.plans import inputs as I
from flowsight.plans.queries import FEATURE_GROUPS, ORDER, RAW_LABELS, SPLIT_US, TIMEOUT_US, feature_digits
from flowsight.schema import ATTACK_NAMES, CLIP_VALUE, FEATURE_COLUMNS

ORACLES: dict[str, str] = {}


def _select(expressions, source):
    cols = ", ".join(e.replace("`", '"') for e in expressions)
    return f"select {cols} from {source}"


def _values(rows):
    return "(values " + ", ".join("(" + ", ".join(map(_lit, r)) + ")" for r in rows) + ")"


def _lit(v):
    return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)


# -- inputs ------------------------------------------------------------------

PACKETS = """
e as (select event_id, epoch_us(ts) as us, user_id % 20 as c, event_type in ('error', 'view') as bwd,
  cast(floor(value) as int) as v, cast(json_extract_string(props, '$.k') as int) as k from events),
d as (select event_id, 1704067200000000 + cast(floor((us - 1704067200000000) / 3000) as bigint) as ts_us, c, bwd, v, k,
  case when c = 19 then 1 when c % 5 = 2 then 17 else 6 end as protocol,
  case c % 5 when 0 then 80 when 1 then 22 when 2 then 53 when 3 then 4444 else 443 end as sport from e),
packets as (select event_id as pkt_id, ts_us,
  case when bwd then concat('10.1.0.', c % 3) else concat('10.0.0.', c) end as src_ip,
  case when bwd then concat('10.0.0.', c) else concat('10.1.0.', c % 3) end as dst_ip,
  cast(case when protocol = 1 then (case when bwd then 0 else 8 end) when bwd then sport else 40000 + c end as int) as src_port,
  cast(case when protocol = 1 then 0 when bwd then 40000 + c else sport end as int) as dst_port,
  cast(protocol as int) as protocol, 20 as ip_header_len,
  case when protocol = 6 then 20 else 8 end as transport_header_len, 40 + v as total_len,
  case when protocol <> 6 then 0 else 16 + (case when k % 2 = 0 then 8 else 0 end)
    + (case when k % 7 = 0 then 2 else 0 end) + (case when k % 50 = 24 then 1 else 0 end)
    + (case when k = 49 then 4 else 0 end) end as tcp_flags,
  case when protocol <> 6 or k % 10 = 0 then 0 else 1024 + k end as tcp_window from d)
"""

FLOWS_IN = f"flows as ({_select(I.FLOWS_FROM_ORDERS, 'orders')})"
PREDICTIONS = f"predictions as ({_select(I.PREDICTIONS_FROM_FLOWS, 'flows')})"
SCORED = f"""
base as ({_select(I.SCORED_FROM_EMBEDDINGS, 'embeddings')}),
scored as (select *, list_transform(range(0, 16), lambda i: case when i = y_pred
  then (40 + vec_id % 60) / cast(100 as double) else ((vec_id * 31 + i * 17) % 40) / cast(100 as double) end) as probs from base)
"""
ROWS = (
    "rows64 as (select vec_id, label, "
    + ", ".join(f"cast(embedding[{i + 1}] as double) as f{i}" for i in range(64))
    + " from embeddings)"
)
LONG = "cells as (select vec_id, label, i - 1 as pos, cast(embedding[i] as double) as x from embeddings, range(1, 65) t(i))"

IP_SHAPE = r"^[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+\.?$"


def _ip(c):
    part = [f"try_cast(split_part({c}, '.', {i}) as bigint)" for i in range(1, 5)]
    ok = " and ".join([f"regexp_matches({c}, '{IP_SHAPE}')", *[f"{p} <= 255" for p in part]])
    return (
        f"case when {ok} then ({part[0]} << 24) + ({part[1]} << 16) + ({part[2]} << 8) + {part[3]} end"
    )


FEEDS = f"""
lines as ({_select(I.FEED_LINES_FROM_SUPPLIER, 'supplier')}),
trimmed as (select feed_name, trim(line) as line from lines),
words as (select feed_name, split_part(split_part(split_part(line, ';', 1), ',', 1), ' ', 1) as w
  from trimmed where line <> '' and line[1] not in ('#', ';')),
sides as (select feed_name, not contains(w, '/') as is_exact, split_part(w, '/', 1) as base,
  try_cast(regexp_extract(split_part(w, '/', 2), '^[0-9]+') as int) as bits from words),
nums as (select feed_name, is_exact, base, {_ip('base')} as num, case when is_exact then 32 else bits end as prefix_len from sides),
feeds as (select (num >> (32 - prefix_len)) << (32 - prefix_len) as network, prefix_len, is_exact, feed_name
  from nums where num is not null and (num <> 0 or (base = '0.0.0.0' and not is_exact)) and prefix_len between 1 and 32)
"""

TI = f"""
ends as (select flow_id, 0 as place, src_ip as ip, true as is_source, {_ip('src_ip')} as num from flows
  union all select flow_id, 1, dst_ip, false, {_ip('dst_ip')} from flows),
ips as (select distinct num from ends where num <> 0),
exact as (select network as num, max(feed_name) as feed_name from feeds where is_exact group by network),
ranged as (select num, feed_name from (select i.num, f.feed_name, row_number() over (partition by i.num
    order by f.network, f.prefix_len, f.feed_name) as rk from ips i join feeds f
    on not f.is_exact and (i.num >> (32 - f.prefix_len)) = (f.network >> (32 - f.prefix_len))) where rk = 1),
hit as (select i.num, coalesce(x.feed_name, r.feed_name) as feed_name from ips i left join exact x using (num)
  left join ranged r using (num)),
ti as (select e.flow_id, e.place, e.ip, h.feed_name, e.is_source from ends e join hit h using (num) where h.feed_name is not null)
"""

_PORTS = ", ".join(map(str, SUSPICIOUS_PORTS))
_AUTH = ", ".join(map(str, AUTH_SERVICES))


def rules_cte(source="flows"):
    return f"""
rf as (select *, fwd_packets + bwd_packets as n, case when duration_us > 0
    then (fwd_packets + bwd_packets) / (duration_us / 1e6) end as rate,
  case when ack_count > 0 then syn_count / cast(ack_count as double) else cast(syn_count as double) end as ratio from {source}),
fired as (
  select flow_id, 1 as k, 'suspicious_port' as rule_name, case when src_port in ({_PORTS}) and dst_port in ({_PORTS}) then 0.8e0 else 0.6e0 end as severity
    from rf where src_port in ({_PORTS}) or dst_port in ({_PORTS})
  union all select flow_id, 2, 'syn_flood', least(1, ratio / 20e0) from rf where protocol = 6 and syn_count >= 50 and ratio >= 5
  union all select flow_id, 3, 'icmp_flood', least(1, rate / 1000e0) from rf where protocol = 1 and n >= 20 and rate >= 100
  union all select flow_id, 4, 'brute_force', least(1, rate / 100e0) from rf where protocol = 6 and dst_port in ({_AUTH}) and n >= 20 and rate >= 10
  union all select flow_id, 5, 'high_packet_rate', least(1, rate / 50000e0) from rf where n >= 100 and rate >= 10000
  union all select flow_id, 6, 'reset_flood', least(1, rst_count / cast(n as double)) from rf where protocol = 6 and rst_count >= 30 and n > 0 and rst_count / cast(n as double) >= 0.5)
"""


def fused_cte(scored, ti=True, rules=True, w=("0.5e0", "0.3e0", "0.2e0"), threshold="0.7e0"):
    """``scored``: SQL giving flow_id, classification, confidence. ti/fired are counted per flow."""
    t = "select flow_id, count(*) as ti from ti group by flow_id" if ti else "select 0 as flow_id, 0 as ti where false"
    r = (
        "select flow_id, count(*) as rules, max(severity) as sev from fired group by flow_id"
        if rules
        else "select 0 as flow_id, 0 as rules, 0e0 as sev where false"
    )
    return f"""
sc as ({scored}), tc as ({t}), rc as ({r}),
sig as (select sc.*, coalesce(ti, 0) as ti, coalesce(rules, 0) as rules, coalesce(sev, 0e0) as sev,
  classification not in (0, 16) as atk from sc left join tc using (flow_id) left join rc using (flow_id)),
fused as (select *, case when atk then classification when classification = 0 and ti = 0
    and not (rules > 0 and sev >= 0.7e0 and confidence < {threshold}) then 0 else 16 end as verdict,
  least(1e0, greatest(0e0, {w[0]} * (case when atk then confidence when classification = 0 then 1 - confidence else 0e0 end)
    + {w[1]} * (case when ti > 0 then 1e0 else 0e0 end) + {w[2]} * sev)) as score,
  case when atk then (case when ti > 0 and rules > 0 then 'Ensemble' when ti > 0 then 'MlPlusThreatIntel'
      when rules > 0 then 'MlPlusHeuristic' else 'MlOnly' end)
    when ti > 0 then 'ThreatIntel' when rules > 0 then 'HeuristicRule' else 'None' end as source,
  atk or ti > 0 or rules > 0 as is_flagged from sig)
"""


FUSED_COLUMNS = """select flow_id, cast(classification as int) as classification, confidence, cast(verdict as int) as verdict,
  round(score, 9) as combined_score, source, cast(ti as int) as ti, cast(rules as int) as rules, is_flagged from fused"""

SCORES = "select flow_id, classification, confidence from flows join predictions using (flow_id)"
DETECTED = f"with {FLOWS_IN}, {PREDICTIONS}, {FEEDS}, {TI}, {rules_cte()}, {fused_cte(SCORES)}"


def _case(column, pairs, default):
    whens = " ".join(f"when {_lit(k)} then {_lit(v)}" for k, v in pairs)
    return f"case {column} {whens} else {_lit(default)} end"


def _attack(c):
    return _case(c, list(enumerate(ATTACK_NAMES)), "Unknown")


def _proto(c="protocol"):
    return _case(c, [(6, "TCP"), (17, "UDP"), (1, "ICMP")], "Other")


RISK = """case when not is_flagged and score < 0.3e0 then 'benign' when score < 0.3e0 then 'low'
  when score < 0.6e0 then 'medium' else 'high' end"""

# -- assembly ----------------------------------------------------------------


def flows_cte(timeout=TIMEOUT_US, most=200, idle=5_000_000, longest=None):
    """Segments by gaps and FIN/RST, pieces of ``most`` packets, runs as gaps and islands.

    With ``longest`` a piece also ends at the first packet that long after its start, which only a walk from packet
    to packet can tell: the query must then begin with ``with recursive``.
    """
    key = "lo_ip, lo_port, hi_ip, hi_port, protocol"
    seg, piece = f"{key}, seg", f"{key}, seg, chunk"
    o = "order by ts_us, pkt_id"
    half = []
    for p, cond in (("f", "fwd"), ("b", "not fwd")):
        half.append(f"""
  count(*) filter ({cond}) as {p}n, coalesce(sum(total_len) filter ({cond}), 0) as {p}bytes,
  max(total_len) filter ({cond}) as {p}max, min(total_len) filter ({cond}) as {p}min,
  stddev_samp(total_len) filter ({cond}) as {p}std,
  count(dgap) filter ({cond}) as {p}gn, sum(dgap) filter ({cond}) as {p}gsum, max(dgap) filter ({cond}) as {p}gmax,
  min(dgap) filter ({cond}) as {p}gmin, stddev_samp(dgap) filter ({cond}) as {p}gstd,
  count(*) filter ({cond} and tcp and tcp_flags & 8 > 0) as {p}psh, count(*) filter ({cond} and tcp and tcp_flags & 32 > 0) as {p}urg,
  coalesce(sum(hdr) filter ({cond}), 0) as {p}hdr,
  arg_min(tcp_window, pos) filter ({cond} and tcp and tcp_window > 0) as {p}win""")
    flags = ", ".join(
        f"count(*) filter (tcp and tcp_flags & {b} > 0) as c_{f}"
        for f, b in [("fin", 1), ("syn", 2), ("rst", 4), ("psh", 8), ("ack", 16), ("urg", 32), ("ece", 64), ("cwr", 128)]
    )
    pieces = f"parts as (select *, (pos - 1) // {most} as chunk, lo = lo0 as fwd from placed)"
    overdue = "false"
    if longest:
        ended = f"(w.cnt >= {most} or w.ts_us - w.base >= {longest})"
        pieces = f"""
walk as (select {seg}, pos, ts_us, ts_us as base, 1 as cnt, 0 as chunk from placed where pos = 1
  union all select {", ".join("p." + c for c in seg.split(", "))}, p.pos, p.ts_us,
  case when {ended} then w.ts_us else w.base end, case when {ended} then 1 else w.cnt + 1 end,
  case when {ended} then w.chunk + 1 else w.chunk end
  from walk w join placed p on {" and ".join(f"p.{c} = w.{c}" for c in seg.split(", "))} and p.pos = w.pos + 1),
parts as (select p.*, w.chunk, lo = lo0 as fwd from placed p join walk w using ({seg}, pos))"""
        overdue = f"end_us - start_us >= {longest}"
    return f"""
keyed as (select *, (src_ip, src_port) <= (dst_ip, dst_port) as lo, protocol = 6 as tcp,
  ip_header_len + transport_header_len as hdr, greatest(total_len - ip_header_len - transport_header_len, 0) as payload,
  protocol = 6 and (tcp_flags & 5) > 0 as closes,
  case when (src_ip, src_port) <= (dst_ip, dst_port) then src_ip else dst_ip end as lo_ip,
  case when (src_ip, src_port) <= (dst_ip, dst_port) then src_port else dst_port end as lo_port,
  case when (src_ip, src_port) <= (dst_ip, dst_port) then dst_ip else src_ip end as hi_ip,
  case when (src_ip, src_port) <= (dst_ip, dst_port) then dst_port else src_port end as hi_port from packets),
near as (select *, lag(ts_us) over k as pts, lag(closes) over k as pcl, lead(ts_us) over k as nts from keyed
  window k as (partition by {key} {o})),
segs as (select *, sum(case when pts is null or pcl or ts_us - pts > {timeout} then 1 else 0 end)
  over (partition by {key} {o} rows unbounded preceding) as seg from near),
placed as materialized (select *, row_number() over s as pos, first_value(lo) over s as lo0, first_value(pts) over s as dummy,
  lag(ts_us) over s as sts from segs window s as (partition by {seg} {o})),
{pieces},
stepped as (select *, ts_us - sts as gap,
  ts_us - lag(ts_us) over (partition by {piece}, fwd {o}) as dgap,
  lag(fwd) over (partition by {piece} {o}) as pfwd from parts),
runs0 as (select *, sum(case when pfwd is null or pfwd <> fwd then 1 else 0 end)
  over (partition by {piece} {o} rows unbounded preceding) as run from stepped),
runs as (select {piece}, run, fwd, count(*) as rn, sum(total_len) as rb from runs0 group by {piece}, run, fwd having count(*) >= 2),
bulks as (select {piece}, count(*) filter (fwd) as fbk, sum(rn) filter (fwd) as fbp, sum(rb) filter (fwd) as fbb,
  count(*) filter (not fwd) as bbk, sum(rn) filter (not fwd) as bbp, sum(rb) filter (not fwd) as bbb from runs group by {piece}),
agg as (select {piece}, arg_min(pkt_id, pos) as flow_id, arg_max(pkt_id, pos) as last_id, any_value(lo0) as lo0,
  arg_min(coalesce(sts, ts_us), pos) as start_us, max(ts_us) as end_us, count(*) as n, sum(total_len) as bytes,
  bool_or(closes) as closed, max(pos) as last_pos, arg_max(coalesce(nts, -1), pos) as nts,
  {", ".join(half)},
  min(total_len) as amin, max(total_len) as amax, stddev_samp(total_len) as astd, var_pop(total_len) as avar,
  count(gap) filter (gap > 0) as gn, sum(gap) filter (gap > 0) as gsum, max(gap) filter (gap > 0) as gmax,
  min(gap) filter (gap > 0) as gmin, stddev_samp(gap) filter (gap > 0) as gstd,
  count(*) filter (gap > {idle}) as idn, sum(gap) filter (gap > {idle}) as idsum, max(gap) filter (gap > {idle}) as idmax,
  min(gap) filter (gap > {idle}) as idmin, stddev_samp(gap) filter (gap > {idle}) as idstd, {flags},
  count(*) filter (fwd and tcp and payload > 0) as act, min(payload) filter (fwd and tcp and payload > 0) as minseg
  from stepped group by {piece}),
built as (select a.*, b.* exclude ({piece}), end_us - start_us as dur,
  case when closed then 'fin_rst' when n = {most} then 'max_pkts' when {overdue} then 'duration' when nts = -1 then 'finalize' else 'timeout' end as reason,
  case when lo0 then lo_ip else hi_ip end as src_ip, case when lo0 then hi_ip else lo_ip end as dst_ip,
  case when lo0 then lo_port else hi_port end as src_port, case when lo0 then hi_port else lo_port end as dst_port
  from agg a left join bulks b using ({piece}))
"""


def _r(n):
    return f"case when dur > 0 then {n} / (dur / 1e6) else 0 end"


def _q(n, d):
    return f"case when {d} > 0 then cast({n} as double) / {d} else 0 end"


def _four(n, s, std, hi, lo):
    return [_q(s, n), f"coalesce({std}, 0)", f"coalesce({hi}, 0)", f"coalesce({lo}, 0)"]


FEATURE_SQL = [
    "dst_port", "dur", "fn", "bn", "fbytes", "bbytes",
    "coalesce(fmax, 0)", "coalesce(fmin, 0)", _q("fbytes", "fn"), "coalesce(fstd, 0)",
    "coalesce(bmax, 0)", "coalesce(bmin, 0)", _q("bbytes", "bn"), "coalesce(bstd, 0)",
    _r("bytes"), _r("n"),
    *_four("gn", "gsum", "gstd", "gmax", "gmin"),
    "coalesce(fgsum, 0)", *_four("fgn", "fgsum", "fgstd", "fgmax", "fgmin"),
    "coalesce(bgsum, 0)", *_four("bgn", "bgsum", "bgstd", "bgmax", "bgmin"),
    "fpsh", "bpsh", "furg", "burg", "fhdr", "bhdr", _r("fn"), _r("bn"),
    "amin", "amax", _q("bytes", "n"), "coalesce(astd, 0)", "avar",
    "c_fin", "c_syn", "c_rst", "c_psh", "c_ack", "c_urg", "c_cwr", "c_ece",
    _q("bn", "fn"), _q("bytes", "n"), _q("(fbytes - fhdr)", "fn"), _q("(bbytes - bhdr)", "bn"),
    _q("fbb", "coalesce(fbk, 0)"), _q("fbp", "coalesce(fbk, 0)"), f"case when fbk > 0 then {_r('fbb')} else 0 end",
    _q("bbb", "coalesce(bbk, 0)"), _q("bbp", "coalesce(bbk, 0)"), f"case when bbk > 0 then {_r('bbb')} else 0 end",
    "fn", "fbytes", "bn", "bbytes", "coalesce(fwin, 0)", "coalesce(bwin, 0)", "act", "coalesce(minseg, 0)",
    "0", "0", "0", "0", *_four("idn", "idsum", "idstd", "idmax", "idmin"),
]
assert len(FEATURE_SQL) == len(FEATURE_COLUMNS)

INFO = f"""select flow_id, start_us, end_us, reason, src_ip, dst_ip, src_port, dst_port, protocol, fn as fwd_packets,
  bn as bwd_packets, dur as duration_us, cast({_r('fn')} as double) as fwd_pps, cast({_r('bn')} as double) as bwd_pps,
  c_syn as syn_count, c_ack as ack_count, c_rst as rst_count, c_fin as fin_count,
  cast({_q('bytes', 'n')} as double) as avg_packet_size from built"""
ASSEMBLED = f"with {PACKETS}, {flows_cte()}"

ORACLES["flow_metadata"] = f"{ASSEMBLED} {INFO}"
ORACLES["flow_metadata_in_blocks"] = ORACLES["flow_metadata"]
ORACLES["flow_splits"] = f"""with {PACKETS}, {flows_cte(2_000_000, 50)} {INFO}
  union all select -1 - last_id, end_us, end_us, case when nts = -1 then 'finalize' else 'timeout' end, src_ip, dst_ip,
  src_port, dst_port, protocol, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0 from built
  where not closed and n = 50 and (nts = -1 or nts - end_us > 2000000)"""
ORACLES["flow_diagnostic_counts"] = f"""{ASSEMBLED} select 'flows_' || reason as counter, count(*) as value from built group by reason
  union all select 'packets_received', count(*) from packets union all select 'packets_parsed', count(*) from packets
  union all select 'packets_skipped', 0"""
for _name, _positions in FEATURE_GROUPS.items():
    _cols = ", ".join(
        f"round(cast({FEATURE_SQL[i]} as double), {feature_digits(i)}) as {FEATURE_COLUMNS[i]}" for i in _positions
    )
    ORACLES[_name] = f"{ASSEMBLED} select flow_id, {_cols} from built"
ORACLES["feature_vectors"] = (
    ASSEMBLED
    + ", vals as (select flow_id, ["
    + ", ".join(f"cast({x} as float)" for x in FEATURE_SQL)
    + "] as v from built) select i as pos, count(*) as n, count(*) filter (v[i + 1] <> 0) as non_zero"
    " from vals, range(0, 77) t(i) group by i"
)
ORACLES["flow_keys"] = f"""with {PACKETS}, {flows_cte()} select lo_ip, lo_port, hi_ip, hi_port, protocol, count(*) as n,
  count(*) filter (lo) as from_lo from keyed group by all"""
ORACLES["skewed_flow_features"] = (
    ASSEMBLED
    + ", vals as (select ["
    + ", ".join(f"cast({x} as double)" for x in FEATURE_SQL)
    + """] as v from built), cells as (select i as pos, v[i + 1] as x from vals, range(0, 77) t(i)),
 m as (select pos, avg(x) as mu, stddev_pop(x) as sd from cells group by pos),
 sk as (select c.pos, avg(power((x - mu) / sd, 3)) as skew from cells c join m using (pos) where sd > 0 group by c.pos)
 select pos, """
    + _case("pos", list(enumerate(FEATURE_COLUMNS)), "")
    + " as feature, round(skew, 4) as skew from sk where abs(skew) > 2"
)

# -- sources -----------------------------------------------------------------


def _int(c, default=0):
    return f"coalesce(cast(trunc(try_cast(nullif(lower(trim({c})), 'nan') as double)) as bigint), {default})"


_HEX = """case when regexp_matches("TCP Flags", '^0[xX][0-9a-fA-F]+$') then cast(lower("TCP Flags") as int)
  else coalesce(try_cast("TCP Flags" as int), 0) end"""
_CSV = f"csv as ({_select(I.CSV_ROWS_FROM_EVENTS, 'events')})"
_PROTO_NAME = """upper(coalesce(nullif(nullif(trim("IP Protocol"), ''), 'nan'), "Protocol"))"""
_WHO = r"Who has ([0-9.]+)\? Tell ([0-9.]+)"
ORACLES["csv_packets"] = f"""with {_CSV}, p as (select *, try_cast(nullif("Frame Time (Epoch)", 'nan') as double) as secs,
  case {_PROTO_NAME} when 'TCP' then 6 when 'UDP' then 17 when 'ICMP' then 1 when 'ARP' then 0 end as proto,
  nullif(regexp_extract("Info", '{_WHO}', 1), '') as target, nullif(regexp_extract("Info", '{_WHO}', 2), '') as teller,
  nullif(regexp_extract("Info", '^([0-9.]+) is at', 1), '') as owner from csv),
q as (select path, pkt_id, cast(trunc(secs * 1000000) as bigint) as ts_us,
  case when proto = 0 then coalesce(teller, owner) else nullif(nullif("IP Source", ''), 'nan') end as src_ip,
  case when proto = 0 then coalesce(target, owner) else "IP Destination" end as dst_ip,
  case proto when 6 then {_int('"TCP Source Port"')} when 17 then {_int('"UDP Source Port"')} when 1 then {_int('"ICMP Type"')} else 0 end as src_port,
  case proto when 6 then {_int('"TCP Destination Port"')} when 17 then {_int('"UDP Destination Port"')} else 0 end as dst_port,
  proto as protocol, case when proto = 0 then 0 else 20 end as ip_header_len,
  case proto when 6 then 20 when 0 then 0 else 8 end as transport_header_len,
  case when proto = 0 then (case when {_int('"frame length"')} > 0 then {_int('"frame length"')} else {_int('"Length"')} end)
    else {_int('"IP Length"')} end as total_len,
  case when proto = 6 then {_HEX} else 0 end as tcp_flags,
  case when proto = 6 then {_int('"TCP Window Size"')} else 0 end as tcp_window
  from p where secs > 0 and proto is not null)
select * from q where src_ip is not null and dst_ip is not null and total_len > 0"""
ORACLES["csv_labels"] = f"""with {_CSV} select path, cast(case when path like '%/SYN Flood/%' then 11 else 0 end as int) as label_code,
  count(*) as n from csv group by path"""
ORACLES["feed_entries"] = f"with {FEEDS} select network, prefix_len, is_exact, feed_name from feeds"
ORACLES["feed_counts"] = f"""with {FEEDS}, kept as (select max(feed_name) as feed_name from feeds where is_exact group by network
  union all select feed_name from feeds where not is_exact) select feed_name, count(*) as entries from kept group by feed_name"""
ORACLES["tolerant_casts"] = f"""with {_CSV} select pkt_id, {_int('"IP Length"', 7)} as length,
  coalesce(try_cast(nullif("Frame Time (Epoch)", 'nan') as double), -1) as seconds, {_int('"TCP Window Size"')} as window, {_HEX} as flags,
  coalesce(nullif(regexp_extract("Info", '{_WHO}', 2), ''), nullif(regexp_extract("Info", '^([0-9.]+) is at', 1), '')) as arp_src,
  coalesce(nullif(regexp_extract("Info", '{_WHO}', 1), ''), nullif(regexp_extract("Info", '^([0-9.]+) is at', 1), '')) as arp_dst from csv"""
ORACLES["address_numbers"] = f"""with lines as ({_select(I.FEED_LINES_FROM_SUPPLIER, 'supplier')}),
w as (select line, split_part(split_part(trim(line), ' ', 1), ',', 1) as word from lines),
x as (select *, split_part(word, '/', 1) as base, try_cast(regexp_extract(split_part(word, '/', 2), '^[0-9]+') as int) as bits from w),
y as (select *, {_ip('base')} as num from x)
select line, nullif({_ip('word')}, 0) as ip,
 case when contains(word, '/') and bits between 1 and 32 and (num <> 0 or base = '0.0.0.0') then (num >> (32 - bits)) << (32 - bits) end as network,
 case when contains(word, '/') and bits between 1 and 32 and (num <> 0 or base = '0.0.0.0') then bits end as prefix_len from y"""

# -- scalar functions --------------------------------------------------------

_SERVICES = f"services as (select * from {_values(SERVICES.items())} t(port, service))"
ORACLES["packet_filters"] = f"""with {PACKETS} select 'web' as filter, pkt_id from packets where protocol = 6 and dst_port = 443
  and src_ip in ({", ".join(f"'10.0.0.{i}'" for i in range(16))})
  union all select 'host', pkt_id from packets where dst_ip = '10.1.0.1' and src_port = 40006"""
ORACLES["applications"] = f"""with {FLOWS_IN}, {_SERVICES} select coalesce(service, 'Unknown') as application, count(*) as n
  from flows left join services on port = dst_port group by 1"""
ORACLES["services_in_use"] = f"with {FLOWS_IN}, {_SERVICES} select distinct service from flows join services on port = dst_port"
ORACLES["protocol_names"] = f"""with {FLOWS_IN}, p as (select protocol + case when flow_id % 9 = 0 then 30 else 0 end as p from flows)
  select {_proto('p')} as protocol, count(*) as n from p group by 1"""
ORACLES["attack_names"] = f"""with {FLOWS_IN}, p as (select cast(flow_id % 20 - 2 as int) as c from flows)
  select c, {_case('c', list(enumerate(ATTACK_NAMES[:16])), 'Unknown')} as name, case when c between 0 and 15 then c else 16 end as code,
  case when c between 0 and 15 then c else 16 end as code_of_name, count(*) as n from p group by all"""
ORACLES["packet_lengths"] = f"""with {PACKETS} select protocol, cast(sum(ip_header_len + transport_header_len) as bigint) as header_bytes,
  cast(sum(greatest(total_len - ip_header_len - transport_header_len, 0)) as bigint) as payload_size from packets group by protocol"""
ORACLES["flag_counts"] = f"""with {PACKETS} select protocol, """ + ", ".join(
    f"count(*) filter (protocol = 6 and tcp_flags & {b} > 0) as {f}"
    for f, b in [("fin", 1), ("syn", 2), ("rst", 4), ("psh", 8), ("ack", 16)]
) + " from packets group by protocol"
ORACLES["verdict_predicates"] = f"""{DETECTED} select flow_id, atk as is_attack, classification = 16 as is_unknown, confidence >= 0.7e0 as sure,
  case when verdict = 0 then 'BENIGN' else 'ATTACK' end as binary, is_flagged as flagged, round(sev, 6) as severity, {RISK} as risk,
  {_case('source', list(SOURCE_NAMES.items()), 'Unknown')} as source_name from fused"""

# -- rules, threats, fusion --------------------------------------------------

ORACLES["rule_matches"] = f"""with {FLOWS_IN}, {rules_cte()} select flow_id, cast(row_number() over (partition by flow_id order by k) - 1 as int) as place,
  rule_name, round(severity, 6) as severity from fired"""
ORACLES["port_scans"] = f"""with {FLOWS_IN} select src_ip, count(distinct dst_port) as distinct_ports, 'port_scan' as rule_name,
  concat('Source ', src_ip, ' contacted ', count(distinct dst_port), ' distinct destination ports (threshold: 20)') as description,
  round(least(1e0, count(distinct dst_port) / 60e0), 6) as severity from flows group by src_ip having count(distinct dst_port) >= 20"""
ORACLES["threat_matches"] = f"""with {FLOWS_IN}, {FEEDS}, {TI} select flow_id, cast(row_number() over (partition by flow_id order by place) - 1 as int) as place,
  ip, feed_name, is_source from ti"""
ORACLES["threat_matches_shuffled"] = ORACLES["threat_matches"]
ORACLES["fusion"] = f"{DETECTED} {FUSED_COLUMNS}"
ORACLES["fusion_without_rules"] = (
    f"with {FLOWS_IN}, {PREDICTIONS}, {FEEDS}, {TI}, {fused_cte(SCORES, rules=False)} {FUSED_COLUMNS}"
)
ORACLES["classifier_only"] = f"""with {FLOWS_IN}, {PREDICTIONS} select flow_id, cast(classification as int) as classification, confidence,
  cast(classification as int) as verdict, 0e0 as combined_score, 'MlOnly' as source, cast(0 as int) as ti, cast(0 as int) as rules,
  classification not in (0, 16) as is_flagged from predictions"""
_SOME = """select flow_id, cast(case when protocol <> 1 then classification else 16 end as int) as classification,
  case when protocol <> 1 then confidence else 0 end as confidence from predictions join flows using (flow_id)"""
ORACLES["fusion_missing_scores"] = f"""with {FLOWS_IN}, {PREDICTIONS}, {FEEDS}, {TI}, {rules_cte()},
  {fused_cte(_SOME, w=("0.4e0", "0.4e0", "0.2e0"), threshold="0.9e0")} {FUSED_COLUMNS}"""
_SWEEP = []
for _m, _t, _h, _c in [(0.5, 0.3, 0.2, 0.7), (0.2, 0.6, 0.2, 0.5), (0.8, 0.1, 0.1, 0.9)]:
    _cte = fused_cte(SCORES, w=(f"{_m}e0", f"{_t}e0", f"{_h}e0"), threshold=f"{_c}e0")
    _SWEEP.append(
        f"select * from (with {_cte} select {_m}e0 as w_ml, {_t}e0 as w_threat, {_h}e0 as w_rules, {_c}e0 as threshold,"
        " cast(verdict as int) as verdict, count(*) as flows, round(sum(score), 3) as score_sum, round(max(score), 6) as score_max"
        " from fused group by verdict)"
    )
ORACLES["weight_sweep"] = f"with {FLOWS_IN}, {PREDICTIONS}, {FEEDS}, {TI}, {rules_cte()} " + " union all ".join(_SWEEP)
ORACLES["results_with_metadata"] = f"""with {FLOWS_IN}, {PREDICTIONS}, kept as (select * from flows where protocol <> 17)
  select p.flow_id, p.classification, p.confidence, coalesce(src_ip, '') as src_ip, coalesce(dst_port, 0) as dst_port,
  coalesce(fwd_packets, 0) as fwd_packets, coalesce(avg_packet_size, 0) as avg_packet_size from predictions p left join kept s on s.flow_id = p.flow_id"""
_BUILT_FLOWS = """flows as (select flow_id, src_ip, dst_ip, src_port, dst_port, protocol, fn as fwd_packets, bn as bwd_packets, dur as duration_us,
  c_syn as syn_count, c_ack as ack_count, c_rst as rst_count from built)"""
_BY_PORT = "select flow_id, case when dst_port <= 1024 then 11 else 0 end as classification, 0.85e0 as confidence from flows"
ORACLES["detections_from_packets"] = (
    f"{ASSEMBLED}, {_BUILT_FLOWS}, {FEEDS}, {TI}, {rules_cte()}, {fused_cte(_BY_PORT)} {FUSED_COLUMNS}"
)
ORACLES["rule_hits_in_packets"] = f"""{ASSEMBLED}, {_BUILT_FLOWS}, {rules_cte()} select rule_name, count(*) as n,
  round(max(severity), 6) as worst from fired group by rule_name"""
_FEW = FEEDS.replace("feeds as (", "all_feeds as (") + ", feeds as (select * from all_feeds where feed_name in ('feed_0', 'feed_1'))"
ORACLES["reanalysis"] = f"""with {FLOWS_IN}, {PREDICTIONS}, {_FEW}, {TI}, {rules_cte()},
  {fused_cte(SCORES, w=("0.3e0", "0.5e0", "0.2e0"))} {FUSED_COLUMNS}"""

# -- reports -----------------------------------------------------------------

_SRC = _case("source", list(SOURCE_NAMES.items()), "Unknown")
ORACLES["flow_reports"] = f"""{DETECTED} select row_number() over (order by flow_id) as number, src_ip, src_port, dst_ip, dst_port,
  {_proto()} as protocol, {_attack('verdict')} as verdict, printf('%.1f%%', cast(cast(confidence as float) as double) * 100 + 1e-10) as ml_confidence,
  printf('%.3f', cast(cast(score as float) as double) + 1e-10) as combined_score, {_SRC} as detection_source, {RISK} as risk from fused join flows using (flow_id)"""
ORACLES["packet_reports"] = f"""with {PACKETS}, {_SERVICES} select row_number() over (order by ts_us, pkt_id) as number, 'eth0' as interface,
  {_proto()} as protocol, coalesce(service, 'Unknown') as application, src_ip,
  case when src_port = 0 then '-' else cast(src_port as varchar) end as src_port, dst_ip,
  case when dst_port = 0 then '-' else cast(dst_port as varchar) end as dst_port from packets left join services on port = dst_port"""
ORACLES["probability_table"] = f"""with {FLOWS_IN}, {PREDICTIONS} select flow_id, cast(i as int) as class, {_attack('i')} as name,
  printf('%.2f%%', case when i = classification then cast(cast(confidence as float) as double) * 100 + 1e-10 else 0e0 end) as percentage from predictions, range(0, 16) t(i)"""
ORACLES["ti_table"] = f"""with {FLOWS_IN}, {FEEDS}, {TI} select flow_id, ip, feed_name,
  case when is_source then 'Source' else 'Destination' end as direction from ti"""
ORACLES["rule_table"] = f"with {FLOWS_IN}, {rules_cte()} select flow_id, rule_name, printf('%.2f', cast(cast(severity as float) as double) + 1e-10) as severity from fired"
ORACLES["alert_lines"] = f"""{DETECTED} select flow_id, case when is_flagged then printf('ALERT flow #%d: %s:%d -> %s:%d verdict=%s confidence=%.3f source=%s',
  flow_id, src_ip, src_port, dst_ip, dst_port, {_attack('verdict')}, cast(cast(confidence as float) as double) + 1e-10, {_SRC})
  else printf('CLEAN flow #%d: %s:%d -> %s:%d [%s] confidence=%.3f', flow_id, src_ip, src_port, dst_ip, dst_port, {_attack('verdict')}, cast(cast(confidence as float) as double) + 1e-10) end as line
  from fused join flows using (flow_id)"""
ORACLES["events"] = f"""{DETECTED}, dirs as (select flow_id, string_agg(case when is_source then 'source' else 'destination' end, '+' order by place) as directions
  from ti group by flow_id) select flow_id as flow_index, {_proto()} as protocol, duration_us, syn_count, {_attack('classification')} as ml_classification,
  case when verdict = 0 then 'BENIGN' else 'ATTACK' end as verdict, cast(16 as int) as n_probabilities, cast(rules as int) as n_rules,
  coalesce(directions, '') as directions from fused join flows using (flow_id) left join dirs using (flow_id)"""
ORACLES["syslog_levels"] = f"""{DETECTED} select case when score < 0.3e0 then 6 when score < 0.5e0 then 5 when score < 0.7e0 then 4
  when score < 0.85e0 then 3 else 2 end as level, count(*) as n from fused group by 1"""
ORACLES["session_totals"] = f"""{DETECTED} select protocol, count(*) as total, count(*) filter (is_flagged) as flagged,
  count(*) filter (not is_flagged) as clean from fused join flows using (flow_id) group by protocol"""
ORACLES["verdict_counts"] = f"""{DETECTED} select {_attack('verdict')} as verdict, count(*) as flows, count(*) filter (is_flagged) as flagged
  from fused group by verdict"""
ORACLES["analysis_totals"] = f"""{DETECTED} select (select count(*) from fused) as total_analyzed,
  (select count(*) from fused where is_flagged) as flagged_count, {_attack('verdict')} as name, count(*) as flows from fused group by verdict"""

# -- preparation -------------------------------------------------------------

ORACLES["cleaned_rows"] = "select vec_id from embeddings where vec_id % 17 <> 0 and vec_id % 19 <> 0"
_ORDER = ORDER.replace("L", "")
SPLIT = f"""ranked as (select vec_id, label, count(*) over (partition by label) as n, row_number() over (partition by label
    order by {_ORDER} % {P.SPLIT_BUCKETS}, {_ORDER}, vec_id) as r from embeddings),
sized as (select *, case when n < 10 then 0 else cast(floor(n * {0.15 + 0.15!r}e0 + 0.5e0) as bigint) end as held from ranked),
splits as (select vec_id, label, case when r <= n - held then 'train' when r <= n - cast(ceil(held * 0.5e0) as bigint) then 'val' else 'test' end as split from sized)"""
ORACLES["split_rows"] = f"with {SPLIT} select vec_id, label, split from splits"
ORACLES["split_distribution"] = f"""with {SPLIT}, g as (select cast(i as int) as label from range(0, 16) t(i)) select g.label, """ + ", ".join(
    f"count(*) filter (split = '{s}') as {s}_n, round(coalesce(100e0 * count(*) filter (split = '{s}') / (select count(*) from splits where split = '{s}'), 0), 6) as {s}_pct"
    for s in ("train", "val", "test")
) + " from g left join splits using (label) group by g.label"
ORACLES["class_imbalance"] = """with c as (select label, count(*) as n from embeddings group by label)
  select max(n) / cast(min(n) as double) as ratio, count(*) filter (n < 100) as small_classes from c"""
_FIT = f"{LONG}, fit as (select pos, avg(x) as mean, case when stddev_pop(x) < 1e-8 then 1 else stddev_pop(x) end as std from cells group by pos)"
ORACLES["fitted_normaliser"] = f"with {_FIT} select cast(pos as int) as pos, 'f' || pos as feature, round(mean, 8) as mean, round(std, 8) as std from fit"
_Z = f"{_FIT}, z as (select vec_id, pos, x, (x - mean) / std as raw, greatest(-2e0, least(2e0, (x - mean) / std)) as z from cells join fit using (pos))"
ORACLES["normalised_rows"] = f"with {_Z} select vec_id, " + ", ".join(
    f"round(max(z) filter (pos = {i}), 5) as f{i}" for i in range(64)
) + " from z group by vec_id"
ORACLES["normalised_vectors"] = f"with {_Z} select vec_id, round(sum(abs(z)), 4) as total from z group by vec_id"
ORACLES["clipped_cells"] = f"with {_Z} select count(*) filter (abs(raw) > 2) as clipped, count(*) as cells from z"
ORACLES["class_weight_table"] = """with c as (select label, count(*) as n from embeddings group by label), g as (select cast(i as int) as label from range(0, 16) t(i))
  select g.label, coalesce(n, 0) as n, round(case when n > 0 then (select count(*) from embeddings) / cast(16 * n as double) else 0 end, 10) as weight
  from g left join c using (label)"""
ORACLES["sampling_weight_table"] = f"""with {FLOWS_IN}, c as (select dst_port as label, count(*) as n from flows group by 1)
  select label, n, round(least(1e0 / n, 2e0 * (select median(1e0 / n) from c)), 12) as weight from c"""
_RAW = f"raw as (select {RAW_LABELS} as raw from orders)"
_CODES = {
    "Benign": 0, "NORMAL": 0, "ssh bruteforce": 2, "DDoS-UDP_Flood": 6, "big XSS attack": 15, "SQL": 14, "what": 0,
    "Port Scanning": 12, "icmp_flood": 10, "dos": 7, "Syn-Flood": 11,
}
_LABEL_NAMES = list(P.LABELS)
ORACLES["label_codes"] = f"""with {_RAW}, m as (select * from {_values([(k, v, _LABEL_NAMES[v]) for k, v in _CODES.items()])} t(raw, code, name))
  select raw, code, case raw when 'Benign' then 0 when 'DDoS-UDP_Flood' then 6 end as exact, name, count(*) as n from raw join m using (raw) group by all"""
ORACLES["merged_classes"] = "select cast(case label when 4 then 3 when 9 then 8 else label end as int) as label, count(*) as n from embeddings group by 1"

# -- evaluation --------------------------------------------------------------

ORACLES["interpreted_scores"] = f"""with {SCORED} select vec_id, cast(list_position(probs, list_max(probs)) - 1 as int) as classification,
  list_max(probs) as confidence from scored"""
GRID = f"""{SCORED}, g as (select cast(i // 16 as int) as y_true, cast(i % 16 as int) as y_pred from range(0, 256) t(i)),
c as (select y_true, y_pred, count(*) as n from scored group by 1, 2),
cm as (select g.y_true, g.y_pred, coalesce(n, 0) as n from g left join c using (y_true, y_pred))"""
ORACLES["confusion_matrix"] = f"""with {GRID}, t as (select y_true, sum(n) as total from cm group by 1)
  select y_true, y_pred, n, case when total > 0 then n / cast(total as double) else 0 end as share from cm join t using (y_true)"""
METRICS = f"""{GRID}, s as (select y_true as label, sum(n) as support, sum(n) filter (y_true = y_pred) as hits from cm group by 1),
p as (select y_pred as label, sum(n) as predicted from cm group by 1),
m as (select label, cast(support as bigint) as support, case when predicted > 0 then hits / cast(predicted as double) else 0 end as precision,
  case when support > 0 then hits / cast(support as double) else 0 end as recall,
  case when support + predicted > 0 then 2 * hits / cast(support + predicted as double) else 0 end as f1 from s join p using (label))"""
ORACLES["per_class_metrics"] = f"""with {METRICS} select label, support, round(precision, 10) as precision, round(recall, 10) as recall, round(f1, 10) as f1,
  case when f1 < 0.5 then 'BAD' when f1 < 0.8 then 'WEAK' else 'GOOD' end as grade from m"""
ORACLES["average_metrics"] = f"with {METRICS} select " + ", ".join(
    f"round(avg({x}), 10) as macro_{x}, round(sum({x} * support) / sum(support), 10) as weighted_{x}" for x in ("precision", "recall", "f1")
) + ", round((select avg(case when y_true = y_pred then 1e0 else 0 end) from scored), 10) as accuracy, cast(sum(support) as bigint) as support from m"
ORACLES["accuracy"] = f"with {SCORED} select round(avg(case when y_true = y_pred then 1e0 else 0 end), 10) as accuracy from scored"
ROC = f"""{SCORED}, each as (select y_true, cast(i as int) as label, probs[i + 1] as score from scored, range(0, 16) t(i)),
pts as (select label, score, count(*) filter (y_true = label) as pos, count(*) filter (y_true <> label) as neg from each group by 1, 2),
cum as (select label, score, pos, neg, sum(pos) over w as tp, sum(neg) over w as fp, sum(pos) over (partition by label) as ap,
  sum(neg) over (partition by label) as an from pts window w as (partition by label order by score desc rows unbounded preceding)),
auc as (select label, sum(neg * (tp - pos + pos / 2e0)) / (max(ap) * cast(max(an) as double)) as auc from cum where ap > 0 and an > 0 group by label)"""
ORACLES["roc_curve"] = f"""with {ROC} select label, score, round(tp / cast(ap as double), 10) as tpr,
  round(case when an > 0 then fp / cast(an as double) else 0 end, 10) as fpr from cum where ap > 0"""
ORACLES["roc_auc"] = f"with {ROC} select label, round(auc, 10) as auc from auc"
ORACLES["macro_auc"] = f"with {ROC} select round(avg(auc), 10) as macro_auc from auc"
_BIN = """select count(*) filter (y_true > 0 and y_pred = 0) as false_negatives, count(*) filter (y_true = 0 and y_pred > 0) as false_positives,
  round(coalesce(count(*) filter (y_true > 0 and y_pred > 0) / cast(nullif(count(*) filter (y_true > 0), 0) as double), 0), 10) as recall,
  round(coalesce(count(*) filter (y_true > 0 and y_pred > 0) / cast(nullif(count(*) filter (y_pred > 0), 0) as double), 0), 10) as precision"""
ORACLES["binary_detection"] = f"with {SCORED} {_BIN} from scored"
ORACLES["binary_labels"] = f"{_BIN} from (select toxic as y_true, 1 - quality as y_pred from labels)"
ORACLES["confidence_summary"] = f"""with {SCORED}, c as (select y_true = y_pred as ok, list_max(probs) as conf from scored)
  select count(*) as total, count(*) filter (ok) as correct, count(*) filter (not ok) as incorrect,
  round(coalesce(avg(conf) filter (ok), 0), 8) as mean_correct, round(coalesce(avg(conf) filter (not ok), 0), 8) as mean_incorrect,
  count(*) filter (not ok and conf > 0.9e0) as sure_errors, count(*) filter (ok and conf < 0.5e0) as unsure_hits from c"""
ORACLES["confidence_bins"] = f"""with {SCORED} select y_true = y_pred as correct, cast(least(19, floor(list_max(probs) * 20)) as int) as bin, count(*) as n
  from scored group by 1, 2"""
ORACLES["missed_attacks"] = f"""with {SCORED}, c as (select y_true, count(*) filter (y_pred = 0) as as_benign, count(*) as total from scored where y_true > 0 group by 1)
  select y_true, as_benign, total, round(as_benign / cast(total as double), 10) as fn_rate, as_benign / cast(total as double) > 0.1e0 as flagged from c"""
ORACLES["top_confusions"] = f"""with {SCORED}, c as (select y_true, y_pred, count(*) as n from scored where y_true <> y_pred group by 1, 2),
  r as (select *, cast(row_number() over (partition by y_true order by n desc, y_pred) as int) as place, sum(n) over (partition by y_true) as errs from c)
  select y_true, y_pred, n, place, round(100e0 * n / errs, 8) as error_pct from r where place <= 3"""
ORACLES["quality_audit"] = f"""with {LONG}, r as (select case when vec_id % 3 = 0 then 'val' else 'train' end as split, pos, pos = 0 and vec_id % 17 = 0 as nan,
    pos = 0 and vec_id % 17 <> 0 and vec_id % 19 = 0 as inf, case pos when 1 then 100 * x when 2 then 3.5e0 else x end as x from cells),
  flat as (select split, pos from r where pos <> 0 group by split, pos having stddev_pop(x) < 1e-8)
  select split, count(*) filter (nan) as nan_cells, count(*) filter (inf) as inf_cells, count(*) filter (inf or (not nan and abs(x) > 10)) as beyond_cells,
  cast((select count(*) from flat where flat.split = r.split) as int) as flat_columns from r group by split"""
_STATS = f"""{LONG}, m as (select pos, avg(x) as mu, stddev_pop(x) as sd, min(x) as lo, max(x) as hi from cells group by pos),
hm as (select pos, avg(power((x - mu) / sd, 3)) as skew, avg(power((x - mu) / sd, 4)) - 3 as kurt from cells join m using (pos) group by pos)"""
ORACLES["feature_stats"] = f"""with {_STATS} select cast(pos as int) as pos, 'f' || pos as feature, round(mu, 6) as mean, round(sd, 6) as std, round(lo, 6) as min,
  round(hi, 6) as max, round(skew, 6) as skew, round(kurt, 6) as kurtosis from m join hm using (pos)"""
ORACLES["top_spread_features"] = f"""with {_STATS} select * from (select 'f' || pos as feature, 'top' as "end" from m order by sd desc, pos limit 10)
  union all select * from (select 'f' || pos, 'bottom' from m order by sd, pos limit 10)"""
ORACLES["feature_bins"] = f"""with {_STATS}, pick as (select pos, lo, hi from m order by sd desc, pos limit 12)
  select 'f' || pos as feature, cast(greatest(0, least(79, floor((x - lo) * 80 / (hi - lo)))) as int) as bin, count(*) as n
  from cells join pick using (pos) group by 1, 2"""
ORACLES["correlations"] = f"""with {LONG}, r as (select a.pos as i, b.pos as j, corr(a.x, b.x) as r from cells a join cells b on a.vec_id = b.vec_id and a.pos < b.pos group by 1, 2)
  select 'f' || i as a, 'f' || j as b, round(r, 8) as r from r where abs(r) > 0.05"""
ORACLES["temperatures"] = f"""with {SCORED}, l as (select y_true, list_transform(probs, lambda p: ln(greatest(p, 1e-12))) as g from scored),
  t as (select y_true, g, list_max(g) as top, temperature from l, (values (0.5e0), (1e0), (1.5e0), (2e0), (4e0)) v(temperature)),
  s as (select *, list_sum(list_transform(g, lambda x: exp((x - top) / temperature))) as z from t)
  select temperature, round(avg(ln(z) - (g[y_true + 1] - top) / temperature), 8) as log_loss from s group by temperature"""

# -- alert texts -------------------------------------------------------------

_SHOWN = "cast(cast(confidence as float) as double)"
_TI_TEXT = "ti_text as (select flow_id, string_agg(feed_name, ',' order by place) as feeds, min_by(feed_name, place) as first_feed from ti group by flow_id)"
_RULE_TEXT = "rule_text as (select flow_id, string_agg(rule_name, ',' order by k) as names, min_by(rule_name, k) as first_rule from fired group by flow_id)"
_WITH_TEXT = f"{DETECTED}, {_TI_TEXT}, {_RULE_TEXT}"
_FROM_TEXT = "from fused join flows using (flow_id) left join ti_text using (flow_id) left join rule_text using (flow_id)"
_SUMMARY = f"printf('%s detected with %.0f%% ML confidence', {_attack('verdict')}, confidence * 100)"
ORACLES["cef_alerts"] = f"""{_WITH_TEXT} select flow_id, concat('CEF:0|flowsight|flowsight|1.0|flowsight-', source, '-', verdict, '|', {_attack('verdict')}, '|',
  cast(round(score * 10) as int), '|src=', src_ip, ' dst=', dst_ip, ' spt=', src_port, ' dpt=', dst_port, ' proto=', protocol,
  ' cs1=', printf('%.2f', {_SHOWN} + 1e-10), ' cs1Label=mlConfidence cs2=', source, ' cs2Label=detectionSource cs3=', coalesce(feeds, ''),
  ' cs3Label=threatIntelFeeds cs4=', coalesce(names, ''), ' cs4Label=heuristicRules cn1=', cast(round(score * 100) as int),
  ' cn1Label=combinedScore msg=', {_SUMMARY}) as line {_FROM_TEXT}"""
ORACLES["leef_alerts"] = f"""{_WITH_TEXT} select flow_id, concat('LEEF:2.0|flowsight|flowsight|1.0|', source, '-', verdict, '|src=', src_ip, chr(9), 'dst=', dst_ip,
  chr(9), 'srcPort=', src_port, chr(9), 'dstPort=', dst_port, chr(9), 'proto=', {_proto()}, chr(9), 'sev=', greatest(1, cast(round(score * 10) as int)),
  chr(9), 'cat=', {_attack('verdict')}, chr(9), 'reason=', {_SUMMARY}) as line {_FROM_TEXT}"""
ORACLES["json_alerts"] = f"""{_WITH_TEXT} select strftime(make_timestamp(start_us + duration_us), '%Y-%m-%dT%H:%M:%S.') || lpad(cast((start_us + duration_us) // 1000 % 1000 as varchar), 3, '0') || 'Z' as stamp,
  src_ip as src, cast(fwd_packets + bwd_packets as varchar) as packets, cast(duration_us // 1000 as varchar) as ms, {_attack('verdict')} as verdict, source,
  first_feed as feed, first_rule as rule {_FROM_TEXT} where is_flagged"""

# -- hunting -----------------------------------------------------------------

_NOON = I.EPOCH_US + 43_200_000_000
ORACLES["flow_search"] = f"""{DETECTED} select flow_id, start_us, src_ip, dst_ip, source from fused join flows using (flow_id)
  where (src_ip like '10.0.2.%' or dst_ip like '10.0.2.%') and protocol = 6 and is_flagged and score >= 0.4e0 and start_us >= {I.EPOCH_US + 3_600_000_000}
  order by start_us desc, flow_id limit 50 offset 10"""
ORACLES["frequent_ports"] = f"with {FLOWS_IN} select dst_port, count(*) as flows from flows group by 1 order by flows desc, dst_port limit 20"
ORACLES["duration_summary"] = f"""with {FLOWS_IN} select protocol, count(*) as n, min(duration_us) as least, max(duration_us) as most,
  cast(sum(duration_us) as bigint) as total, round(avg(duration_us), 6) as average from flows group by 1"""
_FEED2 = FEEDS.replace("feeds as (", "all_feeds as (") + ", feeds as (select * from all_feeds where feed_name = 'feed_2')"
ORACLES["indicator_hits"] = f"""with {FLOWS_IN}, {_FEED2}, {TI} select flow_id, dst_ip, dst_port from flows where start_us between {I.EPOCH_US} and {_NOON}
  and (dst_port in (31337, 6667) or flow_id in (select flow_id from ti where not is_source))"""
ORACLES["correlated_groups"] = f"""with {FLOWS_IN}, w as (select *, start_us - start_us % 300000000 as window_us from flows)
  select 'source' as kind, src_ip as who, window_us, count(*) as flows from w group by all having count(*) >= 3
  union all select 'target', dst_ip, window_us, count(*) from w group by all having count(*) >= 3
  union all select 'time', '', window_us, count(*) from w group by all having count(*) >= 3"""
ORACLES["sweeps"] = f"""with {FLOWS_IN}, w as (select *, start_us - start_us % 3600000000 as window_us from flows)
  select 'port' as kind, window_us, src_ip, count(distinct dst_port) as targets, count(*) as flows from w group by all having count(distinct dst_port) >= 5
  union all select 'network', window_us, src_ip, count(distinct dst_ip), count(*) from w group by all having count(distinct dst_ip) >= 5"""
def _moving(kind, value, least, who="src_ip"):
    """By its meaning: at each flow, the distinct values of the window that ends with it."""
    same = f"a.{who} = b.{who} and" if who else ""
    key = f"a.{who}" if who else "''"
    return f"""select '{kind}' as kind, who, min(at_us) as first_us, max(n) as most, arg_max(at_us, (n, -at_us)) as most_us from
    (select {key} as who, a.start_us as at_us, count(distinct b.{value}) as n from flows a join flows b
      on {same} b.start_us > a.start_us - 300000000 and b.start_us <= a.start_us group by all) where n >= {least} group by who"""


_MOVING = [("port", "dst_port", 3), ("network", "dst_ip", 3), ("flows", "flow_id", 3), ("sources", "src_ip", 30, "")]
ORACLES["moving_sweeps"] = f"with {FLOWS_IN} " + " union all ".join(_moving(*m) for m in _MOVING)
ORACLES["moving_sweep_members"] = f"""with {FLOWS_IN}, g as ({_moving("port", "dst_port", 3)})
  select src_ip, first_us, flow_id, dst_port, start_us from flows join g on who = src_ip and start_us > first_us - 300000000 and start_us <= first_us"""
ORACLES["correlations_with_gaps"] = f"""with {LONG}, held as (select vec_id, pos, case when pos = 2 then 3.5 else x end as x from cells
    where not (pos = 0 and vec_id % 7 = 0) and not (pos = 1 and vec_id % 5 = 0)),
  r as (select a.pos as i, b.pos as j, count(*) as n, case when a.pos <> 2 and b.pos <> 2 then corr(a.x, b.x) end as r
    from held a join held b on a.vec_id = b.vec_id and a.pos < b.pos group by 1, 2)
  select 'f' || i as a, 'f' || j as b, round(r, 8) as r, n from r"""
_OUTSIDE_FLOWS = (
    FLOWS_IN.replace("flows as (", "plain as (")
    + ", flows as (select * exclude (src_ip, dst_ip), "
    + ", ".join(I.OUTSIDE_ENDS)
    + " from plain)"
)
_OUTSIDE = f"with {_OUTSIDE_FLOWS}, {PREDICTIONS}, {FEEDS}, {TI}, {rules_cte()}, {fused_cte(SCORES)}, det as (select *, src_ip like '10.%' as si, dst_ip like '10.%' as di from fused join flows using (flow_id))"
_LATERAL = """lat as (select * from det d where si and di and exists (select 1 from det a where a.is_flagged and not a.si and a.di
    and a.dst_ip = d.src_ip and a.start_us between d.start_us - 300000000 and d.start_us))"""
ORACLES["lateral_flows"] = f"{_OUTSIDE}, {_LATERAL} select flow_id, src_ip, dst_ip, start_us from lat"
ORACLES["incident_timeline"] = f"""{_OUTSIDE}, {_LATERAL}, w as (select *, start_us - start_us % 300000000 as window_us from det),
  pairs as (select src_ip, dst_ip, window_us, min(start_us) as at_us from w group by all),
  ev as (select 'FirstContact' as event, src_ip, min(start_us) as at_us from det group by src_ip
  union all select 'Reconnaissance', src_ip, window_us from w group by src_ip, window_us having count(distinct dst_port) >= 4
  union all select 'Exploitation', src_ip, start_us from det where atk
  union all select 'LateralMovement', src_ip, start_us from lat
  union all select 'Exfiltration', src_ip, start_us from det where si and not di and fwd_packets * avg_packet_size >= 500000
  union all select 'Persistence', src_ip, min(at_us) from pairs group by src_ip, dst_ip having count(*) >= 3)
  select event, src_ip, count(*) as n, min(at_us) as first_us, max(at_us) as last_us from ev group by event, src_ip"""


def _baseline(source):
    return f"""per as (select start_us // 60000000 as minute, count(*) as flows, sum(fwd_packets + bwd_packets) as packets,
    sum((fwd_packets + bwd_packets) * avg_packet_size) as bytes from {source} group by 1),
  base as (select avg(flows) as flows_mean, avg(packets) as packets_mean, avg(bytes) as bytes_mean, stddev_pop(flows) as flows_std,
    stddev_pop(packets) as packets_std, stddev_pop(bytes) as bytes_std, (select avg(duration_us) from {source}) as duration_mean,
    (select stddev_pop(duration_us) from {source}) as duration_std from per)"""


ORACLES["baseline_metrics"] = f"with {FLOWS_IN}, {_baseline('flows')} select " + ", ".join(
    f"round({c}, 3) as {c}"
    for c in [*[f"{m}_{s}" for s in ("mean", "std") for m in ("flows", "packets", "bytes")], "duration_mean", "duration_std"]
) + " from base"
ORACLES["anomalies"] = f"""with {FLOWS_IN}, past as (select * from flows where start_us < {_NOON}), cur as (select * from flows where start_us >= {_NOON}),
  {_baseline('past')}, m as (select start_us // 60000000 as minute, count(*) as flows, sum(fwd_packets + bwd_packets) as packets,
    sum((fwd_packets + bwd_packets) * avg_packet_size) as bytes from cur group by 1)""" + " ".join(
    f"{'union all' if i else ''} select 'volume {c}' as kind, cast(minute as varchar) as what, round(({c} - {c}_mean) / {c}_std, 6) as sigma from m, base where ({c} - {c}_mean) / {c}_std >= 2"
    for i, c in enumerate(("flows", "packets", "bytes"))
) + """ union all select 'duration', cast(flow_id as varchar), round((duration_us - duration_mean) / duration_std, 6) from cur, base
    where abs((duration_us - duration_mean) / duration_std) >= 1.5
  union all select 'port', cast(dst_port as varchar), cast(count(*) as double) from cur where dst_port not in (select dst_port from past) group by dst_port
  union all select 'ratio', cast(flow_id as varchar), 0e0 from cur where fwd_packets * avg_packet_size > 0
    and fwd_packets * avg_packet_size >= 40 * greatest(bwd_packets * (1440 - avg_packet_size), 1)"""
ORACLES["address_frequency"] = f"with {FLOWS_IN} select src_ip as value, count(*) as flows from flows group by 1"

# -- state -------------------------------------------------------------------

ORACLES["streamed_flow_metadata"] = f"{ASSEMBLED}, info as ({INFO}) select * exclude (reason) from info"
_SPLIT = f"with recursive {PACKETS}, {flows_cte(longest=SPLIT_US)}"
ORACLES["streamed_detections"] = f"""{_SPLIT}, {_BUILT_FLOWS}, {FEEDS}, {TI}, {rules_cte()}, {fused_cte(_BY_PORT)},
  verdicts as ({FUSED_COLUMNS}) select *, true as has_line from verdicts"""
ORACLES["duration_splits"] = f"""with recursive {PACKETS}, {flows_cte(longest=4_000_000)} {INFO}
  union all select -1 - last_id, end_us, end_us, case when nts = -1 then 'finalize' else 'timeout' end, src_ip, dst_ip,
  src_port, dst_port, protocol, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0 from built
  where not closed and (n = 200 or end_us - start_us >= 4000000) and (nts = -1 or nts - end_us > {TIMEOUT_US})"""
ORACLES["streamed_counters"] = f"""with {PACKETS} select 'packets' as name, count(*) as total from packets
  union all select 'seen.rows', count(*) from packets union all select 'seen.flagged', count(*) filter (protocol = 6) from packets
  union all select 'late', 0 union all select 'missing', 0"""
ORACLES["streamed_port_scans"] = f"""with {PACKETS},
  w as (select ts_us - ts_us % 120000000 as window_us, src_ip, src_port * 7 % 50 + total_len as port from packets
    where not (pkt_id % 10 = 3 and ts_us + 200000 < {I.EPOCH_US + 144_000_000})),
  seen as (select (max(ts_us) // 1000 - 20000) * 1000 as mark from packets)
  select window_us, src_ip, count(distinct port) as distinct_ports, round(least(1, count(distinct port) / 9e0), 6) as severity
  from w, seen where window_us + 120000000 <= mark group by all having count(distinct port) >= 3"""

ORACLES["csv_tree"] = f"""select * exclude (path, pkt_id), split_part(path, '/', -2) as folder from ({ORACLES['csv_packets']})"""
ORACLES["packet_table"] = f"with {PACKETS} select * from packets"
ORACLES["feed_folder"] = ORACLES["feed_entries"]
ORACLES["training_set"] = f"""with {SPLIT}, {LONG}, sums as (select vec_id, sum((pos + 1) * x) as total from cells group by vec_id)
  select vec_id, label, split, round(total, 5) as total from splits join sums using (vec_id)"""
ORACLES["norm_file"] = f"""with {SPLIT}, {LONG}, fit as (select pos, avg(x) as mean, case when stddev_pop(x) < 1e-8 then 1 else stddev_pop(x) end as std
  from cells join splits using (vec_id) where split = 'train' group by pos)
  select pos, 'f' || pos as feature, round(mean, 8) as mean, round(std, 8) as std, cast({CLIP_VALUE} as double) as clip from fit"""
