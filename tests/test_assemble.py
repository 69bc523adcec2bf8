import pytest
from tests.helpers import (
    ACK, CWR, ECE, FIN, PSH, RST, SEC, SYN, URG, frame, packet, random_packets, reply, same_flows, simulate,
)

from flowsight.operators.assemble import (
    HotKeys, assemble_flows, find_hot_keys, flow_diagnostics, keyed_packets, with_flow_key,
)
from flowsight.operators.features import feature_vector, flow_info
from flowsight.schema import FEATURE_COLUMNS, FLOW_INFO_COLUMNS


def flows(spark, packets, **kw):
    return assemble_flows(frame(spark, packets), **kw).orderBy("start_us", "flow_id").collect()


def test_both_directions_make_one_flow(spark):
    f = flows(spark, [packet(0, size=100), reply(SEC, size=40)])
    assert len(f) == 1
    f = f[0]
    assert (f.src_ip, f.dst_port, f.fwd_packets, f.bwd_packets) == ("10.0.0.1", 80, 1, 1)
    assert (f.duration_us, f.total_length_of_fwd_packets, f.total_length_of_bwd_packets) == (SEC, 100, 40)
    assert f.fwd_pps == 1.0 and f.down_up_ratio == 1.0 and f.average_packet_size == 70


@pytest.mark.parametrize("ending", [FIN | ACK, RST])
def test_fin_and_rst_end_a_flow_with_that_packet(spark, ending):
    f = flows(spark, [packet(0, flags=SYN), packet(SEC, flags=ending), reply(2 * SEC)])
    assert [(x.fwd_packets, x.reason) for x in f] == [(2, "fin_rst"), (1, "finalize")]
    assert f[1].src_ip == "10.0.0.2"  # the next packet sets the direction anew


def test_fin_bit_means_nothing_outside_tcp(spark):
    udp = [packet(i, proto=17)[:9] + (FIN, 0) for i in range(3)]
    assert len(flows(spark, udp)) == 1


def test_idle_timeout_is_strict(spark):
    assert len(flows(spark, [packet(0), packet(600 * SEC)])) == 1
    f = flows(spark, [packet(0, flags=SYN), packet(700 * SEC)])
    assert [x.reason for x in f] == ["timeout", "finalize"]
    assert len(flows(spark, [packet(0), packet(5 * SEC)], timeout_us=2 * SEC)) == 2


def test_size_split_keeps_direction_and_starts_at_last_packet(spark):
    p = [packet(i * 1000) for i in range(200)] + [reply(200_000 + i * 1000) for i in range(50)]
    f = flows(spark, p)
    assert [(x.fwd_packets, x.bwd_packets, x.reason) for x in f] == [(200, 0, "max_pkts"), (0, 50, "finalize")]
    assert f[1].start_us == SEC + 199_000 and f[1].src_ip == "10.0.0.1"
    assert f[1].flow_iat_min == 1000 and f[1].bwd_iat_total == 49_000


def test_empty_tail(spark):
    p = [packet(i * 1000) for i in range(200)]
    assert len(flows(spark, p)) == 1
    f = flows(spark, p, emit_empty_tail=True)
    assert sorted((x.fwd_packets, x.duration_us, x.reason) for x in f) == [
        (0, 0, "finalize"), (200, 199_000, "max_pkts"),
    ]
    tail = min(f, key=lambda x: x.fwd_packets)
    assert all(tail[c] == 0 for c in FEATURE_COLUMNS if c != "destination_port")


def test_icmp_request_and_reply_stay_apart(spark):
    p = [packet(0, sport=8, dport=0, proto=1), reply(1, sport=0, dport=0, proto=1)]
    assert len(flows(spark, p)) == 2


def test_bulk_runs(spark):
    p = [packet(i, size=100) for i in range(5)] + [reply(10 + i, size=50) for i in range(3)]
    f = flows(spark, p)[0]
    assert (f.fwd_avg_packets_bulk, f.fwd_avg_bytes_bulk) == (5, 500)
    assert (f.bwd_avg_packets_bulk, f.bwd_avg_bytes_bulk) == (3, 150)
    assert f.fwd_avg_bulk_rate == pytest.approx(500 / 12e-6)


def test_idle_and_active(spark):
    p = [packet(0), packet(100_000), packet(10 * SEC)]
    f = flows(spark, p)[0]
    assert (f.idle_mean, f.idle_max, f.idle_std, f.active_mean) == (9_900_000, 9_900_000, 0, 0)
    t = flows(spark, p, true_active_periods=True)[0]
    assert (t.active_mean, t.active_max) == (100_000, 100_000)


def test_payload_and_flags(spark):
    p = [packet(i, flags=PSH | ACK, size=40 + n, win=w) for i, (n, w) in enumerate([(100, 0), (50, 7), (200, 9)])]
    f = flows(spark, p)[0]
    assert (f.act_data_pkt_fwd, f.min_seg_size_forward, f.fwd_psh_flags) == (3, 50, 3)
    assert f.init_win_bytes_forward == 7
    p = [packet(0, flags=URG), packet(1, flags=CWR), packet(2, flags=ECE), reply(3, flags=URG | PSH)]
    f = flows(spark, p)[0]
    assert (f.urg_flag_count, f.cwe_flag_count, f.ece_flag_count, f.bwd_urg_flags, f.bwd_psh_flags) == (2, 1, 1, 1, 1)


def test_zero_duration_has_no_rates(spark):
    f = flows(spark, [packet(0, size=60)])[0]
    assert f.flow_bytes_s == f.flow_packets_s == f.fwd_pps == 0
    assert (f.packet_length_std, f.packet_length_variance, f.fwd_packet_length_mean) == (0, 0, 60)


def test_variance_is_of_the_population_and_std_of_the_sample(spark):
    f = flows(spark, [packet(0, size=40), packet(1, size=60)])[0]
    assert f.packet_length_variance == pytest.approx(100)
    assert f.packet_length_std == pytest.approx(200**0.5)


CASES = [dict(), dict(timeout=3 * SEC, most=20), dict(timeout=SEC, most=7, tails=True)]


@pytest.mark.parametrize("seed,case", list(enumerate(CASES)))
@pytest.mark.parametrize("hot_rows", [None, 150])
def test_against_brute_force(spark, seed, case, hot_rows):
    p = random_packets(3000, seed)
    got = assemble_flows(
        frame(spark, p),
        timeout_us=case.get("timeout", 600 * SEC),
        max_packets=case.get("most", 200),
        emit_empty_tail=case.get("tails", False),
        hot_rows=hot_rows,
    )
    same_flows(got, simulate(p, **case))


@pytest.mark.parametrize("hot", [False, True])
def test_duration_splits_against_brute_force(spark, hot, monkeypatch):
    from flowsight.operators import duration

    monkeypatch.setattr(duration.split_by_duration, "__defaults__", (False, 60))
    p = random_packets(2500, 9, step=100_000)
    got = assemble_flows(
        frame(spark, p), timeout_us=4 * SEC, max_packets=15, max_duration_us=SEC,
        emit_empty_tail=True, hot_rows=100 if hot else None,
    )
    want = simulate(p, timeout=4 * SEC, most=15, duration=SEC, tails=True)
    assert {"duration", "max_pkts", "timeout"} <= {w["reason"] for w in want}
    same_flows(got, want)


def test_one_key_with_most_rows_is_cut_into_blocks(spark):
    p = [packet(i * 10) for i in range(4000)] + [packet(i * 10, sport=5) for i in range(200)]
    keyed = keyed_packets(frame(spark, p), ())
    hot = find_hot_keys(keyed, ["lo_ip", "lo_port", "hi_ip", "hi_port", "protocol"], 500)
    assert isinstance(hot, HotKeys) and len(hot.rows) == 1 and len(hot.rows[0][-1]) >= 6
    same_flows(assemble_flows(frame(spark, p), hot_rows=500), simulate(p))


@pytest.mark.parametrize("times", [1, 3])
def test_packets_of_one_time_are_cut_into_blocks(spark, times):
    from pyspark.sql import functions as F

    from flowsight.operators.assemble import KEY, _block

    ends = {1999: FIN, 700: FIN}
    p = [packet(i * times // 2000, flags=ends.get(i, ACK)) if i % 3 else reply(i * times // 2000) for i in range(2000)]
    keyed = keyed_packets(frame(spark, p), ())
    hot = find_hot_keys(keyed, KEY, 200)
    blocks = keyed.join(F.broadcast(hot.table(keyed)), KEY).groupBy(_block().alias("b")).count().collect()
    assert len(blocks) == 10 and max(r["count"] for r in blocks) <= 201
    same_flows(assemble_flows(frame(spark, p), hot_rows=200), simulate(p))


def test_scope_keeps_sessions_apart(spark):
    from pyspark.sql import functions as F

    p = frame(spark, [packet(i) for i in range(10)]).withColumn("session_id", F.expr("pkt_id % 2"))
    f = assemble_flows(p, scope=["session_id"])
    assert sorted((r.session_id, r.fwd_packets) for r in f.collect()) == [(0, 5), (1, 5)]


def test_assembly_takes_one_shuffle_and_one_sort(spark):
    plan = assemble_flows(frame(spark, [packet(0)]), find_hot=False)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
    assert plan.count("+- Sort ") == 1
    assert "SortAggregate" not in plan and "ObjectHashAggregate" not in plan


def test_vector_and_metadata_shapes(spark):
    f = assemble_flows(frame(spark, [packet(0), reply(5)]))
    assert len(FEATURE_COLUMNS) == 77 == len(feature_vector(f).first().features)
    assert flow_info(f).columns == ["flow_id", *FLOW_INFO_COLUMNS]


def test_diagnostics_count_unusable_packets(spark):
    p = frame(spark, [packet(0), packet(1, flags=FIN), packet(2, src=None)])
    d = {r.counter: r.value for r in flow_diagnostics(assemble_flows(p), p).collect()}
    assert d == {"flows_fin_rst": 1, "packets_received": 3, "packets_parsed": 2, "packets_skipped": 1}


def test_flow_key_is_the_same_both_ways(spark):
    k = with_flow_key(frame(spark, [packet(0), reply(1)]))
    assert k.select("lo_ip", "lo_port", "hi_ip", "hi_port").distinct().count() == 1
    assert [r.from_lo for r in k.orderBy("pkt_id").collect()] == [True, False]


def test_duration_split_does_not_depend_on_batches():
    """The splitter fed row by row, in small batches and at once."""
    import numpy as np
    import pandas as pd

    from flowsight.operators.duration import MAX_PKTS, _splitter, reached

    rng = np.random.default_rng(6)
    parts = []
    for key in range(4):
        n = int(rng.integers(1, 120))
        ts = np.cumsum(rng.integers(0, 40, n))
        end = pd.array(np.where(rng.random(n) < 0.05, rng.choice([0, 2], n), -1), "Int32")
        end[-1] = 4
        end[end == -1] = pd.NA
        start = np.append(True, ~end.isna()[:-1])
        prev = pd.array(np.where(start, 0, np.append(0, ts[:-1])), "Int64")
        prev[start] = pd.NA
        rn = np.arange(1, n + 1)
        parts.append(pd.DataFrame({
            "k": key, "rn": rn, "ts_us": ts, "seg_prev_ts": prev, "flow_rn": 0, "reason": end, "tail_reason": end,
            "seg_end": end, "block": 0, "open_rn": pd.array([pd.NA] * n, "Int64"), "open_ts": pd.array([pd.NA] * n, "Int64"),
        }))
        if key == 2:  # a block that the flow of packets -2 to 0, begun at time -30, enters
            parts[-1].loc[:, "open_rn"], parts[-1].loc[:, "open_ts"] = -2, -30
    rows = pd.concat(parts, ignore_index=True)
    columns = ["k", "rn", "ts_us", "flow_rn", "reason", "tail_reason"]

    def plain():
        out, first, base = [], None, None
        for r in rows.itertuples():
            if r.Index == 0 or rows.k[r.Index - 1] != r.k:
                first = None
                if not pd.isna(r.open_rn):
                    first, base = int(r.open_rn), int(r.open_ts)
            if first is None:
                first, base = r.rn, r.ts_us if pd.isna(r.seg_prev_ts) else r.seg_prev_ts
            end = None if pd.isna(r.seg_end) else int(r.seg_end)
            why, tail = end, None
            if end != 0 and r.rn - first + 1 >= 9:
                why, tail = MAX_PKTS, end
            elif end != 0 and r.ts_us - base >= 100:
                why, tail = 3, end
            out.append((r.k, r.rn, r.ts_us, first, why, tail))
            if why is not None:
                first = None
        return out

    for size in (1, 2, 7, 1000):
        split = _splitter(columns, ["k"], 100, 9)
        got = pd.concat(split(rows[i : i + size].reset_index(drop=True) for i in range(0, len(rows), size)))
        none = got.astype(object).where(got.notna(), None)
        assert list(none.itertuples(index=False, name=None)) == plain()
    marks = reached(np.array([True, False, False, False, False]), np.array([2, 2, 4, 5, 5]))
    assert marks.tolist() == [True, False, True, False, True]


def test_long_lists_of_cuts_are_searched(spark):
    """Over 64 blocks of a key, with packets of one time and two hot keys: searched blocks equal the listed ones."""
    from flowsight.operators.assemble import KEY, LISTED_CUTS, _block

    ends = {1999: FIN, 700: FIN}
    p = [packet(i // 40, flags=ends.get(i, ACK), sport=1000 + i % 7 // 4) for i in range(4000)]
    keyed = keyed_packets(frame(spark, p), ())
    hot = find_hot_keys(keyed, KEY, 20)
    assert len(hot.rows) == 2 and min(len(r[-1]) for r in hot.rows) > LISTED_CUTS
    searched = hot.with_block(keyed)
    assert "ArrowEvalPython" in searched._jdf.queryExecution().executedPlan().toString()
    listed = keyed.join(hot.table(keyed), KEY).withColumn("block", _block())
    rows = lambda df: sorted(map(tuple, df.select("pkt_id", "block").collect()))
    assert rows(searched) == rows(listed) and len({r[1] for r in rows(listed)}) > LISTED_CUTS
    same_flows(assemble_flows(frame(spark, p), hot_rows=20), simulate(p))
