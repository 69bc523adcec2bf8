import json
import types

import numpy as np
import pandas as pd
import pytest
from tests.helpers import FIN, SEC, frame, packet, random_packets, reply

from flowsight.operators.assemble import assemble_flows
from flowsight.operators.features import FEATURE_COLUMNS
from flowsight.operators.fusion import detect
from flowsight.operators.scoring import score_by_port
from flowsight.schema import PACKET_SCHEMA
from flowsight.sources.packets import read_packet_stream
from flowsight.sources.sinks import (
    alert_json, alert_line, cef_line, fan_out, filter_alerts, leef_line, syslog_severity, to_events, to_json_lines,
)
from flowsight.streaming.accumulate import PACKET, Limits, OpenFlow, advance, expire, finish
from flowsight.streaming.counters import RunCounters, counted
from flowsight.streaming.live import LiveDetection, TableSink, stream_port_scan
from flowsight.streaming.sessions import FlowSessions, flush_sessions, stream_flows

LIMITS = dict(timeout_us=6 * SEC, max_packets=20, max_duration_us=3 * SEC)


def write_slices(spark, p, tmp_path, slices, first=None):
    """Packets as files by time; a packet number ``first`` arrives before all others."""
    pdf = p.toPandas()
    low, high = pdf.ts_us.min(), pdf.ts_us.max() + 1
    place = (pdf.ts_us - low) * slices // (high - low)
    if first is not None:
        place[pdf.pkt_id == first] = 0
    for i in range(slices):
        spark.createDataFrame(pdf[place == i], PACKET_SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    return read_packet_stream(spark, f"{tmp_path}/in/*", max_files=1)


def same(streamed, batch):
    streamed, batch = (x.sort_values("flow_id").reset_index(drop=True) for x in (streamed, batch))
    # the timer of an idle 5-tuple may end a flow that the end of input ends in a batch
    streamed["reason"], batch["reason"] = (x["reason"].replace("finalize", "timeout") for x in (streamed, batch))
    pd.testing.assert_frame_equal(streamed, batch, check_dtype=False, rtol=1e-9)


def test_stream_and_flush_equal_batch(spark, tmp_path):
    p = frame(spark, random_packets(900, 5, keys=4, step=50_000))
    got = []
    stream = write_slices(spark, p, tmp_path, 3)
    q = stream_flows(
        stream, [lambda df, i: got.append(df.toPandas())], f"{tmp_path}/c", watermark="1 second", true_active_periods=True, **LIMITS
    ).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sum(len(g) > 0 for g in got) >= 3 and len(q.recentProgress) >= 3
    rest = flush_sessions(spark, f"{tmp_path}/c", true_active_periods=True, **LIMITS).toPandas()
    assert "finalize" in set(rest.reason)
    streamed = pd.concat([*got, rest])
    assert {"fin_rst", "max_pkts", "timeout", "duration"} <= set(streamed.reason)
    same(streamed, assemble_flows(p, true_active_periods=True, **LIMITS).toPandas())


def test_last_packet_first_needs_no_sentinel(spark, tmp_path):
    """Packets in any order within the watermark: nothing closes before the flush, which then gives the batch."""
    p = frame(spark, random_packets(300, 8, keys=3, step=50_000))
    last = p.agg({"pkt_id": "max"}).first()[0]
    got = []
    q = stream_flows(
        write_slices(spark, p, tmp_path, 2, last), [lambda df, i: got.append(df.toPandas())], f"{tmp_path}/c",
        watermark="30 days", **LIMITS,
    ).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sum(map(len, got)) == 0
    same(flush_sessions(spark, f"{tmp_path}/c", **LIMITS).toPandas(), assemble_flows(p, **LIMITS).toPandas())


class Store:
    """A state handle that counts what it is asked for."""

    def __init__(self):
        self.maps, self.timers, self.reads = {}, set(), []

    def getMapState(self, name, *_):
        data = self.maps.setdefault(name, {})

        def get(k):
            self.reads.append((name, k))
            return data[k]

        return types.SimpleNamespace(
            containsKey=data.__contains__, getValue=get, updateValue=data.__setitem__, removeKey=data.pop
        )

    def getValueState(self, name, _):
        data = self.maps.setdefault(name, {})
        return types.SimpleNamespace(
            exists=lambda: bool(data), get=lambda: data[0], update=lambda v: data.__setitem__(0, v), clear=data.clear
        )

    def registerTimer(self, at):
        self.timers.add(at)


def test_only_due_buckets_are_read():
    rows, seconds, chunk = 200_000, 100, 20_000
    pdf = pd.DataFrame({
        "ts_us": np.arange(rows, dtype="int64") * (seconds * SEC // rows), "pkt_id": np.arange(rows),
        "header_bytes": 40, "total_len": 60 + np.arange(rows) % 50, "payload_size": 20, "tcp_flags": 16, "tcp_window": 9,
        "from_lo": np.arange(rows) % 3 > 0, "closes": False,
    })
    store, key = Store(), ("a", 1, "b", 2, 6)
    limits = Limits(60 * SEC, 10**9, None)
    sessions = FlowSessions(limits)
    sessions.init(store)
    shuffled = pdf.sample(frac=1, random_state=3)
    for at in range(0, rows, chunk):
        list(sessions.handleInputRows(key, iter([shuffled[at : at + chunk]]), None))
    # adding packets reads no packet, and one timer stands per bucket
    assert not [r for r in store.reads if r[0] == "waiting"] and len(store.timers) == seconds
    size = set()
    for at in sorted(store.timers):
        store.reads.clear()
        out = list(sessions.handleExpiredTimer(key, None, types.SimpleNamespace(getExpiryTimeInMs=lambda at=at: at)))
        assert {r[1][0] for r in store.reads} <= {at // 1000 - 1} and not out
        size.add(len(store.maps["open"][0][0]))
    assert len(size) == 1 and not store.maps["waiting"] and not store.maps["blocks"]
    flow = OpenFlow.from_bytes(store.maps["open"][0][0])
    (row,) = finish(flow, key)
    assert row[5:9] == (0, 0, pdf.ts_us.max(), rows - 1)
    # idle: the timer that was set while packets came ends it
    late = max(store.timers)
    assert late * 1000 > pdf.ts_us.max() + limits.timeout_us or len(store.timers) > seconds


def test_counters_survive_their_state_form():
    rng = np.random.default_rng(1)
    packets = np.zeros(500, PACKET)
    packets["ts_us"] = np.cumsum(rng.integers(0, 9 * SEC, 500))
    packets["pkt_id"], packets["total_len"] = np.arange(500), rng.integers(40, 900, 500)
    packets["from_lo"], packets["tcp_flags"] = rng.random(500) < 0.6, rng.integers(0, 256, 500)
    limits, key = Limits(8 * SEC, 30, 20 * SEC), ("a", 1, "b", 2, 17)
    whole, parted = OpenFlow(), OpenFlow()
    want = [*advance(whole, packets, key, limits), *finish(whole, key)]
    got = []
    for at in range(0, 500, 7):
        parted = OpenFlow.from_bytes(parted.to_bytes())
        got += advance(parted, packets[at : at + 7], key, limits)
    got += finish(parted, key)
    assert got == want and len(want) > 20
    assert list(finish(OpenFlow(), key)) == [] and list(expire(OpenFlow(), key, 10**15, limits)) == []


def test_totals_over_many_batches_and_a_restart(spark, tmp_path):
    sizes = [i % 7 + 1 for i in range(110)]
    schema = "a long"

    def run(part):
        for i in part:
            spark.range(sizes[i]).selectExpr("id as a").coalesce(1).write.parquet(f"{tmp_path}/in/{i:04d}")
        counters = RunCounters(spark, f"{tmp_path}/totals", "totals-test")
        spark.streams.addListener(counters)
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
        q = counted(stream, "seen", "a > 2").writeStream.queryName("totals-test").format("noop")
        q.option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
        out = counters.totals()
        spark.streams.removeListener(counters)
        return out

    assert run(range(105))["packets"] == sum(sizes[:105])
    out = run(range(105, 110))
    assert out == {
        "batches": 110, "missing": 0, "packets": sum(sizes), "late": 0, "seen.rows": sum(sizes),
        "seen.flagged": sum(max(0, n - 3) for n in sizes),
    }
    # one small file per batch, of which a few stay
    again = RunCounters(spark, f"{tmp_path}/totals", "other")
    assert len([n for n in again.folder.names() if n.startswith("batch-")]) == 3
    # a repeated report changes nothing, a skipped one shows
    again.add({"batchId": 109, "numInputRows": 5})
    again.add({"batchId": 111, "numInputRows": 5, "stateOperators": [{"numRowsDroppedByWatermark": 2}]})
    assert (again.sums["packets"], again.sums["late"], again.missing) == (sum(sizes) + 5, 2, 1)
    saved = json.loads(again.folder.read("batch-" + "111".zfill(20) + ".json"))
    assert saved["missing"] == 1


def test_live_detection_with_a_failing_sink(spark, tmp_path):
    p = frame(spark, random_packets(500, 4, keys=4, step=50_000))
    feeds = spark.createDataFrame([(167772161, 32, True, "bad")], "network long, prefix_len int, is_exact boolean, feed_name string")
    first, second = TableSink(f"{tmp_path}/first"), TableSink(f"{tmp_path}/second", lambda d: d.select("flow_id", "verdict"))
    failed = []

    def breaks_once(df, batch_id):
        if batch_id == 2 and not failed:
            failed.append(batch_id)
            raise RuntimeError("the second sink is away")
        second(df, batch_id)

    stream = write_slices(spark, p, tmp_path, 4)

    def detection():
        return LiveDetection([first, breaks_once], f"{tmp_path}/c", feeds, score_by_port, "1 second", **LIMITS)

    q = detection().writer(stream).trigger(availableNow=True).start()
    with pytest.raises(Exception, match="second sink is away"):
        q.awaitTermination()
    live = detection()
    live.writer(stream).trigger(availableNow=True).start().awaitTermination()
    live.flush(spark)
    want = detect(score_by_port(assemble_flows(p, **LIMITS)), feeds)
    rows = lambda df: sorted(map(tuple, df.select("flow_id", "verdict").collect()))
    assert failed and rows(first.read(spark)) == rows(second.read(spark)) == rows(want)
    assert sorted(map(tuple, first.read(spark).select("flow_id", "has_ti", *FEATURE_COLUMNS[:9]).collect())) == sorted(
        map(tuple, want.select("flow_id", "has_ti", *FEATURE_COLUMNS[:9]).collect())
    )


def test_port_scan_windows_of_a_stream(spark, tmp_path):
    """Windows of 10 s, watermark 5 s: a window is reported once it is passed, and rows after that are dropped."""
    at = lambda t, src, *ports: [(t * SEC, src, p) for p in ports]
    batches = [
        at(1, "s", 1, 2, 3) + at(2, "s", 3, 3) + at(3, "quiet", 1),
        at(4, "s", 4) + at(12, "s", 9),  # 4 is out of order, in time
        at(27, "t", 1, 2, 3, 4),
        at(28, "t", 5),
        at(5, "s", 7, 8),  # its window has gone
        at(60, "x", 1),
    ]
    for i, b in enumerate(batches):
        spark.createDataFrame(b, "ts_us long, src_ip string, dst_port int").coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    stream = spark.readStream.schema("ts_us long, src_ip string, dst_port int").option("maxFilesPerTrigger", 1)
    stream = stream.parquet(f"{tmp_path}/in/*").selectExpr("*", "timestamp_micros(ts_us) as ts")
    sink = TableSink(f"{tmp_path}/out")
    q = stream_port_scan(stream, "10 seconds", 4, watermark="5 seconds").writeStream.foreachBatch(sink)
    q = q.option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination()
    rows = sink.read(spark).selectExpr("unix_seconds(window_start) as at", "src_ip", "distinct_ports").collect()
    assert sorted(map(tuple, rows)) == [(0, "s", 4), (20, "t", 5)]
    assert sum(o["numRowsDroppedByWatermark"] for r in q.recentProgress for o in r["stateOperators"]) >= 1
    everything = spark.read.schema("ts_us long, src_ip string, dst_port int").parquet(f"{tmp_path}/in/*")
    batch = stream_port_scan(everything.selectExpr("*", "timestamp_micros(ts_us) as ts"), "10 seconds", 4, watermark=None)
    assert sorted((r.src_ip, r.distinct_ports) for r in batch.collect()) == [("s", 6), ("t", 5)]


def detections(spark):
    f = assemble_flows(frame(spark, [packet(0), reply(5), packet(10 * SEC, sport=2, dport=4444), packet(11 * SEC, flags=FIN, sport=2, dport=4444), packet(1, dport=5000)]))
    return detect(score_by_port(f))


def test_alert_filters_and_lines(spark):
    d = detections(spark)
    assert [filter_alerts(d, m).count() for m in ("all", "flagged", "clean")] == [3, 2, 1]
    lines = {r.dst_port: r.line for r in d.select("dst_port", alert_line().alias("line")).collect()}
    assert lines[80].startswith("ALERT flow #0: 10.0.0.1:1000 -> 10.0.0.2:80 verdict=SYN Flood confidence=0.850 source=ML Classifier")
    assert lines[5000].startswith("CLEAN flow #") and lines[5000].endswith("[Benign] confidence=0.850")
    assert sorted(r[0] for r in d.select(syslog_severity()).collect()) == [5, 6, 6]


def test_events_and_documents(spark):
    d = detections(spark)
    e = to_events(d).filter("flow.dst_port = 4444").first()
    assert (e.flow.protocol, e.verdict, e.source, e.rule_matches[0].rule_name) == ("TCP", "BENIGN", "HeuristicRule", "suspicious_port")
    assert '"ml_classification":"Benign"' in to_json_lines(to_events(d).filter("flow.dst_port = 4444")).first().value
    assert '"timestamp":"1970-01-01T00:00:12.000Z"' in alert_json(d.filter("dst_port = 4444")).first().value
    row = d.filter("dst_port = 80").select(cef_line().alias("c"), leef_line("v", "p").alias("l")).first()
    assert row.c.startswith("CEF:0|flowsight|flowsight|1.0|flowsight-MlOnly-11|SYN Flood|4|src=10.0.0.1 dst=10.0.0.2 spt=1000")
    assert row.l.startswith("LEEF:2.0|v|p|1.0|MlOnly-11|src=10.0.0.1\tdst=10.0.0.2\t")


def test_fan_out_reaches_every_sink(spark, tmp_path):
    frame(spark, [packet(i) for i in range(7)]).write.parquet(str(tmp_path / "in"))
    seen = {"a": 0, "b": 0}

    def sink(name):
        def write(df, i):
            seen[name] += df.count()

        return write

    stream = spark.readStream.schema(PACKET_SCHEMA).parquet(str(tmp_path / "in"))
    fan_out(stream, [sink("a"), sink("b")], str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert seen == {"a": 7, "b": 7}


def test_a_slice_of_many_files_is_one_batch(spark, tmp_path):
    """Rows of one slice lie in several files in no order: none is late, and the files do not multiply the batches."""
    from flowsight.plans.queries import QUERIES

    events = spark.range(600).selectExpr(
        "id as event_id", "timestamp_micros(1704067200000000 + (id * 7919 % 600) * 4300000000) as ts", "id % 3 as user_id",
        "if(id % 2 = 0, 'view', 'click') as event_type", "cast(id % 90 as double) as value",
        "concat('{\"k\": ', id % 50, '}') as props",
    )
    events.repartition(6).write.parquet(f"{tmp_path}/events.parquet")
    counters = {r.name: r.total for r in QUERIES["streamed_counters"](spark, str(tmp_path)).collect()}
    assert counters["packets"] == 600 and counters["missing"] == 0
    got = QUERIES["streamed_flow_metadata"](spark, str(tmp_path))
    want = QUERIES["flow_metadata"](spark, str(tmp_path)).select(*got.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    # six slices, the last move of the watermark and the flush
    assert len({f.rsplit("batch=", 1)[1].split("/")[0] for f in got.inputFiles()}) <= 8
