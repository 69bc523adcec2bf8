import json
import struct

import pytest
from tests.helpers import ACK, frame, packet

from flowsight.functions import names as N
from flowsight.functions import scalar as S
from flowsight.operators import prepare as P
from flowsight.operators.assemble import assemble_flows, flow_diagnostics
from flowsight.operators.scoring import interpret, normalise, normalise_vector, score_with_model
from flowsight.plans.training import build_training_set
from flowsight.sources.feeds import norm_lists, read_feeds, read_norm
from flowsight.sources.packets import packets_from_files, parse_packet_rows, read_packet_csv, read_packets


def column(spark, values, kind="string"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")


def evaluate(spark, values, expr, kind="string"):
    return [r[0] for r in column(spark, values, kind).orderBy("i").select(expr).collect()]


def test_addresses(spark):
    got = evaluate(spark, ["1.2.3.4", "255.255.255.255", "010.0.0.1", "1.2.3.4.", "0.0.0.0", "1.2.3", "1.2.3.256", "a", None, "1.2.3.4.5"], S.ip_to_long("x"))
    assert got == [16909060, 4294967295, 167772161, 16909060, None, None, None, None, None, None]
    got = evaluate(spark, ["10.1.2.3/8", "0.0.0.0/4", "1.1.1.1/0", "1.1.1.1/33", "1.1.1.1/24x", "/8", "1.1.1.1"], S.parse_cidr("x"))
    assert [tuple(g) if g else None for g in got] == [(167772160, 8), (0, 4), None, None, (16843008, 24), None, None]


def test_tolerant_casts(spark):
    assert evaluate(spark, ["951.0", "", None, "nan", "x", "-3.9", " 7 ", "1d", "inf"], S.safe_int("x", 5)) == [951, 5, 5, 5, 5, -3, 7, 5, 5]
    assert evaluate(spark, ["0x018", "24", "0X1f", "zz", None, ""], S.parse_hex_flags("x")) == [24, 24, 31, 0, 0, 0]
    got = evaluate(spark, ["Who has 1.1.1.1? Tell 2.2.2.2", "3.3.3.3 is at aa", "hm"], S.parse_arp_info("x"))
    assert [tuple(g) if g else None for g in got] == [("2.2.2.2", "1.1.1.1"), ("3.3.3.3", "3.3.3.3"), None]


def test_names(spark):
    assert evaluate(spark, [0, 11, 15, 16, 99, -1], N.attack_name("x"), "int") == ["Benign", "SYN Flood", "XSS", "Unknown", "Unknown", "Unknown"]
    assert evaluate(spark, [0, 15, 16, -1, None], N.attack_code("x"), "int") == [0, 15, 16, 16, 16]
    assert evaluate(spark, [6, 17, 1, 47], N.protocol_name("x"), "int") == ["TCP", "UDP", "ICMP", "Other"]
    assert evaluate(spark, ["Ensemble", "None", "?"], N.source_name("x")) == ["Ensemble (ML + TI + Rules)", "None", "Unknown"]
    p = frame(spark, [packet(0, dport=22), packet(1, dport=2)])
    assert [r.application for r in N.with_application(p).orderBy("pkt_id").collect()] == ["SSH/SCP/SFTP", "Unknown"]
    assert N.with_application(p, filter_src=80, filter_dst=443).first().application == "HTTPS"
    assert N.distinct_services(spark).filter("service = 'Kerberos'").count() == 1


def test_packet_filter(spark):
    p = frame(spark, [packet(0), packet(1, src="10.0.7.1"), packet(2, proto=17), packet(3, dport=443)])
    ids = lambda **kw: [r.pkt_id for r in p.filter(S.packet_filter(**kw)).orderBy("pkt_id").collect()]
    assert ids() == [0, 1, 2, 3] and ids(protocol="ALL") == [0, 1, 2, 3]
    assert ids(protocol="UDP") == [2] and ids(src_ip="10.0.7.0/24") == [1] and ids(dst_port="443") == [3]
    assert ids(protocol="tcp", src_ip="10.0.0.1", dst_port=80) == [0]


def test_filter_reaches_the_scan(spark, tmp_path):
    frame(spark, [packet(0)]).write.parquet(str(tmp_path / "p"))
    p = read_packets(spark, str(tmp_path / "p")).filter(S.packet_filter(protocol="TCP", dst_port=80))
    plan = p.select("ts_us")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(protocol,6)" in plan and "EqualTo(dst_port,80)" in plan and "tcp_window" not in plan


def test_risk_bands(spark):
    rows = spark.createDataFrame([(0.29, False), (0.29, True), (0.3, False), (0.6, True)], "s double, f boolean")
    assert [r[0] for r in rows.select(S.risk_band("s", "f")).collect()] == ["benign", "low", "medium", "high"]


HEADER = (
    "Frame Time (Epoch),IP Protocol,Protocol,Info,frame length,Length,IP Source,IP Destination,IP Length,TCP Source Port,"
    "TCP Destination Port,TCP Flags,TCP Window Size,TCP Length,UDP Source Port,UDP Destination Port,ICMP Type"
)


def write_exports(root, n=40):
    for folder, k in [("Benign", 0), ("Malicious/SYN Flood", 1), ("Malicious/Mystery", 2)]:
        d = root / folder
        d.mkdir(parents=True)
        lines = [
            f"{1700000000 + i}.5,TCP,TCP,,60,60,10.0.{k}.{i},10.1.0.1,{60 + i % 7}.0,{1000 + i},80.0,0x01{i % 2},512,20,,,"
            for i in range(n)
        ]
        lines += [
            "1700000100.25,,ARP,Who has 1.1.1.1? Tell 2.2.2.2,,42,,,,,,,,,,,",
            "1700000101.25,ICMP,ICMP,,,,3.3.3.3,4.4.4.4,84,,,,,,,,8",
            "0,TCP,TCP,,60,60,9.9.9.9,9.9.9.9,60,1,2,0x10,1,1,,,",
            "1700000102,IGMP,IGMP,,60,60,9.9.9.9,9.9.9.9,60,1,2,0x10,1,1,,,",
        ]
        (d / "x.csv").write_text("\n".join([HEADER, *lines]) + "\n")


def test_csv_exports(spark, tmp_path):
    write_exports(tmp_path)
    raw = read_packet_csv(spark, str(tmp_path))
    p = parse_packet_rows(raw)
    assert p.count() == 3 * 42
    arp = p.filter("protocol = 0").first()
    assert (arp.src_ip, arp.dst_ip, arp.total_len, arp.ip_header_len, arp.ts_us) == ("2.2.2.2", "1.1.1.1", 42, 0, 1700000100250000)
    icmp = p.filter("protocol = 1").first()
    assert (icmp.src_port, icmp.dst_port, icmp.transport_header_len) == (8, 0, 8)
    codes = {r.path.split("/")[-2]: r.label_code for r in P.with_label(raw, f"file://{tmp_path}").select("path", "label_code").distinct().collect()}
    assert codes == {"Benign": 0, "SYN Flood": 11, "Mystery": 0}


def test_label_resolution(spark):
    raw = ["Benign", "normal", "SSH bruteforce", "my XSS file", "nothing", "Port Scanning"]
    got = [r[0] for r in column(spark, raw).orderBy("i").selectExpr(P.resolve_label("x")).collect()]
    assert got == [0, 0, 2, 15, 0, 12]
    paths = ["a/benign/x.csv", "q/Malicious/dos/y.csv", "Malicious/z.csv", "other/x.csv", "Malicious/Odd/x.csv"]
    got = [r[0] for r in column(spark, paths).orderBy("i").selectExpr(P.label_from_path("x")).collect()]
    assert got == ["Benign", "DoS", "Malicious", None, "Odd"]


def test_training_set(spark, tmp_path):
    write_exports(tmp_path / "in", 60)
    raw = read_packet_csv(spark, str(tmp_path / "in"))
    out = build_training_set(raw, f"file://{tmp_path}/in", str(tmp_path / "out"))
    meta = json.loads(spark.read.text(str(tmp_path / "out/metadata")).first()[0])
    assert meta == out["meta"] and meta["n_features"] == 77
    data = spark.read.parquet(str(tmp_path / "out/data"))
    assert {r.split: r["count"] for r in data.groupBy("split").count().collect()} == meta["split_sizes"]
    assert all(s == 1.0 for s, m in zip(meta["normalization"]["stds"], meta["feature_names"]) if m == "active_std")


def test_feed_folder(spark, tmp_path):
    (tmp_path / "alpha.txt").write_text("1.2.3.4\n# no\n")
    (tmp_path / "beta.csv").write_text("10.0.0.0/8,x\n")
    (tmp_path / "gamma").write_text("5.5.5.5\n")
    (tmp_path / "skip.json").write_text("6.6.6.6\n")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "deep.txt").write_text("7.7.7.7\n")
    assert sorted(r.feed_name for r in read_feeds(spark, str(tmp_path)).collect()) == ["alpha", "beta", "gamma"]


def test_norm_file(spark, tmp_path):
    good = tmp_path / "n.json"
    good.write_text(json.dumps({"feature_names": ["a", "b"], "normalization": {"means": [1.0, 2.0], "stds": [2.0, 0.0], "clip_value": 3.0}}))
    norm, clip = read_norm(spark, str(good))
    means, stds = norm_lists(norm)
    assert (means, stds, clip) == ([1.0, 2.0], [2.0, 0.0], 3.0)
    df = spark.createDataFrame([(5.0, 9.0), (-99.0, 2.5)], "a double, b double")
    assert [tuple(r) for r in normalise(df, means, stds, clip, ["a", "b"]).collect()] == [(2.0, 3.0), (-3.0, 0.5)]
    assert [tuple(r) for r in normalise(df, [1.0], [1.0], clip, ["a", "b"]).collect()] == [(5.0, 9.0), (-99.0, 2.5)]
    v = df.selectExpr("array(a, b) as features")
    assert [list(r[0]) for r in normalise_vector(v, means, stds, clip).collect()] == [[2.0, 3.0], [-3.0, 0.5]]
    for bad in ({"x": 1}, {"normalization": {"means": [1.0]}}, {"normalization": {"means": [1.0], "stds": [1.0, 2.0]}}):
        f = tmp_path / f"bad{len(str(bad))}.json"
        f.write_text(json.dumps(bad))
        with pytest.raises(ValueError):
            read_norm(spark, str(f))


def capture(records, order="<", magic=0xA1B2C3D4, link=1):
    out = struct.pack(order + "IHHiIII", magic, 2, 4, 0, 0, 65535, link)
    for us, data in records:
        out += struct.pack(order + "IIII", us // 1_000_000, us % 1_000_000, len(data), len(data)) + data
    return out


def tcp_frame(vlan=False, flags=0x12, payload=10, kind=0x0800):
    body = struct.pack(">HHIIBBHHH", 1000, 80, 0, 0, 5 << 4, flags, 512, 0, 0) + b"x" * payload
    ip = struct.pack(">BBHHHBBH4s4s", 0x45, 0, 20 + len(body), 0, 0, 64, 6, 0, bytes([10, 0, 0, 1]), bytes([10, 0, 0, 2])) + body
    tag = struct.pack(">HH", 0x8100, 5) if vlan else b""
    return b"\0" * 12 + tag + struct.pack(">H", kind) + ip


def test_capture_files(spark, tmp_path):
    (tmp_path / "a.pcap").write_bytes(capture([(1_000_000, tcp_frame()), (2_000_000, tcp_frame(vlan=True)), (3_000_000, tcp_frame(kind=0x86DD)), (4_000_000, tcp_frame()[:40])]))
    (tmp_path / "b.pcap").write_bytes(capture([(5_000_000, tcp_frame(flags=1))], order=">")[:-4])
    (tmp_path / "c.pcap").write_bytes(b"not a capture")
    p = packets_from_files(spark, str(tmp_path))
    rows = p.orderBy("ts_us").collect()
    # a file that is no capture and the record that its file cuts are one row each, without addresses
    assert [(r.ts_us, r.src_ip) for r in rows] == [
        (None, None), (1_000_000, "10.0.0.1"), (2_000_000, "10.0.0.1"), (3_000_000, None), (4_000_000, None), (5_000_000, None),
    ]
    counted = {r.counter: r.value for r in flow_diagnostics(assemble_flows(p, scope=["path"]), p).collect()}
    assert (counted["packets_received"], counted["packets_parsed"], counted["packets_skipped"]) == (6, 2, 4)
    r = rows[2]
    assert (r.src_port, r.dst_port, r.protocol, r.total_len, r.tcp_flags, r.tcp_window, r.transport_header_len) == (1000, 80, 6, 50, 18, 512, 20)
    assert assemble_flows(p, scope=["path"]).first().fwd_packets == 2


def test_interpretation_and_user_model(spark):
    rows = [([0.1, 0.9, 0.9],), ([],), ([0.0] * 16 + [1.0],)]
    got = interpret(spark.createDataFrame(rows, "probabilities array<double>")).collect()
    assert [(r.classification, r.confidence) for r in got] == [(1, 0.9), (16, 0.0), (16, 1.0)]
    df = spark.createDataFrame([(1, 0.0), (2, 5.0)], "flow_id long, a double")

    def load():
        import numpy as np

        return lambda x: np.hstack([1 - (x > 1), x > 1]).astype(float)

    out = score_with_model(df, load, ["a"]).orderBy("flow_id").collect()
    assert [r.classification for r in out] == [0, 1]
    assert ACK == 16


def test_csv_files_of_different_headers(spark, tmp_path):
    from flowsight.sources.packets import csv_layouts, read_packet_csv

    (tmp_path / "a [1]").mkdir()
    (tmp_path / "b").mkdir()
    (tmp_path / "a [1]" / "x.csv").write_text("IP Source,Length\n1.1.1.1,5\n2.2.2.2,6\n")
    (tmp_path / "b" / "y.csv").write_text("﻿Length,IP Source,Extra\r\n7,3.3.3.3,e\r\n")
    (tmp_path / "b" / "z.csv").write_text("IP Source,Length\n4.4.4.4,8\n")
    (tmp_path / "b" / "empty.csv").write_text("")
    (tmp_path / "b" / "note.txt").write_text("not a table\n")
    layouts = csv_layouts(spark, str(tmp_path))
    assert sorted(map(len, layouts.values())) == [1, 2]
    rows = read_packet_csv(spark, str(tmp_path), mixed=True)
    got = {(r["IP Source"], r["Length"], r["Extra"], r.path.rsplit("/", 2)[1]) for r in rows.collect()}
    assert got == {
        ("1.1.1.1", "5", None, "a [1]"), ("2.2.2.2", "6", None, "a [1]"), ("3.3.3.3", "7", "e", "b"), ("4.4.4.4", "8", None, "b"),
    }
    assert rows.select("pkt_id").distinct().count() == 4
