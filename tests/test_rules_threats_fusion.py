import pytest
from pyspark.sql import functions as F

from flowsight.operators.fusion import detect, sweep
from flowsight.operators.rules import apply_rules, default_rules, port_scan, rule
from flowsight.operators.threats import lookup_bounds, match_threats
from flowsight.sources.feeds import parse_feed_lines

BASE = dict(
    flow_id=1, src_ip="172.16.0.1", dst_ip="172.16.0.2", src_port=40000, dst_port=80, protocol=6,
    fwd_packets=10, bwd_packets=0, duration_us=1_000_000, syn_count=0, ack_count=0, rst_count=0, fin_count=0,
)
SCHEMA = (
    "flow_id long, src_ip string, dst_ip string, src_port int, dst_port int, protocol int, fwd_packets long,"
    " bwd_packets long, duration_us long, syn_count long, ack_count long, rst_count long, fin_count long"
)


def flows(spark, *changes):
    rows = [tuple({**BASE, "flow_id": i + 1, **c}.values()) for i, c in enumerate(changes)]
    return spark.createDataFrame(rows, SCHEMA)


CASES = [
    (dict(dst_port=4444), [("suspicious_port", 0.6)]),
    (dict(src_port=31337), [("suspicious_port", 0.6)]),
    (dict(src_port=6667, dst_port=9999), [("suspicious_port", 0.8)]),
    (dict(), []),
    (dict(syn_count=49), []),
    (dict(syn_count=50), [("syn_flood", 1.0)]),
    (dict(syn_count=60, ack_count=12), [("syn_flood", 0.25)]),
    (dict(syn_count=60, ack_count=13), []),
    (dict(syn_count=60, protocol=17), []),
    (dict(protocol=1, fwd_packets=100), [("icmp_flood", 0.1)]),
    (dict(protocol=1, fwd_packets=99), []),
    (dict(protocol=1, fwd_packets=100, duration_us=0), []),
    (dict(dst_port=22, fwd_packets=20), [("brute_force", 0.2)]),
    (dict(dst_port=22, fwd_packets=19), []),
    (dict(dst_port=22, fwd_packets=20, duration_us=2_100_000), []),
    (dict(fwd_packets=100, duration_us=10_000), [("high_packet_rate", 0.2)]),
    (dict(fwd_packets=99, duration_us=1), []),
    (dict(fwd_packets=60, rst_count=30), [("reset_flood", 0.5)]),
    (dict(fwd_packets=61, rst_count=30), []),
    (dict(fwd_packets=40, rst_count=29), []),
    (dict(src_port=1337, dst_port=22, syn_count=100, fwd_packets=200, duration_us=10_000, rst_count=150),
     [("suspicious_port", 0.6), ("syn_flood", 1.0), ("brute_force", 1.0), ("high_packet_rate", 0.4), ("reset_flood", 0.75)]),
]


def test_rules_at_their_thresholds(spark):
    out = apply_rules(flows(spark, *[c for c, _ in CASES])).orderBy("flow_id").collect()
    for r, (change, want) in zip(out, CASES):
        got = [(m.rule_name, round(m.severity, 9)) for m in r.rule_matches]
        assert got == want, change


def test_rule_texts(spark):
    f = flows(spark, dict(dst_port=22, fwd_packets=25), dict(syn_count=50, ack_count=4), dict(src_port=4444))
    texts = [r.rule_matches[0].description for r in apply_rules(f).orderBy("flow_id").collect()]
    assert texts == [
        "High packet rate (25 pkt/s) to SSH port 22 -- potential brute force",
        "High SYN/ACK ratio (12.5) with 50 SYN flags -- potential SYN flood",
        "Source port 4444 is a known suspicious port (potential backdoor/C2)",
    ]


def test_own_rules_are_list_entries(spark):
    mine = [*default_rules(), rule("telnet", "dst_port = 23", "0.3", "'Telnet in use'")]
    m = apply_rules(flows(spark, dict(dst_port=23)), mine).first().rule_matches
    assert [(x.rule_name, x.severity) for x in m] == [("telnet", 0.3)]


def test_port_scan_counts_distinct_ports(spark):
    f = flows(spark, *[dict(dst_port=p) for p in [*range(20), *range(20)]], *[dict(src_ip="10.9.9.9", dst_port=p) for p in range(19)])
    r = port_scan(f).collect()
    assert [(x.src_ip, x.distinct_ports, round(x.severity, 6)) for x in r] == [("172.16.0.1", 20, round(20 / 60, 6))]
    assert r[0].description == "Source 172.16.0.1 contacted 20 distinct destination ports (threshold: 20)"


LINES = [
    ("a", "1.2.3.4"), ("a", "# 9.9.9.9"), ("a", "; x"), ("a", "   "), ("a", "5.6.7.8;443"), ("a", "5.6.7.9,bad"),
    ("a", "5.6.7.10 text"), ("a", "  7.7.7.7\t\r"), ("a", "10.0.0.0/24"), ("a", "10.0.1.9/32"), ("a", "0.0.0.0/0"),
    ("a", "10.0.0.0/33"), ("a", "/24"), ("a", "10.0.0.0/x"), ("a", "1.2.3"), ("a", "1.2.3.256"), ("a", "0.0.0.0"),
    ("b", "1.2.3.4"), ("b", "001.002.003.005."), ("b", "10.0.0.0/24abc"), ("b", "8.0.0.0/7"), ("b", "9.1.2.3/32"),
    ("b", "9.1.2.3"), ("b", "20.0.0.0/9"), ("c", "20.1.0.0/20"),
]


def feeds(spark):
    return parse_feed_lines(spark.createDataFrame(LINES, "feed_name string, line string"))


def test_feed_lines(spark):
    got = {(r.feed_name, r.network, r.prefix_len, r.is_exact) for r in feeds(spark).collect()}

    def ip(a, b, c, d):
        return ((a * 256 + b) * 256 + c) * 256 + d

    assert got == {
        ("a", ip(1, 2, 3, 4), 32, True), ("a", ip(5, 6, 7, 8), 32, True), ("a", ip(5, 6, 7, 9), 32, True),
        ("a", ip(5, 6, 7, 10), 32, True), ("a", ip(7, 7, 7, 7), 32, True), ("a", ip(10, 0, 0, 0), 24, False),
        ("a", ip(10, 0, 1, 9), 32, False), ("b", ip(1, 2, 3, 4), 32, True), ("b", ip(1, 2, 3, 5), 32, True),
        ("b", ip(10, 0, 0, 0), 24, False), ("b", ip(8, 0, 0, 0), 7, False), ("b", ip(9, 1, 2, 3), 32, False),
        ("b", ip(9, 1, 2, 3), 32, True), ("b", ip(20, 0, 0, 0), 9, False), ("c", ip(20, 1, 0, 0), 20, False),
    }


@pytest.mark.parametrize("limit", [1_000_000, 0])
def test_threat_lookup(spark, limit):
    ends = [
        ("1.2.3.4", "10.0.0.77"), ("10.0.1.9", "9.1.2.3"), ("9.255.0.1", "8.8.8.8"), ("0.0.0.0", "bad"),
        ("20.1.2.3", "20.128.0.0"), ("10.0.1.8", "12.0.0.0"),
    ]
    f = flows(spark, *[dict(src_ip=a, dst_ip=b) for a, b in ends])
    got = [
        [(m.ip, m.feed_name, m.is_source) for m in r.ti_matches]
        for r in match_threats(f, feeds(spark), limit).orderBy("flow_id").collect()
    ]
    assert got == [
        [("1.2.3.4", "b", True), ("10.0.0.77", "a", False)],  # greatest feed name; least on equal ranges
        [("10.0.1.9", "a", True), ("9.1.2.3", "b", False)],
        [("9.255.0.1", "b", True), ("8.8.8.8", "b", False)],
        [],
        [("20.1.2.3", "b", True)],  # the outer range comes first
        [],
    ]


def test_lookup_bound_is_proven_before_broadcasting(spark):
    bounds = lookup_bounds(feeds(spark))
    assert bounds[16] == 512 + 128 and bounds[24] == 2 + 16 and bounds[32] <= 16


def scored(spark, cls, conf, **flow):
    f = flows(spark, flow)
    return f.selectExpr("*", f"{cls} as classification", f"{conf}D as confidence", "array_repeat(0D, 16) as probabilities")


TI, RULE = dict(src_ip="1.2.3.4"), dict(fwd_packets=100, duration_us=2_500)  # rate 40000: severity 0.8
FUSION = [
    (0, 0.95, {}, (0, 0.025, "None", False)),
    (11, 0.9, {}, (11, 0.45, "MlOnly", True)),
    (0, 0.9, TI, (16, 0.35, "ThreatIntel", True)),
    (0, 0.6, RULE, (16, 0.36, "HeuristicRule", True)),
    (0, 0.7, RULE, (0, 0.31, "HeuristicRule", True)),
    (11, 0.9, TI, (11, 0.75, "MlPlusThreatIntel", True)),
    (11, 0.9, RULE, (11, 0.61, "MlPlusHeuristic", True)),
    (11, 1.0, {**TI, **RULE}, (11, 0.96, "Ensemble", True)),
    (0, 1.0, {**TI, **RULE}, (16, 0.46, "ThreatIntel", True)),
    (16, 0.9, {}, (16, 0.0, "None", False)),
    (16, 0.9, TI, (16, 0.3, "ThreatIntel", True)),
]


@pytest.mark.parametrize("cls,conf,flow,want", FUSION)
def test_fusion_table(spark, cls, conf, flow, want):
    r = detect(scored(spark, cls, conf, **flow), feeds(spark)).first()
    assert (r.verdict, pytest.approx(r.combined_score), r.source, r.is_flagged) == want


def test_weights_are_clamped_and_missing_scores_are_unknown(spark):
    r = detect(scored(spark, 11, 1.0, **TI), feeds(spark), weights=(2, 2, 2)).first()
    assert r.combined_score == 1.0
    none = spark.createDataFrame([], "flow_id long, classification int, confidence double, probabilities array<double>")
    r = detect(flows(spark, {}), None, none).first()
    assert (r.classification, r.confidence, r.verdict, len(r.probabilities)) == (16, 0.0, 16, 16)
    assert detect(flows(spark, {}), None, none, rules=False, combine=False).first().source == "MlOnly"


def test_detection_adds_no_shuffle_with_small_feeds(spark):
    plan = detect(scored(spark, 0, 0.5), feeds(spark))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_sweep_counts_every_setting(spark):
    d = detect(scored(spark, 0, 0.6, **RULE), None)
    out = {r.threshold: r.verdict for r in sweep(d, [(0.5, 0.3, 0.2, 0.7), (0.5, 0.3, 0.2, 0.5)]).collect()}
    assert out == {0.7: 16, 0.5: 0}
    assert sweep(d, [(1, 0, 0, 0.5)]).agg(F.sum("flows")).first()[0] == 1
