"""Registered queries: every operator, run over whole driver tables."""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowsight.functions import names as N
from flowsight.functions import scalar as S
from flowsight.operators import evaluate as E
from flowsight.operators import hunt as H
from flowsight.operators import prepare as P
from flowsight.operators import reports as R
from flowsight.operators.assemble import assemble_flows, flow_diagnostics, with_flow_key
from flowsight.operators.features import feature_vector, flow_info
from flowsight.operators.moving import group_members, moving_groups
from flowsight.operators.fusion import detect, sweep
from flowsight.operators.rules import apply_rules, port_scan
from flowsight.operators.scoring import (
    attach_results,
    interpret,
    normalise,
    normalise_vector,
    score_by_port,
)
from flowsight.operators.threats import feed_inventory, match_threats
from flowsight.operators.train import predict, train_classifier, with_class_weight
from flowsight.plans import inputs as I
from flowsight.plans.detection import analyse, reanalyse
from flowsight.schema import ATTACK_NAMES, FEATURE_COLUMNS, FEATURE_NAMES, N_CLASSES
from flowsight.sources.feeds import parse_feed_lines, read_feeds, read_norm
from flowsight.session import scratch_folder
from flowsight.sources.packets import parse_packet_rows, read_packet_csv, read_packets, with_event_time
from flowsight.sources.sinks import (
    alert_json,
    alert_line,
    cef_line,
    filter_alerts,
    leef_line,
    syslog_severity,
    to_events,
    write_training_set,
)
from flowsight.streaming.counters import RunCounters, counted
from flowsight.streaming.live import LiveDetection, TableSink, stream_port_scan
from flowsight.streaming.sessions import flush_sessions, hand_out, stream_flows

TIMEOUT_US = 15_000_000
SPLIT_US = 15_000_000
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _n():
    return F.count(F.lit(1)).alias("n")


def _feeds(spark, d):
    return parse_feed_lines(I.feed_lines_from_supplier(spark, d))


def _assembled(spark, d, **kw):
    return assemble_flows(I.packets_from_events(spark, d), timeout_us=TIMEOUT_US, **kw)


def _detected(spark, d, **kw):
    flows = I.flows_from_orders(spark, d)
    return detect(flows, _feeds(spark, d), I.predictions_from_flows(flows), **kw)


# -- sources -----------------------------------------------------------------


@query
def csv_packets(spark, d):
    return parse_packet_rows(I.csv_rows_from_events(spark, d))


@query
def csv_labels(spark, d):
    rows = P.with_label(I.csv_rows_from_events(spark, d), "/set")
    return rows.groupBy("path", "label_code").agg(_n())


@query
def feed_entries(spark, d):
    return _feeds(spark, d)


@query
def feed_counts(spark, d):
    return feed_inventory(_feeds(spark, d))


# -- files: what the tables hold is written out in the shape of each source and read back ----


@query
def csv_tree(spark, d):
    """A folder per class; every other file has its columns in reverse and one that the rest lacks."""
    rows, root = I.csv_rows_from_events(spark, d), scratch_folder(spark)
    columns = [c for c in rows.columns if c not in ("path", "pkt_id")]
    for number, (name, folder) in enumerate(I.CSV_FOLDERS.items()):
        part = rows.where(F.col("path") == f"/set/{name}").select(*columns)
        if number % 2:
            part = part.withColumn("note", F.lit("n")).select("note", *reversed(columns))
        part.write.mode("append").option("header", "true").csv(f"{root}/{folder}")
    packets = parse_packet_rows(read_packet_csv(spark, root, mixed=True))
    return packets.withColumn("folder", F.expr("element_at(split(path, '/'), -2)")).drop("path", "pkt_id")


@query
def packet_table(spark, d):
    folder = f"{scratch_folder(spark)}/packets"
    I.packets_from_events(spark, d).write.parquet(folder)
    return read_packets(spark, folder)


@query
def feed_folder(spark, d):
    """One folder of text files per feed; the files' own names are Spark's, so the folder names the feed."""
    root = scratch_folder(spark)
    lines = I.feed_lines_from_supplier(spark, d)
    lines.withColumnRenamed("feed_name", "feed").write.partitionBy("feed").text(root)
    feeds = [r.feed for r in spark.read.text(root).select("feed").distinct().orderBy("feed").collect()]
    each = [read_feeds(spark, f"{root}/feed={f}").withColumn("feed_name", F.lit(f)) for f in feeds]
    return reduce(DataFrame.unionByName, each)


def _training_set(spark, d):
    """Folder of a training set: rows with their split, parameters fitted on the training rows, class weights."""
    rows = I.feature_rows_from_embeddings(spark, d)
    split, out = P.stratified_split(rows, order=ORDER, key=("vec_id",)), scratch_folder(spark)
    split.write.parquet(f"{out}/split")
    split = spark.read.parquet(f"{out}/split")
    train = split.where("split = 'train'")
    names = {name: code for code, name in enumerate(ATTACK_NAMES[:N_CLASSES])}
    write_training_set(split, P.fit_normaliser(train, V), P.class_weights(train), f"{out}/set", names)
    return f"{out}/set"


@query
def training_set(spark, d):
    """Rows as they are read back from the written set, all features summed up by position."""
    rows = spark.read.parquet(f"{_training_set(spark, d)}/data")
    total = "+".join(f"{i + 1} * {c}" for i, c in enumerate(V))
    return rows.selectExpr("vec_id", "label", "split", f"round({total}, 5) as total")


@query
def norm_file(spark, d):
    """Scaling parameters as they are read back from the written set's metadata."""
    norm, clip = read_norm(spark, f"{_training_set(spark, d)}/metadata")
    return norm.selectExpr("pos", "feature", "round(mean, 8) as mean", "round(std, 8) as std").withColumn("clip", F.lit(clip))


# -- scalar functions --------------------------------------------------------


@query
def packet_filters(spark, d):
    p = I.packets_from_events(spark, d)
    web = p.filter(S.packet_filter(protocol="TCP", src_ip="10.0.0.0/28", dst_port=443))
    host = p.filter(S.packet_filter(protocol="ALL", dst_ip="10.1.0.1", src_port=40006))
    out = web.withColumn("filter", F.lit("web")).unionByName(host.withColumn("filter", F.lit("host")))
    return out.select("filter", "pkt_id")


@query
def applications(spark, d):
    flows = N.with_application(I.flows_from_orders(spark, d))
    return flows.groupBy("application").agg(_n())


@query
def services_in_use(spark, d):
    ports = I.flows_from_orders(spark, d).select("dst_port").distinct()
    return ports.join(N.services(spark), ports.dst_port == F.col("port")).select("service").distinct()


@query
def protocol_names(spark, d):
    flows = I.flows_from_orders(spark, d)
    odd = (F.col("protocol") + F.when(F.col("flow_id") % 9 == 0, 30).otherwise(0)).alias("p")
    return flows.select(N.protocol_name(odd).alias("protocol")).groupBy("protocol").agg(_n())


@query
def attack_names(spark, d):
    codes = I.flows_from_orders(spark, d).selectExpr("cast(flow_id % 20 - 2 as int) as c")
    return (
        codes.select(
            "c",
            N.attack_name("c").alias("name"),
            N.attack_code("c").alias("code"),
            N.attack_code_of_name(N.attack_name("c")).alias("code_of_name"),
        )
        .groupBy("c", "name", "code", "code_of_name")
        .agg(_n())
    )


@query
def address_numbers(spark, d):
    lines = I.feed_lines_from_supplier(spark, d).selectExpr(
        "line", "substring_index(substring_index(trim(line), ' ', 1), ',', 1) as word"
    )
    cidr = S.parse_cidr("word")
    return lines.select(
        "line",
        S.ip_to_long("word").alias("ip"),
        cidr["network"].alias("network"),
        cidr["prefix_len"].alias("prefix_len"),
    )


@query
def tolerant_casts(spark, d):
    rows = I.csv_rows_from_events(spark, d)
    arp = S.parse_arp_info("Info")
    return rows.select(
        "pkt_id",
        S.safe_int("`IP Length`", 7).alias("length"),
        S.safe_float("`Frame Time (Epoch)`", -1.0).alias("seconds"),
        S.safe_int("`TCP Window Size`").alias("window"),
        S.parse_hex_flags("`TCP Flags`").alias("flags"),
        arp["src_ip"].alias("arp_src"),
        arp["dst_ip"].alias("arp_dst"),
    )


@query
def packet_lengths(spark, d):
    p = S.with_lengths(I.packets_from_events(spark, d))
    return p.groupBy("protocol").agg(
        F.sum("header_bytes").alias("header_bytes"), F.sum("payload_size").alias("payload_size")
    )


@query
def flag_counts(spark, d):
    p = I.packets_from_events(spark, d)
    return p.groupBy("protocol").agg(
        *[F.count_if(S.flag("tcp_flags", f)).alias(f) for f in ("fin", "syn", "rst", "psh", "ack")]
    )


@query
def verdict_predicates(spark, d):
    f = _detected(spark, d)
    return f.select(
        "flow_id",
        S.is_attack("classification").alias("is_attack"),
        S.is_unknown("classification").alias("is_unknown"),
        S.is_high_confidence("confidence").alias("sure"),
        S.binary_verdict("verdict").alias("binary"),
        S.is_flagged().alias("flagged"),
        F.round(S.max_rule_severity(), 6).alias("severity"),
        S.risk_band("combined_score", "is_flagged").alias("risk"),
        N.source_name("source").alias("source_name"),
    )


# -- assembly and features ---------------------------------------------------


@query
def flow_keys(spark, d):
    p = with_flow_key(I.packets_from_events(spark, d))
    return p.groupBy("lo_ip", "lo_port", "hi_ip", "hi_port", "protocol").agg(
        _n(), F.count_if("from_lo").alias("from_lo")
    )


@query
def flow_metadata(spark, d):
    return flow_info(_assembled(spark, d), "start_us", "end_us", "reason")


@query
def flow_metadata_in_blocks(spark, d):
    """The same flows by the route for hot keys: every busy key is cut into time blocks."""
    return flow_info(_assembled(spark, d, hot_rows=200), "start_us", "end_us", "reason")


@query
def flow_splits(spark, d):
    """Small flows: 50 packets at most, 2 s timeout, packet-less successors included."""
    flows = assemble_flows(
        I.packets_from_events(spark, d),
        timeout_us=2_000_000,
        max_packets=50,
        emit_empty_tail=True,
    )
    return flow_info(flows, "start_us", "end_us", "reason")


@query
def flow_diagnostic_counts(spark, d):
    return flow_diagnostics(_assembled(spark, d), I.packets_from_events(spark, d))


FEATURE_GROUPS = {
    "features_volume": list(range(0, 6)),
    "features_length": [*range(6, 14), *range(38, 43)],
    "features_rate": [14, 15, 36, 37, *range(51, 55)],
    "features_iat": list(range(16, 30)),
    "features_flags": [*range(30, 36), *range(43, 51)],
    "features_bulk": list(range(55, 61)),
    "features_subflow": list(range(61, 69)),
    "features_active_idle": list(range(69, 77)),
}


def feature_digits(i: int) -> int:
    """Decimals compared: microsecond spreads to 0.1, others to 4 places."""
    return 1 if "iat" in FEATURE_COLUMNS[i] or "idle" in FEATURE_COLUMNS[i] else 4


def feature_query(positions: list[int]) -> Query:
    def run(spark, d):
        flows = _assembled(spark, d)
        return flows.selectExpr(
            "flow_id",
            *[f"round({FEATURE_COLUMNS[i]}, {feature_digits(i)}) as {FEATURE_COLUMNS[i]}" for i in positions],
        )

    return run


for _name, _positions in FEATURE_GROUPS.items():
    QUERIES[_name] = feature_query(_positions)


@query
def feature_vectors(spark, d):
    """The 77 values as a float vector, one row per position."""
    v = feature_vector(_assembled(spark, d)).selectExpr("flow_id", "posexplode(features) as (pos, value)")
    return v.groupBy("pos").agg(_n(), F.count_if(F.col("value") != 0).alias("non_zero"))


# -- rules, threats, fusion --------------------------------------------------


@query
def rule_matches(spark, d):
    f = apply_rules(I.flows_from_orders(spark, d))
    return f.selectExpr("flow_id", "posexplode(rule_matches) as (place, r)").selectExpr(
        "flow_id", "place", "r.rule_name as rule_name", "round(r.severity, 6) as severity"
    )


@query
def port_scans(spark, d):
    return port_scan(I.flows_from_orders(spark, d)).selectExpr(
        "src_ip", "distinct_ports", "rule_name", "description", "round(severity, 6) as severity"
    )


@query
def threat_matches(spark, d):
    f = match_threats(I.flows_from_orders(spark, d), _feeds(spark, d))
    return f.selectExpr("flow_id", "posexplode(ti_matches) as (place, m)").selectExpr(
        "flow_id", "place", "m.ip as ip", "m.feed_name as feed_name", "m.is_source as is_source"
    )


@query
def threat_matches_shuffled(spark, d):
    """The same matches by the route for feeds too large to broadcast."""
    f = match_threats(I.flows_from_orders(spark, d), _feeds(spark, d), broadcast_rows=0)
    return f.selectExpr("flow_id", "posexplode(ti_matches) as (place, m)").selectExpr(
        "flow_id", "place", "m.ip as ip", "m.feed_name as feed_name", "m.is_source as is_source"
    )


def _fused(df):
    return df.selectExpr(
        "flow_id",
        "classification",
        "confidence",
        "verdict",
        "round(combined_score, 9) as combined_score",
        "source",
        "size(ti_matches) as ti",
        "size(rule_matches) as rules",
        "is_flagged",
    )


@query
def fusion(spark, d):
    return _fused(_detected(spark, d))


@query
def fusion_without_rules(spark, d):
    return _fused(_detected(spark, d, rules=False))


@query
def classifier_only(spark, d):
    flows = I.flows_from_orders(spark, d)
    return _fused(detect(flows, None, I.predictions_from_flows(flows), rules=False, combine=False))


@query
def fusion_missing_scores(spark, d):
    """Flows whose score never arrived are Unknown with confidence 0."""
    flows = I.flows_from_orders(spark, d)
    scores = I.predictions_from_flows(flows.filter("protocol <> 1"))
    return _fused(detect(flows, _feeds(spark, d), scores, weights=(0.4, 0.4, 0.2), threshold=0.9))


@query
def weight_sweep(spark, d):
    settings = [(0.5, 0.3, 0.2, 0.7), (0.2, 0.6, 0.2, 0.5), (0.8, 0.1, 0.1, 0.9)]
    return sweep(_detected(spark, d), settings).selectExpr(
        "w_ml", "w_threat", "w_rules", "threshold", "verdict", "flows", "round(score_sum, 3) as score_sum",
        "round(score_max, 6) as score_max",
    )


@query
def results_with_metadata(spark, d):
    flows = I.flows_from_orders(spark, d)
    results = I.predictions_from_flows(flows).select("flow_id", "classification", "confidence")
    return attach_results(results, flows.filter("protocol <> 17")).select(
        "flow_id", "classification", "confidence", "src_ip", "dst_port", "fwd_packets", "avg_packet_size"
    )


@query
def detections_from_packets(spark, d):
    """Packets to verdicts in one plan, with the stand-in classifier."""
    feeds = _feeds(spark, d)
    found = analyse(
        I.packets_from_events(spark, d), feeds, score_by_port, assemble={"timeout_us": TIMEOUT_US}
    )
    return _fused(found)


@query
def rule_hits_in_packets(spark, d):
    """Which assembled conversations break a rule, and how many."""
    hits = apply_rules(_assembled(spark, d)).selectExpr("inline(rule_matches)")
    return hits.groupBy("rule_name").agg(_n(), F.round(F.max("severity"), 6).alias("worst"))


@query
def reanalysis(spark, d):
    """Stored detections run again with half the feeds and other weights."""
    stored = _detected(spark, d)
    feeds = _feeds(spark, d).filter("feed_name in ('feed_0', 'feed_1')")
    return _fused(reanalyse(stored, feeds, weights=(0.3, 0.5, 0.2)))


# -- reports -----------------------------------------------------------------


@query
def flow_reports(spark, d):
    return R.flow_report(_detected(spark, d))


@query
def packet_reports(spark, d):
    return R.packet_report(I.packets_from_events(spark, d), "eth0")


@query
def probability_table(spark, d):
    return R.explode_probabilities(_detected(spark, d)).drop("probability")


@query
def ti_table(spark, d):
    return R.explode_ti(_detected(spark, d))


@query
def rule_table(spark, d):
    return R.explode_rules(_detected(spark, d)).drop("description")


@query
def alert_lines(spark, d):
    f = filter_alerts(_detected(spark, d), "flagged").select("flow_id", alert_line().alias("line"))
    clean = filter_alerts(_detected(spark, d), "clean").select("flow_id", alert_line().alias("line"))
    return f.unionByName(clean)


@query
def events(spark, d):
    e = to_events(_detected(spark, d))
    return e.selectExpr(
        "flow_index",
        "flow.protocol as protocol",
        "flow.duration_us as duration_us",
        "flow.syn_count as syn_count",
        "ml_classification",
        "verdict",
        "size(ml_probabilities) as n_probabilities",
        "size(rule_matches) as n_rules",
        "coalesce(array_join(transform(ti_matches, m -> m.direction), '+'), '') as directions",
    )


@query
def syslog_levels(spark, d):
    f = _detected(spark, d).select(syslog_severity().alias("level"))
    return f.groupBy("level").agg(_n())


@query
def session_totals(spark, d):
    return R.session_counts(_detected(spark, d), "protocol")


@query
def verdict_counts(spark, d):
    return R.verdict_histogram(_detected(spark, d))


@query
def analysis_totals(spark, d):
    s = R.analysis_summary(_detected(spark, d))
    return s.selectExpr(
        "total_analyzed", "flagged_count", "explode(attack_counts) as (name, flows)"
    )


# -- preparation -------------------------------------------------------------

V = I.VECTOR_COLUMNS
ORDER = "(vec_id * 48271L + 11L) % 2147483647L"


@query
def cleaned_rows(spark, d):
    """Rows with an infinite or NaN cell are dropped; one such cell a row is planted by row id, over all columns."""
    rows = I.feature_rows_from_embeddings(spark, d).selectExpr(
        "vec_id",
        *[
            f"case when vec_id % 17 = 0 and vec_id % 64 = {i} then double('NaN')"
            f" when vec_id % 19 = 0 and vec_id * 3 % 64 = {i} then double('-Infinity') else {c} end as {c}"
            for i, c in enumerate(V)
        ],
    )
    return P.clean(rows, V).select("vec_id")


@query
def split_rows(spark, d):
    rows = I.feature_rows_from_embeddings(spark, d).select("vec_id", "label")
    return P.stratified_split(rows, order=ORDER, key=("vec_id",))


@query
def split_distribution(spark, d):
    rows = I.feature_rows_from_embeddings(spark, d).select("vec_id", "label")
    s = P.stratified_split(rows, order=ORDER, key=("vec_id",))
    out = E.class_distribution(s)
    return out.selectExpr("label", *[f"{s}_n" for s in ("train", "val", "test")],
                          *[f"round({s}_pct, 6) as {s}_pct" for s in ("train", "val", "test")])


@query
def class_imbalance(spark, d):
    return E.imbalance(I.feature_rows_from_embeddings(spark, d))


def _fitted(spark, d):
    rows = I.feature_rows_from_embeddings(spark, d)
    fit = P.fit_normaliser(rows, V).orderBy("pos").collect()  # one row per feature
    return rows, [r["mean"] for r in fit], [r["std"] for r in fit]


@query
def fitted_normaliser(spark, d):
    return P.fit_normaliser(I.feature_rows_from_embeddings(spark, d), V).selectExpr(
        "pos", "feature", "round(mean, 8) as mean", "round(std, 8) as std"
    )


@query
def normalised_rows(spark, d):
    rows, means, stds = _fitted(spark, d)
    z = normalise(rows, means, stds, 2.0, V)
    return z.selectExpr("vec_id", *[f"round({c}, 5) as {c}" for c in V])


@query
def normalised_vectors(spark, d):
    rows, means, stds = _fitted(spark, d)
    packed = rows.selectExpr("vec_id", f"array({', '.join(V)}) as features")
    z = normalise_vector(packed, means, stds, 2.0)
    return z.selectExpr(
        "vec_id", "round(aggregate(features, 0.0D, (a, x) -> a + abs(x)), 4) as total"
    )


@query
def clipped_cells(spark, d):
    rows, means, stds = _fitted(spark, d)
    return P.clipped_cells(rows, means, stds, 2.0, V)


@query
def class_weight_table(spark, d):
    w = P.class_weights(I.feature_rows_from_embeddings(spark, d))
    return w.selectExpr("label", "n", "round(weight, 10) as weight")


@query
def sampling_weight_table(spark, d):
    """Packet services have very uneven counts, so the cap is visible at a factor of 2."""
    rows = I.flows_from_orders(spark, d).selectExpr("dst_port as label")
    w = P.sampling_weights(rows, factor=2.0)
    return w.selectExpr("label", "n", "round(weight, 12) as weight")


@query
def label_codes(spark, d):
    rows = table_labels(spark, d)
    return rows.selectExpr("raw", f"{P.resolve_label('raw')} as code", f"{P.encode_label('raw')} as exact",
                           f"{P.decode_label(P.resolve_label('raw'))} as name").groupBy(
        "raw", "code", "exact", "name").agg(_n())


RAW_LABELS = (
    "case o_orderkey % 11 when 0 then 'Benign' when 1 then 'NORMAL' when 2 then 'ssh bruteforce'"
    " when 3 then 'DDoS-UDP_Flood' when 4 then 'big XSS attack' when 5 then 'SQL' when 6 then 'what'"
    " when 7 then 'Port Scanning' when 8 then 'icmp_flood' when 9 then 'dos' else 'Syn-Flood' end"
)


def table_labels(spark, d):
    return I.table(spark, d, "orders").selectExpr(f"{RAW_LABELS} as raw")


@query
def merged_classes(spark, d):
    s = I.scored_from_embeddings(spark, d)
    m = s.selectExpr(f"{P.merge_classes('y_true', {4: 3, 9: 8})} as label")
    return m.groupBy("label").agg(_n())


# -- evaluation --------------------------------------------------------------


@query
def interpreted_scores(spark, d):
    s = interpret(I.scored_from_embeddings(spark, d))
    return s.select("vec_id", "classification", "confidence")


@query
def confusion_matrix(spark, d):
    return E.confusion(I.scored_from_embeddings(spark, d))


@query
def per_class_metrics(spark, d):
    return E.class_metrics(I.scored_from_embeddings(spark, d)).selectExpr(
        "label", "support", *[f"round({c}, 10) as {c}" for c in ("precision", "recall", "f1")], "grade"
    )


@query
def average_metrics(spark, d):
    r = E.classification_report(I.scored_from_embeddings(spark, d))
    return r.selectExpr(*[c if c == "support" else f"round({c}, 10) as {c}" for c in r.columns])


@query
def accuracy(spark, d):
    return E.accuracy(I.scored_from_embeddings(spark, d)).selectExpr("round(accuracy, 10) as accuracy")


@query
def roc_curve(spark, d):
    r = E.roc_points(I.scored_from_embeddings(spark, d))
    return r.selectExpr("label", "score", "round(tpr, 10) as tpr", "round(fpr, 10) as fpr")


@query
def roc_auc(spark, d):
    return E.roc_auc(I.scored_from_embeddings(spark, d)).selectExpr("label", "round(auc, 10) as auc")


@query
def macro_auc(spark, d):
    return E.macro_auc(I.scored_from_embeddings(spark, d)).selectExpr("round(macro_auc, 10) as macro_auc")


@query
def binary_detection(spark, d):
    return E.binary_metrics(I.scored_from_embeddings(spark, d)).selectExpr(
        "false_negatives", "false_positives", "round(recall, 10) as recall", "round(precision, 10) as precision"
    )


@query
def binary_labels(spark, d):
    """Document labels as a two-class check: toxic against low quality."""
    s = I.table(spark, d, "labels").selectExpr("toxic as y_true", "1 - quality as y_pred")
    return E.binary_metrics(s).selectExpr(
        "false_negatives", "false_positives", "round(recall, 10) as recall", "round(precision, 10) as precision"
    )


@query
def confidence_summary(spark, d):
    c = E.confidence_analysis(I.scored_from_embeddings(spark, d))
    return c.selectExpr(
        *[f"round({x}, 8) as {x}" if x.startswith("mean") else x for x in c.columns]
    )


@query
def confidence_bins(spark, d):
    return E.confidence_histogram(I.scored_from_embeddings(spark, d), 20)


@query
def missed_attacks(spark, d):
    m = E.missed_attacks(I.scored_from_embeddings(spark, d))
    return m.selectExpr("y_true", "as_benign", "total", "round(fn_rate, 10) as fn_rate", "flagged")


@query
def top_confusions(spark, d):
    t = E.top_confusions(I.scored_from_embeddings(spark, d))
    return t.selectExpr("y_true", "y_pred", "n", "place", "round(error_pct, 8) as error_pct")


@query
def quality_audit(spark, d):
    rows = I.feature_rows_from_embeddings(spark, d).selectExpr(
        "case when vec_id % 3 = 0 then 'val' else 'train' end as split",
        "case when vec_id % 17 = 0 then double('NaN') when vec_id % 19 = 0 then double('Infinity') else f0 end as f0",
        "f1 * 100 as f1",
        "3.5D as f2",
        *V[3:],
    )
    return E.quality_audit(rows, V)


@query
def feature_stats(spark, d):
    s = E.feature_statistics(I.feature_rows_from_embeddings(spark, d), V)
    return s.selectExpr(
        "pos", "feature", *[f"round({c}, 6) as {c}" for c in ("mean", "std", "min", "max", "skew", "kurtosis")]
    )


@query
def top_spread_features(spark, d):
    s = E.feature_statistics(I.feature_rows_from_embeddings(spark, d), V)
    top = E.top_features(s, 10).select("feature", F.lit("top").alias("end"))
    low = E.top_features(s, 10, largest=False).select("feature", F.lit("bottom").alias("end"))
    return top.unionByName(low)


@query
def skewed_flow_features(spark, d):
    """Assembled features with abs(skew) above 2."""
    stats = E.feature_statistics(_assembled(spark, d))
    return E.skewed_features(stats).selectExpr("pos", "feature", "round(skew, 4) as skew")


@query
def feature_bins(spark, d):
    return E.feature_histograms(I.feature_rows_from_embeddings(spark, d), V, k=12, bins=80)


@query
def correlations(spark, d):
    pairs = E.correlated_pairs(I.feature_rows_from_embeddings(spark, d), V, limit=0.05)
    return pairs.selectExpr("a", "b", "round(r, 8) as r")


@query
def temperatures(spark, d):
    t = E.temperature_scan(I.scored_from_embeddings(spark, d), [0.5, 1.0, 1.5, 2.0, 4.0])
    return t.selectExpr("temperature", "round(log_loss, 8) as log_loss")


FEATURES_IN_ORDER = FEATURE_NAMES


# -- alert texts -------------------------------------------------------------


@query
def cef_alerts(spark, d):
    return _detected(spark, d).select("flow_id", cef_line().alias("line"))


@query
def leef_alerts(spark, d):
    return _detected(spark, d).select("flow_id", leef_line().alias("line"))


@query
def json_alerts(spark, d):
    """Fields read back from the JSON document of each flagged flow."""
    f = filter_alerts(_detected(spark, d).selectExpr("*", "start_us + duration_us as end_us"))
    j = alert_json(f)
    path = {
        "stamp": "timestamp",
        "src": "flow.srcIp",
        "packets": "flow.packetCount",
        "ms": "flow.durationMs",
        "verdict": "detection.finalVerdict",
        "source": "detection.detectionSource",
        "feed": "detection.threatIntel[0].feed",
        "rule": "detection.heuristicRules[0].name",
    }
    return j.select(*[F.get_json_object("value", f"$.{p}").alias(n) for n, p in path.items()])


# -- hunting -----------------------------------------------------------------


def _outside(spark, d):
    flows = I.outside_flows(spark, d)
    return detect(flows, _feeds(spark, d), I.predictions_from_flows(flows))


@query
def flow_search(spark, d):
    found = H.search(
        _detected(spark, d),
        limit=50,
        offset=10,
        any_ip="10.0.2.0/24",
        protocol=6,
        flagged=True,
        min_score=0.4,
        start_us=I.EPOCH_US + 3_600_000_000,
    )
    return found.select("flow_id", "start_us", "src_ip", "dst_ip", "source")


@query
def frequent_ports(spark, d):
    return H.distinct_values(I.flows_from_orders(spark, d), "dst_port", 20)


@query
def duration_summary(spark, d):
    s = H.field_summary(I.flows_from_orders(spark, d), "duration_us", "protocol")
    return s.selectExpr("protocol", "n", "least", "most", "total", "round(average, 6) as average")


@query
def indicator_hits(spark, d):
    """Addresses and blocks taken from the supplier feed, plus two ports, in half a day of flows."""
    lines = I.feed_lines_from_supplier(spark, d).filter("feed_name = 'feed_2'").select("line")
    hits = H.indicator_search(
        I.flows_from_orders(spark, d),
        lines,
        ports=[31337, 6667],
        start_us=I.EPOCH_US,
        end_us=I.EPOCH_US + 43_200_000_000,
        side="dst",
    )
    return hits.select("flow_id", "dst_ip", "dst_port")


@query
def correlated_groups(spark, d):
    f = I.flows_from_orders(spark, d)
    one = H.same_source(f).selectExpr("'source' as kind", "src_ip as who", "window_us", "flows")
    two = H.same_target(f).selectExpr("'target' as kind", "dst_ip as who", "window_us", "flows")
    three = H.close_in_time(f).selectExpr("'time' as kind", "'' as who", "window_us", "flows")
    return one.unionByName(two).unionByName(three)


@query
def sweeps(spark, d):
    f = I.flows_from_orders(spark, d)
    hour = 3_600_000_000
    one = H.port_sweep(f, hour, 5).selectExpr("'port' as kind", "*")
    return one.unionByName(H.network_sweep(f, hour, 5).selectExpr("'network' as kind", "*"))


@query
def moving_sweeps(spark, d):
    """Sources that reach three ports, or three addresses, or start three flows within any five minutes."""
    f = I.flows_from_orders(spark, d)
    parts = []
    for kind, value in (("port", "dst_port"), ("network", "dst_ip"), ("flows", "flow_id")):
        groups = moving_groups(f, ["src_ip"], value, H.WINDOW_US, 3)
        parts.append(groups.selectExpr(f"'{kind}' as kind", "src_ip as who", "first_us", "most", "most_us"))
    rush = moving_groups(f, [], "src_ip", H.WINDOW_US, 30)
    parts.append(rush.selectExpr("'sources' as kind", "'' as who", "first_us", "most", "most_us"))
    return reduce(DataFrame.unionByName, parts)


@query
def moving_sweep_members(spark, d):
    """The flows of every source's first five minutes with three different ports."""
    f = I.flows_from_orders(spark, d)
    groups = moving_groups(f, ["src_ip"], "dst_port", H.WINDOW_US, 3)
    members = group_members(f, groups, ["src_ip"], H.WINDOW_US)
    return members.select("src_ip", "first_us", "flow_id", "dst_port", "start_us")


@query
def correlations_with_gaps(spark, d):
    """Pearson r of feature pairs where every seventh value of f0 and every fifth of f1 is missing and f2 is constant."""
    rows = I.feature_rows_from_embeddings(spark, d)
    rows = rows.withColumn("f0", F.expr("if(vec_id % 7 = 0, null, f0)"))
    rows = rows.withColumn("f1", F.expr("if(vec_id % 5 = 0, null, f1)")).withColumn("f2", F.lit(3.5))
    pairs = E.correlated_pairs(rows, V, limit=None)
    return pairs.selectExpr("a", "b", "round(r, 8) as r", "n")


@query
def lateral_flows(spark, d):
    return H.lateral_movement(_outside(spark, d)).select("flow_id", "src_ip", "dst_ip", "start_us")


@query
def incident_timeline(spark, d):
    t = H.timeline(_outside(spark, d), exfiltration_bytes=500_000, sweep=4)
    return t.groupBy("event", "src_ip").agg(
        _n(), F.min("at_us").alias("first_us"), F.max("at_us").alias("last_us")
    )


@query
def baseline_metrics(spark, d):
    b = H.traffic_baseline(I.flows_from_orders(spark, d))
    return b.selectExpr(*[f"round({c}, 3) as {c}" for c in b.columns])


@query
def anomalies(spark, d):
    """The second half of the day against the first."""
    flows = I.flows_from_orders(spark, d)
    noon = I.EPOCH_US + 43_200_000_000
    past, now = flows.filter(F.col("start_us") < noon), flows.filter(F.col("start_us") >= noon)
    base = H.traffic_baseline(past)
    volume = H.volume_anomalies(now, base, 2.0).selectExpr(
        "concat('volume ', metric) as kind", "cast(minute as string) as what", "round(sigma, 6) as sigma"
    )
    length = H.duration_anomalies(now, base, 1.5).selectExpr(
        "'duration' as kind", "cast(flow_id as string) as what", "round(sigma, 6) as sigma"
    )
    ports = H.new_values(now, past, "dst_port").selectExpr(
        "'port' as kind", "cast(dst_port as string) as what", "cast(flows as double) as sigma"
    )
    sized = now.selectExpr(
        "flow_id", "fwd_packets * avg_packet_size as sent", "bwd_packets * (1440 - avg_packet_size) as received"
    )
    ratio = H.byte_ratio_anomalies(sized, 40.0, "sent", "received").selectExpr(
        "'ratio' as kind", "cast(flow_id as string) as what", "0.0D as sigma"
    )
    return volume.unionByName(length).unionByName(ports).unionByName(ratio)


@query
def address_frequency(spark, d):
    return H.value_frequency(I.flows_from_orders(spark, d), "src_ip")


# -- state and order ---------------------------------------------------------


@query
def duration_splits(spark, d):
    """Flows also cut after 4 s, with packet-less successors."""
    flows = _assembled(spark, d, max_duration_us=4_000_000, emit_empty_tail=True)
    return flow_info(flows, "start_us", "end_us", "reason")


SLICES = 6
# arrival in time order, a sixth of the time span each; rows of the last 200 ms of a slice come with the next one
_SLICE = f"cast(least({SLICES - 1}, greatest(0, (ts_us + 200000 - {I.EPOCH_US}) div 144000000)) as int)"
# in the port-scan stream, some rows of the first slice come with the last one: far too late
_LATE = "pkt_id % 10 = 3"


def _packet_streams(spark, d, folder, late=False):
    """Whole events table as packets in ``SLICES`` micro-batches, slightly out of order, with event time.

    One stream per slice, to be run with the same checkpoint as soon as it is there. The last one also takes the batch
    without rows that moves the watermark for the last time.
    """
    packets = I.packets_from_events(spark, d)
    number = f"if({_SLICE} = 0 and {_LATE}, {SLICES - 1}, {_SLICE})" if late else _SLICE
    for i in range(SLICES):
        stream = with_event_time(I.stream_of_slice(packets, number, i, f"{folder}/in"))
        with _settings(spark, {"spark.sql.streaming.noDataMicroBatches.enabled": str(i == SLICES - 1).lower()}):
            yield stream


def _run(writer):
    writer.trigger(availableNow=True).start().awaitTermination()


def _state_store(spark):
    """Sessions keep their state in RocksDB, two partitions a core at most, as each of them is opened and saved in every
    micro-batch; the settings hold for this query only."""
    partitions = min(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    provider = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    return _settings(
        spark,
        {"spark.sql.streaming.stateStore.providerClass": provider, "spark.sql.shuffle.partitions": str(partitions)},
    )


@contextmanager
def _settings(spark, values):
    old = {name: spark.conf.get(name, None) for name in values}
    for name, value in values.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in old.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


@query
def streamed_flow_metadata(spark, d):
    """The packets as a stream in several micro-batches, sessionised with state; what is open at the end is read
    from the state store. All flows together equal the batch result."""
    folder = scratch_folder(spark)
    sink = TableSink(f"{folder}/flows", lambda flows: flow_info(flows, "start_us", "end_us"))
    limits = {"timeout_us": TIMEOUT_US, "max_duration_us": None}
    with _state_store(spark):
        for packets in _packet_streams(spark, d, folder):
            _run(stream_flows(packets, [sink], f"{folder}/checkpoint", watermark="1 second", **limits))
        hand_out(flush_sessions(spark, f"{folder}/checkpoint", **limits), [sink], "flush")
    return sink.read(spark)


@query
def streamed_detections(spark, d):
    """Live detection over the whole stream: sessions that also split after 15 s, feeds prepared once, two sinks."""
    folder = scratch_folder(spark)
    verdicts = TableSink(f"{folder}/verdicts", _fused)
    alerts = TableSink(f"{folder}/alerts", lambda found: found.select("flow_id", alert_line().alias("line")))
    with _state_store(spark):
        live = LiveDetection(
            [verdicts, alerts], f"{folder}/checkpoint", _feeds(spark, d), score_by_port, "1 second",
            timeout_us=TIMEOUT_US, max_duration_us=SPLIT_US,
        )
        for packets in _packet_streams(spark, d, folder):
            _run(live.writer(packets))
        live.flush(spark)
    lines = alerts.read(spark).selectExpr("flow_id", "line is not null as has_line")
    return verdicts.read(spark).join(lines, "flow_id")


@query
def streamed_counters(spark, d):
    """Totals of a stream that is stopped after every slice and started again: rows read, rows and TCP packets
    passed on, from progress reports alone."""
    folder = scratch_folder(spark)
    name = f"counted-{folder.rsplit('/', 1)[-1]}"
    for packets in _packet_streams(spark, d, folder):
        passed = counted(packets.select("pkt_id", "protocol"), "seen", "protocol = 6")
        # a new listener each time, as after a restart of the driver
        counters = RunCounters(spark, f"{folder}/counters", name)
        spark.streams.addListener(counters)
        try:
            writer = passed.writeStream.queryName(name).format("noop")
            _run(writer.option("checkpointLocation", f"{folder}/checkpoint"))
            counters.totals()
        finally:
            spark.streams.removeListener(counters)
    return counters.table(spark).filter("name <> 'batches'")


@query
def streamed_port_scans(spark, d):
    """Port scans per two minutes of a running stream with late rows, by two stages of state."""
    folder = scratch_folder(spark)
    sink = TableSink(f"{folder}/scans")
    with _state_store(spark):
        for p in _packet_streams(spark, d, folder, late=True):
            wide = p.selectExpr("ts", "src_ip", "cast(src_port * 7 % 50 + total_len as int) as dst_port")
            found = stream_port_scan(wide, "2 minutes", 3, watermark="20 seconds")
            _run(found.writeStream.foreachBatch(sink).option("checkpointLocation", f"{folder}/checkpoint"))
    return sink.read(spark).selectExpr(
        "cast(unix_micros(window_start) as bigint) as window_us", "src_ip", "distinct_ports",
        "round(severity, 6) as severity",
    )


@query
def forest_predictions(spark, d):
    """A random forest with class weights, trained on three splits in four and read back as classes."""
    rows = I.feature_rows_from_embeddings(spark, d)
    s = P.stratified_split(rows, order=ORDER, key=("vec_id",))
    train = s.filter("split = 'train'")
    weighted = with_class_weight(train, P.class_weights(train))
    model = train_classifier(weighted, V, weight="weight", numTrees=10, maxDepth=5)
    scored = interpret(predict(model, s.filter("split = 'test'")))
    return scored.select("vec_id", "label", "classification", "confidence")
