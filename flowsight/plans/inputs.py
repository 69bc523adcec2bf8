"""Packets, flows, predictions and scores derived from the driver's generic tables.

The tables hold no network data; these views give every row of a table a deterministic place in a
packet or flow table, with integer arithmetic only, so that any SQL engine can derive the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# 30 days of events are compressed 3000-fold and users folded to 20 clients, to give busy flows.
EPOCH_US = 1_704_067_200_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def packets_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packets_of_events(table(spark, sf_dir, "events"))


def stream_of_slice(df: DataFrame, number: str, i: int, folder: str) -> DataFrame:
    """Rows of ``df`` arrive in the stream over ``folder``: those for which SQL ``number`` is ``i``.

    The stream takes whatever is new when it runs, so a slice is one micro-batch however many files it is written in:
    taken file by file, the first file would move the watermark past the rows of the others.
    """
    df.filter(f"{number} = {i}").write.parquet(f"{folder}/slice={i}")
    return df.sparkSession.readStream.schema(df.schema).parquet(f"{folder}/slice=*")


def packets_of_events(events: DataFrame) -> DataFrame:
    e = events.select(
        F.col("event_id").alias("pkt_id"),
        # wall-clock time read as UTC, whatever the session time zone
        F.unix_micros(
            F.from_utc_timestamp(F.col("ts").cast("timestamp"), F.current_timezone())
        ).alias("us"),
        (F.col("user_id") % 20).alias("c"),
        F.col("event_type").isin("error", "view").alias("bwd"),
        F.floor("value").cast("int").alias("v"),
        F.get_json_object("props", "$.k").cast("int").alias("k"),
    )
    c, k, bwd = F.col("c"), F.col("k"), F.col("bwd")
    client = F.concat(F.lit("10.0.0."), c.cast("string"))
    server = F.concat(F.lit("10.1.0."), (c % 3).cast("string"))
    service = (
        F.when(c % 5 == 0, 80)
        .when(c % 5 == 1, 22)
        .when(c % 5 == 2, 53)
        .when(c % 5 == 3, 4444)
        .otherwise(443)
    )
    high = (40000 + c).cast("int")
    proto = F.col("protocol")
    flags = (
        F.lit(16)
        + F.when(k % 2 == 0, 8).otherwise(0)
        + F.when(k % 7 == 0, 2).otherwise(0)
        + F.when(k % 50 == 24, 1).otherwise(0)
        + F.when(k == 49, 4).otherwise(0)
    )
    return e.withColumn(
        "protocol", F.when(c == 19, 1).when(c % 5 == 2, 17).otherwise(6).cast("int")
    ).select(
        "pkt_id",
        (F.lit(EPOCH_US) + F.floor((F.col("us") - EPOCH_US) / 3000)).cast("long").alias("ts_us"),
        F.when(bwd, server).otherwise(client).alias("src_ip"),
        F.when(bwd, client).otherwise(server).alias("dst_ip"),
        F.when(proto == 1, F.when(bwd, 0).otherwise(8))
        .when(bwd, service)
        .otherwise(high)
        .cast("int")
        .alias("src_port"),
        F.when(proto == 1, 0).when(bwd, high).otherwise(service).cast("int").alias("dst_port"),
        "protocol",
        F.lit(20).alias("ip_header_len"),
        F.when(proto == 6, 20).otherwise(8).cast("int").alias("transport_header_len"),
        (40 + F.col("v")).cast("int").alias("total_len"),
        F.when(proto != 6, 0).otherwise(flags).cast("int").alias("tcp_flags"),
        F.when((proto != 6) | (k % 10 == 0), 0).otherwise(1024 + k).cast("int").alias("tcp_window"),
    )


# The derivations below are plain expressions that read the same in any SQL engine.

_DURATION = "((o_orderkey % 997) * (case when o_orderkey % 5 = 0 then 20 else 20000 end))"
FLOWS_FROM_ORDERS = [
    "o_orderkey as flow_id",
    "concat('10.0.', cast(o_custkey % 4 as varchar(20)), '.', cast(o_custkey % 50 as varchar(20))) as src_ip",
    "concat('10.2.0.', cast(o_orderkey % 200 as varchar(20))) as dst_ip",
    "cast(case when o_orderkey % 401 = 0 then 31337 else 30000 + o_orderkey % 2000 end as int) as src_port",
    "cast(case o_orderkey % 8 when 0 then 80 when 1 then 22 when 2 then 4444 when 3 then 443"
    " when 4 then 3389 when 5 then 53 when 6 then 6667 else 1024 + o_orderkey % 977 end as int) as dst_port",
    "cast(case o_custkey % 4 when 0 then 1 when 1 then 17 else 6 end as int) as protocol",
    "o_orderkey % 601 as fwd_packets",
    "o_custkey % 50 as bwd_packets",
    f"{_DURATION} as duration_us",
    "o_orderkey % 307 as syn_count",
    "o_custkey % 41 as ack_count",
    "o_orderkey % 293 as rst_count",
    "o_orderkey % 3 as fin_count",
    "cast(40 + o_orderkey % 1400 as double) as avg_packet_size",
    "1704067200000000 + (o_orderkey * 7919 % 86400) * 1000000 as start_us",
    f"case when {_DURATION} > 0 then (o_orderkey % 601) / ({_DURATION} / 1e6) else 0e0 end as fwd_pps",
    f"case when {_DURATION} > 0 then (o_custkey % 50) / ({_DURATION} / 1e6) else 0e0 end as bwd_pps",
]

PREDICTIONS_FROM_FLOWS = [
    "flow_id",
    "case when flow_id % 97 = 0 then 16 when dst_port <= 1024 then 11 else 0 end as classification",
    "(flow_id % 100) / cast(100 as double) as confidence",
]

# One feed line per supplier, in every shape a feed file may hold.
FEED_LINES_FROM_SUPPLIER = [
    "concat('feed_', cast(s_nationkey % 5 as varchar(20))) as feed_name",
    "case s_suppkey % 9"
    " when 0 then concat('10.0.', cast(s_suppkey % 4 as varchar(20)), '.', cast(s_suppkey * 7 % 250 as varchar(20)))"
    " when 1 then concat('10.2.0.', cast(s_suppkey * 3 % 256 as varchar(20)), ';8080')"
    " when 2 then concat('# note ', cast(s_suppkey as varchar(20)))"
    " when 3 then concat('10.2.0.', cast(s_suppkey * 13 % 256 as varchar(20)), '/', cast(26 + s_suppkey % 9 as varchar(20)))"
    " when 4 then concat('  10.0.', cast(s_suppkey % 4 as varchar(20)), '.', cast(s_suppkey * 11 % 250 as varchar(20)), ',seen twice ')"
    " when 5 then concat('300.1.2.', cast(s_suppkey % 256 as varchar(20)))"
    " when 6 then concat('10.0.0.0/', cast(s_suppkey % 2 * 40 as varchar(20)))"
    " when 7 then concat('010.002.000.', cast(s_suppkey * 17 % 256 as varchar(20)), '. listed')"
    " else concat('10.0.', cast(s_suppkey % 4 as varchar(20)), '.', cast(s_suppkey * 5 % 250 as varchar(20)), '/2', cast(s_suppkey % 10 as varchar(20)), ' net') end as line",
]

OUTSIDE_ENDS = [
    "case when flow_id % 5 = 0 then concat('203.0.113.', cast(flow_id % 250 as varchar(20)))"
    " else concat('10.2.0.', cast((flow_id * 3 + 1) % 200 as varchar(20))) end as src_ip",
    "case when flow_id % 7 = 0 then concat('198.51.100.', cast(flow_id % 250 as varchar(20))) else dst_ip end as dst_ip",
]

CSV_ROWS_FROM_EVENTS = [
    "event_id as pkt_id",
    "concat('/set/', case when user_id % 4 = 0 then 'Benign/a.csv'"
    " when user_id % 4 = 1 then 'Malicious/SYN Flood/b.csv'"
    " when user_id % 4 = 2 then 'Malicious/Odd Folder/c.csv' else 'Malicious/d.csv' end) as path",
    "case when event_id % 31 = 0 then '' when event_id % 37 = 0 then 'nan'"
    " else concat(cast(1704067200 + event_id as varchar(20)), '.25') end as `Frame Time (Epoch)`",
    "case event_id % 7 when 0 then 'TCP' when 1 then 'udp' when 2 then ' ICMP ' when 3 then ''"
    " when 4 then 'nan' when 5 then 'IGMP' else 'TCP' end as `IP Protocol`",
    "case when event_id % 7 in (3, 4) then 'ARP' else 'x' end as `Protocol`",
    "case event_id % 3 when 0 then concat('Who has 10.9.0.', cast(user_id % 250 as varchar(20)), '? Tell 10.9.1.', cast(user_id % 99 as varchar(20)))"
    " when 1 then concat('10.9.2.', cast(user_id % 250 as varchar(20)), ' is at aa:bb:cc:dd:ee:ff') else 'other' end as `Info`",
    "case when event_id % 5 = 0 then '' else '60' end as `frame length`",
    "'42.0' as `Length`",
    "case when event_id % 41 = 0 then '' else concat('10.8.0.', cast(user_id % 250 as varchar(20))) end as `IP Source`",
    "concat('10.8.1.', cast(event_id % 250 as varchar(20))) as `IP Destination`",
    "case when event_id % 43 = 0 then '-1' else concat(cast(40 + event_id % 1400 as varchar(20)), '.0') end as `IP Length`",
    "cast(1000 + user_id as varchar(20)) as `TCP Source Port`",
    "'443.0' as `TCP Destination Port`",
    "case event_id % 4 when 0 then '0x018' when 1 then '16' when 2 then '0X002' else 'zz' end as `TCP Flags`",
    "case when event_id % 6 = 0 then 'bad' else cast(500 + event_id % 100 as varchar(20)) end as `TCP Window Size`",
    "'5353' as `UDP Source Port`",
    "cast(event_id % 1000 as varchar(20)) as `UDP Destination Port`",
    "'8' as `ICMP Type`",
]

# the files named in ``path`` above and the folders they lie in
CSV_FOLDERS = {
    "Benign/a.csv": "Benign",
    "Malicious/SYN Flood/b.csv": "Malicious/SYN Flood",
    "Malicious/Odd Folder/c.csv": "Malicious/Odd Folder",
    "Malicious/d.csv": "Malicious",
}

SCORED_FROM_EMBEDDINGS = [
    "vec_id",
    "label as y_true",
    "case when vec_id % 7 = 0 then (label + 1) % 10 when vec_id % 11 = 0 then 0 else label end as y_pred",
]


def flows_from_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(*FLOWS_FROM_ORDERS)


def predictions_from_flows(flows: DataFrame) -> DataFrame:
    p = flows.selectExpr(*PREDICTIONS_FROM_FLOWS)
    return p.selectExpr(
        "*",
        "transform(sequence(0, 15), i -> case when i = classification then confidence else 0.0D end)"
        " as probabilities",
    )


def feed_lines_from_supplier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").selectExpr(*FEED_LINES_FROM_SUPPLIER)


def outside_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same flows with every fifth one coming from, and every seventh one going to, outside."""
    flows = flows_from_orders(spark, sf_dir)
    kept = [c for c in flows.columns if c not in ("src_ip", "dst_ip")]
    return flows.selectExpr(*kept, *OUTSIDE_ENDS)


def csv_rows_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(*CSV_ROWS_FROM_EVENTS)


def scored_from_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """y_true, y_pred and 16 probabilities: the predicted class leads by an amount set by the row id."""
    s = table(spark, sf_dir, "embeddings").selectExpr(*SCORED_FROM_EMBEDDINGS)
    other = "((vec_id * 31 + i * 17) % 40) / 100.0D"
    own = "(40 + vec_id % 60) / 100.0D"
    return s.selectExpr(
        "*",
        f"transform(sequence(0, 15), i -> case when i = y_pred then {own} else {other} end) as probabilities",
    )


def feature_rows_from_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """64 numeric columns f0..f63 with a class label: a feature matrix."""
    cols = [f"cast(embedding[{i}] as double) as f{i}" for i in range(64)]
    return table(spark, sf_dir, "embeddings").selectExpr("vec_id", "label", *cols)


VECTOR_COLUMNS = [f"f{i}" for i in range(64)]
