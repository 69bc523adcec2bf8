"""Schemas and fixed values shared by every operator."""

from __future__ import annotations

import re

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Packets
# ---------------------------------------------------------------------------

PACKET_SCHEMA = T.StructType(
    [
        T.StructField("pkt_id", T.LongType()),
        T.StructField("ts_us", T.LongType()),
        T.StructField("src_ip", T.StringType()),
        T.StructField("dst_ip", T.StringType()),
        T.StructField("src_port", T.IntegerType()),
        T.StructField("dst_port", T.IntegerType()),
        T.StructField("protocol", T.IntegerType()),
        T.StructField("ip_header_len", T.IntegerType()),
        T.StructField("transport_header_len", T.IntegerType()),
        T.StructField("total_len", T.IntegerType()),
        T.StructField("tcp_flags", T.IntegerType()),
        T.StructField("tcp_window", T.IntegerType()),
    ]
)
PACKET_COLUMNS = PACKET_SCHEMA.fieldNames()

FEED_SCHEMA = T.StructType(
    [
        T.StructField("network", T.LongType()),
        T.StructField("prefix_len", T.IntegerType()),
        T.StructField("is_exact", T.BooleanType()),
        T.StructField("feed_name", T.StringType()),
    ]
)

TI_MATCHES = "array<struct<ip:string,feed_name:string,is_source:boolean>>"
RULE_MATCHES = "array<struct<rule_name:string,description:string,severity:double>>"

PREDICTION_SCHEMA = T.StructType(
    [
        T.StructField("flow_id", T.LongType()),
        T.StructField("classification", T.IntegerType()),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("probabilities", T.ArrayType(T.DoubleType())),
    ]
)

# ---------------------------------------------------------------------------
# Protocol numbers, TCP flag bits, limits
# ---------------------------------------------------------------------------

ICMP, TCP, UDP, ARP = 1, 6, 17, 0

TCP_FLAG_BITS = {
    "fin": 1,
    "syn": 2,
    "rst": 4,
    "psh": 8,
    "ack": 16,
    "urg": 32,
    "ece": 64,
    "cwr": 128,
}

BATCH_TIMEOUT_US = 600_000_000
LIVE_TIMEOUT_US = 60_000_000
LIVE_MAX_DURATION_US = 15_000_000
IDLE_THRESHOLD_US = 5_000_000
MAX_PACKETS = 200
MIN_BULK_PACKETS = 2

CONFIDENCE_THRESHOLD = 0.7
WEIGHT_ML, WEIGHT_THREAT, WEIGHT_RULES = 0.5, 0.3, 0.2
ESCALATION_SEVERITY = 0.7
CLIP_VALUE = 10.0
NEAR_ZERO_STD = 1e-8

# Class names by code 0..16.
ATTACK_NAMES = [
    "Benign",
    "MITM ARP Spoofing",
    "SSH Brute Force",
    "FTP Brute Force",
    "DDoS ICMP",
    "DDoS Raw IP",
    "DDoS UDP",
    "DoS",
    "Exploiting FTP",
    "Fuzzing",
    "ICMP Flood",
    "SYN Flood",
    "Port Scanning",
    "Remote Code Execution",
    "SQL Injection",
    "XSS",
    "Unknown",
]
N_CLASSES = 16
BENIGN, UNKNOWN = 0, 16

# The 77 feature names in vector order.
FEATURE_NAMES = [
    "Destination Port",
    "Flow Duration",
    "Total Fwd Packets",
    "Total Backward Packets",
    "Total Length of Fwd Packets",
    "Total Length of Bwd Packets",
    "Fwd Packet Length Max",
    "Fwd Packet Length Min",
    "Fwd Packet Length Mean",
    "Fwd Packet Length Std",
    "Bwd Packet Length Max",
    "Bwd Packet Length Min",
    "Bwd Packet Length Mean",
    "Bwd Packet Length Std",
    "Flow Bytes/s",
    "Flow Packets/s",
    "Flow IAT Mean",
    "Flow IAT Std",
    "Flow IAT Max",
    "Flow IAT Min",
    "Fwd IAT Total",
    "Fwd IAT Mean",
    "Fwd IAT Std",
    "Fwd IAT Max",
    "Fwd IAT Min",
    "Bwd IAT Total",
    "Bwd IAT Mean",
    "Bwd IAT Std",
    "Bwd IAT Max",
    "Bwd IAT Min",
    "Fwd PSH Flags",
    "Bwd PSH Flags",
    "Fwd URG Flags",
    "Bwd URG Flags",
    "Fwd Header Length",
    "Bwd Header Length",
    "Fwd Packets/s",
    "Bwd Packets/s",
    "Min Packet Length",
    "Max Packet Length",
    "Packet Length Mean",
    "Packet Length Std",
    "Packet Length Variance",
    "FIN Flag Count",
    "SYN Flag Count",
    "RST Flag Count",
    "PSH Flag Count",
    "ACK Flag Count",
    "URG Flag Count",
    "CWE Flag Count",
    "ECE Flag Count",
    "Down/Up Ratio",
    "Average Packet Size",
    "Avg Fwd Segment Size",
    "Avg Bwd Segment Size",
    "Fwd Avg Bytes/Bulk",
    "Fwd Avg Packets/Bulk",
    "Fwd Avg Bulk Rate",
    "Bwd Avg Bytes/Bulk",
    "Bwd Avg Packets/Bulk",
    "Bwd Avg Bulk Rate",
    "Subflow Fwd Packets",
    "Subflow Fwd Bytes",
    "Subflow Bwd Packets",
    "Subflow Bwd Bytes",
    "Init_Win_bytes_forward",
    "Init_Win_bytes_backward",
    "act_data_pkt_fwd",
    "min_seg_size_forward",
    "Active Mean",
    "Active Std",
    "Active Max",
    "Active Min",
    "Idle Mean",
    "Idle Std",
    "Idle Max",
    "Idle Min",
]


def feature_column(name: str) -> str:
    """Column name of a feature: lower case, every other character run becomes one underscore."""
    return re.sub(r"[^a-z0-9]+", "_", name.lower()).strip("_")


FEATURE_COLUMNS = [feature_column(n) for n in FEATURE_NAMES]

FLOW_INFO_COLUMNS = [
    "src_ip",
    "dst_ip",
    "src_port",
    "dst_port",
    "protocol",
    "fwd_packets",
    "bwd_packets",
    "duration_us",
    "fwd_pps",
    "bwd_pps",
    "syn_count",
    "ack_count",
    "rst_count",
    "fin_count",
    "avg_packet_size",
]
