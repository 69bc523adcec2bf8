"""Packet sources: training-export CSV, packet tables and streams, capture-file archives."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowsight.functions.scalar import parse_arp_info, parse_hex_flags, safe_float, safe_int
from flowsight.schema import ARP, ICMP, PACKET_COLUMNS, PACKET_SCHEMA, TCP, UDP

# Column names of the training export, read by name.
CSV_COLUMNS = [
    "Frame Time (Epoch)",
    "IP Protocol",
    "Protocol",
    "Info",
    "frame length",
    "Length",
    "IP Source",
    "IP Destination",
    "IP Length",
    "TCP Source Port",
    "TCP Destination Port",
    "TCP Flags",
    "TCP Window Size",
    "TCP Length",
    "UDP Source Port",
    "UDP Destination Port",
    "ICMP Type",
    "label",
]


_GLOB = re.compile(r"[\\*?\[\]{},]")
# file paths come URL-encoded ("SYN%20Flood"); "+" is a plain character in them
_PATH = "url_decode(replace(_metadata.file_path, '+', '%2B'))"


def _csv_files(spark: SparkSession):
    return spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.csv")


def csv_layouts(spark: SparkSession, path: str) -> dict[str, list[str]]:
    """Header line -> files below ``path`` that begin with it; files without a line are left out.

    The first split of every file is read once as text. The driver holds the file names, as Spark's own listing does.
    """

    def first_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the rows of a file stand in order and together within a task
        last = None
        for batch in batches:
            names = batch.column(0).to_numpy(zero_copy_only=False)
            if not len(names):
                continue
            new = np.concatenate([[names[0] != last], names[1:] != names[:-1]])
            last = names[-1]
            yield batch.filter(pa.array(new))

    lines = _csv_files(spark).text(path).where("_metadata.file_block_start = 0").selectExpr(f"{_PATH} as file", "value")
    heads = lines.mapInArrow(first_lines, "file string, header string")
    found: dict[str, list[str]] = {}
    for file, header in heads.orderBy("file").collect():
        found.setdefault(header.removeprefix("\ufeff").rstrip("\r"), []).append(file)
    return found


def read_packet_csv(spark: SparkSession, path: str, mixed: bool = False) -> DataFrame:
    """Every ``*.csv`` below ``path`` as text columns, with the file path and the row's place in it.

    ``enforceSchema`` is off, so a file with another header fails loudly instead of being read into the wrong columns.
    With ``mixed`` files are first grouped by their header; each group is read with its own, columns are put together
    by name, and a column that a file lacks is null there.
    """

    def read(paths: str | list[str]) -> DataFrame:
        raw = _csv_files(spark).option("header", "true").option("enforceSchema", "false").csv(paths)
        return raw.withColumn("path", F.expr(_PATH))

    # names are taken as they are, not as patterns
    layouts = [[_GLOB.sub(r"\\\g<0>", f) for f in files] for files in csv_layouts(spark, path).values()] if mixed else []
    raw = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), map(read, layouts or [path]))
    return raw.withColumn("pkt_id", F.monotonically_increasing_id())


def _text(df: DataFrame, name: str):
    """Column by name, null when the export lacks it; blank and "nan" count as missing."""
    if name not in df.columns:
        return F.lit(None).cast("string")
    c = F.trim(F.col(f"`{name}`").cast("string"))
    return F.when((c != "") & (F.lower(c) != "nan"), c)


def parse_packet_rows(rows: DataFrame, *extra: str) -> DataFrame:
    """CSV text rows -> packets. Rows without time, length, address or a known protocol are dropped."""
    t = lambda name: _text(rows, name)
    named = F.upper(F.coalesce(t("IP Protocol"), t("Protocol")))
    protocol = (
        F.when(named == "TCP", TCP)
        .when(named == "UDP", UDP)
        .when(named == "ICMP", ICMP)
        .when(named == "ARP", ARP)
    )
    order = [F.col("pkt_id")] if "pkt_id" in rows.columns else [
        F.monotonically_increasing_id().alias("pkt_id")
    ]
    extra = [*extra, *[c for c in ("path",) if c in rows.columns and c not in extra]]
    parsed = F.struct(
        safe_float(t("Frame Time (Epoch)")).alias("seconds"),
        protocol.cast("int").alias("protocol"),
        parse_arp_info(t("Info")).alias("arp"),
        safe_int(t("frame length")).alias("frame_len"),
        safe_int(t("Length")).alias("shown_len"),
        t("IP Source").alias("ip_src"),
        t("IP Destination").alias("ip_dst"),
        safe_int(t("IP Length")).alias("ip_len"),
        *[
            safe_int(t(name)).cast("int").alias(alias)
            for name, alias in [
                ("TCP Source Port", "tcp_src"),
                ("TCP Destination Port", "tcp_dst"),
                ("UDP Source Port", "udp_src"),
                ("UDP Destination Port", "udp_dst"),
                ("ICMP Type", "icmp_type"),
                ("TCP Window Size", "window"),
            ]
        ],
        parse_hex_flags(t("TCP Flags")).alias("flags"),
    )
    # explode keeps the optimiser from repeating the parsing inside every later filter
    base = rows.select(*extra, *order, F.explode(F.array(parsed)).alias("r")).select(
        *extra, "pkt_id", "r.*"
    )
    arp_len = "case when frame_len > 0 then frame_len else shown_len end"
    packets = base.filter("seconds > 0 and protocol is not null").selectExpr(
        *extra,
        "pkt_id",
        "cast(seconds * 1000000 as bigint) as ts_us",
        f"case when protocol = {ARP} then arp.src_ip else ip_src end as src_ip",
        f"case when protocol = {ARP} then arp.dst_ip else ip_dst end as dst_ip",
        f"case protocol when {TCP} then tcp_src when {UDP} then udp_src"
        f" when {ICMP} then icmp_type else 0 end as src_port",
        f"case protocol when {TCP} then tcp_dst when {UDP} then udp_dst else 0 end as dst_port",
        "protocol",
        f"case when protocol = {ARP} then 0 else 20 end as ip_header_len",
        f"case protocol when {TCP} then 20 when {ARP} then 0 else 8 end as transport_header_len",
        f"cast(case when protocol = {ARP} then {arp_len} else ip_len end as int) as total_len",
        f"case when protocol = {TCP} then flags else 0 end as tcp_flags",
        f"case when protocol = {TCP} then window else 0 end as tcp_window",
    )
    return packets.filter("src_ip is not null and dst_ip is not null and total_len > 0")


def read_packets(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return spark.read.schema(PACKET_SCHEMA).format(fmt).load(path).select(*PACKET_COLUMNS)


def read_packet_stream(
    spark: SparkSession, path: str, fmt: str = "parquet", max_files: int | None = None
) -> DataFrame:
    """Packet stream with an event-time column ``ts`` for watermarks."""
    reader = spark.readStream.schema(PACKET_SCHEMA).format(fmt)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return with_event_time(reader.load(path))


def with_event_time(packets: DataFrame) -> DataFrame:
    return packets.withColumn("ts", F.timestamp_micros("ts_us"))


# ---------------------------------------------------------------------------
# Capture files
# ---------------------------------------------------------------------------

# Capture-file magic numbers (byte order, ticks per microsecond) and link types.
_MAGICS = {
    b"\xd4\xc3\xb2\xa1": ("<", 1),
    b"\xa1\xb2\xc3\xd4": (">", 1),
    b"\x4d\x3c\xb2\xa1": ("<", 1000),
    b"\xa1\xb2\x3c\x4d": (">", 1000),
}
_ETHERNET, _RAW_IP = 1, (101, 228)
_IPV4, _VLANS = 0x0800, (0x8100, 0x88A8)


def _ip_offset(frame: memoryview, link: int) -> int:
    """Where the IPv4 header starts, -1 when the frame carries none. VLAN tags are stepped over."""
    if link in _RAW_IP:
        return 0
    if link != _ETHERNET or len(frame) < 14:
        return -1
    at = 12
    while int.from_bytes(frame[at : at + 2], "big") in _VLANS:
        at += 4
    return at + 2 if int.from_bytes(frame[at : at + 2], "big") == _IPV4 else -1


def _decode(frame: memoryview, link: int) -> tuple | None:
    """Header fields of one frame, None when it is not IPv4 TCP/UDP/ICMP or is cut short."""
    start = _ip_offset(frame, link)
    if start < 0 or len(frame) < start + 20 or frame[start] >> 4 != 4:
        return None
    ip = frame[start:]
    ip_len, proto = (ip[0] & 15) * 4, ip[9]
    body = ip[ip_len:]
    need = {TCP: 20, UDP: 8, ICMP: 8}.get(proto)
    if need is None or len(body) < need:
        return None
    source, target = (".".join(map(str, ip[i : i + 4])) for i in (12, 16))
    total = int.from_bytes(ip[2:4], "big")
    if proto == ICMP:
        return source, target, body[0], 0, proto, ip_len, 8, total, 0, 0
    ports = struct.unpack(">HH", body[:4])
    if proto == UDP:
        return source, target, *ports, proto, ip_len, 8, total, 0, 0
    header = max(20, (body[12] >> 4) * 4)
    window = int.from_bytes(body[14:16], "big")
    return source, target, *ports, proto, ip_len, header, total, body[13], window


def _frames(content: bytes) -> Iterator[tuple[int | None, memoryview, int]]:
    """(microseconds, frame, link type) of every record of a classic capture file.

    What cannot be read is one record without a frame: a file of another format, and a last record that is cut short
    (with its time if its own header is whole).
    """
    magic, nothing = _MAGICS.get(content[:4]), memoryview(b"")
    if magic is None or len(content) < 24:
        yield None, nothing, _ETHERNET
        return
    order, ticks = magic
    link = struct.unpack(order + "I", content[20:24])[0] & 0xFFFF
    record = struct.Struct(order + "IIII")
    view, at = memoryview(content), 24
    while at < len(content):
        if at + 16 > len(content):
            yield None, nothing, link
            return
        seconds, fraction, kept, _ = record.unpack_from(content, at)
        at += 16
        whole = at + kept <= len(content)
        yield seconds * 1_000_000 + fraction // ticks, view[at : at + kept] if whole else nothing, link
        at += kept


def packets_from_files(
    spark: SparkSession, path: str, glob: str = "*.pcap", batch: int = 50_000
) -> DataFrame:
    """Capture files -> packets (plus ``path``), one task per file, rows emitted in batches.

    Frames that are not IPv4 TCP/UDP/ICMP, or are cut short, come out with null addresses so that
    ``flow_diagnostics`` can count them; assembly drops them. So do a record that the file's end cuts and a file that
    is no capture file, one row each.
    """
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", glob)
        .option("recursiveFileLookup", "true")
        .load(path)
        .select("path", "content")
    )
    names = [c for c in PACKET_COLUMNS if c != "pkt_id"]

    def decode(batches: Iterator) -> Iterator:
        import pandas as pd

        def table(rows: list, name: str):
            pdf = pd.DataFrame(rows, columns=["seq", *names])
            for c in pdf.columns:
                if c not in ("src_ip", "dst_ip"):
                    pdf[c] = pdf[c].astype("Int64")
            return pdf.assign(path=name)

        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"]):
                rows = []
                for seq, (us, frame, link) in enumerate(_frames(content)):
                    rows.append((seq, us, *(_decode(frame, link) or (None,) * 10)))
                    if len(rows) >= batch:
                        yield table(rows, name)
                        rows = []
                if rows:
                    yield table(rows, name)

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in PACKET_SCHEMA if f.name != "pkt_id")
    parsed = files.mapInPandas(decode, f"seq bigint, {fields}, path string")
    # the record number orders packets inside a file; scope=["path"] keeps files apart
    return parsed.selectExpr("seq as pkt_id", *names, "path")
