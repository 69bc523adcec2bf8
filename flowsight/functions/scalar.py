"""Column -> Column helpers: addresses, tolerant casts, flags, rates, verdict predicates.

Everything here is a built-in expression, so it stays inside whole-stage code generation.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from flowsight.functions.names import as_column
from flowsight.schema import BENIGN, CONFIDENCE_THRESHOLD, ICMP, TCP, TCP_FLAG_BITS, UDP, UNKNOWN

# Four decimal octets, one trailing dot tolerated.
_IPV4 = "^[0-9]+[.][0-9]+[.][0-9]+[.][0-9]+[.]?$"
# Address-resolution request and reply texts.
_ARP_REQUEST = r"(?i)Who has ([0-9.]+)\?\s*Tell ([0-9.]+)"
_ARP_REPLY = r"(?i)^([0-9.]+) is at"


# -- addresses ---------------------------------------------------------------


def ip_value_sql(c: str) -> str:
    """SQL text: dotted address -> number, 0.0.0.0 kept as 0, null when malformed."""
    octets = [f"try_cast(split_part({c}, '.', {i}) as bigint)" for i in range(1, 5)]
    valid = " and ".join([f"{c} rlike '{_IPV4}'", *[f"{o} <= 255" for o in octets]])
    value = " + ".join(f"{o} * {256 ** (3 - i)}" for i, o in enumerate(octets))
    return f"case when {valid} then {value} end"


def ip_value_compact(c: str) -> str:
    """The same with only two uses of ``c``, for an address that is itself a long expression."""
    step = "case when try_cast(o as bigint) <= 255 then a * 256 + try_cast(o as bigint) end"
    shaped = f"case when {c} rlike '{_IPV4}' then rtrim('.', {c}) end"
    return f"aggregate(split({shaped}, '[.]'), 0L, (a, o) -> {step})"


def ip_sql(c: str) -> str:
    """SQL text of ``ip_to_long``."""
    return f"nullif({ip_value_sql(c)}, 0L)"


def _ip_value(c: Column) -> Column:
    octets = [F.split_part(c, F.lit("."), F.lit(i)).try_cast("long") for i in range(1, 5)]
    valid = reduce(lambda a, b: a & b, [o <= 255 for o in octets], c.rlike(_IPV4))
    return F.when(valid, reduce(lambda acc, o: acc * 256 + o, octets))


def ip_to_long(c: str | Column) -> Column:
    """IPv4 text -> LONG. Malformed text and 0.0.0.0 give null, so neither ever matches a feed."""
    v = _ip_value(as_column(c))
    return F.when(v != 0, v)


def network_of(ip: Column, prefix_len: int | Column) -> Column:
    """Clear the host bits of a LONG address."""
    if isinstance(prefix_len, int):
        return ip.bitwiseAND(F.lit((0xFFFFFFFF << (32 - prefix_len)) & 0xFFFFFFFF))
    host_bits = F.lit(32) - prefix_len
    return F.call_function("shiftleft", F.call_function("shiftright", ip, host_bits), host_bits)


def parse_cidr(c: str | Column) -> Column:
    """"a.b.c.d/n" -> struct(network, prefix_len), null when malformed or n is not in 1..32.

    Only the leading digits of the prefix are read; the base 0.0.0.0 is accepted here.
    """
    c = as_column(c)
    base = F.substring_index(c, "/", 1)
    rest = F.substr(c, F.length(base) + F.lit(2))
    prefix = F.regexp_extract(rest, r"^([0-9]+)", 1).try_cast("int")
    ip = _ip_value(base)
    # zero is only a real base when it is written plainly
    ip = F.when((ip != 0) | (base == "0.0.0.0"), ip)
    ok = F.contains(c, F.lit("/")) & ip.isNotNull() & prefix.between(1, 32)
    return F.when(
        ok, F.struct(network_of(ip, prefix).alias("network"), prefix.alias("prefix_len"))
    )


def in_network(ip: str | Column, spec: str) -> Column:
    """True when an IPv4 text column equals ``spec`` or lies in the CIDR block ``spec``."""
    ip = as_column(ip)
    if "/" not in spec:
        return ip == spec
    base, _, bits = spec.partition("/")
    octets = [int(o) for o in base.split(".")]
    prefix = int(bits)
    if len(octets) != 4 or any(o > 255 for o in octets) or not 0 <= prefix <= 32:
        raise ValueError(f"not a CIDR block: {spec}")
    mask = (0xFFFFFFFF << (32 - prefix)) & 0xFFFFFFFF
    network = reduce(lambda a, o: a * 256 + o, octets) & mask
    return _ip_value(ip).bitwiseAND(F.lit(mask)) == F.lit(network)


# -- tolerant casts ----------------------------------------------------------


# A plain or exponent decimal number (the JVM parser would also take "1d").
_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def _number(c: str | Column) -> Column:
    s = F.trim(as_column(c).cast("string"))
    return F.when(s.rlike(_NUMBER), s.try_cast("double"))


def safe_float(c: str | Column, default: float = 0.0) -> Column:
    return F.coalesce(_number(c), F.lit(float(default)))


def safe_int(c: str | Column, default: int = 0) -> Column:
    """"951.0" -> 951; blank, NaN, infinity and garbage -> default."""
    v = _number(c)
    fits = F.abs(v) < F.lit(9.0e18)
    return F.coalesce(F.when(fits, v.cast("long")), F.lit(int(default)).cast("long"))


def parse_hex_flags(c: str | Column) -> Column:
    """"0x018" -> 24, "24" -> 24, anything else -> 0."""
    s = F.trim(as_column(c))
    hexed = F.regexp_extract(s, r"^0[xX]([0-9a-fA-F]{1,15})$", 1)
    return (
        F.when(hexed != "", F.conv(hexed, 16, 10).cast("int"))
        .otherwise(F.coalesce(s.try_cast("int"), F.lit(0)))
        .cast("int")
    )


def parse_arp_info(c: str | Column) -> Column:
    """Request -> (teller, target), reply -> (owner, owner), otherwise null."""
    c = as_column(c)
    target, teller = F.regexp_extract(c, _ARP_REQUEST, 1), F.regexp_extract(c, _ARP_REQUEST, 2)
    owner = F.regexp_extract(c, _ARP_REPLY, 1)
    return F.when(
        teller != "", F.struct(teller.alias("src_ip"), target.alias("dst_ip"))
    ).when(owner != "", F.struct(owner.alias("src_ip"), owner.alias("dst_ip")))


# -- packet arithmetic -------------------------------------------------------


def header_bytes() -> Column:
    return F.col("ip_header_len") + F.col("transport_header_len")


def payload_size() -> Column:
    return F.greatest(F.col("total_len") - header_bytes(), F.lit(0))


def with_lengths(packets):
    return packets.withColumns({"header_bytes": header_bytes(), "payload_size": payload_size()})


def flag(c: str | Column, name: str, protocol: str | Column = "protocol") -> Column:
    """True when the TCP flag is set; always false for other protocols."""
    hit = as_column(c).bitwiseAND(F.lit(TCP_FLAG_BITS[name])) != 0
    return (as_column(protocol) == TCP) & hit


def safe_div(n: Column, d: Column) -> Column:
    return F.when(d > 0, n.cast("double") / d.cast("double")).otherwise(F.lit(0.0))


def rate_per_second(n: Column, duration_us: Column) -> Column:
    seconds = duration_us.cast("double") / F.lit(1e6)
    return F.when(duration_us > 0, n.cast("double") / seconds).otherwise(F.lit(0.0))


# -- packet filter -----------------------------------------------------------

_PROTOCOLS = {"tcp": TCP, "udp": UDP, "icmp": ICMP}


def packet_filter(
    protocol: str = "",
    src_ip: str = "",
    dst_ip: str = "",
    src_port: int | str = "",
    dst_port: int | str = "",
) -> Column:
    """Conjunction of the given clauses; an empty value adds none, "ALL"/"Unknown" protocol too.

    Host equality and port clauses are plain comparisons, so they reach the parquet scan.
    """
    clauses = []
    if protocol and protocol not in ("ALL", "Unknown"):
        number = _PROTOCOLS.get(str(protocol).lower())
        if number is None:
            number = int(protocol)
        clauses.append(F.col("protocol") == number)
    for name, spec in (("src_ip", src_ip), ("dst_ip", dst_ip)):
        if spec:
            clauses.append(in_network(name, spec))
    for name, port in (("src_port", src_port), ("dst_port", dst_port)):
        if port != "" and port is not None:
            clauses.append(F.col(name) == int(port))
    return reduce(lambda a, b: a & b, clauses, F.lit(True))


# -- verdict predicates ------------------------------------------------------


def is_attack(c: str | Column) -> Column:
    c = as_column(c)
    return (c != BENIGN) & (c != UNKNOWN)


def is_unknown(c: str | Column) -> Column:
    return as_column(c) == UNKNOWN


def is_high_confidence(c: str | Column, threshold: float = CONFIDENCE_THRESHOLD) -> Column:
    return as_column(c) >= threshold


def binary_verdict(c: str | Column) -> Column:
    """Benign -> BENIGN; every other class, Unknown included, -> ATTACK."""
    return F.when(as_column(c) == BENIGN, "BENIGN").otherwise("ATTACK")


def max_rule_severity(rule_matches: str | Column = "rule_matches") -> Column:
    severities = F.transform(as_column(rule_matches), lambda r: r["severity"])
    return F.coalesce(F.array_max(severities), F.lit(0.0))


def is_flagged(
    verdict: str | Column = "classification",
    ti_matches: str | Column = "ti_matches",
    rule_matches: str | Column = "rule_matches",
) -> Column:
    return (
        is_attack(verdict)
        | (F.size(as_column(ti_matches)) > 0)
        | (F.size(as_column(rule_matches)) > 0)
    )


# Risk band limits.
LOW_RISK, MEDIUM_RISK = 0.3, 0.6


def risk_band(score: str | Column, flagged: str | Column) -> Column:
    score, flagged = as_column(score), as_column(flagged)
    return (
        F.when(~flagged & (score < LOW_RISK), "benign")
        .when(score < LOW_RISK, "low")
        .when(score < MEDIUM_RISK, "medium")
        .otherwise("high")
    )


def shown(c: str | Column) -> Column:
    """Single-precision value as a double: what a display format rounds, free of decimal ties."""
    return as_column(c).cast("float").cast("double")
