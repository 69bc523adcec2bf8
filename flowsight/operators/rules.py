"""Heuristic rules. Each rule is a condition, a severity and a description in SQL, so new ones are
list entries."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowsight.schema import ICMP, RULE_MATCHES, TCP

# Watched ports and thresholds.
SUSPICIOUS_PORTS = [4444, 5555, 31337, 1337, 12345, 54321, 6666, 6667, 6668, 6669, 8888, 9999]
AUTH_SERVICES = {21: "FTP", 22: "SSH", 23: "Telnet", 3389: "RDP", 5900: "VNC"}
SYN_FLOOD_RATIO, SYN_FLOOD_MIN = 5.0, 50
ICMP_FLOOD_RATE, ICMP_FLOOD_MIN = 100.0, 20
BRUTE_FORCE_RATE, BRUTE_FORCE_MIN = 10.0, 20
HIGH_RATE, HIGH_RATE_MIN = 10000.0, 100
RESET_FLOOD_RATIO, RESET_FLOOD_MIN = 0.5, 30
PORT_SCAN_PORTS = 20

PACKETS = "(fwd_packets + bwd_packets)"
# null without a duration: Spark may evaluate a shared subexpression before the test that guards it
RATE = f"(case when duration_us > 0 then {PACKETS} / (duration_us / 1e6D) end)"


def _number(x: str) -> str:
    """Shortest text of a double: no trailing ".0", no exponent."""
    return (
        f"case when {x} = floor({x}) then cast(cast({x} as bigint) as string)"
        f" when {x} < 1e7 then cast({x} as string)"
        f" else rtrim('0', cast(cast({x} as decimal(38, 6)) as string)) end"
    )


@dataclass(frozen=True)
class Rule:
    """SQL text of one rule. ``severity`` applies where ``when`` holds, capped at 1."""

    name: str
    when: str
    severity: str
    description: tuple[str, ...]

    def fired(self) -> str:
        """Severity, null when the rule does not fire. Cheap: no text is built here."""
        return f"case when {self.when} then least(1.0D, cast({self.severity} as double)) end"

    def match(self, severity: str) -> str:
        text = f"concat({', '.join(self.description)})"
        return (
            f"case when {severity} is not null then named_struct('rule_name', '{self.name}',"
            f" 'description', {text}, 'severity', {severity}) end"
        )


def rule(name: str, when: str, severity: str, *description: str) -> Rule:
    return Rule(name, when, severity, description)


def suspicious_port() -> Rule:
    ports = ", ".join(map(str, SUSPICIOUS_PORTS))
    src, dst = f"src_port in ({ports})", f"dst_port in ({ports})"
    text = (
        f"case when {src} and {dst} then concat('Both source port ', src_port,"
        " ' and destination port ', dst_port, ' are known suspicious ports')"
        f" when {dst} then concat('Destination port ', dst_port,"
        " ' is a known suspicious port (potential backdoor/C2)')"
        " else concat('Source port ', src_port,"
        " ' is a known suspicious port (potential backdoor/C2)') end"
    )
    severity = f"case when {src} and {dst} then 0.8D else 0.6D end"
    return rule("suspicious_port", f"({src} or {dst})", severity, text)


def syn_flood() -> Rule:
    ratio = "(case when ack_count > 0 then syn_count / cast(ack_count as double) else cast(syn_count as double) end)"
    return rule(
        "syn_flood",
        f"protocol = {TCP} and syn_count >= {SYN_FLOOD_MIN} and {ratio} >= {SYN_FLOOD_RATIO}D",
        f"{ratio} / {SYN_FLOOD_RATIO * 4}D",
        "'High SYN/ACK ratio ('",
        _number(ratio),
        "') with '",
        "syn_count",
        "' SYN flags -- potential SYN flood'",
    )


def icmp_flood() -> Rule:
    return rule(
        "icmp_flood",
        f"protocol = {ICMP} and {PACKETS} >= {ICMP_FLOOD_MIN}"
        f" and {RATE} >= {ICMP_FLOOD_RATE}D",
        f"{RATE} / {ICMP_FLOOD_RATE * 10}D",
        "'ICMP traffic at '",
        _number(RATE),
        "' packets/sec with '",
        PACKETS,
        "' total packets -- potential ICMP flood'",
    )


def brute_force() -> Rule:
    ports = ", ".join(map(str, AUTH_SERVICES))
    service = " ".join(f"when {p} then '{n}'" for p, n in AUTH_SERVICES.items())
    return rule(
        "brute_force",
        f"protocol = {TCP} and dst_port in ({ports}) and {PACKETS} >= {BRUTE_FORCE_MIN}"
        f" and {RATE} >= {BRUTE_FORCE_RATE}D",
        f"{RATE} / {BRUTE_FORCE_RATE * 10}D",
        "'High packet rate ('",
        _number(RATE),
        "' pkt/s) to '",
        f"case dst_port {service} end",
        "' port '",
        "dst_port",
        "' -- potential brute force'",
    )


def high_packet_rate() -> Rule:
    return rule(
        "high_packet_rate",
        f"{PACKETS} >= {HIGH_RATE_MIN} and {RATE} >= {HIGH_RATE}D",
        f"{RATE} / {HIGH_RATE * 5}D",
        "'Extremely high packet rate: '",
        _number(RATE),
        "' packets/sec over '",
        PACKETS,
        "' packets -- potential DoS/DDoS'",
    )


def reset_flood() -> Rule:
    ratio = f"(case when {PACKETS} > 0 then rst_count / cast({PACKETS} as double) end)"
    return rule(
        "reset_flood",
        f"protocol = {TCP} and rst_count >= {RESET_FLOOD_MIN}"
        f" and {ratio} >= {RESET_FLOOD_RATIO}D",
        ratio,
        "'High RST ratio ('",
        _number(ratio),
        "') with '",
        "rst_count",
        "' RST flags -- potential reset attack or scan response'",
    )


def default_rules() -> list[Rule]:
    return [
        suspicious_port(),
        syn_flood(),
        icmp_flood(),
        brute_force(),
        high_packet_rate(),
        reset_flood(),
    ]


def with_rule_signals(flows: DataFrame, rules: Sequence[Rule] | None = None) -> DataFrame:
    """Add ``rule_matches``, ``has_rule`` and ``max_severity``. Narrow, no shuffle.

    Severities are computed first; whoever asks only whether a rule fired never builds match texts.
    """
    rules = default_rules() if rules is None else list(rules)
    if not rules:
        return flows.selectExpr(
            "*",
            f"cast(array() as {RULE_MATCHES}) as rule_matches",
            "false as has_rule",
            "0.0D as max_severity",
        )
    levels = [f"_severity{i}" for i in range(len(rules))]
    fired = flows.selectExpr("*", *[f"{r.fired()} as {c}" for r, c in zip(rules, levels)])
    matches = ", ".join(r.match(c) for r, c in zip(rules, levels))
    return fired.selectExpr(
        *flows.columns,
        f"cast(array_compact(array({matches})) as {RULE_MATCHES}) as rule_matches",
        f"({' or '.join(f'{c} is not null' for c in levels)}) as has_rule",
        f"greatest(0.0D, {', '.join(levels)}) as max_severity",
    )


def apply_rules(flows: DataFrame, rules: Sequence[Rule] | None = None) -> DataFrame:
    """Add ``rule_matches``: every rule that fires, in list order."""
    return with_rule_signals(flows, rules).drop("has_rule", "max_severity")


def port_scan(flows: DataFrame, threshold: int = PORT_SCAN_PORTS) -> DataFrame:
    """Sources that contacted at least ``threshold`` distinct destination ports.

    The distinct pairs come first, combined map-side; a source then has at most 65,536 rows, however
    many flows it opened.
    """
    pairs = flows.select("src_ip", "dst_port").distinct()
    counted = pairs.groupBy("src_ip").agg(F.count("dst_port").alias("distinct_ports"))
    return counted.filter(F.col("distinct_ports") >= threshold).selectExpr(
        "src_ip",
        "distinct_ports",
        "'port_scan' as rule_name",
        "concat('Source ', src_ip, ' contacted ', distinct_ports,"
        f" ' distinct destination ports (threshold: {threshold})') as description",
        f"least(1.0D, distinct_ports / {float(threshold * 3)}D) as severity",
    )
