"""Flows built packet by packet in a fixed number of counters.

The batch route labels packets and aggregates them in one hash aggregation; a stream cannot hold the packets of an
open flow for that. Here the same aggregates are kept as running numbers: one ``OpenFlow`` per 5-tuple, of constant
size however many packets it has seen. What it yields when a flow closes has the columns that the batch aggregation
yields, so metadata and features come from the same expressions.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd

from flowsight.operators.assemble import DURATION, FIN_RST, FINALIZE, KEY, MAX_PKTS, TIMEOUT
from flowsight.schema import IDLE_THRESHOLD_US, MIN_BULK_PACKETS, TCP, TCP_FLAG_BITS

# one waiting packet, as it lies in state
PACKET = np.dtype(
    [
        ("ts_us", "<i8"), ("pkt_id", "<i8"), ("header_bytes", "<i4"), ("total_len", "<i4"), ("payload_size", "<i4"),
        ("tcp_flags", "<i4"), ("tcp_window", "<i4"), ("from_lo", "?"), ("closes", "?"),
    ]
)
PACKET_FIELDS = list(PACKET.names)

# (name, what it measures); each is n, sum, max, min, mean and sum of squared deviations
MOMENTS = ["gap", "idle", "al", "fl", "bl", "fgap", "bgap", "burst"]
FLAG_COUNTS = ["fin", "syn", "rst", "ack", "cwr", "ece"]
_BOTH = ["header", "psh", "urg", "bulks", "bulk_packets", "bulk_bytes", "window", "last_ts"]
# of the 5-tuple: they outlive a flow
_SEGMENT = ["live", "lo_is_fwd", "rn", "last_ts", "start_ts", "timer_ms"]
_FLOW = [
    "n", "flow_id", "start_us", "end_us", "last_pkt_id", *[f"n_{f}" for f in FLAG_COUNTS],
    *[f"{d}_{c}" for d in "fb" for c in _BOTH], "f_data", "f_min_payload", "run_fwd", "run_n", "run_bytes", "began",
]
_NUMBERS = struct.Struct(f"<{len(_SEGMENT) + len(_FLOW)}q")
_MOMENT = struct.Struct("<4q2d")
_NONE = -1  # of a window, a least payload or a last time that has not been seen


@dataclass(frozen=True)
class Limits:
    """When a flow ends, and which gaps count as idle."""

    timeout_us: int
    max_packets: int
    max_duration_us: int | None
    idle_threshold_us: int = IDLE_THRESHOLD_US


class OpenFlow:
    """Counters of one 5-tuple: where its segment stands and what its open flow has seen."""

    def __init__(self) -> None:
        self.seg = dict.fromkeys(_SEGMENT, 0)
        self._reset()

    def _reset(self) -> None:
        self.num = dict.fromkeys(_FLOW, 0)
        for name in ("f_window", "b_window", "f_min_payload", "f_last_ts", "b_last_ts"):
            self.num[name] = _NONE
        self.mom = {name: [0, 0, 0, 0, 0.0, 0.0] for name in MOMENTS}

    def to_bytes(self) -> bytes:
        numbers = _NUMBERS.pack(*(int(v) for v in (*self.seg.values(), *self.num.values())))
        return numbers + b"".join(_MOMENT.pack(*m) for m in self.mom.values())

    @classmethod
    def from_bytes(cls, raw: bytes) -> OpenFlow:
        out = cls()
        values = _NUMBERS.unpack_from(raw)
        out.seg = dict(zip(_SEGMENT, values, strict=False))
        out.num = dict(zip(_FLOW, values[len(_SEGMENT) :], strict=True))
        parts = _MOMENT.iter_unpack(raw[_NUMBERS.size :])
        out.mom = {name: list(part) for name, part in zip(MOMENTS, parts, strict=True)}
        return out

    def _measure(self, name: str, x: int) -> None:
        m = self.mom[name]
        if m[0]:
            m[2], m[3] = max(m[2], x), min(m[3], x)
        else:
            m[2] = m[3] = x
        m[0] += 1
        m[1] += x
        off = x - m[4]
        m[4] += off / m[0]
        m[5] += off * (x - m[4])

    def _end_run(self) -> None:
        num = self.num
        if num["run_n"] >= MIN_BULK_PACKETS:
            d = "f" if num["run_fwd"] else "b"
            num[f"{d}_bulks"] += 1
            num[f"{d}_bulk_packets"] += num["run_n"]
            num[f"{d}_bulk_bytes"] += num["run_bytes"]
        num["run_n"] = num["run_bytes"] = 0

    def add(self, packet: tuple, protocol: int, previous: int | None, idle_threshold_us: int) -> None:
        """One packet of the open flow; ``previous`` is the time of the packet before it in the segment."""
        ts, pkt_id, header, length, payload, flags, window, from_lo, _ = packet
        num, tcp = self.num, protocol == TCP
        fwd = bool(from_lo) == bool(self.seg["lo_is_fwd"])
        d = "f" if fwd else "b"
        opens = num["n"] == 0
        began = ts if previous is None else previous
        if opens:
            num["flow_id"], num["start_us"], num["end_us"] = pkt_id, began, ts
        gap = None if previous is None else ts - previous
        if gap is not None and gap > 0:
            self._measure("gap", gap)
        if gap is not None and gap > idle_threshold_us:
            self._measure("idle", gap)
            if not opens:
                self._measure("burst", previous - num["began"])
            num["began"] = ts
        elif opens:
            num["began"] = began
        if num[f"{d}_last_ts"] != _NONE:
            self._measure(f"{d}gap", ts - num[f"{d}_last_ts"])
        num[f"{d}_last_ts"] = ts
        self._measure("al", length)
        self._measure(f"{d}l", length)
        num["n"] += 1
        num["end_us"] = max(num["end_us"], ts)
        num["last_pkt_id"] = pkt_id
        num[f"{d}_header"] += header
        if num["run_n"] and bool(num["run_fwd"]) != fwd:
            self._end_run()
        num["run_fwd"] = fwd
        num["run_n"] += 1
        num["run_bytes"] += length
        if tcp:
            for name in FLAG_COUNTS:
                num[f"n_{name}"] += flags & TCP_FLAG_BITS[name] != 0
            num[f"{d}_psh"] += flags & TCP_FLAG_BITS["psh"] != 0
            num[f"{d}_urg"] += flags & TCP_FLAG_BITS["urg"] != 0
            if window > 0 and num[f"{d}_window"] == _NONE:
                num[f"{d}_window"] = window
            if fwd and payload > 0:
                num["f_data"] += 1
                least = num["f_min_payload"]
                num["f_min_payload"] = payload if least == _NONE else min(least, payload)

    def close(self, reason: int) -> tuple | None:
        """The aggregates of the open flow, which is empty afterwards; None if it had no packet."""
        if not self.num["n"]:
            self._reset()
            return None
        self._end_run()
        num = self.num

        def moments(name: str) -> list:
            n, total, most, least, _, squares = self.mom[name]
            return [n, *((total, most, least) if n else (None,) * 3), squares / (n - 1) if n > 1 else None]

        out = [num[c] for c in ("flow_id", "start_us", "end_us", "last_pkt_id")]
        out += [bool(self.seg["lo_is_fwd"]), reason, None, moments("al")[-1], *moments("gap"), *moments("idle")]
        out += [num[f"n_{f}"] for f in FLAG_COUNTS]
        for d in "fb":
            out += [*moments(f"{d}l"), *moments(f"{d}gap")]
            out += [num[f"{d}_header"] if self.mom[f"{d}l"][0] else None, num[f"{d}_psh"], num[f"{d}_urg"], num[f"{d}_bulks"]]
            bulks = num[f"{d}_bulks"]
            out += [num[f"{d}_bulk_packets"] if bulks else None, num[f"{d}_bulk_bytes"] if bulks else None]
            out.append(None if num[f"{d}_window"] == _NONE else num[f"{d}_window"])
        out += [num["f_data"], None if num["f_min_payload"] == _NONE else num["f_min_payload"], *moments("burst")]
        self._reset()
        return tuple(out)


def _moment_fields(name: str) -> list[str]:
    return [f"{name}_{c} bigint" for c in ("n", "sum", "max", "min")] + [f"{name}_var double"]


def closed_flow_schema() -> str:
    """Key and aggregates of a closed flow, named as the batch aggregation names them."""
    fields = ["lo_ip string", "lo_port int", "hi_ip string", "hi_port int", "protocol int"]
    fields += [f"{c} bigint" for c in ("flow_id", "start_us", "end_us", "last_pkt_id")]
    fields += ["lo_is_src boolean", "reason int", "tail_reason int", "al_var double"]
    fields += [*_moment_fields("gap"), *_moment_fields("idle"), *[f"n_{f} bigint" for f in FLAG_COUNTS]]
    for d in "fb":
        fields += [*_moment_fields(f"{d}l"), *_moment_fields(f"{d}gap")]
        fields += [f"{d}_{c} bigint" for c in _BOTH[:-1]]
    return ", ".join([*fields, "f_data bigint", "f_min_payload bigint", *_moment_fields("burst")])


_COLUMNS = [c.split()[0] for c in closed_flow_schema().split(", ")]


def closed_frame(rows: list[tuple]) -> pd.DataFrame:
    """Plain object columns: nulls stay None and Arrow takes the types from the output schema."""
    return pd.DataFrame(rows, columns=_COLUMNS, dtype="object")


def advance(flow: OpenFlow, packets: np.ndarray, key: tuple, limits: Limits) -> Iterator[tuple]:
    """Feed packets in order of time and number; yields the key and aggregates of every flow that closes."""
    seg, protocol = flow.seg, key[KEY.index("protocol")]

    def ended(reason: int) -> Iterator[tuple]:
        out = flow.close(reason)
        if out:
            yield (*key, *out)

    for p in np.sort(packets, order=["ts_us", "pkt_id"]).tolist():
        ts = p[0]
        if seg["live"] and ts - seg["last_ts"] > limits.timeout_us:
            yield from ended(TIMEOUT)
            seg["live"] = 0
        previous = seg["last_ts"] if seg["live"] else None
        if previous is None:
            seg["live"], seg["lo_is_fwd"], seg["start_ts"] = 1, int(p[7]), ts
        seg["rn"] += 1
        flow.add(p, protocol, previous, limits.idle_threshold_us)
        seg["last_ts"] = ts
        if p[8]:
            yield from ended(FIN_RST)
            seg["live"] = 0
        elif flow.num["n"] >= limits.max_packets:
            yield from ended(MAX_PKTS)
            seg["start_ts"] = ts
        elif limits.max_duration_us and ts - seg["start_ts"] >= limits.max_duration_us:
            yield from ended(DURATION)
            seg["start_ts"] = ts


def expire(flow: OpenFlow, key: tuple, now_us: int, limits: Limits) -> Iterator[tuple]:
    """Close the flow if nothing has come for longer than the idle timeout."""
    if flow.seg["live"] and now_us - flow.seg["last_ts"] > limits.timeout_us:
        out = flow.close(TIMEOUT)
        flow.seg["live"] = 0
        if out:
            yield (*key, *out)


def finish(flow: OpenFlow, key: tuple) -> Iterator[tuple]:
    """Close whatever is open at the end of a session."""
    out = flow.close(FINALIZE)
    flow.seg["live"] = 0
    if out:
        yield (*key, *out)
