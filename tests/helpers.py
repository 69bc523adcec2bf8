"""Packet builders and a sequential brute-force sessioniser, written apart from the library."""

import random
from statistics import stdev

from flowsight.schema import PACKET_SCHEMA

FIN, SYN, RST, PSH, ACK, URG, ECE, CWR = (1 << i for i in range(8))
SEC = 1_000_000


def packet(ts, src="10.0.0.1", dst="10.0.0.2", sport=1000, dport=80, proto=6, flags=ACK, size=60, win=0):
    """(ts_us, src, dst, sport, dport, proto, ip header, transport header, length, flags, window)."""
    transport = 20 if proto == 6 else 8
    return (ts, src, dst, sport, dport, proto, 20, transport, size, flags if proto == 6 else 0, win)


def reply(ts, **kw):
    base = dict(src="10.0.0.2", dst="10.0.0.1", sport=80, dport=1000)
    return packet(ts, **{**base, **kw})


def frame(spark, packets):
    """One second is added to all times: zero means unset in the semantics being matched."""
    rows = [(i, p[0] + SEC, *p[1:]) for i, p in enumerate(packets)]
    return spark.createDataFrame(rows, PACKET_SCHEMA)


def random_packets(n, seed, keys=5, step=400_000):
    rng = random.Random(seed)
    ends = [(f"10.0.0.{i}", 1000 + i, f"10.0.1.{i % 2}", 80 + i) for i in range(keys)]
    ends[0] = ("10.0.0.9", 7, "10.0.0.9", 7)  # both ends equal
    protos = [17, 6, 1, 6, 6]
    out, ts = [], 0
    for _ in range(n):
        ts += rng.choice([0, 1, 1000, step, step, step * 4, step * 30])
        i = rng.choice([1, 1, 1, rng.randrange(keys)])
        a, ap, b, bp = ends[i]
        if rng.random() < 0.4:
            a, ap, b, bp = b, bp, a, ap
        flags = rng.choice([ACK] * 40 + [ACK | PSH] * 15 + [SYN] * 5 + [ACK | URG, ECE, CWR | ACK, FIN | ACK, RST])
        out.append(
            packet(ts, a, b, ap, bp, protos[i % 5], flags, rng.randrange(28, 1500), rng.choice([0, 512, 4096]))
        )
    return out


class Flow:
    def __init__(self, key, start):
        self.key, self.start, self.last = key, start, start
        self.packets, self.gaps, self.idle = [], [], []

    def add(self, p, fwd, idle_threshold, had_last):
        gap = p[0] - self.last if had_last else 0
        if gap > 0:
            self.gaps.append(gap)
        if gap > idle_threshold:
            self.idle.append(gap)
        self.last = p[0]
        self.packets.append((p, fwd))


def simulate(packets, timeout=600 * SEC, most=200, duration=None, idle=5 * SEC, tails=False):
    """Follow packets one by one. Returns a list of dicts, one per flow."""
    live, done = {}, []

    def finish(flow, reason):
        if flow.packets or tails:
            done.append(describe(flow, reason))

    for p in packets:
        ts, src, dst, sport, dport, proto = p[:6]
        fwd_key, bwd_key = (src, sport, dst, dport, proto), (dst, dport, src, sport, proto)
        for k in (fwd_key, bwd_key):
            if k in live and ts - live[k].last > timeout:
                finish(live.pop(k), "timeout")
        key = fwd_key if fwd_key in live else bwd_key if bwd_key in live else fwd_key
        fresh = key not in live
        flow = live.setdefault(key, Flow(key, ts))
        flow.add(p, key == fwd_key, idle, not fresh)
        again = None
        if proto == 6 and p[9] & (FIN | RST):
            finish(live.pop(key), "fin_rst")
        elif len(flow.packets) >= most:
            again = "max_pkts"
        elif duration and ts - flow.start >= duration:
            again = "duration"
        if again:
            finish(flow, again)
            live[key] = Flow(key, ts)
    for flow in live.values():
        finish(flow, "finalize")
    return done


def spread(values):
    return stdev(values) if len(values) > 1 else 0.0


def describe(flow, reason):
    fwd = [p for p, d in flow.packets if d]
    bwd = [p for p, d in flow.packets if not d]

    def gaps(ps):
        return [b[0] - a[0] for a, b in zip(ps, ps[1:])]

    runs, bulk = [], {True: [], False: []}
    for p, d in flow.packets:
        if runs and runs[-1][0] == d:
            runs[-1][1].append(p[8])
        else:
            runs.append((d, [p[8]]))
    for d, sizes in runs:
        if len(sizes) >= 2:
            bulk[d].append(sizes)
    tcp = flow.key[4] == 6
    flags = [p[9] for p, _ in flow.packets] if tcp else []
    data = [p[8] - p[6] - p[7] for p in fwd if tcp and p[8] > p[6] + p[7]]

    def window(ps):
        return next((p[10] for p in ps if tcp and p[10]), 0)

    def mean(v):
        return sum(v) / len(v) if v else 0.0

    return {
        "src_ip": flow.key[0],
        "src_port": flow.key[1],
        "dst_ip": flow.key[2],
        "dst_port": flow.key[3],
        "protocol": flow.key[4],
        "start_us": flow.start,
        "end_us": flow.last,
        "reason": reason,
        "fwd_packets": len(fwd),
        "bwd_packets": len(bwd),
        "total_length_of_fwd_packets": sum(p[8] for p in fwd),
        "total_length_of_bwd_packets": sum(p[8] for p in bwd),
        "fwd_packet_length_std": spread([p[8] for p in fwd]),
        "packet_length_std": spread([p[8] for p, _ in flow.packets]),
        "flow_iat_mean": mean(flow.gaps),
        "flow_iat_std": spread(flow.gaps),
        "fwd_iat_total": sum(gaps(fwd)),
        "fwd_iat_std": spread(gaps(fwd)),
        "bwd_iat_total": sum(gaps(bwd)),
        "bwd_iat_max": max(gaps(bwd), default=0),
        "idle_mean": mean(flow.idle),
        "idle_std": spread(flow.idle),
        "fwd_avg_packets_bulk": mean([len(b) for b in bulk[True]]),
        "bwd_avg_bytes_bulk": mean([sum(b) for b in bulk[False]]),
        "syn_flag_count": sum(f & SYN > 0 for f in flags),
        "urg_flag_count": sum(f & URG > 0 for f in flags),
        "fwd_psh_flags": sum(p[9] & PSH > 0 for p in fwd) if tcp else 0,
        "bwd_header_length": sum(p[6] + p[7] for p in bwd),
        "init_win_bytes_forward": window(fwd),
        "init_win_bytes_backward": window(bwd),
        "act_data_pkt_fwd": len(data),
        "min_seg_size_forward": min(data, default=0),
    }


def same_flows(spark_flows, simulated):
    """Compare as sorted rows; spreads to a relative 1e-9."""
    fields = list(simulated[0])
    got = sorted(
        [tuple(r[f] for f in fields) for r in spark_flows.select(*fields).collect()], key=repr_key
    )
    want = sorted(
        [tuple(d[f] + SEC if f in ("start_us", "end_us") else d[f] for f in fields) for d in simulated],
        key=repr_key,
    )
    assert len(got) == len(want)
    for g, w in zip(got, want):
        for f, a, b in zip(fields, g, w):
            if isinstance(b, str):
                assert a == b, (f, g, w)
            else:
                assert abs(a - b) <= 1e-9 * max(1.0, abs(b)), (f, a, b, g, w)


def repr_key(row):
    return tuple(str(v) for v in row[:10])
