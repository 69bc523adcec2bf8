"""Duration splits on a batch: a flow also closes once ``limit`` has passed since it started.

Where a flow closes depends on where the one before it closed, so this is a chain and not a window. Every packet could
start a flow; where that flow would end is a search in the times of its segment, done for all packets at once. Which
packets do start one is then found by pointer doubling: the packets reached in one, two, four ... steps from the start
of a segment, in a logarithmic number of rounds over whole arrays.

Ordinary keys are taken in arrival order, one Arrow batch at a time, holding back the packets of the open flow. A hot
key is taken in blocks at once: a flow has at most ``max_packets`` packets, so some flow starts among the first
``max_packets`` packets of a block. Each block tells, for each of these places, where the first flow of the next block
would start; following those answers from block to block gives every block its true entry.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FIN_RST, MAX_PKTS, DURATION = 0, 1, 3
BLOCK_ROWS = 4_000_000
_OPEN = -1

# how the packet's segment ends here, null inside a segment
_SEGMENT_END = f"case when reason = {MAX_PKTS} then tail_reason else reason end as seg_end"


def split_by_duration(
    labelled: DataFrame,
    keys: Sequence[str],
    limit_us: int,
    max_packets: int,
    hot: bool = False,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Replace ``flow_rn``, ``reason`` and ``tail_reason`` of labelled packets."""
    columns = labelled.columns
    rows = labelled.selectExpr("*", _SEGMENT_END)
    if hot:
        rows = rows.selectExpr("*", f"(rn - 1) div {block_rows} as block")
        entries = block_entries(rows, keys, limit_us, max_packets, block_rows)
        # one row per block of a hot key
        rows = rows.join(F.broadcast(entries), [*keys, "block"], "left")
        place = [*keys, "block"]
        rows = rows.repartition(*place)
    else:
        rows = rows.selectExpr(
            "*", "0L as block", "cast(null as bigint) as open_rn", "cast(null as bigint) as open_ts"
        )
        place = list(keys)
    # ordinary keys come from a window by key, so each is already whole and ordered in its partition
    ordered = rows.sortWithinPartitions(*place, "ts_us", "pkt_id")
    names = [*columns, "seg_end", "block", "open_rn", "open_ts"]
    schema = labelled.schema
    return ordered.select(*names).mapInPandas(
        _splitter(columns, list(keys), limit_us, max_packets), schema
    )


def flow_ends(ts: np.ndarray, base: np.ndarray, closing: np.ndarray, limit_us: int, max_packets: int) -> np.ndarray:
    """The last packet of a flow that starts at each packet; ``closing`` marks the last packets of segments."""
    n, at = len(ts), np.arange(len(ts))
    segment = np.cumsum(closing) - closing
    last = np.searchsorted(segment, segment, side="right") - 1
    # rows and searched times sorted together, times before equal rows: how many rows stand before each time
    order = np.lexsort((np.repeat([1, 0], n), np.concatenate([ts, base + limit_us]), np.tile(segment, 2)))
    before = np.cumsum(order < n)
    overdue = np.empty(n, np.int64)
    overdue[order[order >= n] - n] = before[order >= n]
    return np.minimum(np.minimum(np.maximum(overdue, at), at + max_packets - 1), last)


def reached(starts: np.ndarray, following: np.ndarray) -> np.ndarray:
    """All places on the chains from ``starts``: ``following`` leads forward, its length stands for the end."""
    n = len(following)
    marks = np.append(starts, False)
    jump = np.append(following, n)
    for _ in range(max(1, n.bit_length())):
        marks[jump[marks]] = True
        jump = jump[jump]
    return marks[:n]


def _splitter(columns: list[str], keys: list[str], limit_us: int, max_packets: int):
    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, entered, here = None, False, None
        for pdf in batches:
            if not len(pdf):
                continue
            pdf = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            out, keep, entered = _split(pdf, here, entered)
            here = tuple(pdf.iloc[-1][[*keys, "block"]])
            held = pdf[keep:]
            if keep:
                yield out[:keep]
        if held is not None and len(held):
            yield _split(held.reset_index(drop=True), here, entered)[0]

    def _split(pdf: pd.DataFrame, here, entered: bool) -> tuple[pd.DataFrame, int, bool]:
        """The answer for all rows, how many of them are final, and whether the rest is still the flow a block began with.

        ``here`` is the key and block of the row before (held rows belong to it); ``entered`` tells that the first rows
        are the flow that was open when their block began.
        """
        n, at = len(pdf), np.arange(len(pdf))
        ts, rn = pdf["ts_us"].to_numpy("int64"), pdf["rn"].to_numpy("int64")
        base = pdf["seg_prev_ts"].fillna(pdf["ts_us"]).to_numpy("int64")
        ends = pdf["seg_end"].fillna(_OPEN).to_numpy("int64")
        moved = np.ones(n, bool)
        moved[1:] = False
        for k in [*keys, "block"]:
            column = pdf[k].to_numpy()
            moved[1:] |= column[1:] != column[:-1]
        first_is_new = here is None or tuple(pdf.iloc[0][[*keys, "block"]]) != here
        # a segment ends where it says so, and where the rows of a key or block do
        closing = (ends != _OPEN) | np.append(moved[1:], True)
        entry = pdf["open_rn"].notna().to_numpy() & moved
        entry[0] &= first_is_new or entered
        # the first row of a block that a flow enters counts from where that flow began
        first, begun = rn.copy(), base.copy()
        first[entry] = pdf["open_rn"].to_numpy()[entry].astype("int64")
        begun[entry] = pdf["open_ts"].to_numpy()[entry].astype("int64")
        last = flow_ends(ts, begun, closing, limit_us, max_packets)
        room = first[entry] + max_packets - 1 - rn[entry]
        last[entry] = np.minimum(last[entry], at[entry] + np.maximum(room, 0))
        starts = np.append(True, closing[:-1])
        starts = reached(starts, last + 1)
        start = np.maximum.accumulate(np.where(starts, at, 0))
        full = rn - first[start] + 1 >= max_packets
        overdue = ts - begun[start] >= limit_us
        cut = np.where(full, MAX_PKTS, np.where(overdue, DURATION, _OPEN))
        cut[ends == FIN_RST] = _OPEN
        why = np.where(cut != _OPEN, cut, ends)
        tail = np.where(cut != _OPEN, ends, _OPEN)
        out = pdf.assign(flow_rn=first[start])
        for name, values in (("reason", why), ("tail_reason", tail)):
            out[name] = pd.array(values, "Int32")
            out.loc[values == _OPEN, name] = pd.NA
        keep = n if why[-1] != _OPEN else int(start[-1])
        return out[columns], keep, bool(keep < n and entry[keep])

    return split


def block_entries(
    rows: DataFrame, keys: Sequence[str], limit_us: int, max_packets: int, block_rows: int
) -> DataFrame:
    """(keys, block, open_rn, open_ts): the flow already open when a block begins; none for the first."""
    keys = list(keys)
    seen = rows.selectExpr(
        *keys,
        "rn",
        "ts_us",
        "seg_prev_ts",
        "seg_end",
        # the packets after a block tell where its last flow ends
        f"explode(case when block > 0 and (rn - 1) % {block_rows} < {max_packets}"
        " then array(block, block - 1) else array(block) end) as block",
    )
    types = ", ".join(f"`{k}` {dict(rows.dtypes)[k]}" for k in keys)
    answers = seen.groupBy(*keys, "block").applyInPandas(
        _answers(keys, limit_us, max_packets, block_rows),
        f"{types}, block bigint, starts array<bigint>, lasts array<bigint>, bases array<bigint>",
    )
    return answers.groupBy(*keys).applyInPandas(
        _follow(keys, block_rows), f"{types}, block bigint, open_rn bigint, open_ts bigint"
    )


def _answers(keys: list[str], limit_us: int, max_packets: int, block_rows: int):
    def answer(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rn")
        block = int(key[-1])
        begin = block * block_rows + 1
        own = int((pdf["rn"] < begin + block_rows).sum())
        head = dict(zip([*keys, "block"], key))
        if own == len(pdf):  # nothing follows this block
            return pd.DataFrame(columns=[*head, "starts", "lasts", "bases"])
        ts = pdf["ts_us"].to_numpy("int64")
        base = pdf["seg_prev_ts"].fillna(pdf["ts_us"]).to_numpy("int64")
        after = flow_ends(ts, base, pdf["seg_end"].notna().to_numpy(), limit_us, max_packets)[:own] + 1
        # the last start inside the block on each chain: doubled until nothing moves
        last = np.where(after < own, after, np.arange(own))
        for _ in range(own.bit_length()):
            last = last[last]
        start = after[last]
        firsts = slice(0, min(max_packets, own))
        return pd.DataFrame(
            [
                {
                    **head,
                    "starts": (start[firsts] + begin).tolist(),
                    "lasts": (last[firsts] + begin).tolist(),
                    "bases": base[last[firsts]].tolist(),
                }
            ]
        )

    return answer


def _follow(keys: list[str], block_rows: int):
    def follow(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        entry, out = 1, []
        for r in pdf.sort_values("block").itertuples(index=False):
            i = entry - (r.block * block_rows + 1)
            entry = int(r.starts[i])
            begin = (r.block + 1) * block_rows + 1
            if entry > begin:
                out.append((*key, r.block + 1, int(r.lasts[i]), int(r.bases[i])))
        return pd.DataFrame(out, columns=[*keys, "block", "open_rn", "open_ts"])

    return follow
