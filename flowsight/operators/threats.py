"""Threat-feed matching: exact addresses first, then address ranges, as equi-joins only.

Every range is spelled out at the next finer of three fixed granularities (/16, /24, /32), so that a lookup
is at most three hash probes on ``ip >> bits`` - no range condition and no per-flow explosion. Of several
ranges that hold an address the first in network order wins. Ranges nest, so that is the outermost: the
coarsest granularity that matches, and within one slot the least network, then the shortest prefix.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowsight.functions.scalar import ip_sql
from flowsight.schema import TI_MATCHES
from flowsight.session import BROADCAST_ROWS, cut_lineage

GRAINS = (16, 24, 32)
_GRAIN = "case when prefix_len <= 16 then 16 when prefix_len <= 24 then 24 else 32 end"
# granularity and slot in one LONG key, so that all probes share one hash table
_KEY = "shiftleft(cast({grain} as bigint), 32) + {slot}"


def lookup_table(feeds: DataFrame) -> DataFrame:
    """(probe, exact_feed, range_feed): of one address in several feeds the greatest name wins."""
    slots = feeds.filter("not (is_exact and network = 0)").selectExpr(
        "is_exact",
        "network",
        "prefix_len",
        "feed_name",
        f"{_GRAIN} as grain",
    )
    spread = slots.selectExpr(
        "is_exact",
        "network",
        "prefix_len",
        "feed_name",
        "grain",
        "explode(sequence(shiftright(network, 32 - grain),"
        " shiftright(network, 32 - grain) + shiftleft(1L, grain - prefix_len) - 1)) as slot",
    )
    return (
        spread.groupBy(F.expr(_KEY.format(grain="grain", slot="slot")).alias("probe"))
        .agg(
            F.expr("max(case when is_exact then feed_name end) as exact_feed"),
            F.expr(
                "min(case when not is_exact then struct(network, prefix_len, feed_name) end) as outer"
            ),
        )
        .selectExpr("probe", "exact_feed", "outer.feed_name as range_feed")
    )


def lookup_bounds(feeds: DataFrame) -> dict[int, int]:
    """Upper bound of lookup rows per granularity, from one pass over the feed entries."""
    rows = (
        feeds.selectExpr(f"{_GRAIN} as grain", "prefix_len")
        .groupBy("grain")
        .agg(F.expr("sum(shiftleft(1L, grain - prefix_len)) as slots"))
        .collect()
    )
    return {r["grain"]: min(r["slots"], 1 << r["grain"]) for r in rows}


def _probe(df: DataFrame, number: str, out: str, table: DataFrame, grains, small: bool) -> DataFrame:
    """Add ``out``: the feed that lists the address in LONG column ``number``, or null."""
    keep, exact, ranges = df.columns, [], []
    for grain in grains:
        side = table.selectExpr(
            f"probe as _probe{grain}", f"exact_feed as _exact{grain}", f"range_feed as _range{grain}"
        )
        key = _KEY.format(grain=grain, slot=f"shiftright({number}, {32 - grain})")
        df = df.join(
            F.broadcast(side) if small else side, F.expr(f"{key} = _probe{grain}"), "left"
        )
        exact.append(f"_exact{grain}")
        ranges.append(f"_range{grain}")
    return df.selectExpr(*keep, f"coalesce({', '.join([exact[-1], *ranges])}) as {out}")


def _matches() -> str:
    def side(ip: str, feed: str, is_source: str) -> str:
        return (
            f"case when {feed} is not null then named_struct('ip', {ip}, 'feed_name', {feed},"
            f" 'is_source', {is_source}) end"
        )

    pair = f"array({side('src_ip', '_src', 'true')}, {side('dst_ip', '_dst', 'false')})"
    return f"cast(array_compact({pair}) as {TI_MATCHES})"


@dataclass(frozen=True)
class Lookup:
    """Feeds made ready for probing: the table, the granularities it holds and whether it may be broadcast."""

    table: DataFrame
    grains: list[int]
    small: bool


def prepare_lookup(feeds: DataFrame, broadcast_rows: int = BROADCAST_ROWS, keep: bool = False) -> Lookup:
    """The lookup of ``feeds``, its size bounded by one pass over the entries.

    ``keep`` writes the table to the shared checkpoint folder, so that any number of batches probe it without
    reading the feeds again.
    """
    bounds = lookup_bounds(feeds)
    table = lookup_table(feeds)
    small = sum(bounds.values()) <= broadcast_rows
    return Lookup(cut_lineage(table) if keep else table, [g for g in GRAINS if g in bounds], small)


def with_threat_signals(
    flows: DataFrame, feeds: DataFrame | Lookup | None, broadcast_rows: int = BROADCAST_ROWS
) -> DataFrame:
    """Add ``ti_matches`` (the source match first, then the destination's, at most one each) and ``has_ti``.

    The size of the lookup table is bounded first. Up to ``broadcast_rows`` rows it is broadcast - once for
    all probes - and flows are not shuffled; above, distinct addresses are matched in a shuffle and only
    the addresses found are joined back.
    """
    keep = flows.columns
    if feeds is None:
        return flows.selectExpr(
            "*", f"cast(array() as {TI_MATCHES}) as ti_matches", "false as has_ti"
        )
    lookup = feeds if isinstance(feeds, Lookup) else prepare_lookup(feeds, broadcast_rows)
    table, grains, small = lookup.table, lookup.grains, lookup.small
    if not grains:
        return flows.selectExpr(
            "*", f"cast(array() as {TI_MATCHES}) as ti_matches", "false as has_ti"
        )
    if small:
        out = flows.selectExpr("*", f"{ip_sql('src_ip')} as _s", f"{ip_sql('dst_ip')} as _d")
        out = _probe(out, "_s", "_src", table, grains, True)
        out = _probe(out, "_d", "_dst", table, grains, True)
    else:
        hits = matched_addresses(flows, table, grains)
        out = flows.join(
            hits.selectExpr("ip as src_ip", "feed_name as _src"), "src_ip", "left"
        ).join(hits.selectExpr("ip as dst_ip", "feed_name as _dst"), "dst_ip", "left")
    return out.selectExpr(
        *keep,
        f"{_matches()} as ti_matches",
        "(_src is not null or _dst is not null) as has_ti",
    )


def match_threats(
    flows: DataFrame, feeds: DataFrame | Lookup | None, broadcast_rows: int = BROADCAST_ROWS
) -> DataFrame:
    """Add ``ti_matches`` only."""
    return with_threat_signals(flows, feeds, broadcast_rows).drop("has_ti")


def matched_addresses(flows: DataFrame, table: DataFrame, grains=GRAINS) -> DataFrame:
    """Distinct flow addresses that a feed lists, with the feed: (ip, feed_name)."""
    ips = flows.selectExpr("explode(array(src_ip, dst_ip)) as ip").distinct()
    numbered = ips.selectExpr("ip", f"{ip_sql('ip')} as _n").filter("_n is not null")
    found = _probe(numbered, "_n", "feed_name", table, grains, False)
    return found.filter("feed_name is not null").select("ip", "feed_name")


def feed_inventory(feeds: DataFrame) -> DataFrame:
    """Entries per feed. Of the same address in several feeds one entry stays; ranges all stay."""
    addresses = feeds.filter("is_exact").groupBy("network").agg(F.max("feed_name").alias("feed_name"))
    kept = addresses.select("feed_name").unionByName(feeds.filter("not is_exact").select("feed_name"))
    return kept.groupBy("feed_name").agg(F.count(F.lit(1)).alias("entries"))
