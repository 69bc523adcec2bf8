"""Moving windows: how many distinct values a key meets within any stretch of time, and the rows behind it.

A value counts at time x if it was last seen in (x - window, x]. So each sighting counts from its time until the next one
of the same value, or until the window has passed: +1 and -1, and their running sum is the exact count at every moment.
Time is cut into slots no shorter than the window. A sighting reaches at most into the next slot, where it is entered as
one at the slot's beginning, so every slot of a key is summed alone and no task holds a whole key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SLOT_WINDOWS = 4


def moving_counts(
    rows: DataFrame, by: Sequence[str], value: str, window_us: int, time: str = "start_us"
) -> DataFrame:
    """(by, at_us, n): the number of distinct ``value`` of a key in (at_us - window, at_us], at every moment it changes.

    Rows without a time or value are left out; ``by`` may be empty (all rows are one key).
    """
    by, slot = list(by), SLOT_WINDOWS * window_us
    seen = rows.where(F.col(time).isNotNull() & F.col(value).isNotNull()).selectExpr(
        *by, f"{value} as _value", f"cast({time} as bigint) as _t"
    )
    seen = seen.distinct().selectExpr("*", f"floor(_t / {slot}) as _slot", f"_t + {window_us} as _until")
    # what the slot before hands on: the last sighting of each value, combined map-side
    last = seen.groupBy(*by, "_value", "_slot").agg(F.max("_until").alias("_until"))
    carried = last.selectExpr(
        *by, "_value", f"(_slot + 1) * {slot} as _t", "_slot + 1 as _slot", "_until"
    ).where("_until > _t")
    place = ", ".join([*by, "_value", "_slot"])
    spans = seen.unionByName(carried).selectExpr(
        *by, "_slot", "_t",
        f"least(_until, (_slot + 1) * {slot}, coalesce(lead(_t) over (partition by {place} order by _t, _until), _until)) as _end",
    )
    # a sighting handed on may stand beside one of the same moment: its span is empty
    steps = spans.where("_end > _t").selectExpr(
        *by, "_slot", "inline(array(struct(_t as at_us, 1L as step), struct(_end as at_us, -1L as step)))"
    )
    steps = steps.groupBy(*by, "_slot", "at_us").agg(F.sum("step").alias("step"))
    order = f"over (partition by {', '.join([*by, '_slot'])} order by at_us)"
    counts = steps.selectExpr(*by, "_slot", "at_us", f"sum(step) {order} as n")
    # at its end a slot drops to zero; the next one begins with what was handed on
    return counts.where(f"at_us < (_slot + 1) * {slot}").drop("_slot")


def moving_groups(
    rows: DataFrame, by: Sequence[str], value: str, window_us: int, least: int, time: str = "start_us"
) -> DataFrame:
    """Keys that meet at least ``least`` distinct values within some window: (by, first_us, most, most_us).

    ``first_us``: when the count first reaches ``least``; ``most``: its greatest, first reached at ``most_us``.
    """
    counts = moving_counts(rows, by, value, window_us, time).where(F.col("n") >= least)
    top = F.max(F.struct("n", (-F.col("at_us")).alias("back")))
    out = counts.groupBy(*by).agg(F.min("at_us").alias("first_us"), top.alias("top"))
    # without a key an aggregate of nothing is one row
    return out.where("top is not null").selectExpr(*by, "first_us", "top.n as most", "-top.back as most_us")


def group_members(
    rows: DataFrame, groups: DataFrame, by: Sequence[str], window_us: int, time: str = "start_us"
) -> DataFrame:
    """The rows in (first_us - window, first_us] of each group, with the group's ``first_us``.

    An equi-join on the key and the slot of time; a group reaches into at most two slots.
    """
    by = list(by)
    ends = groups.select(*[F.col(c).alias(f"_{c}") for c in by], "first_us").selectExpr(
        "*", f"explode(array_distinct(array(floor((first_us - {window_us} + 1) / {window_us}), floor(first_us / {window_us})))) as _slot"
    )
    placed = rows.selectExpr("*", f"floor({time} / {window_us}) as _at")
    same = " and ".join(["_at = _slot", *[f"{c} = _{c}" for c in by]])
    inside = f"{time} > first_us - {window_us} and {time} <= first_us"
    return placed.join(ends, F.expr(f"{same} and {inside}")).select(*rows.columns, "first_us")
