"""Row numbers and running totals over data too large for one task.

Spark evaluates an unpartitioned (or barely partitioned) window in one task. Here rows are dealt by ranges of their order
in one shuffle, each partition is handled alone, and one number per partition is carried across. Ties are told apart by
the row's place in the input, so a value that fills a third of the table is divided as well. The input is evaluated
once: it is checkpointed before Spark looks for the range bounds.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowsight.session import cut_lineage


def _dealt(df: DataFrame, order: Sequence[Column | str]) -> DataFrame:
    """``df`` in ranges of ``order``, sorted within each, with ``_part`` (its range) and ``_at`` (rising with the order)."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    held = cut_lineage(df.withColumn("_tie", F.monotonically_increasing_id()))
    by = [*order, "_tie"]
    placed = held.repartitionByRange(parts, *by).sortWithinPartitions(*by).drop("_tie")
    # upper bits: partition; lower 33 bits: row within it
    return placed.withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_at", 33))


def number_rows(df: DataFrame, order: Sequence[Column | str], out: str = "number") -> DataFrame:
    """Add 1..n in the given order; rows that the order leaves equal take any places next to each other."""
    placed = cut_lineage(_dealt(df, order))
    # one row per partition, here and on the driver
    sizes = sorted((r["_part"], r["count"]) for r in placed.groupBy("_part").count().collect())
    before = [0, *accumulate(n for _, n in sizes)]
    offsets = df.sparkSession.createDataFrame(
        [(p, b) for (p, _), b in zip(sizes, before, strict=False)], "_part bigint, _before bigint"
    )
    numbered = placed.join(F.broadcast(offsets), "_part")
    return numbered.select(*df.columns, F.expr("_before + (_at & 8589934591L) + 1").alias(out))


def running_totals(df: DataFrame, group: str, order: str, values: Sequence[str]) -> DataFrame:
    """Add ``before_<v>``: the total of ``v`` (bigint) over rows of the group with a greater ``order``.

    Needs one row per (group, order). The driver sees nothing; a row per partition and group that meets it is broadcast.
    """
    placed = _dealt(df, [F.col(group), F.desc(order)])
    sums = [f"_sum_{v}" for v in values]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, carried = None, np.zeros(len(values), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            groups = batch.column(batch.schema.names.index(group)).to_pylist()
            new = np.array([True, *(a != b for a, b in zip(groups[1:], groups[:-1], strict=True))])
            new[0] = here is None or groups[0] != here[0]
            start = np.maximum.accumulate(np.where(new, np.arange(len(new)), -1))
            columns = []
            for i, v in enumerate(values):
                x = batch.column(batch.schema.names.index(v)).to_numpy(zero_copy_only=False).astype(np.int64)
                total = np.concatenate([[0], np.cumsum(x)])
                # rows before the first new group go on from the batch before
                upto = total[1:] - np.where(start >= 0, total[np.maximum(start, 0)], -carried[i])
                columns.append(upto)
            here = (groups[-1],)
            carried = np.array([c[-1] for c in columns])
            arrays = [*batch.columns, *(pa.array(c) for c in columns)]
            yield pa.RecordBatch.from_arrays(arrays, [*batch.schema.names, *sums])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in placed.schema)
    scanned = cut_lineage(placed.mapInArrow(scan, schema + "".join(f", {s} bigint" for s in sums)))
    # what the ranges before this one hold of the group
    ends = scanned.groupBy(group, "_part").agg(*[F.max(F.struct("_at", s))[s].alias(s) for s in sums])
    earlier = f"over (partition by {group} order by _part rows between unbounded preceding and 1 preceding)"
    offsets = ends.selectExpr(
        f"{group} as _group", "_part as _range", *[f"coalesce(sum({s}) {earlier}, 0L) as _off{s}" for s in sums]
    )
    joined = scanned.join(
        F.broadcast(offsets), F.expr(f"{group} <=> _group and _part = _range")
    )
    return joined.selectExpr(
        *df.columns, *[f"_off{s} + {s} - {v} as before_{v}" for s, v in zip(sums, values, strict=True)]
    )
