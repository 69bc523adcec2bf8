"""Global ranks by range partition: one range shuffle, one count per partition, offsets added."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowsight.session import scratch_folder


def with_rank(df: DataFrame, order: list[Column], rank: str = "rank") -> DataFrame:
    """``df`` with its place 1, 2, 3 ... in ``order``, which must tell all rows apart if places are to be fixed.

    ``df`` is read twice (range bounds, then rows), so it should be a table. The driver sees one number per partition.
    """
    spark = df.sparkSession
    folder = scratch_folder(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    # upper bits: partition; lower 33 bits: row within it
    dealt.withColumn("_at", F.monotonically_increasing_id()).write.parquet(f"{folder}/ordered")
    ordered = spark.read.parquet(f"{folder}/ordered")
    ordered = ordered.withColumn("_part", F.shiftright("_at", 33))
    sizes = sorted((r[0], r[1]) for r in ordered.groupBy("_part").count().collect())
    before = [0, *accumulate(n for _, n in sizes)]
    offsets = spark.createDataFrame(
        [(p, b) for (p, _), b in zip(sizes, before, strict=False)], "_part long, _before long"
    )
    placed = ordered.join(F.broadcast(offsets), "_part")
    return placed.withColumn(rank, F.expr("_before + (_at & 8589934591L) + 1")).drop("_part", "_at", "_before")
