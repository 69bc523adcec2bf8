"""Keys that meet in one task: hot keys cut into pairs of parts, sorted runs read as a stream, connected components."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowsight.session import broadcast_if_small, cut_lineage

SAMPLE = 0.05


def split_hot(df: DataFrame, key: str, member: str, limit: int) -> DataFrame:
    """Adds ``a`` and ``b``: any two rows of one ``key`` meet in some (key, a, b), whose size stays near ``2 * limit``.

    A key of more than ``limit`` rows is dealt into parts by ``member`` and each pair of parts becomes a group. The
    sample only decides which keys are cut and how finely, never which rows meet.
    """
    hot = df.select(key).sample(SAMPLE, seed=7).groupBy(key).count().where(F.col("count") > limit * SAMPLE)
    hot = hot.select(key, F.ceil(F.col("count") / F.lit(limit * SAMPLE)).cast("int").alias("parts"))
    dealt = df.join(broadcast_if_small(hot), key, "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    dealt = dealt.withColumn("part", F.expr(f"pmod(xxhash64({member}, 11), parts)"))
    dealt = dealt.withColumn("other", F.explode(F.expr("sequence(0, parts - 1)")))
    least, most = F.least("part", "other").cast("int"), F.greatest("part", "other").cast("int")
    return dealt.withColumn("a", least).withColumn("b", most).drop("parts", "part", "other")


def pack(columns: list[np.ndarray]) -> bytes:
    """Columns of equal length as bytes. Bytes of one place stand together, so those that rows share take next to no room."""
    planes = b"".join(c.view(np.uint8).reshape(len(c), c.itemsize).T.tobytes() for c in columns)
    return len(columns[0]).to_bytes(8, "little") + pa.Codec("zstd", 1).compress(planes, asbytes=True)


def unpack(data: bytes, kinds: list[str]) -> list[np.ndarray]:
    """The columns, of numpy types ``kinds``, that were packed."""
    n, sizes = int.from_bytes(data[:8], "little"), [np.dtype(k).itemsize for k in kinds]
    planes = np.frombuffer(pa.Codec("zstd").decompress(data[8:], n * sum(sizes)), np.uint8)
    cuts = np.split(planes, np.cumsum(sizes)[:-1] * n)
    return [np.ascontiguousarray(c.reshape(w, n).T).view(k).reshape(n) for c, k, w in zip(cuts, kinds, sizes, strict=True)]


def map_runs(df: DataFrame, keys: list[str], order: list[str], find: Callable[..., tuple], schema: str) -> DataFrame:
    """``find(columns, from, to)`` for every run of two or more rows of equal ``keys``, rows sorted by ``order``."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []

        def answers(table: dict, stop: int) -> Iterator[pa.RecordBatch]:
            edge = np.zeros(stop + 1, bool)
            edge[[0, stop]] = True
            for k in keys:
                edge[1:stop] |= table[k][1:stop] != table[k][: stop - 1]
            at = np.flatnonzero(edge)
            wide = np.flatnonzero(np.diff(at) > 1)
            found = [find(table, int(at[i]), int(at[i + 1])) for i in wide]
            found = [f for f in found if len(f[0])]
            if found:
                columns = [pa.array(np.concatenate(c)) for c in zip(*found, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names)

        for batch in batches:
            part = {n: batch.column(n).to_numpy(zero_copy_only=False) for n in batch.schema.names}
            if not len(part[keys[0]]):
                continue
            if held and all(part[k][-1] == held[-1][k][-1] for k in keys):
                held.append(part)
                continue
            held.append(part)
            table = {n: np.concatenate([h[n] for h in held]) for n in part}
            size = len(table[keys[0]])
            last = np.ones(size, bool)
            for k in keys:
                last &= table[k] == table[k][-1]
            cut = int(np.argmax(last))
            if cut:
                yield from answers(table, cut)
            held = [{n: v[cut:] for n, v in table.items()}]
        if held:
            table = {n: np.concatenate([h[n] for h in held]) for n in held[0]}
            yield from answers(table, len(table[keys[0]]))

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def connected(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of ``edges(a, b)``; root is the least node reachable.

    Alternates the large-star and small-star steps, so long chains shrink in a logarithmic number of rounds. Each
    round is a checkpoint in the shared folder, from which a lost executor's work is read again.
    """
    edges = cut_lineage(edges.where("a <> b").selectExpr("greatest(a, b) as a", "least(a, b) as b").distinct())
    state = None
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = large.where("a <> b")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select("b", "m").union(least.select(F.col("a").alias("b"), "m"))
        small = small.where("b <> m").select(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b")).distinct()
        edges = cut_lineage(small)
        now = edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))")).first()
        if now == state:
            break
        state = now
    roots = edges.select("b").distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots.select("b", F.col("b").alias("root")))
