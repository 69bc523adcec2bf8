"""Session defaults, lineage cuts and the size check behind every broadcast."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A broadcast table must fit comfortably in every executor; rows here are under 200 bytes.
BROADCAST_ROWS = 1_000_000


def build_session(app: str = "flowsight", master: str | None = None, **conf) -> SparkSession:
    """Session with the settings the operators expect; anything in ``conf`` wins.

    Nothing cluster-specific is set: master, memory and the shuffle service come from the submitter.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # the JVM never compiles methods above 8 KB of bytecode: let Spark split such stages instead
        .config("spark.sql.codegen.hugeMethodLimit", "8000")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def _local_folder(spark: SparkSession, prefix: str) -> str:
    """A machine-local folder, which only a local master may use: executors elsewhere would not share it."""
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix=prefix)


def scratch_folder(spark: SparkSession) -> str:
    """A fresh folder below the shared folder the cluster names; a local one only where none is named."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return f"{shared.rstrip('/')}/flowsight-{uuid.uuid4().hex}"
    return _local_folder(spark, "flowsight-")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the folder named by ``spark.checkpoint.dir``.

    Only when the cluster names none (local tests) is a scratch folder set.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        sc.setCheckpointDir(shared or _local_folder(spark, "flowsight-checkpoint-"))
    return df.checkpoint()


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of each query run within go when it ends, not when the driver happens to collect its garbage.

    For jobs whose steps are written and read again. The session's own setting is put back.
    """
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def at_most(df: DataFrame, rows: int) -> bool:
    """True when ``df`` holds no more than ``rows`` rows; stops reading just past the bound."""
    return df.limit(rows + 1).count() <= rows


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast only after counting; a larger side is left to a shuffled join."""
    return F.broadcast(df) if at_most(df, rows) else df
