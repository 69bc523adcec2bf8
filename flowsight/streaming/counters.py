"""Totals of a whole streaming run: every progress report is added up once, and the sum outlives the process."""

from __future__ import annotations

import json
import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

KEPT = 3


class SharedFolder:
    """Small text files in any store that Spark knows, written whole under a temporary name and then renamed."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._streams = jvm.org.apache.commons.io.IOUtils
        self.root = self._path(path)
        self.store = self.root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.store.mkdirs(self.root)

    def names(self) -> list[str]:
        return sorted(f.getPath().getName() for f in self.store.listStatus(self.root))

    def write(self, name: str, text: str) -> None:
        draft, final = self._path(self.root, f".{name}"), self._path(self.root, name)
        out = self.store.create(draft, True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        self.store.delete(final, False)
        self.store.rename(draft, final)

    def read(self, name: str) -> str:
        source = self.store.open(self._path(self.root, name))
        try:
            return self._streams.toString(source, "UTF-8")
        finally:
            source.close()

    def remove(self, name: str) -> None:
        self.store.delete(self._path(self.root, name), False)


def counted(df: DataFrame, name: str, flagged: str | None = None) -> DataFrame:
    """Attach counters of the rows that pass here, which progress reports then carry."""
    metrics = [F.count(F.lit(1)).alias("rows")]
    if flagged:
        metrics.append(F.expr(f"count_if({flagged})").alias("flagged"))
    return df.observe(name, *metrics)


def report_totals(progress: dict) -> dict[str, int]:
    """What one report adds: rows read, rows dropped as late, and every observed metric as ``name.metric``."""
    out = {"packets": progress.get("numInputRows", 0), "late": 0}
    for op in progress.get("stateOperators", []):
        out["late"] += op.get("numRowsDroppedByWatermark", 0)
    for name, metrics in (progress.get("observedMetrics") or {}).items():
        for field, value in (metrics or {}).items():
            out[f"{name}.{field}"] = out.get(f"{name}.{field}", 0) + (value or 0)
    return out


class RunCounters(StreamingQueryListener):
    """Adds up the reports of one query over its whole life, restarts included.

    Runs are known by the query's ``name``, whose batch ids go on over restarts as its checkpoint does. After each
    micro-batch the totals are written under its batch id into ``folder`` (shared storage), where the last ``KEPT``
    stay; a restarted run goes on from the newest. A report of a batch already added is left out, and a batch that
    was committed without its report having been added shows as ``missing``.

    Register it before the query starts: ``spark.streams.addListener(counters)``.
    """

    def __init__(self, spark: SparkSession, folder: str, name: str) -> None:
        self.name, self.folder = name, SharedFolder(spark, folder)
        self._lock = threading.Lock()
        self._runs: set[str] = set()
        self._done = threading.Event()
        self.batch, self.sums, self.missing = -1, {}, 0
        kept = [n for n in self.folder.names() if n.startswith("batch-")]
        if kept:
            saved = json.loads(self.folder.read(kept[-1]))
            self.batch, self.sums, self.missing = saved["batch"], saved["sums"], saved["missing"]

    def onQueryStarted(self, event) -> None:
        if event.name == self.name:
            self._runs.add(str(event.runId))
            self._done.clear()

    def onQueryProgress(self, event) -> None:
        progress = json.loads(event.progress.json)
        if progress.get("runId") in self._runs:
            self.add(progress)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        if str(event.runId) in self._runs:
            self._done.set()

    def add(self, progress: dict) -> None:
        """Take one report into the totals, once per batch id."""
        with self._lock:
            number = progress["batchId"]
            if number <= self.batch:
                return
            self.missing += number - self.batch - 1
            self.batch = number
            for name, value in report_totals(progress).items():
                self.sums[name] = self.sums.get(name, 0) + value
            # fixed width, so that the newest name sorts last
            self.folder.write(
                f"batch-{number:020d}.json",
                json.dumps({"batch": number, "sums": self.sums, "missing": self.missing}),
            )
            for name in [n for n in self.folder.names() if n.startswith("batch-")][:-KEPT]:
                self.folder.remove(name)

    def totals(self, wait_seconds: float = 30.0) -> dict[str, int]:
        """Totals of all batches; waits until the reports of a stopped query have come in."""
        self._done.wait(wait_seconds)
        with self._lock:
            return {"batches": self.batch + 1, "missing": self.missing, **self.sums}

    def table(self, spark: SparkSession) -> DataFrame:
        """The totals as rows (name, total)."""
        return spark.createDataFrame(sorted(self.totals().items()), "name string, total long")
