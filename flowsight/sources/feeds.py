"""Threat-feed and normalisation-parameter sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowsight.functions.scalar import ip_value_compact

# File kinds read from a feed folder (.txt, .csv, no extension).
_FEED_FILE = r"(^|/)([^/.]+|[^/]*\.(txt|csv))$"
# An entry ends at ";", "," or a blank; a line starting with "#" or ";" is a comment.
_ENTRY = "^[ \\t\\r\\n]*([^#;, \\t\\r\\n](?:[^;, ]*[^;, \\t\\r\\n])?)"
_ADDRESS = "^([0-9.]+)(?:/([0-9]+).*)?$"


def read_feed_lines(spark: SparkSession, path: str) -> DataFrame:
    """(feed_name, line) of the files directly in ``path``; the feed is named by the file's stem."""
    lines = spark.read.text(path).select(
        F.col("_metadata.file_name").alias("file"), F.col("value").alias("line")
    )
    return lines.filter(F.col("file").rlike(_FEED_FILE)).select(
        F.regexp_replace("file", r"\.[^.]*$", "").alias("feed_name"), "line"
    )


def parse_feed_lines(lines: DataFrame) -> DataFrame:
    """(feed_name, line) -> feed entries (network, prefix_len, is_exact, feed_name).

    Blank and comment lines are skipped; a line is cut at ";", then ",", then a blank. With "/" it is a
    range (prefix 1..32), otherwise an address. Malformed lines and 0.0.0.0 are dropped.
    """
    # explode keeps the optimiser from repeating the extraction in every later use of ``entry``
    entries = lines.selectExpr("feed_name", f"explode(regexp_extract_all(line, '{_ENTRY}', 1)) as entry")
    parts = entries.selectExpr(
        "feed_name",
        f"regexp_extract(entry, '{_ADDRESS}', 1) as base",
        f"regexp_extract(entry, '{_ADDRESS}', 2) as bits",
    )
    found = parts.selectExpr(
        "feed_name",
        "bits = '' as is_exact",
        f"{ip_value_compact('base')} as number",
        "base = '0.0.0.0' as is_zero",
        "case when bits = '' then 32 else try_cast(bits as int) end as prefix_len",
    ).filter(
        "number is not null and (number <> 0 or (is_zero and not is_exact)) and prefix_len between 1 and 32"
    )
    return found.selectExpr(
        "shiftleft(shiftright(number, 32 - prefix_len), 32 - prefix_len) as network",
        "prefix_len",
        "is_exact",
        "feed_name",
    )


def read_feeds(spark: SparkSession, path: str) -> DataFrame:
    return parse_feed_lines(read_feed_lines(spark, path))


def read_norm(spark: SparkSession, path: str) -> tuple[DataFrame, float | None]:
    """JSON with normalization.{means, stds, clip_value} -> (pos, feature, mean, std) and the clip value."""
    raw = spark.read.option("multiLine", "true").json(path)
    kinds = dict(raw.dtypes)
    if "normalization" not in kinds:
        raise ValueError("no 'normalization' object")
    inner = raw.select("normalization.*")
    types = dict(inner.dtypes)
    for name in ("means", "stds"):
        if not types.get(name, "").startswith("array<"):
            raise ValueError(f"normalization.{name} is missing or not an array")
    clip = "cast(clip_value as double)" if "clip_value" in types else "cast(null as double)"
    head = inner.selectExpr(
        "size(means) as m", "size(stds) as s", f"{clip} as clip"
    ).first()
    if head is None or head["m"] != head["s"]:
        raise ValueError("normalization.means and stds differ in length")
    feature = "n.feature_names[pos]" if kinds.get("feature_names", "").startswith("array<") else "null"
    cols = "normalization.means as means, normalization.stds as stds"
    names = "feature_names" if feature != "null" else "array() as feature_names"
    rows = (
        raw.selectExpr(*cols.split(", "), names)
        .selectExpr("feature_names", "posexplode(arrays_zip(means, stds)) as (pos, p)")
        .selectExpr(
            "pos",
            "cast(get(feature_names, pos) as string) as feature",
            "cast(p.means as double) as mean",
            "cast(p.stds as double) as std",
        )
    )
    return rows, head["clip"]


def norm_lists(norm: DataFrame, most: int = 10_000) -> tuple[list[float], list[float]]:
    """Means and stds in feature order; one row per feature, so the driver holds a bounded list."""
    rows = norm.orderBy("pos").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError("too many normalisation parameters")
    return [r["mean"] for r in rows], [r["std"] for r in rows]
