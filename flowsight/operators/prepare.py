"""Building labelled training sets: labels, cleaning, splitting, scaling parameters, weights."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowsight.schema import CLIP_VALUE, FEATURE_COLUMNS, N_CLASSES, NEAR_ZERO_STD
from flowsight.session import broadcast_if_small

# Training label -> class code.
LABELS = {
    "Benign": 0,
    "MITM-ARP-Spoofing": 1,
    "SSH-Bruteforce": 2,
    "FTP-BruteForce": 3,
    "DDoS-ICMP_Flood": 4,
    "DDoS-RawIPDDoS": 5,
    "DDoS-UDP_Flood": 6,
    "DoS": 7,
    "Exploiting-FTP": 8,
    "Fuzzing": 9,
    "ICMP-Flood": 10,
    "SYN-Flood": 11,
    "Port_Scanning": 12,
    "Remote-Code-Execution": 13,
    "SQL_Injection": 14,
    "XSS": 15,
}
# Capture folder (lower case) -> training label.
FOLDERS = {
    "arp-spoof": "MITM-ARP-Spoofing",
    "mitm-arp spoofing": "MITM-ARP-Spoofing",
    "ssh brute force": "SSH-Bruteforce",
    "ftp brute force": "FTP-BruteForce",
    "ddos icmp": "DDoS-ICMP_Flood",
    "ddos raw": "DDoS-RawIPDDoS",
    "ddos-udp": "DDoS-UDP_Flood",
    "ddos udp": "DDoS-UDP_Flood",
    "dos": "DoS",
    "exploiting ftp": "Exploiting-FTP",
    "fuzzing": "Fuzzing",
    "icmp flood": "ICMP-Flood",
    "syn flood": "SYN-Flood",
    "port scanning": "Port_Scanning",
    "remote code execution": "Remote-Code-Execution",
    "sql injection": "SQL_Injection",
    "xss": "XSS",
}
MIN_ROWS_TO_SPLIT = 10
SPLIT_BUCKETS = 4096


def _literal(text: str) -> str:
    return "'" + text.replace("'", "\\'") + "'"


def _map(pairs: dict) -> str:
    items = [f"{_literal(k)}, {_literal(v) if isinstance(v, str) else v}" for k, v in pairs.items()]
    return f"map({', '.join(items)})"


# -- labels ------------------------------------------------------------------


def label_from_path(path: str) -> str:
    """SQL text: raw label from a path below the input folder, null when no folder tells.

    The first "benign" or "malicious" folder decides; under "malicious" the next folder names the attack.
    """
    slashed = f"concat('/', {path})"
    kind = f"lower(regexp_extract({slashed}, '(?i)/(benign|malicious)/', 1))"
    rest = f"regexp_extract({slashed}, '(?i)/(?:benign|malicious)/(.+)$', 1)"
    folder = f"case when contains({rest}, '/') then split_part({rest}, '/', 1) else 'Malicious' end"
    known = f"try_element_at({_map(FOLDERS)}, lower({folder}))"
    return (
        f"case {kind} when 'benign' then 'Benign'"
        f" when 'malicious' then coalesce({known}, {folder}) end"
    )


def resolve_label(raw: str) -> str:
    """SQL text: raw label -> class code: exact, alias, punctuation-free, substring, else Benign."""
    squeezed = {k.lower().replace(" ", "").replace("-", "").replace("_", ""): v for k, v in LABELS.items()}
    aliases = {k.lower(): v for k, v in LABELS.items()} | {"normal": 0}
    entries = ", ".join(
        f"named_struct('k', {_literal(k.lower())}, 'code', {v})" for k, v in LABELS.items()
    )
    low = f"lower({raw})"
    near = f"get(filter(array({entries}), e -> contains({low}, e.k) or contains(e.k, {low})), 0).code"
    return (
        f"coalesce(try_element_at({_map(LABELS)}, {raw}),"
        f" try_element_at({_map(aliases)}, {low}),"
        f" try_element_at({_map(squeezed)}, regexp_replace({low}, '[ _-]', '')),"
        f" {near}, 0)"
    )


def with_label(rows: DataFrame, root: str, path: str = "path") -> DataFrame:
    """Add ``label_code`` per source file: from its folder, else from a single-valued label column.

    The per-file summary is combined map-side (min and max suffice to tell a single value) and has one
    row per file, so it is normally broadcast: a file may hold a large share of all rows, and its rows
    should not meet in one task. Without a label column there is no join at all.
    """
    base, columns = root.rstrip("/"), [f"`{c}`" for c in rows.columns]
    relative = f"regexp_replace({path}, concat('^.*?', {_literal(_quote(base))}, '/'), '')"
    out = rows.selectExpr("*", f"{label_from_path(relative)} as _folder_label")
    if "label" in rows.columns:
        single = (
            rows.groupBy(path)
            .agg(F.min("label").alias("_lo"), F.max("label").alias("_hi"))
            .selectExpr(path, "case when _lo = _hi then trim(_lo) end as _file_label")
        )
        out = out.join(broadcast_if_small(single), path, "left")
        raw = "coalesce(_folder_label, _file_label, 'Benign')"
    else:
        raw = "coalesce(_folder_label, 'Benign')"
    return out.selectExpr(*columns, f"{resolve_label(raw)} as label_code")


def _quote(text: str) -> str:
    return "".join("\\\\" + ch if ch in ".+*?^$()[]{}|\\" else ch for ch in text)


def encode_label(name: str) -> str:
    """SQL text: training label -> code, null when unknown."""
    return f"try_element_at({_map(LABELS)}, {name})"


def decode_label(code: str) -> str:
    names = ", ".join(_literal(n) for n in LABELS)
    return f"get(array({names}), cast({code} as int))"


def merge_classes(code: str, merged: dict[int, int]) -> str:
    """SQL text: fold confusable classes into one before training or metrics."""
    cases = " ".join(f"when {a} then {b}" for a, b in merged.items())
    return f"case {code} {cases} else {code} end" if merged else code


# -- cleaning and scaling ----------------------------------------------------


def clean(df: DataFrame, columns: Sequence[str] = FEATURE_COLUMNS) -> DataFrame:
    """Drop rows with a null, NaN or infinite feature. Narrow; NaN fails every comparison here."""
    finite = " and ".join(f"abs({c}) < double('Infinity') and not isnan({c})" for c in columns)
    return df.filter(finite)


def fit_normaliser(df: DataFrame, columns: Sequence[str] = FEATURE_COLUMNS) -> DataFrame:
    """(pos, feature, mean, std): population std of the given (training) rows, near zero -> 1.

    Values are laid out as (pos, x) and combined map-side, so one row per feature is shuffled and the
    generated code stays small however many features there are.
    """
    moments = unpivot(df, columns).groupBy("pos").agg(
        F.avg("x").alias("mean"), F.stddev_pop("x").alias("std")
    )
    return moments.selectExpr(
        "pos",
        f"{feature_name(columns)} as feature",
        "mean",
        f"case when std < {NEAR_ZERO_STD}D then 1.0D else std end as std",
    )


def unpivot(df: DataFrame, columns: Sequence[str], *keep: str) -> DataFrame:
    """One row per cell: (keep..., pos, x)."""
    cells = ", ".join(f"cast({c} as double)" for c in columns)
    return df.selectExpr(*keep, f"posexplode(array({cells})) as (pos, x)")


def feature_name(columns: Sequence[str]) -> str:
    return f"element_at(array({', '.join(map(_literal, columns))}), pos + 1)"


def clipped_cells(
    df: DataFrame,
    means: Sequence[float],
    stds: Sequence[float],
    clip: float = CLIP_VALUE,
    columns: Sequence[str] = FEATURE_COLUMNS,
) -> DataFrame:
    """How many scaled values lie beyond +-clip, and out of how many."""
    beyond = " + ".join(
        f"cast(abs(({c} - {float(m)!r}D) / {float(s)!r}D) > {float(clip)!r}D as int)"
        for c, m, s in zip(columns, means, stds)
    )
    return df.agg(
        F.coalesce(F.sum(F.expr(f"cast({beyond} as bigint)")), F.lit(0)).alias("clipped"),
        (F.count(F.lit(1)) * len(columns)).alias("cells"),
    )


# -- splitting ---------------------------------------------------------------


def split_sizes(label: str, counts: DataFrame, val: float, test: float, least: int) -> DataFrame:
    """Rows per class that go to train and val; the rest is test. Small classes stay in train."""
    held = f"case when n < {least} then 0 else floor(n * {val + test!r}D + 0.5D) end"
    tested = f"ceil(held * {test / (val + test)!r}D)"
    return counts.selectExpr(label, "n", f"cast({held} as bigint) as held").selectExpr(
        label, "n - held as n_train", f"n - cast({tested} as bigint) as n_val_end"
    )


def stratified_split(
    df: DataFrame,
    label: str = "label",
    order: str = "xxhash64(flow_id, 42)",
    key: Sequence[str] = ("flow_id",),
    val: float = 0.15,
    test: float = 0.15,
    least: int = MIN_ROWS_TO_SPLIT,
) -> DataFrame:
    """Add ``split``: exact shares per class, the same on every run.

    Rows of a class are ranked by ``order`` (a LONG pseudo-random expression; ``key`` breaks ties) and cut
    at exact counts. The order is bucketed and counted first, so all but the buckets that hold a cut
    - two per class of 4096 - are assigned without ranking; only rows in those few are sorted.
    No class is ever gathered in one task. Null labels form a class of their own.
    """
    shared = lambda right, *names: [F.col(f"l.{c}").eqNullSafe(F.col(f"{right}.{c}")) for c in names]
    bucketed = df.withColumn("_bucket", F.expr(f"pmod({order}, {SPLIT_BUCKETS}L)"))
    counts = bucketed.groupBy(label, "_bucket").agg(F.count(F.lit(1)).alias("b"))
    # at most classes x 4096 rows from here on
    totals = counts.groupBy(label).agg(F.sum("b").alias("n"))
    ends = (
        counts.selectExpr(
            label,
            "_bucket",
            "b",
            f"sum(b) over (partition by {label} order by _bucket) as _end",
        )
        .alias("l")
        .join(F.broadcast(split_sizes(label, totals, val, test, least)).alias("s"), shared("s", label))
        .select("l.*", "s.n_train", "s.n_val_end")
    )
    plan = ends.selectExpr(
        label,
        "_bucket",
        "_end - b as _start",
        "n_train",
        "n_val_end",
        "case when _end <= n_train then 'train'"
        " when _end - b >= n_train and _end <= n_val_end then 'val'"
        " when _end - b >= n_val_end then 'test' end as split",
    )
    placed = (
        bucketed.alias("l")
        .join(F.broadcast(plan).alias("p"), shared("p", label, "_bucket"))
        .select("l.*", "p._start", "p.n_train", "p.n_val_end", "p.split")
    )
    whole = placed.filter("split is not null").select(*df.columns, "split")
    ties = ", ".join([f"({order})", *key])
    rank = f"_start + row_number() over (partition by {label}, _bucket order by {ties})"
    cut = placed.filter("split is null").selectExpr(
        *df.columns, "n_train", "n_val_end", f"{rank} as _rank"
    )
    cut = cut.selectExpr(
        *df.columns,
        "case when _rank <= n_train then 'train' when _rank <= n_val_end then 'val' else 'test' end as split",
    )
    return whole.unionByName(cut)


# -- weights -----------------------------------------------------------------


def class_weights(df: DataFrame, label: str = "label", n_classes: int = N_CLASSES) -> DataFrame:
    """(label, n, weight) for every class: total / (classes * count), 0 for an absent class."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    gathered = counts.agg(F.map_from_entries(F.collect_list(F.struct(label, "n"))).alias("by_class"))
    rows = gathered.selectExpr(
        "by_class",
        "aggregate(map_values(by_class), 0L, (a, x) -> a + x) as total",
        f"explode(sequence(0, {n_classes - 1})) as label",
    )
    return rows.selectExpr(
        "label",
        "coalesce(try_element_at(by_class, label), 0L) as n",
        "total",
    ).selectExpr(
        "label",
        "n",
        f"case when n > 0 then total / cast({n_classes} * n as double) else 0.0D end as weight",
    )


def sampling_weights(df: DataFrame, label: str = "label", factor: float = 50.0) -> DataFrame:
    """(label, n, weight): 1 / count, capped at ``factor`` times the median over the present classes."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    # one row per class: gathered into a single small array
    gathered = counts.filter("n > 0").agg(
        F.collect_list(F.struct(F.col(label).alias("label"), "n")).alias("classes"),
        F.percentile(F.expr("1.0D / n"), 0.5).alias("median"),
    )
    return gathered.selectExpr("inline(classes)", "median").selectExpr(
        "label", "n", f"least(1.0D / n, {float(factor)!r}D * median) as weight"
    )
