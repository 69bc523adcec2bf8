"""Benchmark decontamination by winnowing, on DataFrame functions alone.

A text keeps a k-gram hash where it is the least of some run of ``WINDOW - GRAM + 1`` neighbouring k-grams, so any
span of ``WINDOW`` shared words keeps a common fingerprint in both texts. Fingerprints are joined; every hit is
extended to all windows of ``WINDOW`` words that contain it, and these are compared by their words. An item of
fewer words is one window: its whole length is looked up at every word of a document, once per length that occurs.

Null text has no words; empty texts and empty tables give zero hits. A row is known by its doc_id and the hash of its
text, null-safe, so repeated rows and null ids each get their own row of the result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowsight.session import broadcast_if_small, scratch_folder

WINDOW = 10
GRAM = 5
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_GAP = r"[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def _words(text: str) -> str:
    lower = f"if(octet_length({text}) = char_length({text}), lower({text}), translate({text}, '{_UPPER}', '{_LOWER}'))"
    return f"filter(split({lower}, '{_GAP}'), w -> w <> '')"


def _grams(words: str, n: int) -> str:
    return (
        f"if(size({words}) < {n}, cast(array() as array<bigint>), "
        f"transform(sequence(1, greatest(1, size({words}) - {n - 1})), i -> xxhash64(slice({words}, i, {n}))))"
    )


def _is_least(grams: str, at: str, run: int) -> str:
    """Whether ``grams[at]`` is the least of some run of ``run`` neighbours that all exist."""
    reach = []
    for sign in ("-", "+"):
        steps = " ".join(
            f"when not coalesce(get({grams}, {at} {sign} {j}) >= get({grams}, {at}), false) then {j - 1}"
            for j in range(1, run)
        )
        reach.append(f"case {steps} else {run - 1} end")
    # a text of fewer k-grams than a run holds no window, so nothing is lost there
    return f"({reach[0]}) + ({reach[1]}) + 1 >= {run}"


def _fingerprints(rows: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` and every winnowed k-gram: pos, gram, the words around it that a window with it can hold, where they begin.

    The least k-grams are picked inside the array, so that a row carries a few words and never a whole text. The outer
    explode matters: below an inner one Spark repeats the array's definition in a filter on the scan, lambda and all.
    """
    reach = WINDOW - GRAM
    begin = f"greatest(0, p - {reach})"
    least = f"filter(sequence(0, greatest(0, size(grams) - 1)), p -> {_is_least('grams', 'p', reach + 1)})"
    around = f"slice(words, {begin} + 1, {WINDOW + reach})"
    each = f"transform({least}, p -> struct(p as pos, grams[p] as gram, {begin} as begin, size(words) as n, {around} as around))"
    grams = rows.selectExpr(*keep, "words", f"{_grams('words', GRAM)} as grams")
    return grams.selectExpr(*keep, f"explode_outer({each}) as f").where("f.gram is not null").select(*keep, "f.*")


def contaminated(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """One row per row of ``docs``: its words, the words inside a window of an item and the items it holds."""
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    rows = rows.withColumn("text_hash", F.expr("xxhash64(text)"))
    words = rows.selectExpr("doc_id", "text_hash", f"{_words('text')} as words")
    tests = items.select(
        F.col(f"`{item_col}`").cast("string").alias("item_id"), F.col(f"`{item_text_col}`").cast("string").alias("text")
    ).selectExpr("item_id", f"{_words('text')} as words")

    # every distinct window of the items with the items that hold it
    cut = f"transform(sequence(1, greatest(1, size(words) - {WINDOW - 1})), i -> slice(words, i, {WINDOW}))"
    windows = tests.filter("size(words) > 0").selectExpr("item_id", f"explode_outer({cut}) as grams")
    windows = windows.selectExpr("item_id", "size(grams) as length", "array_join(grams, ' ') as span").distinct()
    spans = windows.select("span", "length").distinct()

    # hits of fingerprints, each extended to the windows around it
    wanted = _fingerprints(tests.filter(f"size(words) >= {WINDOW}"), ["item_id"]).select("gram").distinct()
    # texts of fewer words have no fingerprint; a filter on the size would be moved to the scan and split every text twice
    hits = _fingerprints(words, ["doc_id", "text_hash"])
    hits = hits.join(broadcast_if_small(wanted), "gram", "left_semi")
    starts = f"explode_outer(sequence(begin, least(pos, n - {WINDOW}))) as start"
    found = hits.selectExpr("doc_id", "text_hash", "around", "begin", starts).selectExpr(
        "doc_id", "text_hash", "start", f"{WINDOW} as length", f"array_join(slice(around, start - begin + 1, {WINDOW}), ' ') as span"
    )
    # short items: at most WINDOW - 1 lengths, so this collects a few numbers
    lengths = [r.length for r in spans.select("length").distinct().filter(f"length < {WINDOW}").collect()]
    for n in sorted(lengths):
        short = broadcast_if_small(spans.filter(f"length = {n}").selectExpr("xxhash64(split(span, ' ')) as gram").distinct())
        every = f"sequence(0, greatest(0, size(words) - {n}))"
        cuts = f"transform({every}, p -> struct(p as start, xxhash64(slice(words, p + 1, {n})) as gram, slice(words, p + 1, {n}) as around))"
        at = words.filter(f"size(words) >= {n}").selectExpr("doc_id", "text_hash", f"explode_outer({cuts}) as f")
        found = found.unionByName(
            at.select("doc_id", "text_hash", "f.*").join(short, "gram", "left_semi").selectExpr(
                "doc_id", "text_hash", "start", f"{n} as length", "array_join(around, ' ') as span"
            )
        )
    # neighbouring fingerprints lead to the same window: keep each once, and only true ones
    found = found.join(broadcast_if_small(spans), ["span", "length"], "left_semi").distinct()
    # read by words and by items below: written once, so that texts are taken apart once
    folder = scratch_folder(docs.sparkSession)
    found.write.parquet(f"{folder}/found")
    found = docs.sparkSession.read.parquet(f"{folder}/found")

    covered = "size(array_distinct(flatten(collect_list(sequence(start, start + length - 1)))))"
    hit_words = found.groupBy("doc_id", "text_hash").agg(F.expr(f"cast({covered} as bigint)").alias("n_hit"))
    held = found.select("doc_id", "text_hash", "span").distinct()
    held = held.join(broadcast_if_small(windows.select("span", "item_id")), "span")
    held = held.groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_set("item_id")).alias("item_ids"))

    counted = words.selectExpr("doc_id", "text_hash", "cast(greatest(coalesce(size(words), 0), 0) as bigint) as n_words")
    same = lambda right: F.expr(f"d.doc_id <=> {right}.doc_id and d.text_hash = {right}.text_hash")
    return (
        counted.alias("d")
        .join(hit_words.alias("h"), same("h"), "left")
        .join(held.alias("i"), same("i"), "left")
        .selectExpr(
            "d.doc_id",
            "d.n_words",
            "coalesce(h.n_hit, 0L) as n_hit",
            "cast(coalesce(size(i.item_ids), 0) as bigint) as n_items",
            "sha2(coalesce(array_join(i.item_ids, ','), ''), 256) as items_sha256",
            "coalesce(h.n_hit, 0L) > 0 as contaminated",
        )
    )


def op3_decontamination(spark, sf_dir: str) -> DataFrame:
    return contaminated(
        spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    )


def keep_clean(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """The rows of ``docs`` that hold no window of an item, with all their columns; each row is judged on its own text."""
    key = F.struct(F.col(f"`{id_col}`").alias("id"), F.xxhash64(F.col(f"`{text_col}`").cast("string")).alias("k"))
    found = contaminated(docs.select(key.alias("key"), F.col(f"`{text_col}`").alias("text")), items, "key", "text", item_col, item_text_col)
    gone = found.where("contaminated").select(F.col("doc_id").alias("gone")).distinct()
    return docs.join(gone, key.eqNullSafe(F.col("gone")), "left_anti")
