"""Licence scans: a sparse word n-gram logistic regression names the licence family of each paragraph.

A paragraph is a line that shares a word or pair of words with the model's table, or a sentence wrapped over several
lines of a block that names a family; the lines of such a sentence that name no family or the same are part of it. Blank lines end a block. The model is fitted on the driver on a small table of sentences (bounded by ``MAX_SENTENCES``); its weights are a table of
(n-gram, weight per family) with at most one row per n-gram of that table, so broadcasting it is bounded by the training
table and not by the corpus. Scoring is a join and a sum. The class "none" and a probability limit, set on held-out sentences so that none of
no family is accepted, make up the unknown class. A family is confirmed if most word pairs of one of its templates stand
in the paragraph.

Null and empty texts have no paragraphs. Every row of the table gives one row; rows of equal id and text get the same
answer.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import product

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowsight.session import scratch_folder

MAX_SENTENCES = 5_000
CONFIRM = 0.8
NONE = "none"
TEMPLATES = {
    "apache": ["licensed under the apache license version 2.0"],
    "bsd": ["redistribution and use in source and binary forms with or without modification are permitted", "under the bsd license"],
    "cc": ["licensed under cc by", "creative commons attribution license"],
    "gpl": ["licensed under the gnu general public license version"],
    "mit": ["under the mit license", "permission is hereby granted free of charge to any person obtaining a copy of this software"],
    "mpl": ["subject to the terms of the mozilla public license"],
}


def training_table() -> list[tuple[str, str]]:
    """(sentence, family) from frames and licence names, and sentences on licences of no family."""
    heads = ["released under the", "licensed under the", "this work is licensed under the", "distributed under the", "available under the"]
    names = {
        "apache": ["apache license version 2.0", "apache license 2.0", "apache software license"],
        "bsd": ["bsd license", "3 clause bsd license", "bsd 2 clause license"],
        "cc": ["cc by 4.0", "cc by nc 4.0", "cc by sa 3.0", "creative commons attribution license", "creative commons license"],
        "gpl": ["gnu general public license version 3", "gnu general public license", "gpl license", "gnu lesser general public license"],
        "mit": ["mit license", "expat mit license"],
        "mpl": ["mozilla public license version 2.0", "mozilla public license"],
    }
    rows = [(f"{h} {n}", family) for family, some in names.items() for h, n in product(heads, some)]
    rows += [(t, family) for family, some in TEMPLATES.items() for t in some] * 3
    things = ["driving", "fishing", "software", "music", "television"]
    plain = [
        "his {} license was revoked last year", "you need a {} licence for this", "the {} license costs ten euros",
        "all rights reserved {} copyright 2020", "copyright 2021 {} company", "permission to enter the {} hall was denied",
        "the {} warranty ends after two years", "released under the old {} license", "licensed under the {} contract version 2.0",
    ]
    # words of the names that are also words of other sentences or languages: alone they name no family
    single = ["mit", "by", "cc", "cc by", "apache", "gnu", "mozilla", "bsd", "creative", "general public", "version 2.0", "software"]
    common = ["{}", "{} und", "nicht {} und", "{} the river", "a word and {}"]
    rows += [(p.format(t), NONE) for p, t in product(common, single)]
    return rows + [(p.format(t), NONE) for p, t in product(plain, things)]


def _grams(words: str) -> str:
    """SQL for the distinct words and pairs of words of an array."""
    pairs = f"transform(sequence(1, greatest(1, size({words}) - 1)), i -> array_join(slice({words}, i, 2), ' '))"
    return f"array_distinct(concat({words}, {pairs}))"


def _words(text: str) -> str:
    # a full stop within a number belongs to its word
    return rf"regexp_extract_all(lower({text}), '[\\p{{L}}0-9]+(?:[.][0-9]+)*', 0)"


def _spread(sentence: str) -> set[str]:
    words = sentence.split()
    return set(words) | {" ".join(words[i : i + 2]) for i in range(len(words) - 1)}


class Model:
    """Softmax regression on n-gram counts over the root of their number; ``limit`` is the calibrated probability."""

    def __init__(self, table: list[tuple[str, str]], rounds: int = 400, decay: float = 1e-4):
        if len(table) > MAX_SENTENCES:
            raise ValueError(f"the labelled table is bounded by {MAX_SENTENCES} sentences")
        self.families = sorted({f for _, f in table} | {NONE})
        fit, held = [r for i, r in enumerate(table) if i % 4], table[::4]
        self._fit(fit, rounds, decay)
        scores = np.array([self.scores(s) for s, _ in held])
        truth = np.array([self.families.index(f) for _, f in held])
        # temperature by likelihood on the held-out sentences
        grid = np.geomspace(0.1, 10, 60)
        gain = [np.log(self.softmax(scores / t)[np.arange(len(held)), truth]).mean() for t in grid]
        self.temperature = float(grid[int(np.argmax(gain))])
        none = self.families.index(NONE)
        sure = self.softmax(scores / self.temperature)
        sure[:, none] = 0
        wrong = sure.argmax(1) != truth
        self.limit = float(max(0.5, sure.max(1)[wrong].max(initial=0.0)))
        self.held_out = float((np.where(sure.max(1) > self.limit, sure.argmax(1), none) == truth).mean())

    @staticmethod
    def softmax(x: np.ndarray) -> np.ndarray:
        e = np.exp(x - x.max(-1, keepdims=True))
        return e / e.sum(-1, keepdims=True)

    def _fit(self, rows: list[tuple[str, str]], rounds: int, decay: float) -> None:
        grams = [_spread(s) for s, _ in rows]
        self.index = {g: i for i, g in enumerate(sorted(set().union(*grams)))}
        x = np.zeros((len(rows), len(self.index)))
        for i, some in enumerate(grams):
            x[i, [self.index[g] for g in some]] = 1 / np.sqrt(len(some))
        y = np.eye(len(self.families))[[self.families.index(f) for _, f in rows]]
        self.weights, self.bias = np.zeros((x.shape[1], y.shape[1])), np.zeros(y.shape[1])
        for _ in range(rounds):
            miss = y - self.softmax(x @ self.weights + self.bias)
            self.weights += 10 * (x.T @ miss / len(rows) - decay * self.weights)
            self.bias += miss.mean(0)

    def scores(self, sentence: str) -> np.ndarray:
        some = _spread(sentence)
        known = [self.index[g] for g in some if g in self.index]
        return self.bias + self.weights[known].sum(0) / np.sqrt(max(1, len(some)))


@lru_cache(maxsize=1)
def default_model() -> Model:
    return Model(training_table())


def _units(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, k, row, line, last, paragraph: every line, and every sentence that is wrapped over lines ``line`` to ``last``."""
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    rows = rows.where("text is not null").selectExpr("doc_id", "xxhash64(text) as k", "text")
    rows = rows.withColumn("row", F.monotonically_increasing_id())
    # line numbers are written into the text, so that the pieces between full stops and blank lines tell theirs
    lines = "split(translate(text, '\x01\x02', '  '), '\n')"
    rows = rows.selectExpr("doc_id", "k", "row", f"{lines} as lines")
    number = "concat('\x01', i, '\x02', trim(TRAILING ' \t\r' FROM x))"
    cut = "(?<=[.!?:;][ \t\n])|(?<=\x02\n)|(?=\n\x01[0-9]{1,10}\x02(?:\n|$))"
    rows = rows.selectExpr(
        "*", f"split(array_join(transform(lines, (x, i) -> {number}), '\n'), '{cut}') as pieces"
    )
    wrapped = "filter(pieces, p -> p rlike '[^\x02\n]\n\x01[0-9]+\x02[^\n]')"
    marks = "transform(regexp_extract_all(p, '\x01([0-9]+)\x02', 1), m -> int(m))"
    first = f"element_at({marks}, 1) - if(startswith(p, '\x01'), 0, 1)"
    sentence = "trim(regexp_replace(p, '\n?\x01[0-9]+\x02', ' '))"
    each = f"transform({wrapped}, p -> struct({first} as line, element_at({marks}, -1) as last, {sentence} as paragraph))"
    alone = "transform(lines, (x, i) -> struct(i as line, i as last, x as paragraph))"
    return rows.selectExpr("doc_id", "k", "row", f"inline_outer(concat({alone}, {each}))")


def _families(docs: DataFrame, id_col: str, text_col: str, model: Model) -> DataFrame:
    """doc_id, k, line, last, family, probability, confirmed of every paragraph."""
    spark = docs.sparkSession
    units = _units(docs, id_col, text_col).withColumn("words", F.expr(_words("paragraph"))).where("size(words) > 0")
    grams = units.selectExpr("doc_id", "k", "row", "line", "last", f"{_grams('words')} as grams")
    each = grams.selectExpr("doc_id", "k", "row", "line", "last", "size(grams) as n", "explode_outer(grams) as gram")

    names = [f"f{i}" for i in range(len(model.families))]
    templates = [(family, t.split()) for family, some in TEMPLATES.items() for t in some]
    pairs = [{" ".join(words[i : i + 2]) for i in range(len(words) - 1)} for _, words in templates]
    marks = [f"t{i}" for i in range(len(pairs))]
    zero = [0.0] * len(names)
    known = [
        (g, *(model.weights[model.index[g]].tolist() if g in model.index else zero), *[int(g in p) for p in pairs])
        for g in sorted(set(model.index).union(*pairs))
    ]
    columns = ["gram string", *[f"{n} double" for n in names], *[f"{m} int" for m in marks]]
    table = F.broadcast(spark.createDataFrame(known, ", ".join(columns)))
    sums = [f"sum({n}) / sqrt(max(n)) + {float(b)!r}D as {n}" for n, b in zip(names, model.bias, strict=True)]
    # the words and pairs of a paragraph are distinct, so a sum of marks counts the pairs of the template in it
    hits = [f"sum({m}) as {m}" for m in marks]
    key = ["doc_id", "k", "line", "last"]
    scored = each.join(table, "gram").groupBy("row", *key).agg(*[F.expr(x) for x in sums + hits])
    scored = scored.selectExpr(*key, *names, *marks, f"greatest({', '.join(names)}) as most")
    scored = scored.selectExpr(*key, *marks, *[f"exp(({n} - most) / {model.temperature!r}D) as {n}" for n in names])
    scored = scored.selectExpr(*key, *marks, *names, f"{' + '.join(names)} as total")
    chances = [f"struct({n} as chance, '{f}' as family)" for n, f in zip(names, model.families, strict=True) if f != NONE]
    best = scored.selectExpr(*key, *marks, "total", f"array_max(array({', '.join(chances)})) as best")
    best = best.selectExpr(*key, *marks, "best.chance / total as probability", "best.family as family")
    best = best.withColumn("family", F.expr(f"if(probability > {model.limit!r}D, family, '{NONE}')"))
    match = " or ".join(
        f"family = '{family}' and {m} >= {CONFIRM * len(p)!r}D"
        for (family, _), m, p in zip(templates, marks, pairs, strict=True)
    )
    best = best.selectExpr(*key, "family", "probability", f"{match} as confirmed")
    # a wrapped sentence counts only if it names a family; written once, as it is read twice below
    folder = scratch_folder(spark)
    best.where(f"line = last or family <> '{NONE}'").dropDuplicates(key).write.parquet(f"{folder}/families")
    best = spark.read.parquet(f"{folder}/families")
    lines, wrapped = best.where("line = last"), best.where("line < last")
    same = "l.doc_id <=> w.doc_id and l.k = w.k and l.line between w.line and w.last"
    part = F.expr(f"{same} and l.family in ('{NONE}', w.family)")
    return lines.alias("l").join(wrapped.alias("w"), part, "left_anti").union(wrapped)


def licence_paragraphs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: Model | None = None) -> DataFrame:
    """One row per licence paragraph: doc_id, k, line, paragraph, family ("none" if unknown), probability, confirmed."""
    found = _families(docs, id_col, text_col, model or default_model())
    units = _units(docs, id_col, text_col).dropDuplicates(["doc_id", "k", "line", "last"])
    same = F.expr("u.doc_id <=> b.doc_id and u.k = b.k and u.line = b.line and u.last = b.last")
    found = units.alias("u").join(found.alias("b"), same)
    return found.select("b.doc_id", "b.k", "b.line", "u.paragraph", "b.family", "b.probability", "b.confirmed")


def scan_licences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: Model | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_paragraphs, n_unknown, n_confirmed and ``families``, comma-joined."""
    found = _families(docs, id_col, text_col, model or default_model()).groupBy("doc_id", "k").agg(
        F.count("*").alias("n_paragraphs"),
        F.count_if(F.col("family") == NONE).alias("n_unknown"),
        F.count_if("confirmed").alias("n_confirmed"),
        F.expr(f"array_join(sort_array(collect_set(nullif(family, '{NONE}'))), ',')").alias("families"),
    )
    rows = docs.select(
        F.col(f"`{id_col}`").alias("doc_id"), F.xxhash64(F.col(f"`{text_col}`").cast("string")).alias("k")
    )
    return (
        rows.alias("d")
        .join(found.alias("f"), F.expr("d.doc_id <=> f.doc_id and d.k = f.k"), "left")
        .selectExpr(
            "d.doc_id",
            *[f"coalesce(f.{c}, 0L) as {c}" for c in ("n_paragraphs", "n_unknown", "n_confirmed")],
            "coalesce(f.families, '') as families",
        )
    )


def op2_licences(spark, sf_dir: str) -> DataFrame:
    return scan_licences(spark.read.parquet(f"{sf_dir}/documents.parquet"))
