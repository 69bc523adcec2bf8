"""Personal data: base patterns, and names by a linear-chain conditional random field over word shapes.

The field has three labels (outside, first word, further word). A word's features are its shape, ending, length and, if
in the labelled table often enough, its lower-case form, together with those of both neighbours. It is trained by
gradient ascent on a small labelled table and decoded by Viterbi, step by step over all lines of a batch at once.

Null text is empty. Every row of the table gets one row of the result, judged alone, so nothing is shuffled. Spans count
code points, end exclusive. Base spans stay as they are; names are added as kind ``name``.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from flowsight.llm import text as T

KINDS = ["email", "ip", "card", "phone"]
LABELS = 3
# a name of the table stands in ten sentences and an opening of a frame in twelve: names are known by shape and place
MIN_SEEN = 12
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# a match can only begin where a run of digits does, which keeps long runs linear
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_TOKEN = re.compile(r"[^\W_]+(?:['’-][^\W_]+)*|[^\w\s]")
_CAPITAL = "[A-ZÀ-ÖØ-Þ]"
_STARTS = re.compile(_CAPITAL)
# two words with a capital side by side: without them a line holds no name, so it is not decoded
_PAIR = re.compile(rf"{_CAPITAL}[^\W_]*(?:['’-][^\W_]+)*[\s_]+{_CAPITAL}")
SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, n_name long, base_sha256 string, spans string"


def _emails(text: str) -> Iterator[tuple[int, int]]:
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        end = at + 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            last = end = m.end()
        else:
            last = at + 1
        at = text.find("@", end)


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    out = [("email", s, e) for s, e in _emails(text)]
    for m in _IP.finditer(text):
        # parts of more than three significant digits are above 255 without reading them as numbers
        parts = [p.lstrip("0") for p in m[0].split(".")]
        if all(len(p) < 4 and int(p or 0) <= 255 for p in parts):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        digits = "".join(_DIGIT.findall(m[0]))
        if 16 <= len(digits) <= 19 and _luhn(digits):
            out.append(("card", *m.span()))
    for m in _PHONE.finditer(text):
        if 8 <= len(_DIGIT.findall(m[0])) <= 15:
            out.append(("phone", *m.span()))
    return out


def labelled_table() -> list[tuple[list[str], list[int]]]:
    """A small table of sentences whose names are marked, from frames and names; plain sentences have none."""
    names = [
        "Anna Keller", "Maria Lopez", "John Miller", "Peter O'Neil", "Jean Dupont", "Laura Rossi", "Karl Weber",
        "Sofia García Ruiz", "Thomas Becker", "Emily Clark", "Paul Martin", "Lucie Moreau",
    ]
    frames = [
        "Please contact {} for details .", "My name is {} and I live here .", "Signed by {} on Monday .",
        "Mr. {} wrote this letter .", "Mrs. {} will call you back .", "Dear {} , thank you for the order .",
        "Patient {} was seen today .", "Kontakt : {} , Berlin .", "Mi nombre es {} .", "Je m' appelle {} .",
    ]
    plain = [
        "The report was on the table and the rain was over .", "In the end we were there .", "Das Haus und der Garten sind alt .",
        "Please contact the office for details .", "My name is not important here .", "La casa de la noche es grande .",
        "Le chat est dans la maison .", "Released under the MIT License .", "Licensed under the Apache License , Version 2.0 .",
        "Signed copies are on sale .", "Dear all , the meeting is over .", "Er ist in der Stadt . Sie war dort .",
        "Kontakt mit dem Wasser ist gut .", "Those that were here . Then the others came .", "The New Age of Iron began .",
        "Mr. and Mrs. are titles .", "Patient people wait .", "Shin , lysh and tion . Eriner thanea .",
    ]
    out = []
    for frame, name in product(frames, names):
        words, labels = [], []
        for word in frame.split():
            more = _TOKEN.findall(name) if word == "{}" else _TOKEN.findall(word)
            words += more
            labels += ([1] + [2] * (len(more) - 1)) if word == "{}" else [0] * len(more)
        out.append((words, labels))
    for line in plain:
        words = _TOKEN.findall(line)
        out += [(words, [0] * len(words))] * 4
    return out


def shape(word: str) -> str:
    kinds = "".join("X" if c.isupper() else "x" if c.isalpha() else "9" if c.isdigit() else c for c in word[:24])
    return re.sub(r"(.)\1+", r"\1", kinds)


def _features(word: str) -> list[str]:
    low = word.lower()
    return ["s=" + shape(word), "e=" + low[-2:], f"n={min(len(word), 8)}", "w=" + low]


class NameField:
    """Weights of the field: per feature and neighbour position, per pair of labels, and for the first label."""

    def __init__(self, table: list[tuple[list[str], list[int]]], rounds: int = 50, rate: float = 0.5, decay: float = 1e-3):
        seen = Counter(f for words, _ in table for w in words for f in _features(w))
        self.index = {f: i for i, (f, n) in enumerate(sorted(seen.items())) if n >= MIN_SEEN}
        self.index = {f: i for i, f in enumerate(self.index)}
        size = len(self.index) + 1
        self.weights, self.steps, self.begin = np.zeros((3, size, LABELS)), np.zeros((LABELS, LABELS)), np.zeros(LABELS)
        made = [([self._ids(w) for w in words], np.array(labels)) for words, labels in table if words]
        squares = [np.full_like(x, 1e-6) for x in (self.weights, self.steps, self.begin)]
        for _ in range(rounds):
            grads = [np.zeros_like(x) for x in (self.weights, self.steps, self.begin)]
            for ids, labels in made:
                self._gradient(ids, labels, *grads)
            for w, g, s in zip((self.weights, self.steps, self.begin), grads, squares, strict=True):
                g = g / len(made) - decay * w
                s += g * g
                w += rate * g / np.sqrt(s)

    def _ids(self, word: str) -> list[int]:
        return [self.index[f] for f in _features(word) if f in self.index]

    def _gradient(self, ids, labels, on_words, on_steps, on_begin) -> None:
        n = len(ids)
        scores = np.zeros((n, LABELS))
        around = [(t, p, ids[t + p - 1]) for t in range(n) for p in range(3) if 0 <= t + p - 1 < n]
        for t, p, at in around:
            scores[t] += self.weights[p, at].sum(0)
        ahead, back = np.zeros((n, LABELS)), np.zeros((n, LABELS))
        ahead[0] = self.begin + scores[0]
        for t in range(1, n):
            ahead[t] = scores[t] + np.logaddexp.reduce(ahead[t - 1][:, None] + self.steps, axis=0)
        for t in range(n - 2, -1, -1):
            back[t] = np.logaddexp.reduce(self.steps + (scores[t + 1] + back[t + 1])[None, :], axis=1)
        total = np.logaddexp.reduce(ahead[-1])
        miss = np.eye(LABELS)[labels] - np.exp(ahead + back - total)
        for t, p, at in around:
            on_words[p, at] += miss[t]
        on_begin += miss[0]
        for t in range(1, n):
            on_steps[labels[t - 1], labels[t]] += 1
            on_steps -= np.exp(ahead[t - 1][:, None] + self.steps + (scores[t] + back[t])[None, :] - total)

    def emissions(self, word: str) -> np.ndarray:
        """Scores a word gives to its next word's, its own and its previous word's labels.

        A word without a capital is never part of a name.
        """
        out = self.weights[:, self._ids(word)].sum(1)
        if not _STARTS.match(word):
            out[1, 1:] -= 1e6
        return out


def viterbi(scores: np.ndarray, first: np.ndarray, sizes: np.ndarray, field: NameField) -> np.ndarray:
    """Best labels of many lines at once; line ``i`` holds words ``first[i]`` to ``first[i] + sizes[i]``."""
    labels = np.zeros(len(scores), np.int8)
    order = np.argsort(-sizes, kind="stable")
    first, sizes = first[order], sizes[order]
    if not len(sizes) or not sizes[0]:
        return labels
    live = np.searchsorted(-sizes, -np.arange(sizes[0]), "left")
    best = field.begin + scores[first[: live[0]]]
    came = np.zeros((len(scores), LABELS), np.int8)
    for t in range(1, sizes[0]):
        n = live[t]
        paths = best[:n, :, None] + field.steps
        came[first[:n] + t] = paths.argmax(1)
        best[:n] = paths.max(1) + scores[first[:n] + t]
    now = best.argmax(1).astype(np.int8)
    for t in range(sizes[0] - 1, -1, -1):
        n = live[t]
        labels[first[:n] + t] = now[:n]
        now[:n] = came[first[:n] + t, now[:n]]
    return labels


class Finder:
    """Names in texts; a word's scores are computed once and remembered until the memory is full."""

    def __init__(self, field: NameField, most: int = 200_000):
        self.field, self.most, self.known = field, most, {}
        self.table = np.zeros((0, 3, LABELS))

    def names(self, texts: list[str]) -> list[list[tuple[str, int, int]]]:
        if len(self.known) > self.most:
            self.known, self.table = {}, np.zeros((0, 3, LABELS))
        new: list[np.ndarray] = []
        words, spots, owner, sizes = [], [], [], []
        for number, text in enumerate(texts):
            base = 0
            for line in text.split("\n"):
                n = len(words)
                for m in _TOKEN.finditer(line) if _PAIR.search(line) else ():
                    word = m[0]
                    if (at := self.known.get(word)) is None:
                        at = self.known[word] = len(self.known)
                        new.append(self.field.emissions(word))
                    words.append(at)
                    spots.append((base + m.start(), base + m.end()))
                if len(words) > n:
                    owner.append(number)
                    sizes.append(len(words) - n)
                base += len(line) + 1
        out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
        if not words:
            return out
        each = self.table = np.concatenate([self.table, np.array(new)]) if new else self.table
        length = np.array(sizes)
        at, first = np.array(words), np.cumsum(length) - length
        scores = each[at, 1]
        inner = np.ones(len(at), bool)
        inner[first] = False
        after = np.flatnonzero(inner)
        scores[after] += each[at[after - 1], 0]
        scores[after - 1] += each[at[after], 2]
        labels = viterbi(scores, first, length, self.field)
        line_of = np.repeat(np.arange(len(length)), length)
        for i in np.flatnonzero(labels == 1).tolist():
            j = i + 1
            while j < len(labels) and labels[j] == 2 and line_of[j] == line_of[i]:
                j += 1
            # a single word is too weak a sign of a person
            if j - i > 1:
                out[owner[line_of[i]]].append(("name", spots[i][0], spots[j - 1][1]))
        return out


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", table=None) -> DataFrame:
    """One row per row of ``docs``; ``table`` holds the labelled sentences as (words, labels)."""
    field = NameField(table or labelled_table())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder, names = Finder(field), [c.split()[0] for c in SCHEMA.split(", ")]
        for batch in batches:
            ids = batch.column(0)
            for at, to, _ in T.slabs(batch.column(1), T.SLAB_BYTES // 4):
                texts = [x or "" for x in batch.column(1).slice(at, to - at).to_pylist()]
                rows = []
                for text, more in zip(texts, finder.names(texts), strict=True):
                    base = base_spans(text)
                    counts = Counter(k for k, _, _ in base)
                    marks = [f"{k}:{s}:{e}" for k, s, e in base]
                    digest = hashlib.sha256(",".join(marks).encode()).hexdigest()
                    marks += [f"{k}:{s}:{e}" for k, s, e in more]
                    rows.append((*(counts[k] for k in KINDS), len(more), digest, ",".join(marks)))
                columns = [pa.array(c) for c in zip(*rows, strict=True)]
                yield pa.RecordBatch.from_arrays([ids.slice(at, to - at), *columns], names)

    return T.id_and_text(docs, id_col, text_col).mapInArrow(run, SCHEMA)


def op1_personal_data(spark, sf_dir: str) -> DataFrame:
    return personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet"))
