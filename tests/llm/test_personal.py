import hashlib
import random
import re
from itertools import product

import numpy as np

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute(text):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    luhn = lambda d: sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(d[::-1])) % 10 == 0
    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(text) if 16 <= len(digits(m)) <= 19 and luhn(digits(m))]
    return out + [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= len(digits(m)) <= 15]


def test_base_against_patterns():
    from flowsight.llm.personal import base_spans

    r = random.Random(1)
    fixed = ["a@b.c@d.e", "@@a@b", "x@y.z.@q.r", "1.2.3.4.5.6.7.8", "256.1.1.1 010.0.0.0001", "4111 1111-1111 1111", "ä+49 (30) 123-45"]
    some = ["".join(r.choice("a1.@+- (4") for _ in range(r.randrange(60))) for _ in range(3000)]
    for text in fixed + some:
        assert base_spans(text) == brute(text), text


def test_viterbi_against_all_paths():
    from flowsight.llm.personal import NameField, viterbi

    field = NameField([(["a"], [0])], rounds=0)
    g = np.random.default_rng(0)
    field.begin, field.steps = g.normal(size=3), g.normal(size=(3, 3))
    sizes = np.array([4, 1, 6, 3])
    first, scores = np.cumsum(sizes) - sizes, g.normal(size=(14, 3))
    got = viterbi(scores, first, sizes, field)
    for f, n in zip(first, sizes, strict=True):
        value = lambda p: field.begin[p[0]] + sum(scores[f + t, x] for t, x in enumerate(p)) + sum(field.steps[a, b] for a, b in zip(p, p[1:]))  # noqa: B023, E731, E501
        assert tuple(got[f : f + n]) == max(product(range(3), repeat=int(n)), key=value)


def test_held_out_names():
    from flowsight.llm.personal import Finder, NameField, labelled_table

    finder = Finder(NameField(labelled_table()))
    people = ["Robert Schneider", "Clara Jensen", "Diego Fernández", "Nina Petrov"]
    frames = ["Please contact {} today.", "Signed by {} in June.", "Mr. {} was there.", "Dear {}, thank you."]
    texts = [f.format(p) for f in frames for p in people]
    found = finder.names(texts)
    hits = sum([t[s:e] for _, s, e in got] == [p] for t, got, p in zip(texts, found, people * 4, strict=True))
    assert hits >= 14
    plain = ["The and attion to thanedble the, anea. Eriner thanea.", "Das Haus ist alt. Der Garten auch.", "Released under the MIT License."]
    assert finder.names(plain) == [[], [], []]


def test_rows(spark):
    from flowsight.llm.personal import personal_data

    cases = [(1, None), (2, ""), (3, "ä a@b.cc 10.0.0.1 4111 1111 1111 1111 +49 30 1234567"), (None, "x"), (5, "9" * 50_000), (5, "w" * 90_000)]
    docs = spark.createDataFrame([(*c, 1) for c in cases] * 2, "doc_id long, text string, spans int")
    rows = personal_data(docs).collect()
    want = []
    for d, t in cases * 2:
        marks = ",".join(f"{k}:{s}:{e}" for k, s, e in brute(t or "") if len(t) < 1000) if len(t or "") < 1000 else ""
        want.append((d, hashlib.sha256(marks.encode()).hexdigest(), marks))
    assert sorted(((r.doc_id, r.base_sha256, r.spans) for r in rows), key=str) == sorted(want, key=str)
    assert personal_data(docs.limit(0)).count() == 0
