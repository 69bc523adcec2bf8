import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
from tests.llm.test_rows import CASES

from flowsight.llm import resampling as R

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
MORE = [(100 + i, f"Alpha beta{i % 7} GAMMA, delta.epsilon\tzeta " * (i % 9 + 1)) for i in range(60)]
ITEMS = [("alpha beta3 gamma delta",), (None,), ("Größe x, x",), ("",)]


def features(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(text)
    return len(words), [" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def brute(rows, items, percent):
    bucket = lambda f: zlib.crc32(f.encode()) % 10000
    cut = [(d, *features(t)) for d, t in rows]
    s = Counter(bucket(f) for _, _, fs in cut for f in fs)
    t = Counter(bucket(f) for (x,) in items for f in features(x)[1])
    s_all, t_all = sum(s.values()) + 10000, sum(t.values()) + 10000
    out = []
    for d, n, fs in cut:
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * s_all / ((s[b] + 1) * t_all))) for b in map(bucket, fs))
        h = int(hashlib.sha256(f"42:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        out.append([d, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None, n])
    able = sorted((r for r in out if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for place, r in enumerate(able[: percent * len(able) // 100]):
        r[4] = place + 1
    return sorted((tuple(r[:5]) for r in out), key=str)


def test_against_brute_force(spark):
    rows = CASES + MORE + MORE[:5]
    docs = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, text string, score string, row int")
    items = spark.createDataFrame(ITEMS, "text string")
    for percent in (5, 40, 100):
        got = R.resample(docs.repartition(3), items, percent=percent)
        assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
        assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows, ITEMS, percent)
    assert R.resample(docs.limit(0), items).count() == 0
    assert R.resample(docs, items.limit(0), percent=40).count() == len(rows)


def test_pieces_change_nothing():
    text = "One two,three\nFOUR " * 300 + "é" * 90 + " tail" + "x" * 70
    whole = R.text_buckets(text.encode(), 10000, 3)
    for limit in (1, 7, 64):
        n, found = R.text_buckets(text.encode(), 10000, 3, limit)
        assert n == whole[0] and sorted(found) == sorted(whole[1])
    assert R.text_buckets(b"", 10000, 3)[0] == 0


def test_windows_point_into_the_text(spark):
    text = "Die  Größe, X9\nende"
    docs = spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")
    rows = R.feature_windows(docs).collect()
    words = ["die", "größe", "x9", "ende"]
    assert Counter(r.n for r in rows) == {1: 4, 2: 3, 3: 2}
    for r in rows:
        inside = WORD.findall(text[r.start : r.end].lower())
        assert len(inside) == r.n and " ".join(words).count(" ".join(inside)) == 1
        assert r.bucket == zlib.crc32(" ".join(inside).encode()) % 10000


def test_gains_round_down():
    gains = R.bucket_gains(np.array([0, 9, 1]), np.array([4, 0, 0]))
    assert gains.tolist() == [math.floor(1000 * math.log(x * 13 / 7)) for x in (5, 0.1, 0.5)]
