import re
import zlib
from collections import Counter

import numpy as np

CASES = [
    (1, None), (2, ""), (3, "a"), (4, "x y\n\nx y\nx y"), (5, "é" * 5000), (6, "one two three four five six seven eight " * 40),
    (7, "Ünï #cödé | <b> & % $ *\n \nline\nline\t\n"), (8, " ".join(f"w{i}" for i in range(3000))), (8, "a"), (None, "b  c\r\n"),
]


def table(spark):
    return spark.createDataFrame([(d, t, "clash") for d, t in CASES], "doc_id long, text string, n_words string")


def test_repetition_against_brute_force(spark):
    from flowsight.llm.quality import repetition

    want = []
    for doc, text in CASES:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        grams = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
        hit = {i + j for i in range(len(words) - 7) if grams[tuple(words[i : i + 8])] > 1 for j in range(8)}
        seen, dup = set(), 0
        for line in text.split("\n"):
            if re.search(r"[^\x20\x09-\x0D]", line):
                dup += line in seen
                seen.add(line)
        failed = len(words) < 20 or 100 * len(hit) > 30 * len(words)
        want.append((doc, len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit), failed))
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    rows = [tuple(r[n] for n in names) for r in repetition(table(spark)).collect()]
    key = lambda r: str(r)
    assert sorted(rows, key=key) == sorted(want, key=key)
    assert repetition(table(spark).limit(0)).count() == 0


def _check_packing(spark, rows, cases):
    """Every id of every text stands in one piece, pieces lie gapless, and what is not full is a power of two."""
    from tokenizers import Tokenizer

    from flowsight.llm.vocabulary import default_path

    tokenizer = Tokenizer.from_file(default_path())
    left = Counter()
    pieces = {}
    for r in rows:
        pieces.setdefault((r.doc_id, r.doc_tokens), {}).setdefault(r.start, []).append((r.length, r.ids_crc32))
    for doc, text in cases:
        ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        at, mine = 0, pieces[doc, len(ids)]
        while at < len(ids):
            fits = [p for p in mine[at] if zlib.crc32(ids[at : at + p[0]].tobytes()) == p[1]]
            mine[at].remove(fits[0])
            at += fits[0][0]
        assert at == len(ids)
    assert not any(p for starts in pieces.values() for p in starts.values())
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        left[at] += 1
        assert at <= 1024 and at & (at - 1) == 0
    return left


def test_packing_round_trip(spark):
    from flowsight.llm.packing import pack

    _check_packing(spark, pack(table(spark)).collect(), CASES)
    one = _check_packing(spark, pack(table(spark).coalesce(1)).collect(), CASES)
    assert all(n == 1 for size, n in one.items() if size < 1024)
    assert pack(table(spark).limit(0)).count() == 0


def test_packing_with_few_open_windows():
    import random

    from flowsight.llm.packing import Piece, _fill, powers, settle

    rng = random.Random(3)
    for _ in range(200):
        sizes = [rng.randrange(1, 1024) for _ in range(rng.randrange(12))]
        windows = [[Piece(i, n, 0, np.arange(n, dtype=np.uint32) + 10_000 * i)] for i, n in enumerate(sizes)]
        whole = sorted(x for w in windows for p in w for x in p.ids.tolist())
        full, left = settle(windows)
        assert all(_fill(w) == 1024 for w in full) and _fill(left) < 1024
        assert len(full) == sum(sizes) // 1024
        dealt = full + list(powers(left))
        assert sorted(x for w in dealt for p in w for x in p.ids.tolist()) == whole
        assert all(p.ids[0] == 10_000 * p.doc_id + p.start for w in dealt for p in w)


def test_levels_keep_the_least_sum_of_squares():
    import random

    from flowsight.llm.packing import Levels

    window, rng = 12, random.Random(5)
    levels, counts = Levels(window), [0] * window
    fills = {}
    for _ in range(2_000):
        size = rng.randrange(1, window + 1)
        costs = []
        for level in [x for x in range(1, window) if counts[x] and x + size <= window] + [0]:
            after = counts.copy()
            if level:
                after[level] -= 1
            if level + size < window:
                after[level + size] += 1
            costs.append((sum(x * x for x in after), level == 0, level, after))
        _, _, level, counts = min(costs)
        sequence, offset = levels.place(size)
        assert offset == level == fills.get(sequence, 0)
        fills[sequence] = offset + size
        assert levels.counts[:window].tolist() == counts


def test_units_are_encoded_as_whole_texts(monkeypatch):
    import random

    from tokenizers import Tokenizer

    from flowsight.llm import text as T
    from flowsight.llm import vocabulary

    monkeypatch.setattr(vocabulary, "UNITS", 300)
    monkeypatch.setattr(vocabulary, "JOINED", 4)
    rng = random.Random(11)
    parts = ["a", "word", "'ll", "don't", "é", "naïve", "12", "3.5", "...", "\u2014", "\u3000", "\u00a0", "\x1c", "\t", "\r"]
    parts += ["\n", "\n\n", " ", "  ", " x", " yy", "<|endoftext|>", "😀", "\u0301", "中文"] + [f" w{i}" for i in range(400)]
    texts = ["".join(rng.choices(parts, k=rng.randrange(40))) for _ in range(1_500)]
    texts += [" ".join(rng.choices(parts[:12], k=30)) for _ in range(300)]
    import pyarrow as pa

    for plain in (False, True):
        model = Tokenizer.from_file(vocabulary.default_path())
        model.encode_special_tokens = plain
        units = vocabulary.UnitEncoder(vocabulary.default_path(), plain)
        for at, to, slab in T.slabs(pa.array(texts), 4_000):
            ids, first = units.encode(slab.data, slab.offsets)
            for i in range(at, to):
                want = model.encode(texts[i], add_special_tokens=False).ids
                assert ids[first[i - at] : first[i - at + 1]].tolist() == want


def test_keep_good_keeps_columns(spark):
    from flowsight.llm.quality import keep_good

    out = keep_good(table(spark))
    assert out.columns == ["doc_id", "text", "n_words"]
    assert [(r.doc_id, len(r.text)) for r in out.collect()] == [(8, len(CASES[7][1]))]


def test_known_units_take_few_bytes():
    import tracemalloc

    import pyarrow as pa

    from flowsight.llm import text as T
    from flowsight.llm import vocabulary

    def learn(some):
        for _, _, slab in T.slabs(pa.array([" ".join(words[i : i + 2_000]) for i in range(0, some, 2_000)]), 50_000):
            units.encode(slab.data, slab.offsets)

    words = [f"w{i * 7_919 % 100_003}" for i in range(40_000)]
    units = vocabulary.UnitEncoder(vocabulary.default_path())
    learn(8_000)
    units._forget()
    tracemalloc.start()
    try:
        learn(40_000)
        held, _ = tracemalloc.get_traced_memory()
    finally:
        tracemalloc.stop()
    # a dict of int objects took some 180 bytes a unit, and Python workers of the pipeline went over their memory
    assert len(units.slot) >= 40_000 and held < 110 * 40_000
    known = units.hashes[units.slot]
    assert (known[1:] > known[:-1]).all() and (units.known == known).all()


def test_packing_encodes_small_slabs(monkeypatch):
    import pyarrow as pa

    from flowsight.llm import packing
    from flowsight.llm import text as T

    seen = []
    monkeypatch.setattr(packing, "unit_encoder", lambda path: type("E", (), {"encode": lambda self, data, offsets: (seen.append(len(data)), (np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)))[1]})())

    class Rows:
        def mapInArrow(self, run, schema):
            monkeypatch.setattr("pyspark.TaskContext.get", lambda: type("C", (), {"partitionId": lambda self: 0})())
            batch = pa.RecordBatch.from_arrays([pa.array(range(300)), pa.array(["x" * 10_000] * 300)], ["doc_id", "text"])
            return sum(b.num_rows for b in run(iter([batch])))

    monkeypatch.setattr(T, "id_and_text", lambda *_: Rows())
    # one end id for each text, and powers of two split none of them
    assert packing.pack(None, path="none") == 300
    assert sum(seen) == 3_000_000 and max(seen) <= 400_000
