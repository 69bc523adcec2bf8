import hashlib
from bisect import bisect_left
from collections import Counter, defaultdict

import numpy as np
from tests.llm.test_rows import CASES

from flowsight.llm import alignment as A

MORE = [
    (20, "The straße <|endoftext|> naïve  café\n\n\ttabs 日本語 🙂🙂 text"), (21, "under▁score"), (22, " <s> </s> <unk> <0x41> "),
    (23, "plain words again plain words"), (23, "plain words again plain words"), (24, " "), (25, "ångström 12345 \x00 \x7f end"),
]


def token_bytes():
    """Ids with their bytes, token by token."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a_path, b_path = A.default_paths()
    a, b = Tokenizer.from_file(a_path), SentencePieceProcessor(model_file=b_path)
    a.encode_special_tokens = True
    byte_of = A._byte_characters()

    def left(text):
        for token in a.encode(" " + text, add_special_tokens=False).ids:
            yield token, bytes(byte_of[c] for c in a.id_to_token(token))

    def right(text):
        for token in b.encode(text):
            p = b.id_to_piece(token)
            yield token, bytes([int(p[3:5], 16)]) if b.is_byte(token) else p.replace("▁", " ").encode()

    return left, right


def brute(rows):
    left, right = token_bytes()
    found, counts, out = [], Counter(), []
    for doc, text in rows:
        text = text or ""
        sides = [list(left(text)), list(right(text))] if text else [[], []]
        if any(b"".join(x for _, x in s) != (" " + text).encode() for s in sides):
            sides = [[], []]
        spans = []
        for side in sides:
            at, some = 0, []
            for token, raw in side:
                some.append((token, at, at + len(raw)))
                at += len(raw)
            spans.append(some)
        cuts = sorted({e for _, _, e in spans[0]} & {e for _, _, e in spans[1]})
        groups = [[[], []] for _ in cuts]
        for side in (0, 1):
            for token, _, e in spans[side]:
                groups[bisect_left(cuts, e)][side].append(token)
        over, i = [], 0
        for ta, sa, ea in spans[0]:
            while i and spans[1][i - 1][2] > sa:
                i -= 1
            while i < len(spans[1]) and spans[1][i][1] < ea:
                if spans[1][i][2] > sa:
                    over.append((ta, spans[1][i][0]))
                i += 1
        counts.update(over)
        found.append((doc, spans, groups, over))
    best = defaultdict(int)
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    for doc, spans, groups, over in found:
        text = ";".join("|".join(",".join(map(str, s)) for s in g) for g in groups)
        out.append((
            doc, len(spans[0]), len(spans[1]), len(groups), len(over), sum(len(x) * len(y) for x, y in groups),
            hashlib.sha256(text.encode()).hexdigest() if groups else "",
            sum(counts[x] == best[x[1]] for x in over), sum(counts[x] for x in over),
        ))
    return sorted(out, key=str)


def test_against_brute_force(spark, monkeypatch):
    rows = CASES + MORE
    docs = spark.createDataFrame([(*r, 7, "clash") for r in rows], "doc_id long, text string, n_a int, pairs string").repartition(3)
    want = brute(rows)
    assert sorted((tuple(r) for r in A.aligned_documents(docs).collect()), key=str) == want
    # texts one by one, and the pair table by shuffle
    monkeypatch.setattr(A, "at_most", lambda df, rows: False)
    assert sorted((tuple(r) for r in A.aligned_documents(docs).collect()), key=str) == want
    assert A.aligned_documents(docs.limit(0)).count() == 0


def test_links(spark):
    docs = spark.createDataFrame(MORE, "doc_id long, text string")
    sums = {r.doc_id: r for r in A.aligned_documents(docs).collect()}
    for kind, name in (("overlap", "n_links"), ("group", "n_group_links")):
        n = Counter(r.doc_id for r in A.links(docs, kind).collect())
        for doc, row in sums.items():
            assert n[doc] == row[name] * sum(d == doc for d, _ in MORE)
    weights = A.links(docs.where("doc_id = 20"), "overlap").agg({"weight": "sum"}).first()[0]
    assert weights == len((" " + MORE[0][1]).encode())


def test_product_against_dense():
    rng = np.random.default_rng(3)
    for _ in range(20):
        n, k, m = rng.integers(1, 12, 3)
        x, y = rng.integers(0, 2, (n, k)), rng.integers(0, 2, (k, m))
        sides = []
        for z in (x, y):
            at = np.nonzero(z)
            ptr = np.concatenate([[0], np.cumsum(z.sum(1))])
            sides.append(A.Csr(ptr, at[1], np.ones(len(at[1]), np.int64), z.shape[1]))
        for block in (1, 5, 10_000):
            got = np.zeros((n, m), int)
            for r, c, v in A.product_blocks(*sides, block):
                got[r, c] += v
            assert (got == x @ y).all()
        v = rng.integers(0, 9, k)
        assert (sides[0].times(v) == x @ v).all()
        t = sides[0].transpose()
        assert t.rows == k and (t.times(np.ones(n, int)) == x.sum(0)).all()
