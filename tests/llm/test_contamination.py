import hashlib
import re
from collections import Counter

W = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return W.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def test_against_brute_force(spark):
    from flowsight.llm.contamination import contaminated

    long = " ".join(f"w{i}" for i in range(40))
    items = [(1, long), (2, long), (3, "Ärger Ab"), (4, None), (5, ""), (10, "a a a a a a a a a a a a"), (11, "lone")]
    docs = [
        (1, None), (2, ""), (3, "W3, w4 w5 w6 w7 w8 w9 w10 w11 W12! tail"), (4, "w3 w4 w5 w6 w7 w8 w9 w10 w11 x"),
        (5, "a " * 30), (6, "Ärger ab ärger AB lone"), (None, "lone"), (None, "b"), (7, long + " x " + long), (7, long + " x " + long),
        (8, "q " + " ".join(f"w{i}" for i in range(9, 26)) + " z"),
    ]
    want = Counter()
    for doc, text in docs:
        d, hit, held = words(text), set(), set()
        for item, body in items:
            q = words(body)
            spans = {tuple(q[i : i + 10]) for i in range(max(1, len(q) - 9))} if q else set()
            for i in range(len(d)):
                for span in spans:
                    if tuple(d[i : i + len(span)]) == span:
                        hit |= set(range(i, i + len(span)))
                        held.add(str(item))
        digest = hashlib.sha256(",".join(sorted(held)).encode()).hexdigest()
        want[doc, len(d), len(hit), len(held), digest, bool(hit)] += 1
    d = spark.createDataFrame([(*x, 0) for x in docs], "doc_id long, text string, words int")
    i = spark.createDataFrame(items, "item_id long, text string")
    assert Counter(map(tuple, contaminated(d, i).collect())) == want
    assert contaminated(d.limit(0), i).count() == 0
    assert {r.n_hit for r in contaminated(d, i.limit(0)).collect()} == {0}


def test_texts_are_not_matched_word_by_word(spark):
    from flowsight.llm.contamination import contaminated

    texts = [None, "", " \t", "one", "ÄB-cd_9\x7fÉ", "\x00a\x00", "a b c d e f g h i", "x" * 300 + "\n" + "Y" * 300, "\U0001f600 end."]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    items = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(12)))], "item_id long, text string")
    found = contaminated(docs, items)
    # a search with a negated class took more time than all the rest
    assert "regexp_extract_all" not in found._jdf.queryExecution().optimizedPlan().toString().lower()
    assert {r.doc_id: r.n_words for r in found.collect()} == {i: len(words(t)) for i, t in enumerate(texts)}


def test_texts_at_the_edge_of_a_window(spark):
    from flowsight.llm.contamination import contaminated

    long = [f"w{i}" for i in range(14)]
    docs = spark.createDataFrame([(n, " ".join(long[:n])) for n in range(4, 15)], "doc_id long, text string")
    items = spark.createDataFrame([(1, " ".join(long))], "item_id long, text string")
    assert {r.doc_id: r.n_hit for r in contaminated(docs, items).collect()} == {n: n if n >= 10 else 0 for n in range(4, 15)}
