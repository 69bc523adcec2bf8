import random
import re

import pytest


def brute(rows):
    """Later lines alike to an earlier one, whatever their number of words; lines without a word stay."""
    seen, out = [], {}
    for doc, text in sorted(rows):
        kept = []
        for line in text.split("\n"):
            words = frozenset(re.findall(r"[^\x20\x09-\x0D]+", line))
            if not any(5 * len(words & s) >= 4 * len(words | s) for s in seen):
                kept.append(line)
            if words:
                seen.append(words)
        out[doc] = "\n".join(kept)
    return out


def rows():
    r = random.Random(8)
    words = [f"w{i}" for i in range(9)]
    out = [(1, "All rights reserved."), (2, "x\n\nAll rights reserved.\n\n"), (3, "a b c d\na b c d e\na b c"), (4, "a b c d e\nc b a")]
    out += [(5, "字" * 400 + "\n" + "a " * 900), (6, "字" * 400 + "\na"), (7, "a b c d f")]
    return out + [(10 + d, "\n".join(" ".join(r.choices(words, k=r.randrange(7))) for _ in range(5))) for d in range(40)]


@pytest.mark.parametrize("limit", [20_000, 5])
def test_short_lines_against_brute_force(spark, monkeypatch, tmp_path, limit):
    from flowsight.llm import lines

    monkeypatch.setattr(lines, "WORD_ROWS", limit)
    docs = spark.createDataFrame(rows(), "doc_id long, text string")
    want = brute(rows())
    got = {r.doc_id: r.text for r in lines.dedup_lines(docs, min_words=1).select("row.doc_id", "lines.text").collect()}
    assert got == want
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    gone = {r.doc_id: r.n_removed for r in lines.op10_line_dedup(spark, str(tmp_path)).collect()}
    assert (gone[1], gone[2], gone[3], gone[6]) == (0, 1, 1, 2)
