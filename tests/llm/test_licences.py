def test_held_out_accuracy():
    from flowsight.llm.licences import default_model

    assert default_model().held_out >= 0.9


def test_scan(spark):
    from flowsight.llm.licences import default_model, licence_paragraphs, scan_licences

    texts = {
        1: (None, 0, ""), 2: ("", 0, ""), 3: ("Plain words.\n\nNothing here.", 0, ""),
        4: ("Some text.\nReleased under the MIT License.", 1, "mit"),
        5: ("Licensed under the Apache License, Version 2.0.\nThis work is licensed under the GNU General Public License, version 3.", 2, "apache,gpl"),
        6: ("x\nLicensed under CC BY-NC 4.0.", 1, "cc"), 7: ("He lost his driving license again.", 1, ""),
        8: ("Copyright " + "word " * 20_000, 1, ""),
        9: ("This file is subject to the terms of the Mozilla Public License, v. 2.0.", 1, "mpl"),
        10: ("LICENSE\n" * 3, 3, ""),
    }
    rows = [(d, t, 1) for d, (t, _, _) in texts.items()] + [(None, texts[4][0], 1), (5, texts[5][0], 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, k int")
    got = sorted(((r.doc_id, r.n_paragraphs, r.families) for r in scan_licences(docs).collect()), key=str)
    want = [(d, n, f) for d, (_, n, f) in texts.items()] + [(None, 1, "mit"), (5, 2, "apache,gpl")]
    assert got == sorted(want, key=str)
    assert scan_licences(docs.limit(0)).count() == 0
    # the joined sums are the model's own probabilities
    model = default_model()
    for r in licence_paragraphs(docs.where("doc_id in (4, 6, 7)")).collect():
        words = r.paragraph.lower().replace("-", " ").rstrip(".").replace(",", "")
        chance = model.softmax(model.scores(words) / model.temperature)
        chance[model.families.index("none")] = 0
        assert abs(chance.max() - r.probability) < 1e-9
    assert {r.confirmed for r in licence_paragraphs(docs.where("doc_id in (4, 5, 6)")).collect()} == {True}
