def test_paragraphs_without_licence_stem_and_wrapped_headers(spark):
    from flowsight.llm.licences import licence_paragraphs, scan_licences

    mpl = "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy was not given, see below."
    bsd = "Redistribution and use in source and binary forms, with or without\r\nmodification, are permitted provided that the conditions\r\nare met:"
    rows = [(1, "All rights reserved."), (2, "Distributed under GPLv3"), (3, "Creative Commons Attribution 4.0"), (4, mpl)]
    rows += [(5, bsd), (6, "subject to the terms of the Mozilla Public\n \nLicense, v. 2.0"), (7, "Xyzzy plugh.\nPlover"), (8, "Mit und."), (9, "Thin. By."), (None, mpl), (4, mpl)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = scan_licences(docs).collect()
    assert len(got) == len(rows)
    by_id = {r.doc_id: r for r in got}
    assert all(by_id[d].n_paragraphs == 1 for d in (1, 2, 3))
    assert (by_id[1].n_unknown, by_id[1].families) == (1, "")
    for d in (4, None):
        assert (by_id[d].n_paragraphs, by_id[d].n_unknown, by_id[d].families) == (1, 0, "mpl")
    assert (by_id[5].families, by_id[5].n_paragraphs, by_id[5].n_confirmed) == ("bsd", 1, 1)
    # a blank line ends the block
    assert by_id[6].n_paragraphs == 2
    # words of a name that are common elsewhere
    assert (by_id[8].families, by_id[9].families) == ("", "")
    assert by_id[7].n_paragraphs == 0
    found = licence_paragraphs(docs.where("doc_id = 5")).collect()
    assert [(r.line, r.paragraph) for r in found] == [(0, bsd.replace("\r\n", " "))]
