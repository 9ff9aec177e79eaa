"""Licence paragraphs against plain Python scoring, and accuracy on notices in words not trained on."""

import math

import pytest

from quern.llm import licences as L

TEXTS = [
    "Intro line.\nLicensed under the Apache License, Version 2.0.\nEnd.", "Released under the MIT License.", "All rights reserved.", "ALL RIGHTS RESERVED", None, "", "no cue here",
    "This work is licensed under the GNU General Public License, version 3.", "You may use it under the GNU Lesser General Public License, version 3 or later.", "Licensed under CC BY-NC 4.0.",
    "His driving license expired in May.", "See the licence agreement of the vendor.", "This text may be shared under CC BY-SA 4.0", "mit der Software\nlicense " * 3, "word license " * 20_000, "Released under the MIT License.",
]


@pytest.fixture(scope="module")
def classifier():
    return L.train()


@pytest.fixture(scope="module")
def rows(spark, classifier):
    df = spark.createDataFrame([(i, t, "f", 1) for i, t in enumerate(TEXTS)] + [(1, TEXTS[1], "f", 1), (None, TEXTS[2], "f", 1)], "doc_id long, text string, family string, row int").repartition(3)
    assert L.scan(df.limit(0), classifier).count() == 0
    return L.scan(df, classifier).collect()


def plain(line, c):
    z = list(c.bias)
    for g in L.grams_of(L.words_of(line)):
        if g in c.weights:
            z = [a + b for a, b in zip(z, c.weights[g])]
    top = max(z)
    return c.families[z.index(top)], 1 / sum(math.exp(v - top) for v in z)


def test_scores_equal_plain_python(rows, classifier):
    import re

    expected = {(i, k): plain(line, classifier) for i, t in enumerate(TEXTS) for k, line in enumerate(re.split(L.BREAK, t or "")) if re.search(L.CUE_PATTERN, line)}
    got = {(r.doc_id, r.paragraph): (r.family, r.probability) for r in rows if r.doc_id is not None}
    assert set(got) == set(expected)
    for k, (family, p) in expected.items():
        assert got[k][0] == family and abs(got[k][1] - p) < 1e-9
    assert sum(r.doc_id == 1 for r in rows) == 2 and sum(r.doc_id is None for r in rows) == 1


def test_families_and_unknown(rows):
    got = {(r.doc_id, r.paragraph): (r.family, r.confirmed) for r in rows}
    assert got[0, 1] == ("apache", True) and got[1, 0] == ("mit", True) and got[2, 0] == got[3, 0] == ("proprietary", True)
    assert got[7, 0] == ("gpl", True) and got[8, 0] == ("lgpl", True) and got[9, 0] == ("cc-by-nc", True) and got[12, 0] == ("cc-by-sa", True)
    assert got[10, 0] == got[11, 0] == ("unknown", False)


def test_plan_runs_no_python(spark, classifier):
    df = spark.createDataFrame([(1, "Released under the MIT License.")], "doc_id long, text string")
    plan = L.scan(df, classifier)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_notices_are_found_as_their_family_and_no_scanned_line_is_lost(spark, classifier):
    expected = [(n, f) for f, notices in L.NOTICES.items() for n in notices]
    expected += [("Released under MIT.", "mit"), ("Permission is hereby granted, free of charge, to any person obtaining a copy", "mit"), ("sublicense", "unknown")]
    expected += [("mit der Software", None), ("He installed the software.", None)]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(expected)], "doc_id long, text string")
    got = {r.doc_id: r.family for r in L.scan(df, classifier).collect()}
    assert [(t, got.get(i)) for i, (t, _) in enumerate(expected)] == expected


OTHER = ["ISC License", "zlib license", "SIL Open Font License", "Boost Software License", "European Union Public Licence", "Licensed under the Boost Software License, Version 1.0.", "Released under the ISC License.", "The Unlicense", "Zope Public License, version 2.1", "Microsoft Public License"]
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.
"""


def test_licences_of_other_families_are_unknown(spark, classifier):
    df = spark.createDataFrame(list(enumerate(OTHER)), "doc_id long, text string")
    got = {r.doc_id: (r.family, r.confirmed) for r in L.scan(df, classifier).collect()}
    assert got == {i: ("unknown", False) for i in range(len(OTHER))}


def test_wrapped_notices_are_one_paragraph(spark, classifier):
    gpl = "This program is free software: you can redistribute it and/or modify it\r\nunder the terms of the GNU General Public License as published by\r\nthe Free Software Foundation.\r\nAnother line.\r\n"
    df = spark.createDataFrame([(1, "A story.\n\n" + MIT), (2, gpl)], "doc_id long, text string")
    got = {(r.doc_id, r.paragraph): (r.family, r.confirmed) for r in L.scan(df, classifier).collect()}
    assert got == {(1, 1): ("mit", True), (1, 2): ("mit", True), (2, 0): ("gpl", True)}


def test_training_texts_are_told_apart_and_calibrated_on_others(classifier):
    rows = L.training_rows()
    assert len(rows) == len({t for t, _ in rows}) and sum(plain(t, classifier)[0] == f for t, f in rows) / len(rows) > 0.99
    # a held-out name of each family in a sentence that no training text has
    assert all(plain(f"You may copy the text as the {names[0]} allows.", classifier)[0] == f for f, names in L.NAMES.items() if f != "proprietary")
