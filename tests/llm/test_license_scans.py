import re

import pytest

from boxrates.llm.license_scans import Unexpanded, evaluate, licenses, postfix, scan

PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
TEXTS = [
    None, "", "Released under the MIT License.", "mit, license mit-license MITlicense", "MIT LICENSE mit license",
    "the Apache License, Version 2.0", "GNU General\nPublic  License general public license", "mit licensé İMIT license",
    "SPDX-License-Identifier: MIT OR Apache-2.0", "# SPDX-License-Identifier: (GPL-2.0-only WITH x) AND\n",
    "CC BY-NC 4.0 and cc by", "word " * 100_000 + "mit license",
]


def brute(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
    places = [
        (i, label)
        for phrase, label in PHRASES.items()
        for parts in [phrase.split()]
        for i in range(len(words) - len(parts) + 1)
        if words[i : i + len(parts)] == parts
    ]
    starts = [i for i, _ in places]
    labels = ",".join(sorted({label for _, label in places}))
    return len(words), len(places), min(starts, default=None), max(starts, default=None), labels


def docs(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, n_words int, labels string")


def test_base_columns_equal_brute_force(spark):
    got = licenses(docs(spark, enumerate(TEXTS))).collect()
    assert {r.doc_id: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got} == {
        i: brute(t) for i, t in enumerate(TEXTS)
    }
    assert all(0 <= r.score <= 1 and set(r.base_labels.split(",")) - {""} <= set(r.labels.split(",")) for r in got)


def test_tags_and_notices():
    assert scan(TEXTS[8])["labels"] == "apache,mit"
    assert scan(TEXTS[8])["expressions"] == ["MIT OR Apache-2.0"]
    assert scan(TEXTS[9])["expressions"] == []
    assert scan(TEXTS[10])["labels"] == "cc-by,cc-by-nc"
    assert scan(TEXTS[8])["score"] > scan(TEXTS[2])["score"] > scan("none")["score"] == 0


@pytest.mark.parametrize(
    ("expression", "value"),
    [
        ("MIT", [["mit"]]),
        ("MIT OR Apache-2.0 AND BSD-3-Clause", [["apache-2.0", "bsd-3-clause"], ["mit"]]),
        ("(MIT OR Apache-2.0) AND ISC", [["apache-2.0", "isc"], ["isc", "mit"]]),
        ("GPL-2.0 WITH Classpath-exception-2.0 OR MIT", [["gpl-2.0 with classpath-exception-2.0"], ["mit"]]),
        ("mit and mit", [["mit"]]),
        ("", None), ("MIT OR", None), ("OR MIT", None), ("(MIT", None), ("MIT)", None), ("MIT ISC", None),
        ("(MIT OR ISC) WITH x", None), ("MIT ; ISC", None),
    ],
)
def test_expressions(expression, value):
    assert evaluate(expression) == value


def test_precedence():
    assert postfix("a or b and c with d") == ["a", "b", "c", "d", "with", "and", "or"]
    assert postfix("(a or b) and c") == ["a", "b", "or", "c", "and"]


def test_many_alternatives_stay_bounded():
    value = evaluate(" AND ".join(f"(a{i} OR b{i})" for i in range(40)))
    assert value is not None and len(value) <= 256
    assert all({f"a{i}" for i in range(40)} | {f"b{i}" for i in range(40)} >= set(choice) for choice in value)


@pytest.mark.parametrize(
    ("rest", "expression"),
    [
        ("MIT. Permission is hereby granted", "MIT"), ("MIT, see LICENSE", "MIT"), ("MIT Permission is", "MIT"),
        ('MIT OR Apache-2.0"', "MIT OR Apache-2.0"), ("(MIT AND ISC)) of", "(MIT AND ISC)"), ("MIT]", "MIT"),
        ("MIT */", "MIT"), ("MIT-->", "MIT"), ("GPL-2.0+; var a=1", "GPL-2.0+"), ("MIT\\n * x", "MIT"),
        ("MIT OR (ISC AND, x", "MIT"), ("(MIT OR ISC) WITH x", "(MIT OR ISC)"), ("MIT WITH x, y", "MIT WITH x"),
        ("MIT OR\nISC", None), ("MIT OR */", None), ("(MIT", None), ("\nMIT", None), ("", None), ("...", None), ("OR MIT", None),
    ],
)
def test_text_after_an_expression(rest, expression):
    got = scan(f"/* one SPDX-License-Identifier: {rest}")
    assert got["expressions"] == ([] if expression is None else [expression])
    assert (got["score"] > 0.9) == (expression is not None)


def test_tags_of_one_line():
    got = scan("a SPDX-License-Identifier: MIT b SPDX-License-Identifier: ISC, c license-expression: Zlib; d")
    assert got["expressions"] == ["MIT", "ISC", "Zlib"] and got["labels"] == "isc,mit,zlib"


def test_no_choice_is_lost_among_many_alternatives():
    [value] = evaluate(" AND ".join(f"(a{i} OR b{i} WITH x)" for i in range(40)) + " OR c")
    assert isinstance(value, Unexpanded) and len(value) == 81
    assert value.satisfied_by({f"a{i}" if i % 3 else f"b{i} with x" for i in range(40)})
    assert value.satisfied_by({"c"}) and not value.satisfied_by({f"a{i}" for i in range(39)})
    assert evaluate("(" + " AND ".join(f"(a{i} OR b{i})" for i in range(40)) + ") WITH x") is None


def test_empty_table_and_repeated_rows(spark):
    assert licenses(docs(spark, [])).count() == 0
    assert licenses(docs(spark, [(None, "mit license")] * 2)).filter("n_base = 1 and doc_id is null").count() == 2
