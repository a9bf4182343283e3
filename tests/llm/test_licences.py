import re

import pytest

from basketlens.llm import licences as x


@pytest.mark.parametrize(
    "text, rpn, allowed",
    [
        ("mit", "mit", True),
        ("mit or gpl-2.0", "mit gpl-2.0 or", True),
        ("mit and gpl-2.0", "mit gpl-2.0 and", False),
        ("gpl-2.0 or mit and isc", "gpl-2.0 mit isc and or", True),
        ("(gpl-2.0 or mit) and isc", "gpl-2.0 mit or isc and", True),
        ("gpl-2.0 with classpath-exception-2.0", "gpl-2.0 classpath-exception-2.0 with", True),
        ("gpl-2.0+ with other-exception or gpl-3.0", "gpl-2.0+ other-exception with gpl-3.0 or", False),
    ],
)
def test_shunting_yard(text, rpn, allowed):
    assert x.postfix(x.expression_tokens(text, 0)) == rpn.split()
    assert x.evaluate(rpn.split()) is allowed


def test_broken_expressions():
    assert x.postfix(["(", "mit"]) is None
    assert x.evaluate(["mit", "or"]) is None
    assert x.scan_text("SPDX-License-Identifier: OR OR")[6] == []
    assert x.scan_text("SPDX-License-Identifier: MIT OR (")[6:8] == (["mit"], True)
    assert x.scan_text("SPDX-License-Identifier: (MIT")[7] is None


@pytest.mark.parametrize(
    "tag, expressions, permissive",
    [
        ("to be decided", [], None),
        ("foo-bar and something", [], None),
        ("MIT and more on this line", ["mit"], True),
        ("GPL-2.0-only WITH MIT", ["gpl-2.0-only"], False),
        ("GPL-2.0-only WITH Classpath-exception-2.0 OR MIT", ["gpl-2.0-only with classpath-exception-2.0 or mit"], True),
        ("Classpath-exception-2.0", [], None),
        ("(MIT OR ISC) WITH LLVM-exception", [], None),
        ("LGPL-2.1+ or LicenseRef-own", ["lgpl-2.1+ or licenseref-own"], False),
        ("Apache-2.0. It may", ["apache-2.0"], True),
    ],
)
def test_only_known_names_count(tag, expressions, permissive):
    found = x.scan_text(f"SPDX-License-Identifier: {tag}\nMIT")
    assert found[6:8] == (expressions, permissive)
    assert (found[8] == 0) == (not expressions)


def test_permissive_and_lifting_names_are_known():
    assert x.PERMISSIVE <= x.LICENCES and x.LIFTING <= x.EXCEPTIONS and not x.LICENCES & x.EXCEPTIONS


TEXTS = [
    None, "", " \n ", "MIT License", "the mit-license, MIT LICENSE mit  license license", "General Public License" + " x" * 50_000 + " Apache\nLicense",
    "mİt license", "\u212aMIT license é", "mit license mit license", "lesser general public license", "// SPDX-License-Identifier: (MIT OR GPL-2.0-only) AND ISC */",
]


def slow(text):
    lower = "".join(c.lower() if c.isascii() else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    places = [(i, label) for phrase, label in x.BASE.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    at = [i for i, _ in places]
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({label for _, label in places}))


def test_scan(spark):
    docs = spark.createDataFrame([(i, t, 1.5) for i, t in enumerate(TEXTS)], "doc_id long, text string, score double")
    got = {r["doc_id"]: r for r in x.scan_licences(docs).collect()}
    for i, text in enumerate(TEXTS):
        r = got[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == slow(text), text
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1
    assert got[10]["labels"] == "gpl-2.0-only,isc,mit" and got[10]["permissive"] is True
    assert got[0]["labels"] == "" and got[0]["score"] == 0
    assert x.scan_licences(docs.limit(0)).count() == 0
