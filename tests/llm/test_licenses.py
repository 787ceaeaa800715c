from __future__ import annotations

import random
import re
from re import _constants as c
from re import _parser

import pytest

from jobloom.llm import licenses
from tests.llm.fixtures import rows, table

TEXTS = [
    "Released under the MIT License. mit-license; MIT\nLICENSE",
    "éGNU General Public License and gnu  general-public.license v3",
    "Licensed under the Apache License, Version 2.0.",
    "Licensed under CC BY-NC 4.0. CC-BY summit license",
    "SPDX-License-Identifier: MIT\nCopyright (c) 2020 Someone. All rights reserved.",
    "no license here, submit licenses",
]


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))


def brute(text):
    w, places = words(text), []
    for phrase, label in licenses.BASE_PHRASES:
        p = phrase.split()
        places += [(i, label) for i in range(len(w)) if w[i : i + len(p)] == p]
    places.sort()
    return len(w), len(places), places[0][0] if places else None, places[-1][0] if places else None, ",".join(sorted({x[1] for x in places}))


def test_base_columns_match_brute_force(spark):
    data = rows() + [(1000 + i, t, "en", "s", 1, 1, "x", "y") for i, t in enumerate(TEXTS)]
    got = licenses.license_digest(table(spark, data)).collect()
    have = sorted((str(r.doc_id), r.n_words, r.n_base, str(r.first_word), str(r.last_word), r.base_labels) for r in got)
    want = sorted((str(r[0]), b[0], b[1], str(b[2]), str(b[3]), b[4]) for r in data for b in [brute(r[1])])
    assert have == want
    assert all(0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) for r in got)
    assert licenses.license_digest(table(spark, [])).count() == 0


@pytest.mark.parametrize(
    ("text", "labels"),
    [
        (TEXTS[2], {"apache-2.0"}),
        (TEXTS[3].split(".")[0] + ".0.", {"cc-by-nc-4.0"}),
        ("This work is licensed under the GNU General Public License, version 3.", {"gpl-3.0"}),
        ("spdx-license-identifier: LGPL-2.1-or-later", {"lgpl-2.1"}),
        ("Permission is hereby granted, free of charge, to any person obtaining a copy", {"mit"}),
        ("2-clause BSD license", {"bsd-2-clause"}),
        ("nothing at all", set()),
    ],
)
def test_overlaps_are_resolved(text, labels):
    assert {d[2] for d in licenses.detect(text.lower())} == labels


def test_rules_are_many_and_gated():
    all_ = licenses.rules()
    assert len(all_) > 250
    for _, rs in licenses._gates():
        assert all(r.keyword for r in rs)
    for r in all_:  # a rule's keyword is in what the rule matches, or the gate would lose it
        assert r.keyword == r.keyword.lower()


def test_no_detection_lies_inside_a_better_one():
    found = licenses.detect(" ".join(TEXTS).lower())
    for a in found:
        assert not any(b is not a and b[0] <= a[0] and a[1] <= b[1] and b[3] >= a[3] for b in found)


def matching(tree, rnd, short):
    """A text that the parsed pattern matches, look-arounds aside."""
    out = []
    for op, arg in tree:
        if op is c.LITERAL:
            out.append(chr(arg))
        elif op is c.ANY:
            out.append("x")
        elif op is c.IN:
            kind, value = rnd.choice(arg)
            out.append(chr(value if kind is c.LITERAL else value[0]) if kind is not c.CATEGORY else "7")
        elif op is c.BRANCH:
            out.append(matching(rnd.choice(arg[1]), rnd, short))
        elif op is c.SUBPATTERN:
            out.append(matching(arg[-1], rnd, short))
        elif op in (c.MAX_REPEAT, c.MIN_REPEAT):
            least, most, inner = arg
            out += [matching(inner, rnd, short) for _ in range(least if short else rnd.randint(least, min(most, least + 2)))]
        elif op is c.CATEGORY:
            out.append("7")
        else:
            assert op in (c.ASSERT, c.ASSERT_NOT, c.AT), op
    return "".join(out)


def test_each_match_contains_its_keyword():
    rnd = random.Random(3)
    for r in licenses.rules():
        tree = _parser.parse(r.pattern.pattern)
        for k in range(40):
            text = matching(tree, rnd, k == 0)
            assert r.pattern.search(text), (r.pattern.pattern, text)
            assert r.keyword in text, (r.pattern.pattern, text)


@pytest.mark.parametrize(
    ("text", "labels"),
    [
        ("no part of this may be copied in any form without prior written permission", {"proprietary"}),
        ("it may not be copied without written permission", {"proprietary"}),
        ("it must not be distributed without prior permission", {"proprietary"}),
        ("licenced under terms of your choice", {"unknown-license"}),
        ("# Licensed under the Apache\n# License, Version\n#   2.0", {"apache-2.0"}),
        (" * Permission is hereby granted, free of\r\n * charge, to any  person\tobtaining a copy", {"mit"}),
        ("// licensed under the GNU General\n//\n// Public License, version 3.", {"gpl-3.0"}),
        ("<!-- neither the name of the firm nor\n     the names of its contributors may be used -->", {"bsd-3-clause"}),
    ],
)
def test_usual_wordings_and_wrapped_notices(text, labels):
    assert {d[2] for d in licenses.detect(text.lower())} == labels


def test_places_are_those_of_the_text_itself():
    notice = "Licensed under the\n *  Apache License,\n * Version 2.0"
    text = f"é \n\n\t /* {notice}; and  more\n\n of it: GPL-3.0\n"
    assert [text[s:e] for s, e, _, _ in licenses.detect(text.lower())] == [notice, "GPL-3.0"]
    assert licenses.folded("a  b\n# c") == ("a b c", [2, 4], [1, 3])
