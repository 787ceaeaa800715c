"""Ropes, and the fill-in-middle transformation against a plain version."""

from __future__ import annotations

import hashlib
import random
import re

import pytest
from tests.llm.fixtures import rows, table

from jobloom.llm.infill import LEAF_UNITS, Node, Source, arranged, build, check_sentinels, fill_in_middle, infill_digest, join, rearranged, restored, split, text_of

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def source(text: str) -> Source:
    return Source(text, [m.start() for m in UNIT.finditer(text)])


def plain(doc_id, text: str | None) -> tuple:
    text = text or ""
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    units = UNIT.findall(text)
    n = len(units)
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < 80:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


EXTRA = ["<P> here", "a<M>", "< P><S", "<S", ">>", "  lead", "trail \n", " x y", "a\x1cb\x1f c", "é" * 3000 + " 日本 " * 900, "😀 " * 700, "x " * 20_000]


def test_equals_the_plain_version(spark):
    data = rows() + [(5000 + i, t, None, None, None, None, None, None) for i, t in enumerate(EXTRA * 4)]
    docs = table(spark, data)
    got = {}
    for r in restored(fill_in_middle(docs)).collect():
        got.setdefault((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.restored), []).append(r)
    want = {}
    for d in data:
        want.setdefault((d[0], *plain(d[0], d[1]), d[1] or ""), []).append(d)
    assert {k: len(v) for k, v in got.items()} == {k: len(v) for k, v in want.items()}
    assert {k[2] for k in got} == {"plain", "spm", "psm"}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    digest = sorted(map(tuple, infill_digest(docs).collect()), key=repr)
    assert digest == sorted(((d[0], *(x := plain(d[0], d[1]))[:4], sha(x[4]), sha(d[1] or "")) for d in data), key=repr)


def test_empty_tables_string_ids_and_other_sentinels(spark):
    assert infill_digest(table(spark, []).limit(0)).collect() == []
    docs = spark.createDataFrame([(f"id{i}", f"w{i} x\ty ") for i in range(50)], "name string, body string")
    out = restored(fill_in_middle(docs, rate=100, spm_rate=50, sentinels=("[pre]", "[suf]", "[mid]"), id_col="name", text_col="body"), ("[pre]", "[suf]", "[mid]")).collect()
    assert {r.form for r in out} == {"spm", "psm"}
    assert all(r.restored == f"w{r.name[2:]} x\ty " and r.output.count("[mid]") == 1 for r in out)


@pytest.mark.parametrize("bad", [("<P>", "<P>", "<M>"), ("", "<S>", "<M>"), ("ab", "bc", "x"), ("aba", "c", "d"), ("abc", "b", "d")])
def test_sentinels_that_could_overlap_are_refused(bad):
    with pytest.raises(ValueError):
        check_sentinels(bad)


def depth(rope) -> int:
    return 1 + max(depth(rope.left), depth(rope.right)) if isinstance(rope, Node) else 0


def test_ropes_split_and_join_anywhere():
    rnd = random.Random(3)
    text = "".join(rnd.choice(["ab", " ", "é", "\n", "日本", "c "]) for _ in range(LEAF_UNITS * 40))
    units = UNIT.findall(text)
    rope = build(source(text))
    assert (rope.units, rope.points, text_of(rope)) == (len(units), len(text), text)
    for _ in range(300):
        k = rnd.randint(0, len(units))
        a, b = split(rope, k)
        assert text_of(a) == "".join(units[:k])
        assert text_of(b) == "".join(units[k:])
        c = rnd.randint(0, len(text))
        a, b = split(rope, c, by_units=False)
        assert (text_of(a), text_of(b)) == (text[:c], text[c:])
        assert text_of(join(a, b)) == text


def test_ropes_stay_shallow_however_often_they_are_cut():
    rnd = random.Random(4)
    text = "".join(chr(97 + rnd.randrange(26)) for _ in range(20_000))
    rope = build(Source(text, list(range(len(text)))))
    for _ in range(400):
        c = rnd.randint(0, len(text))
        a, b = split(rope, c, by_units=False)
        rope, text = join(b, a), text[c:] + text[:c]
        assert rope.points == len(text)
        assert depth(rope) <= 16
    assert text_of(rope) == text


def test_an_arrangement_touches_few_leaves():
    text = "word " * (LEAF_UNITS * 64)
    out, p, m = arranged(source(text), 10_000, 12_000, "psm", ("<P>", "<S>", "<M>"))
    assert (p, m) == (10_000 * 5 - 1, 2_000 * 5)
    assert depth(out) <= 10
    assert text_of(rearranged(source(text_of(out)), "psm", ("<P>", "<S>", "<M>"))) == text
