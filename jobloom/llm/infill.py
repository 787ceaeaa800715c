"""Fill-in-middle transformation over ropes.

A text is a rope: a balanced tree whose leaves are ranges of the text and
cache how many units and code points they hold.  A transformation splits the
tree at two unit ranks and concatenates the subtrees in another order with
sentinel leaves between; the inverse makes a rope of the output, splits it
before and behind each sentinel by code-point ranks, and concatenates what is
left in the old order.  Splitting and concatenation touch as many nodes as the
tree is deep, and no text is copied before the end.

A unit is a word with the white space before it, or white space at the end of
a text, white space being the space and the five ASCII controls.

Defined results: a null text counts as empty; an empty text, and one that
contains a sentinel, stays plain; very long texts are transformed whole;
repeated rows give repeated results; a null id counts as an empty one in the
draw; an empty table gives no rows; columns other than the id and the text are
not read, so clashing names do not matter.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from itertools import combinations_with_replacement
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from jobloom.llm._shared import IS_SPACE, freed, in_small_batches, slices, texts_of, words_of

#: Prefix, suffix and middle sentinel.
SENTINELS = ("<P>", "<S>", "<M>")
LEAF_UNITS = 256

# ---------------------------------------------------------------- ropes


class Source(NamedTuple):
    """A text and the code-point positions at which its units begin."""

    text: str
    starts: list[int]


class Leaf:
    """Code points ``a`` to ``b`` of a source; its units are those that begin there."""

    __slots__ = ("source", "a", "b", "first", "units", "points")
    height = 0

    def __init__(self, source: Source, a: int, b: int, first: int | None = None, units: int | None = None):
        self.source, self.a, self.b = source, a, b
        self.first = bisect_left(source.starts, a) if first is None else first
        self.units = bisect_left(source.starts, b) - self.first if units is None else units
        self.points = b - a

    def cut(self, rank: int, by_units: bool) -> tuple[Rope, Rope]:
        if by_units:
            at = self.source.starts[self.first + rank] if rank < self.units else self.b
        else:
            at = self.a + rank
        return (Leaf(self.source, self.a, at) if at > self.a else None, Leaf(self.source, at, self.b) if at < self.b else None)


class Node:
    __slots__ = ("left", "right", "units", "points", "height")

    def __init__(self, left: Leaf | Node, right: Leaf | Node):
        self.left, self.right = left, right
        self.units, self.points = left.units + right.units, left.points + right.points
        self.height = 1 + max(left.height, right.height)


Rope = Leaf | Node | None


def build(source: Source) -> Rope:
    """A balanced rope over a text, ``LEAF_UNITS`` units a leaf."""
    n, end = len(source.starts), len(source.text)
    level: list[Leaf | Node] = []
    for i in range(0, n, LEAF_UNITS):
        j = min(i + LEAF_UNITS, n)
        level.append(Leaf(source, source.starts[i], source.starts[j] if j < n else end, i, j - i))
    while len(level) > 1:
        level = [Node(level[i], level[i + 1]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0] if level else None


def _balanced(left: Leaf | Node, right: Leaf | Node) -> Node:
    """A node over two ropes whose heights differ by two at most, turned where needed."""
    if left.height > right.height + 1:
        if left.left.height >= left.right.height:
            return Node(left.left, Node(left.right, right))
        return Node(Node(left.left, left.right.left), Node(left.right.right, right))
    if right.height > left.height + 1:
        if right.right.height >= right.left.height:
            return Node(Node(left, right.left), right.right)
        return Node(Node(left, right.left.left), Node(right.left.right, right.right))
    return Node(left, right)


def join(left: Rope, right: Rope) -> Rope:
    """The concatenation of two ropes."""
    if left is None or right is None:
        return left or right
    if left.height > right.height + 1:
        return _balanced(left.left, join(left.right, right))
    if right.height > left.height + 1:
        return _balanced(join(left, right.left), right.right)
    return Node(left, right)


def split(rope: Rope, rank: int, by_units: bool = True) -> tuple[Rope, Rope]:
    """The first ``rank`` units, or code points, and the rest."""
    if rope is None:
        return None, None
    if isinstance(rope, Leaf):
        return rope.cut(rank, by_units)
    before = rope.left.units if by_units else rope.left.points
    if rank < before:
        a, b = split(rope.left, rank, by_units)
        return a, join(b, rope.right)
    if rank > before:
        a, b = split(rope.right, rank - before, by_units)
        return join(rope.left, a), b
    return rope.left, rope.right


def text_of(rope: Rope) -> str:
    out, todo = [], [rope] if rope is not None else []
    while todo:
        x = todo.pop()
        if isinstance(x, Node):
            todo += (x.right, x.left)
        else:
            out.append(x.source.text[x.a : x.b])
    return "".join(out)


def points_of(rope: Rope) -> int:
    return 0 if rope is None else rope.points


# ---------------------------------------------------------------- one text


def check_sentinels(sentinels: tuple[str, str, str]) -> None:
    """No sentinel may be found across a border: none ends with what another, or it itself, begins with."""
    if len(set(sentinels)) < 3 or not all(sentinels):
        raise ValueError("three different sentinels are needed")
    for x, y in combinations_with_replacement(sentinels, 2):
        for a, b in ((x, y), (y, x)):
            if (a != b and a in b) or any(a.endswith(b[:n]) for n in range(1, min(len(a), len(b)) + (a != b))):
                raise ValueError(f"sentinels {a!r} and {b!r} overlap")


def arranged(source: Source, first: int, second: int, form: str, sentinels: tuple[str, str, str]) -> tuple[Rope, int, int]:
    """(output, code points of the prefix, of the middle) of a text cut at two unit ranks."""
    mark = [Leaf(Source(s, []), 0, len(s)) for s in sentinels]
    head, suffix = split(build(source), second)
    prefix, middle = split(head, first)
    a, b = ((mark[0], prefix), (mark[1], suffix)) if form == "psm" else ((mark[1], suffix), (mark[0], prefix))
    out: Rope = None
    for part in (*a, *b, mark[2], middle):
        out = join(out, part)
    return out, points_of(prefix), points_of(middle)


def rearranged(source: Source, form: str, sentinels: tuple[str, str, str]) -> Rope:
    """The rope of the text that was transformed, from the output's."""
    order = (0, 1, 2) if form == "psm" else (1, 0, 2)
    rope, taken, parts = build(source), 0, {}
    at = [source.text.index(sentinels[k]) for k in order]
    for n, k in enumerate(order):
        _, rope = split(rope, at[n] + len(sentinels[k]) - taken, by_units=False)
        taken = at[n] + len(sentinels[k])
        upto = at[n + 1] if n < 2 else len(source.text)
        parts[k], rope = split(rope, upto - taken, by_units=False)
        taken = upto
    return join(join(parts[0], parts[2]), parts[1])


def unit_starts(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code-point positions at which units begin, offsets by text) of whole texts."""
    _, ends, doc = words_of(data, off)
    points = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    inner = ends < off[doc + 1]  # a unit begins behind each word, unless the text ends there
    some = np.flatnonzero(off[1:] > off[:-1])
    at, of = np.concatenate((off[some], ends[inner])), np.concatenate((some, doc[inner]))
    order = np.argsort(at, kind="stable")
    at, of = at[order], of[order]
    return points[at] - points[off[of]], np.concatenate(([0], np.cumsum(np.bincount(of, minlength=len(off) - 1))))


def _sources(texts: pa.Array) -> Iterator[tuple[int, Source]]:
    """(row, source) of each text, a megabyte of them at a time."""
    for i, j, data, off in slices(texts):
        starts, first = unit_starts(data, off)
        for r in range(i, j):
            yield r, Source(texts[r].as_py(), starts[first[r - i] : first[r - i + 1]].tolist())


# ---------------------------------------------------------------- tables


def fill_in_middle(docs: DataFrame, rate: int = 50, spm_rate: int = 80, seed: int = 42, sentinels: tuple[str, str, str] = SENTINELS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n, form, prefix_chars, middle_chars, output): ``rate`` per cent of the texts rearranged, of these ``spm_rate`` suffix first.

    The draws are four numbers from the hash of seed and id: two cuts, whether
    to rearrange, and which form.
    """
    check_sentinels(sentinels)
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    draws = [F.conv(F.substring("_h", 8 * k + 1, 8), 16, 10).cast("bigint").alias(f"h{k + 1}") for k in range(4)]
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), digest.alias("_h")).select("id", "text", *draws)
    schema = f"id {rows.schema['id'].dataType.simpleString()}, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in freed(batches):
            texts = texts_of(batch.column(1))
            h1, h2, h3, h4 = (batch.column(k).to_pylist() for k in (2, 3, 4, 5))
            out: list[tuple] = []
            held = done = 0
            for r, source in _sources(texts):
                n = len(source.starts)
                if not n or h3[r] % 100 >= rate or any(s in source.text for s in sentinels):
                    out.append((n, "plain", None, None, source.text))
                else:
                    form = "spm" if h4[r] % 100 < spm_rate else "psm"
                    cuts = sorted((h1[r] % (n + 1), h2[r] % (n + 1)))
                    rope, prefix, middle = arranged(source, *cuts, form, sentinels)
                    out.append((n, form, prefix, middle, text_of(rope)))
                held += len(source.text)
                if held > 4 << 20:
                    yield _batch(batch.column(0).slice(done, len(out)), out)
                    done, held, out = done + len(out), 0, []
            if out:
                yield _batch(batch.column(0).slice(done, len(out)), out)

    return in_small_batches(rows).mapInArrow(run, schema).withColumnRenamed("id", id_col)


def _batch(ids: pa.Array, out: list[tuple]) -> pa.RecordBatch:
    kinds = (("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string()))
    return pa.RecordBatch.from_arrays([ids, *(pa.array([x[k] for x in out], kind) for k, (_, kind) in enumerate(kinds))], ["id", *(name for name, _ in kinds)])


def restored(transformed: DataFrame, sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """``transformed`` (any columns, ``form`` and ``output``) with ``restored``, the text before, from these two alone."""
    check_sentinels(sentinels)
    names = transformed.columns
    form_at, output_at = names.index("form"), names.index("output")
    schema = StructType([*transformed.schema.fields, StructField("restored", StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in freed(batches):
            forms, texts = batch.column(form_at).to_pylist(), texts_of(batch.column(output_at))
            back = [source.text if forms[r] == "plain" else text_of(rearranged(source, forms[r], sentinels)) for r, source in _sources(texts)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(back, pa.string())], [*names, "restored"])

    return in_small_batches(transformed).mapInArrow(run, schema)


def infill_digest(docs: DataFrame) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256)."""
    both = restored(fill_in_middle(docs))
    return both.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


ORACLE = r"""WITH t AS (SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
u AS (SELECT doc_id, text, regexp_extract_all(text, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u,
  ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM t),
c AS (SELECT *, len(u) AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT *, array_to_string(list_slice(u, 1, a), '') AS pre, array_to_string(list_slice(u, a + 1, b), '') AS mid, array_to_string(list_slice(u, b + 1, n), '') AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
  sha256(text) AS restored_sha256 FROM p"""
