"""License scans: ordered signature rules.

Hundreds of regular expressions, written as families (name, title, versions)
times forms of notice, are gated by a keyword prefilter: a rule runs only on
texts that contain its keyword, which every match of the rule contains.  Rules
read the text with each run of white space, and of line ends and the comment
marks behind them, as one space; places are those of the text itself.  Overlapping detections are resolved by
priority, then length: a detection inside one of at least its priority is
dropped.

Defined results: a null or empty text has no words and no detections; repeated
rows get equal results; ties of equal intervals and priority go to the rule
that stands first; very long texts are scanned whole.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobloom.llm._shared import LOWER, byte_view, in_small_batches, texts_of, words_of

#: Fixed values of the contract: phrases and their labels.
BASE_PHRASES = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))
#: Families: label, keyword (lower case, must occur), title as a regular expression, SPDX stem, versions.
FAMILIES = (
    ("agpl", "affero", r"(?:gnu )?affero general public licen[cs]e", "agpl", ("1.0", "2.0", "3.0")),
    ("lgpl", "lesser", r"(?:gnu )?lesser general public licen[cs]e", "lgpl", ("2.0", "2.1", "3.0")),
    ("lgpl", "library general", r"(?:gnu )?library general public licen[cs]e", "lgpl", ("2.0",)),
    ("gpl", "general public", r"(?:gnu )?general public licen[cs]e", "gpl", ("1.0", "2.0", "3.0")),
    ("gfdl", "free documentation", r"(?:gnu )?free documentation licen[cs]e", "gfdl", ("1.1", "1.2", "1.3")),
    ("apache", "apache", r"apache(?: software)? licen[cs]e", "apache", ("1.0", "1.1", "2.0")),
    ("mpl", "mozilla", r"mozilla public licen[cs]e", "mpl", ("1.0", "1.1", "2.0")),
    ("epl", "eclipse", r"eclipse public licen[cs]e", "epl", ("1.0", "2.0")),
    ("edl", "eclipse", r"eclipse distribution licen[cs]e", "edl", ("1.0",)),
    ("cpl", "common public", r"common public licen[cs]e", "cpl", ("1.0",)),
    ("cddl", "common development", r"common development and distribution licen[cs]e", "cddl", ("1.0", "1.1")),
    ("eupl", "european union", r"european union public licen[cs]e", "eupl", ("1.0", "1.1", "1.2")),
    ("artistic", "artistic", r"artistic licen[cs]e", "artistic", ("1.0", "2.0")),
    ("bsl", "boost", r"boost software licen[cs]e", "bsl", ("1.0",)),
    ("busl", "business source", r"business source licen[cs]e", "busl", ("1.1",)),
    ("sspl", "server side", r"server side public licen[cs]e", "sspl", ("1.0",)),
    ("osl", "open software", r"open software licen[cs]e", "osl", ("1.0", "2.0", "2.1", "3.0")),
    ("afl", "academic free", r"academic free licen[cs]e", "afl", ("1.1", "2.0", "2.1", "3.0")),
    ("ofl", "sil open font", r"sil open font licen[cs]e", "ofl", ("1.0", "1.1")),
    ("zlib", "zlib", r"zlib licen[cs]e", "zlib", ()),
    ("isc", "isc", r"isc licen[cs]e", "isc", ()),
    ("mit", "mit", r"mit licen[cs]e", "mit", ()),
    ("mit-0", "no attribution", r"mit no attribution", "mit-0", ()),
    ("bsd", "bsd", r"bsd licen[cs]e", "bsd", ()),
    ("unlicense", "unlicense", r"unlicense", "unlicense", ()),
    ("wtfpl", "what the fuck", r"do what the fuck you want to public licen[cs]e", "wtfpl", ("2.0",)),
    ("postgresql", "postgresql", r"postgresql licen[cs]e", "postgresql", ()),
    ("python", "python software", r"python software foundation licen[cs]e", "psf", ("2.0",)),
    ("ruby", "ruby", r"ruby licen[cs]e", "ruby", ()),
    ("php", "php", r"php licen[cs]e", "php", ("3.0", "3.01")),
    ("openssl", "openssl", r"openssl licen[cs]e", "openssl", ()),
    ("ncsa", "ncsa", r"ncsa open source licen[cs]e", "ncsa", ()),
    ("upl", "universal permissive", r"universal permissive licen[cs]e", "upl", ("1.0",)),
    ("odbl", "open database", r"open (?:data commons open )?database licen[cs]e", "odbl", ("1.0",)),
    ("odc-by", "data commons", r"open data commons attribution licen[cs]e", "odc-by", ("1.0",)),
    ("cecill", "cecill", r"cecill(?: free software)? licen[cs]e", "cecill", ("1.0", "2.0", "2.1")),
    ("ms-pl", "microsoft public", r"microsoft public licen[cs]e", "ms-pl", ()),
    ("ms-rl", "microsoft reciprocal", r"microsoft reciprocal licen[cs]e", "ms-rl", ()),
    ("blueoak", "blue oak", r"blue oak model licen[cs]e", "blueoak", ("1.0.0",)),
    ("mulan", "mulan", r"mulan (?:permissive software|psl) licen[cs]e", "mulanpsl", ("1.0", "2.0")),
)
#: Creative Commons elements and versions.
CC_KINDS = ("by", "by-sa", "by-nd", "by-nc", "by-nc-sa", "by-nc-nd")
CC_WORDS = {"by": "attribution", "sa": "share ?alike", "nd": "no ?deriv(?:ative)?s?", "nc": "non ?commercial"}
CC_VERSIONS = ("1.0", "2.0", "2.5", "3.0", "4.0")
#: Single rules: label, keyword, pattern, priority.
SINGLES = (
    ("mit", "permission is hereby granted", r"permission is hereby granted,? free of charge,? to any person obtaining a copy", 70),
    ("isc", "permission to use, copy", r"permission to use, copy, modify, and(?:/or)? distribute this software for any purpose", 70),
    ("bsd-2-clause", "redistribution and use", r"redistribution and use in source and binary forms,? with or without modification,? are permitted", 60),
    ("bsd-3-clause", "neither the name", r"neither the name of .{1,120}? nor the names of its contributors may be used", 75),
    ("bsd-2-clause", "bsd", r"(?:2-clause|simplified) bsd(?: licen[cs]e)?", 80),
    ("bsd-3-clause", "bsd", r"(?:3-clause|new|modified|revised) bsd(?: licen[cs]e)?", 80),
    ("bsd-4-clause", "bsd", r"(?:4-clause|original) bsd(?: licen[cs]e)?", 80),
    ("0bsd", "bsd", r"(?:0-clause|zero-clause) bsd(?: licen[cs]e)?|\b0bsd\b", 80),
    ("zlib", "as-is", r"this software is provided 'as-is', without any express or implied warranty", 60),
    ("cc0", "cc0", r"\bcc0(?:[ -]1\.0)?(?: universal)?", 80),
    ("cc0", "creative commons zero", r"creative commons zero", 80),
    ("public-domain", "public domain", r"(?:released|placed|dedicated|is) (?:in|into|to) the public domain", 50),
    ("unlicense", "unencumbered", r"this is free and unencumbered software released into the public domain", 85),
    ("wtfpl", "wtfpl", r"\bwtfpl\b", 70),
    ("proprietary", "all rights reserved", r"all rights reserved", 20),
    ("proprietary", "proprietary", r"proprietary (?:and confidential|licen[cs]e|software)", 30),
    ("proprietary", "permission", r"(?:may not|must not|no part .{1,60}?may) be (?:copied|reproduced|distributed) .{0,60}?without (?:prior )?(?:written )?permission", 30),
    ("copyright", "copyright", r"copyright (?:\(c\)|©)? ?(?:19|20)\d\d(?:-(?:19|20)?\d\d)?", 15),
    ("unknown-license", "ed under", r"licen[cs]ed under (?:the )?(?:terms of )?", 5),
    ("unknown-license", "released under", r"released under (?:the )?(?:terms of )?", 5),
)


#: Words that lead into a notice; a versioned or titled rule takes them in.
LEAD = r"(?:(?:licen[cs]ed|released|distributed|available|published) under (?:the |a )?(?:terms of (?:the )?)?)?"


@dataclass(frozen=True)
class Rule:
    label: str
    keyword: str
    pattern: re.Pattern
    priority: int


@lru_cache(maxsize=1)
def rules() -> tuple[Rule, ...]:
    """All rules in order: forms of notice of each family and version, Creative Commons, single rules."""
    out: list[Rule] = []

    def add(label: str, keyword: str, pattern: str, priority: int) -> None:
        out.append(Rule(label, keyword, re.compile(pattern), priority))

    for label, keyword, title, spdx, versions in FAMILIES:
        stem = re.escape(spdx)
        for v in versions:
            major = re.escape(v.removesuffix(".0")) + (r"(?:\.0)?" if v.endswith(".0") else "")
            add(f"{label}-{v}", keyword, rf"{LEAD}{title}(?:,? version|,? v\.?)? ?{major}(?![\d.]*\d)", 90)
            add(f"{label}-{v}", spdx, rf"(?<![a-z]){stem}(?:-| |v| v){major}(?:-only|-or-later|\+)?(?![\d.]*\d)", 85)
            add(f"{label}-{v}", "spdx", rf"spdx-license-identifier: ?{stem}-{major}(?:-only|-or-later|\+)?(?![\w.]*\w)", 100)
        add(label, keyword, rf"(?:licen[cs]ed|released|distributed|available|published) under (?:the )?(?:terms of )?(?:the )?{title}", 80)
        add(label, keyword, rf"(?<![a-z]){LEAD}{title}", 60)
        add(label, "spdx", rf"spdx-license-identifier: ?{stem}(?![\w-])", 95)
    for kind in CC_KINDS:
        words = "[ -]+".join(CC_WORDS[x] for x in kind.split("-"))
        for v in CC_VERSIONS:
            add(f"cc-{kind}-{v}", "cc", rf"(?<![a-z]){LEAD}cc[ -]{kind}[ -]{re.escape(v)}(?![\d.]*\d)", 90)
            add(f"cc-{kind}-{v}", "creative commons", rf"{LEAD}creative commons {words}[ -]*(?:international |licen[cs]e )*{re.escape(v)}", 90)
            add(f"cc-{kind}-{v}", "creativecommons.org", rf"creativecommons\.org/licenses/{kind}/{re.escape(v)}", 95)
        add(f"cc-{kind}", "cc", rf"(?<![a-z]){LEAD}cc[ -]{kind}(?![\w-])", 70)
        add(f"cc-{kind}", "creative commons", rf"{LEAD}creative commons {words}(?![ -]*(?:non|share|no ?d))", 65)
    for label, keyword, pattern, priority in SINGLES:
        add(label, keyword, pattern, priority)
    return tuple(out)


@lru_cache(maxsize=1)
def _gates() -> tuple[tuple[str, tuple[Rule, ...]], ...]:
    by: dict[str, list[Rule]] = {}
    for r in rules():
        by.setdefault(r.keyword, []).append(r)
    return tuple((k, tuple(v)) for k, v in by.items())


#: What reads as one space: line ends with the comment marks of the next lines, and white space other than a single space.
_GAP = re.compile(r"[^\S\n]*+\n\s*+(?:(?://+!?|/?\*+/?|#+|;+|%+|<!--+|--+>?)\s*+)*+|\s{2,}+|[^\S ]")


def folded(text: str) -> tuple[str, list[int], list[int]]:
    """(text with each gap as one space, places behind the gaps there, what to add to places from there on)."""
    parts, at, shift, upto, removed = [], [], [], 0, 0
    for m in _GAP.finditer(text):
        parts.append(text[upto : m.start()])
        upto = m.end()
        at.append(m.start() - removed + 1)
        removed += m.end() - m.start() - 1
        shift.append(removed)
    return " ".join([*parts, text[upto:]]), at, shift


def detect(lowered: str) -> list[tuple[int, int, str, int]]:
    """(start, end, label, priority) of the detections that stand, in order.

    One detection suppresses another that lies inside it (or equals it) and
    has no higher priority.
    """
    lowered, at, shift = folded(lowered)
    order = {id(r): k for k, r in enumerate(rules())}
    found = sorted(
        (-r.priority, m.start() - m.end(), m.start(), order[id(r)], m.end(), r.label)
        for keyword, some in _gates()
        if keyword in lowered
        for r in some
        for m in r.pattern.finditer(lowered)
        if m.end() > m.start()
    )
    kept: list[tuple[int, int, str, int]] = []
    reach = 0  # the longest detection kept: none that starts earlier than that can contain another
    for p, _, start, _, end, label in found:
        near = kept[bisect_left(kept, (start - reach,)) : bisect_left(kept, (start + 1,))]
        if not any(end <= e for _, e, _, _ in near):
            insort(kept, (start, end, label, -p))
            reach = max(reach, end - start)

    def place(p: int) -> int:
        k = bisect_right(at, p)
        return p + shift[k - 1] if k else p

    return [(place(start), place(end - 1) + 1, label, p) for start, end, label, p in kept]


#: Base word characters: ASCII digits and letters, and all that is not ASCII.
_NOT_WORD = np.zeros(256, bool)
_NOT_WORD[:128] = True
_NOT_WORD[[*range(48, 58), *range(97, 123)]] = False
_SEP, _IN = rb"[\x00-\x2f\x3a-\x60\x7b-\x7f]+", rb"[0-9a-z\x80-\xff]"
_BASE = tuple((re.compile(rb"(?<!" + _IN + rb")" + _SEP.join(p.encode() for p in phrase.split()) + rb"(?!" + _IN + rb")"), label) for phrase, label in BASE_PHRASES)


def base_places(low: bytes) -> list[tuple[int, str]]:
    """(byte offset, label) of all base phrases in lower-cased UTF-8 bytes."""
    return sorted((m.start(), label) for pattern, label in _BASE for m in pattern.finditer(low))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: words, base places, detections (start, end, label, priority; code points), labels, score."""
    kind = docs.schema[id_col].dataType.simpleString()
    fields = "n_words long, n_base long, first_word long, last_word long, base_labels array<string>, detections array<struct<start:long,end:long,label:string,priority:long>>, score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("label", pa.string()), ("priority", pa.int64())]))
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                ids, texts = batch.column(0).slice(i, 256), texts_of(batch.column(1).slice(i, 256))
                data, off = byte_view(texts)
                low = LOWER[data]
                starts, _, doc = words_of(low, off, _NOT_WORD)
                counts = np.bincount(doc, minlength=len(texts))
                rows = []
                for r in range(len(texts)):
                    raw = low[off[r] : off[r + 1]].tobytes()
                    base = base_places(raw)
                    own = np.searchsorted(starts, [off[r] + b[0] for b in base]) - (counts[:r].sum() if base else 0)
                    hits = detect(raw.decode()) if len(raw) else []
                    best = max([h[3] for h in hits] + [90 * bool(base)])
                    rows.append((len(base), int(own.min()) if base else None, int(own.max()) if base else None, sorted({b[1] for b in base}), [dict(zip(("start", "end", "label", "priority"), h, strict=True)) for h in hits], best / 100))
                cols = list(zip(*rows, strict=True))
                types = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string()), found, pa.float64())
                yield pa.RecordBatch.from_arrays([ids, pa.array(counts, pa.int64()), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], ["id", *(f.split(" ")[0] for f in fields.split(", "))])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return in_small_batches(rows).mapInArrow(run, f"id {kind}, {fields}").withColumnRenamed("id", id_col)


def license_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The query's columns: labels joined, base labels kept beside the rules' own."""
    got = scan_licenses(docs, id_col, text_col)
    both = F.array_sort(F.array_union("base_labels", F.transform("detections", lambda d: d["label"])))
    return got.select(id_col, "n_words", "n_base", "first_word", "last_word", F.array_join("base_labels", ",").alias("base_labels"), F.array_join(both, ",").alias("labels"), "score", F.size("detections").cast("long").alias("n_detections"))
