"""Secret scans: fixed patterns and a linear-chain conditional random field.

The field tags tokens (runs of ``[A-Za-z0-9+/_.-]``) as begin, inside or
outside of a secret.  Tokens of six characters and more are open to it, but
for the cue words themselves; shorter ones are fixed to outside, so a text
falls into independent runs of open tokens, and Viterbi decoding of each run is
the exact decoding of the whole text.  Features are a token's shape, its
neighbouring words, and the file's.

The field is trained here, by gradient ascent on the conditional likelihood,
on a bounded sample of texts whose tags come from the fixed patterns, and on
respelled copies of their secrets, as the patterns alone would teach the field
only the alphabets that they know.

Defined results: a null or empty text has no spans; a corpus without any base
span trains no field, and only base spans are found; repeated rows get equal
spans; spans are in code points, end exclusive; texts are scanned whole.
"""

from __future__ import annotations

import hashlib
import random
import re
import string
from bisect import bisect_left
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobloom.llm._shared import in_small_batches, texts_of
from jobloom.llm.sampling import least_hash

#: Fixed values of the contract. [0-9a-f]{24,} behind no such character is [0-9a-f]+ of 24 and more.
_KEYWORD = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key"))
ASSIGN = re.compile(rf"""({_KEYWORD})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
_THIRDS = re.compile(r"[0-9a-f]{8}")
KINDS = ("assign", "access", "hex", "crf")

#: The bound of the sample that the field is trained on: texts with base spans, and as many without.
MAX_TEXTS = 400
#: Of the runs without a secret in these texts at most so many are trained on, weighted for the others.
MAX_RUNS = 2000
#: The least length of a secret, as in the contract.
MIN_LENGTH = 6
EPOCHS = 80
RATE = 0.1
L2 = 1e-2
TAGS = 3  # begin, inside, outside
_LEXEME = re.compile(r"([A-Za-z0-9+/_.-]+)|(\w+)|([^\s\w])")
_CUES = frozenset("password passwd secret token api_key apikey key auth bearer credential credentials pwd access id phone tel card mail http https example com".split())

#: A token in its place: start, end, and the kinds of the three lexemes before it and of the one behind it.
Place = tuple[int, int, tuple[str, str, str, str]]


@lru_cache(4)
def _has_keyword(text: str) -> bool:
    """Whether a keyword of ``ASSIGN`` or of ``_file`` may be in a text; if not, neither is."""
    low = text.lower()
    return "passw" in low or "token" in low or "secret" in low or "api_key" in low or "apikey" in low


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed patterns, by start and kind."""
    out = []
    if _has_keyword(text) and ("=" in text or ":" in text):
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    # of 24 characters in a row, eight are among those at every third place
    if _THIRDS.search(text[2::3]):
        out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


@lru_cache(1 << 16)
def _kind(token: str) -> str:
    """A token as a neighbour: a cue word, another word, a number or a mark."""
    low = token.lower().strip("+/_.-")
    return low if low in _CUES else "word" if token[0].isalpha() else "number" if any(c.isdigit() for c in token) else token[0]


def runs(text: str) -> list[list[Place]]:
    """Open tokens with no fixed lexeme between them: white space and quotes may stand there."""
    lexemes = [(m.start(), m.lastindex, m[0]) for m in _LEXEME.finditer(text)]
    kinds = ["", "", "", *((low if (low := w.lower()) in _CUES else "word") if g == 1 and w.isalpha() else _kind(w) if g == 1 else "letters" if g == 2 else w for _, g, w in lexemes), ""]
    out: list[list[Place]] = []
    run: list[Place] = []
    for i, (s, g, w) in enumerate(lexemes):
        if g == 1 and len(w) >= MIN_LENGTH and (bare := w.rstrip(".")) and len(bare) >= MIN_LENGTH and kinds[i + 3] not in _CUES:
            run.append((s, s + len(bare), (kinds[i + 2], kinds[i + 1], kinds[i], kinds[i + 4])))
        elif run and w != '"' and w != "'":
            out.append(run)
            run = []
    return [*out, run] if run else out


@lru_cache(1 << 16)
def _shape(token: str) -> tuple[str, ...]:
    lower, upper = any(c.islower() for c in token), any(c.isupper() for c in token)
    classes = "".join(k for k, ok in (("l", lower), ("U", upper), ("p", any(c in "+/_.-" for c in token))) if ok)
    alphabet = "hex" if all(c in "0123456789abcdef" for c in token) else "HEX" if all(c in "0123456789ABCDEF" for c in token) else "num" if all(c in "0123456789.-+" for c in token) else "alpha" if token.isalpha() else "alnum" if token.isalnum() else "other"
    digits = sum(c.isdigit() for c in token)
    turns = sum(a.isdigit() != b.isdigit() for a, b in zip(token, token[1:], strict=False))
    inner = sum(a.islower() and b.isupper() for a, b in zip(token, token[1:], strict=False))
    n = min(len(token), 64) // 4
    word = alphabet in ("alpha", "hex") and not digits and not inner
    head = token[:4] if digits and token[:4].isupper() and token[:4].isalpha() else ""
    return ("bias", f"word={word}", f"classes={classes}", f"alphabet={alphabet}", f"length={n}", f"alphabet,length={alphabet},{min(n, 6)}", f"digits={digits * 4 // len(token)},{digits > 0}", f"turns={min(turns, 8)}", f"humps={min(inner, 3)}", f"head={head}", f"dots={min(token.count('.'), 4)}", f"dashes={min(token.count('-'), 3)}")


_ALL, _NONE = float("inf"), float("-inf")
_CLASSES = str.maketrans({c: "a" if c.islower() else "A" if c.isupper() else "0" for c in string.ascii_letters + string.digits})


def _shape_key(token: str) -> object:
    """Equal for tokens of equal shape."""
    if token.isalpha():
        if token.islower():
            return len(token) >> 2, not token.strip("abcdef")
        if token.isupper():
            return len(token) >> 2, "HEX", not token.strip("ABCDEF")
        if token.istitle():
            return len(token) >> 2, "title"
    if token[:4].isupper() and token[:4].isalpha():
        return token
    return token.translate(_CLASSES), not token.strip("0123456789abcdef"), not token.strip("0123456789ABCDEF")


@lru_cache(1 << 16)
def _neighbours(near: tuple[str, str, str, str], place: int) -> tuple[str, ...]:
    a, b, c, after = near
    return (f"prev={a}", f"prev2={b}", f"prev3={c}", f"prev,prev2={a},{b}", f"cue={any(x in _CUES for x in (a, b, c))}", f"next={after}", f"place={place}")


@lru_cache(4)
def _file(text: str) -> tuple[str, ...]:
    keyword = _has_keyword(text) and bool(re.search("[Pp]assw|[Ss]ecret|[Tt]oken|[Aa][Pp][Ii]_?[Kk]ey", text))
    return (f"file_size={len(text).bit_length()}", f"file_keyword={keyword}", f"file_assign={'=' in text}")


def features(text: str, run: list[Place]) -> list[list[str]]:
    """Each token's features, equally many: shape, neighbours, file."""
    file = _file(text)
    return [[*_shape(text[s:e]), *_neighbours(near, min(k, 3)), *file] for k, (s, e, near) in enumerate(run)]


@dataclass
class Field:
    """Weights of the conditional random field; its size is bounded by the training sample."""

    index: dict[str, int] = field(default_factory=dict)
    unary: np.ndarray = field(default_factory=lambda: np.zeros((0, TAGS)))
    pair: np.ndarray = field(default_factory=lambda: np.zeros((TAGS, TAGS)))

    memo: dict = field(default_factory=dict)
    #: How far chunks between white space may be lifted, their neighbours and the file apart.
    chunks: dict[str, float] = field(default_factory=dict)
    #: What ``_rest`` found.
    rest: tuple[float, float, frozenset[str]] | None = None

    def scores(self, rows: list[list[str]]) -> np.ndarray:
        return np.array([self.unary[[self.index[f] for f in r if f in self.index]].sum(axis=0) for r in rows])

    def _lead(self, key: object, names: tuple[str, ...]) -> float:
        """How far a part of a token's features may lift begin or inside above outside; remembered under ``key``."""
        if len(self.memo) >= 1 << 16:
            self.memo.clear()
        a, b, c = self.scores([list(names)])[0].tolist()
        self.memo[key] = max(a, b) - c
        return self.memo[key]

    def candidates(self, text: str) -> Iterator[list[Place]]:
        """The runs whose best tags are not surely all outside.

        A stretch of n tokens inside gains at most (n + 1) times what the best
        pair of tags is above outside-outside; where every token alone loses
        twice that, no stretch can pay.
        """
        lead = self._lead(None, _file(text))
        least, known = -self._gain() - lead, self.memo
        if self._is_calm(text, lead):
            return
        for run in runs(text):
            for k, (s, e, near) in enumerate(run):
                a, place = self._word(text[s:e]), (near, k if k < 3 else 3)
                if (b := known.get(place)) is None:
                    b = self._lead(place, _neighbours(*place))
                if a + b >= least:
                    yield run
                    break

    def _gain(self) -> float:
        return 2 * max(0.0, float(self.pair[_FORBIDDEN == 0].max() - self.pair[2, 2])) + 1e-9

    def _word(self, word: str) -> float:
        key = _shape_key(word)
        a = self.memo.get(key)
        return self._lead(key, _shape(word)) if a is None else a

    def _rest(self) -> tuple[float, float, frozenset[str]]:
        """(how far neighbours may lift a token, how far its place may, the neighbours that may lift it further)."""
        of = lambda name: self.scores([[name]])[0].tolist() if name in self.index else [0.0] * 3
        lift = lambda name: max((x := of(name))[0], x[1]) - x[2]
        plain, sides, pair = ("", "word", "number", "letters", ",", "."), ("prev", "prev2", "prev3", "next"), "prev,prev2={},{}".format
        kinds = {x.split("=", 1)[1] for x in self.index if x.split("=", 1)[0] in sides} - _CUES
        tops = {side: max(0.0, *(lift(f"{side}={k}") for k in plain)) for side in sides}
        top = max(0.0, *(lift(pair(a, b)) for a in plain for b in plain))
        loud = {k for k in kinds for side in sides if lift(f"{side}={k}") > tops[side]}
        loud |= {k for a in kinds for b in kinds if lift(pair(a, b)) > top for k in (a, b)}
        return sum(tops.values()) + top + lift("cue=False"), max(lift(f"place={k}") for k in range(4)), frozenset(loud.difference(plain) | _CUES)

    def _is_calm(self, text: str, lead: float) -> bool:
        """Whether surely no token of a text may begin a secret; most texts are told by their chunks between white space.

        A calm chunk has plain neighbours only and no token that these could
        lift.  A token's neighbours stand at most three chunks before its own
        and one behind, so only tokens near other chunks are looked at.
        """
        if self.rest is None:
            self.rest = self._rest()
        known, chunks = self.chunks, text.split()
        if len(known) >= 1 << 17:
            known.clear()
        lifts = [*map(known.get, chunks)]
        for j in [j for j, x in enumerate(lifts) if x is None]:
            c = chunks[j]
            lifts[j] = x = self._chunk(c)
            if len(c) < 32:
                known[c] = x
        least = -self._gain() - lead - self.rest[0] - self.rest[1]
        loud = [j for j, x in enumerate(lifts) if x >= least]
        if 5 * len(loud) > len(chunks):
            return False
        least, known, upto = -self._gain() - lead - self.rest[1], self.memo, 0
        while upto < len(loud):
            first = end = loud[upto]
            while upto < len(loud) and loud[upto] <= end + 6:
                end, upto = loud[upto], upto + 1
            window = " ".join(chunks[max(0, first - 4) : end + 5])
            for run in runs(window):
                for s, e, near in run:
                    if (b := known.get(near)) is None:
                        b = self._lead(near, _neighbours(near, 0)[:-1])
                    if self._word(window[s:e]) + b >= least:
                        return False
        return True

    def _chunk(self, chunk: str) -> float:
        """The most that shapes lift a token of a chunk; all if it has a neighbour that may lift others."""
        word = chunk.rstrip(",.")
        if word.isalpha() and word.isascii():
            return _ALL if word.lower() in _CUES else _NONE if len(word) < MIN_LENGTH else self._word(word)
        most = _NONE
        for m in _LEXEME.finditer(chunk):
            g, w = m.lastindex, m[0]
            if (_kind(w) if g == 1 else "letters" if g == 2 else w) in self.rest[2]:
                return _ALL
            if g == 1 and len(w) >= MIN_LENGTH and len(bare := w.rstrip(".")) >= MIN_LENGTH:
                most = max(most, self._word(bare))
        return most

    def viterbi(self, rows: list[list[str]]) -> list[int]:
        """The best tags of a run; both of its ends touch a token fixed to outside."""
        u = self.scores(rows)
        best, back = u[0] + self.pair[2], []
        for x in u[1:]:
            step = best[:, None] + self.pair
            back.append(step.argmax(axis=0))
            best = step.max(axis=0) + x
        tag = int((best + self.pair[:, 2]).argmax())
        tags = [tag]
        for b in reversed(back):
            tag = int(b[tag])
            tags.append(tag)
        return tags[::-1]


#: Inside follows begin or inside only.
_FORBIDDEN = np.zeros((TAGS, TAGS))
_FORBIDDEN[2, 1] = -1e6


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis=axis)
    return m + np.log(np.exp(x - np.expand_dims(m, axis)).sum(axis=axis))


def train(examples: list[tuple[list[list[str]], list[int]]], weights: list[float] | None = None) -> Field:
    """Maximum conditional likelihood by gradient ascent with steps scaled by each weight's recent gradients, runs of one length at a time."""
    model = Field(pair=_FORBIDDEN.copy())
    if not any(t != 2 for _, tags in examples for t in tags):
        return model
    weights = weights or [1.0] * len(examples)
    lengths: dict[int, list[tuple[list[list[int]], list[int], float]]] = {}
    for (rows, tags), w in zip(examples, weights, strict=True):
        coded = [[model.index.setdefault(f, len(model.index)) for f in r] for r in rows]
        lengths.setdefault(len(tags), []).append((coded, tags, w))
    groups = [tuple(np.array(x) for x in zip(*g, strict=True)) for g in lengths.values()]
    model.unary = np.zeros((len(model.index), TAGS))
    share = sum((np.eye(TAGS)[tags].sum(axis=1) * w[:, None]).sum(axis=0) for _, tags, w in groups)
    model.unary[model.index.get("bias", 0)] = np.log((share + 0.5) / (share.sum() + 1.5))
    mean = [np.zeros_like(model.unary), np.zeros_like(model.pair)]
    square = [np.zeros_like(model.unary), np.zeros_like(model.pair)]
    for epoch in range(1, EPOCHS + 1):
        gu, gp = -L2 * model.unary, np.zeros_like(model.pair)
        for at, tags, w in groups:
            u = model.unary[at].sum(axis=2)
            n, each = u.shape[1], w[:, None]
            fwd, bwd = np.zeros_like(u), np.zeros_like(u)
            fwd[:, 0], bwd[:, -1] = u[:, 0] + model.pair[2], model.pair[:, 2]
            for i in range(1, n):
                fwd[:, i] = _lse(fwd[:, i - 1, :, None] + model.pair, 1) + u[:, i]
            for i in range(n - 2, -1, -1):
                bwd[:, i] = _lse(model.pair + (u[:, i + 1] + bwd[:, i + 1])[:, None, :], 2)
            z = _lse(fwd[:, -1] + bwd[:, -1], 1)
            marginal = np.exp(fwd + bwd - z[:, None, None])
            gold = np.eye(TAGS)[tags]
            off = (gold - marginal) * w[:, None, None]
            for t in range(TAGS):
                gu[:, t] += np.bincount(at.ravel(), np.repeat(off[..., t].ravel(), at.shape[2]), len(gu))
            gp[2] += off[:, 0].sum(axis=0)
            gp[:, 2] += off[:, -1].sum(axis=0)
            for i in range(1, n):
                joint = np.exp(fwd[:, i - 1, :, None] + model.pair + (u[:, i] + bwd[:, i])[:, None, :] - z[:, None, None])
                gp += (gold[:, i - 1] * each).T @ gold[:, i] - (joint * w[:, None, None]).sum(axis=0)
        for k, (x, g) in enumerate(((model.unary, gu), (model.pair, np.where(_FORBIDDEN < 0, 0, gp)))):
            mean[k] = 0.9 * mean[k] + 0.1 * g
            square[k] = 0.99 * square[k] + 0.01 * g * g
            x += RATE * (mean[k] / (1 - 0.9**epoch)) / (np.sqrt(square[k] / (1 - 0.99**epoch)) + 1e-6)
    return model


def _tags(run: list[Place], spans: list[tuple[int, int, str]], ends: list[int]) -> list[int]:
    """The tags of a run's tokens by ``spans``, whose ends' running maxima are ``ends``."""
    tags, inside = [], None
    for s, e, _ in run:
        first = bisect_left(ends, s + 1)
        hit = next((k for k in range(first, bisect_left(spans, (e,))) if s < spans[k][1]), None)
        tags.append(2 if hit is None else 1 if hit == inside else 0)
        inside = hit
    return tags


def tagged(text: str, spans: list[tuple[int, int, str]] | None = None) -> list[tuple[list[list[str]], list[int]]]:
    """(features, tags) of each run, tagged by the given spans or by the base spans."""
    spans = base_spans(text) if spans is None else spans
    ends = list(accumulate((b for _, b, _ in spans), max))
    return [(features(text, run), _tags(run, spans, ends)) for run in runs(text)]


_LETTERS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
KEYWORDS = ("password", "passwd", "secret", "token", "api_key", "apikey", "key", "pwd", "Password", "Token")
#: (alphabet, least and largest length) of respelled secrets.
SPELLINGS = ((_LETTERS, 12, 28), ("abcdefghijklmnopqrstuvwxyz0123456789", 6, 12), (_LETTERS + "0123456789+/", 16, 40))


def respelled(text: str, rnd: random.Random) -> Iterator[tuple[str, list[tuple[int, int, str]]]]:
    """Copies of a text with other keywords and values in place of its own, some joined by "is", and their spans."""
    hits = [m for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_LENGTH]
    for alphabet, least, most in SPELLINGS if hits else ():
        out, spans, upto = "", [], 0
        for m in hits:
            value = "".join(rnd.choice(alphabet) for _ in range(rnd.randint(least, most)))
            out += text[upto : m.start(1)] + rnd.choice(KEYWORDS) + (" is " if rnd.random() < 0.5 else text[m.end(1) : m.start(2)])
            spans.append((len(out), len(out) + len(value), "assign"))
            out += value
            upto = m.end(2)
        yield out + text[upto:], spans


def fit_texts(texts: list[str], most: int = MAX_RUNS) -> Field:
    """A field from all runs with secrets, their respelled copies, and at most ``most`` of the other runs."""
    rnd = random.Random(7)
    hold, plain = [], []
    for text in sorted(texts):
        spans = base_spans(text)
        ends = list(accumulate((b for _, b, _ in spans), max))
        for run in runs(text):
            tags = _tags(run, spans, ends)
            if any(t != 2 for t in tags):
                hold.append(((features(text, run), tags), 1.0))
            else:
                plain.append((text, run))
        for copy, known in respelled(text, rnd):
            upto = [e for _, e, _ in known]  # in order, and apart
            for run in runs(copy):
                tags = _tags(run, known, upto)
                if any(t != 2 for t in tags):
                    hold.append(((features(copy, run), tags), 0.5))
    kept = plain if len(plain) <= most else rnd.sample(plain, most)
    rest = [((features(text, run), [2] * len(run)), len(plain) / len(kept)) for text, run in kept]
    both = hold + rest
    return train([x for x, _ in both], [w for _, w in both])


def crf_spans(text: str, model: Field) -> list[tuple[int, int, str]]:
    """Begin and inside runs as spans."""
    out: list[tuple[int, int, str]] = []
    for run in model.candidates(text):
        for (s, e, _), tag in zip(run, model.viterbi(features(text, run)), strict=True):
            if tag == 0:
                out.append((s, e, "crf"))
            elif tag == 1 and out:
                out[-1] = (out[-1][0], e, "crf")
    return out


def all_spans(text: str, model: Field) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """(base spans, all spans): the field adds spans that no base span contains."""
    base = base_spans(text)
    ends = list(accumulate((b for _, b, _ in base), max))
    found = crf_spans(text, model) if model.index else []
    upto = [bisect_left(base, (s[0] + 1,)) for s in found]  # base spans that begin no later
    more = [s for s, k in zip(found, upto, strict=True) if not k or ends[k - 1] < s[1]]
    return base, sorted(base + more, key=lambda s: (s[0], KINDS.index(s[2])))


def fit(docs: DataFrame, text_col: str = "text", limit: int = MAX_TEXTS) -> Field:
    """A field from ``limit`` texts with base spans and as many others with digits, each of least hash."""
    rows = docs.select(F.col(text_col).alias("text")).filter(F.length("text") > 0)
    likely = F.col("text").rlike(r"AKIA[A-Z0-9]{16}|(?<![0-9a-f])[0-9a-f]{24}") | F.lower("text").rlike(r"""(?:password|passwd|secret|token|api_?key)["']? *[:=]""")
    other = ~likely & F.col("text").rlike("[0-9]{3}")  # numbers that are no secrets
    return fit_texts([r.text for part in least_hash(rows, [likely, other], limit) for r in part])


def scan_secrets(docs: DataFrame, model: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, base, spans): spans as arrays of (start, end, kind)."""
    kind = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 1024):
                got = [all_spans(t, shared.value) for t in texts_of(batch.column(1).slice(i, 1024)).to_pylist()]
                named = [[[{"start": s, "end": e, "kind": k} for s, e, k in g[x]] for g in got] for x in (0, 1)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1024), *(pa.array(n, span) for n in named)], ["id", "base", "spans"])

    spans = "array<struct<start:long,end:long,kind:string>>"
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return in_small_batches(rows).mapInArrow(run, f"id {kind}, base {spans}, spans {spans}").withColumnRenamed("id", id_col)


def secret_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The query's columns: counts of base spans and digests of both lists."""
    got = scan_secrets(docs, fit(docs, text_col), id_col, text_col)

    def joined(column: str):
        return F.array_join(F.transform(column, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind: str):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return got.select(id_col, count("assign"), count("access"), count("hex"), F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))


def digest_of(spans: list[tuple[int, int, str]]) -> str:
    """The base digest of one text, as the query computes it."""
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, e, k in spans).encode()).hexdigest()
