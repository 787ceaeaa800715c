"""Toxicity by nearest labelled examples under exact TF-IDF cosine.

Terms are words, and their first four to six characters where these speak for
label 1 (so inflected forms share a term).  The model is fitted on a bounded sample of labelled rows; the
cluster counts the sample's terms:

* a vocabulary of all words of the sample; a term's weight is its inverse
  document frequency, in full where it speaks for label 1 beyond chance
  (chi-squared), down to ``ORDINARY`` of it where it does not: under equal
  weights the neighbours are those of a text's topic;
* an inverted index from term to (example, weight), cut into blocks of
  examples with the largest weight of each term in each block;
* a calibration of the vote, from each example's vote among the others.

Every text is searched for its ``NEIGHBOURS`` nearest examples.  The blocks'
upper bounds (sum of query weight times block maximum) are taken in descending
order; blocks that cannot beat the current last neighbour are skipped, so the
neighbours are exact.  Votes are weighted by similarity, and the neighbours
stand beside the score as its evidence: their ids and cosines.

Defined results: a null or empty text, and any text without a term of the
sample, has no neighbour and gets the calibrated share of label 1 among such
examples; without labelled rows, or with one label only, the score is that
label's share (0 without rows); ties between neighbours go to the lower
example; repeated rows get equal scores; very long texts are scored whole; an
empty table gives no rows; extra columns are not read and, where documents are
kept, come back as they are, whatever their names; only the text column is an
input of a score.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobloom.llm._shared import crc_mod, freed, in_small_batches, texts_of
from jobloom.llm.sampling import least_hash
from jobloom.storage import discard, materialize

#: The bound of the sample that the model is fitted on: labelled rows, taken by least hash of id and label.
MAX_EXAMPLES = 1500
#: The chi-squared from which a term for label 1 has its full weight; in small samples, whose number of rows bounds it, a third of that.
FULL_CHI2 = 30.0
#: The share of its weight that a term keeps which does not speak for label 1.
ORDINARY = 0.2
#: Examples a block.
BLOCK = 512
NEIGHBOURS = 25
BINS = 10
MIDDLES = (np.arange(BINS) + 0.5) / BINS
TOXIC_AT = 0.3
PREFIXES = (4, 5, 6)
#: Words whose terms a task remembers.
WORDS_HELD = 100_000
#: Distinct terms that a task holds before it passes their counts on, and tasks that count.
TALLY, PARTS = 100_000, 16
WORD = re.compile(r"[^\W\d_]+")


def names_of(word: str) -> list[str]:
    """A word's terms: itself and its prefixes."""
    return [word, *(word[:k] + "*" for k in PREFIXES if len(word) > k)]


def terms(text: str) -> set[str]:
    """The distinct terms of a text."""
    return {t for word in set(WORD.findall(text.lower())) for t in names_of(word)}


def chi2(df, df1, n, n1):
    """(chi-squared, whether the term speaks for label 1) of document counts; numbers, arrays or columns."""
    a, b = df1, df - df1
    c, d = n1 - a, n - n1 - b
    return n * (a * d - b * c) ** 2 / ((a + b) * (c + d) * (a + c) * (b + d) + 1e-9), a * d > b * c


def term_shares(n: float, n1: float, df: np.ndarray, df1: np.ndarray) -> np.ndarray:
    """The shares of their weight that terms keep: all of it if they speak for label 1, less for the others."""
    value, toxic = chi2(df, df1, n, n1)
    return np.where(toxic, np.clip(value / min(FULL_CHI2, n / 3), ORDINARY, 1.0), ORDINARY)


def vocabulary(names: list[str], n: float, n1: float, df: np.ndarray, df1: np.ndarray) -> tuple[dict[str, int], np.ndarray]:
    """(the terms by name, their weights), given how many examples hold each, in all and of label 1: every word, and prefixes for label 1."""
    share = term_shares(n, n1, df, df1)
    kept = np.array([share[i] > ORDINARY or not t.endswith("*") for i, t in enumerate(names)], bool)
    weights = (np.log((1 + n) / (1 + df)) + 1) * share
    return {t: i for i, t in enumerate(t for t, k in zip(names, kept, strict=True) if k)}, weights[kept]


@dataclass
class Model:
    """The fitted index; its size is bounded by the sample and its terms."""

    vocabulary: dict[str, int] = field(default_factory=dict)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    labels: np.ndarray = field(default_factory=lambda: np.zeros(0))
    starts: np.ndarray = field(default_factory=lambda: np.zeros((0, 1), np.int64))  # by block and term: where its list begins
    examples: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int16))  # of all lists, within their block
    impacts: np.ndarray = field(default_factory=lambda: np.zeros(0, np.float32))
    block_max: np.ndarray = field(default_factory=lambda: np.zeros((0, 0), np.float32))  # by term and block
    ids: list[str] = field(default_factory=list)  # the examples' ids, as text
    prior: float = 0.0
    bins: np.ndarray = field(default_factory=lambda: np.zeros(0))
    seen: dict[str, tuple[int, ...]] = field(default_factory=dict)  # the terms of words met before

    def count(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """(a text's terms that the sample has, ascending, how often each stands there)."""
        at: list[int] = []
        times: list[int] = []
        seen, known = self.seen, self.vocabulary
        for word, n in Counter(WORD.findall(text.lower())).items():
            own = seen.get(word)
            if own is None:
                if len(seen) == WORDS_HELD:
                    seen.clear()
                own = seen[word] = tuple(known[t] for t in names_of(word) if t in known)
            at += own
            times += (n,) * len(own)
        order = np.argsort(which := np.array(at, np.int32), kind="stable")
        which = which[order]
        first = np.flatnonzero(np.diff(which, prepend=-1))
        return which[first], np.add.reduceat(np.array(times, np.int32)[order], first) if len(first) else np.zeros(0, np.int32)

    def vector(self, at: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(terms, unit-length TF-IDF weights, in single precision)."""
        w = times * self.weights[at]
        return at, (w / np.sqrt((w * w).sum() or 1.0)).astype(np.float32)

    def nearest(self, at: np.ndarray, w: np.ndarray, without: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """The exact nearest examples with a positive cosine: (examples, cosines)."""
        ids, sims = np.zeros(0, np.int64), np.zeros(0)
        if not len(at) or not len(self.starts):
            return ids, sims
        bound = w.astype(np.float64) @ self.block_max[at]
        for b in np.argsort(-bound, kind="stable"):
            last = sims[-1] - 1e-9 if len(ids) == NEIGHBOURS else 0.0
            if bound[b] <= last:
                break
            first = self.starts[b][at]
            size = self.starts[b][at + 1] - first
            ends = np.cumsum(size)
            lists = np.repeat(first - ends + size, size) + np.arange(ends[-1])
            scores = np.bincount(self.examples[lists], np.repeat(w, size) * self.impacts[lists], BLOCK)
            if b == without // BLOCK:
                scores[without % BLOCK] = 0
            hit = np.flatnonzero(scores > last)
            if not len(hit):
                continue
            ids, sims = np.concatenate((ids, hit + b * BLOCK)), np.concatenate((sims, scores[hit]))
            best = np.lexsort((ids, -np.round(sims, 12)))[:NEIGHBOURS]
            ids, sims = ids[best], sims[best]
        return ids, sims

    def vote(self, ids: np.ndarray, sims: np.ndarray) -> float:
        return float((sims * self.labels[ids]).sum() / sims.sum())

    def scored(self, text: str) -> tuple[float, np.ndarray, np.ndarray]:
        """(calibrated score, neighbours, their cosines)."""
        ids, sims = self.nearest(*self.vector(*self.count(text)))
        return float(np.interp(self.vote(ids, sims), MIDDLES, self.bins)) if len(ids) else self.prior, ids, sims

    def score(self, text: str) -> tuple[float, list[dict]]:
        """(calibrated score, the neighbours' ids and cosines as evidence)."""
        score, ids, sims = self.scored(text)
        return score, [{"example": self.ids[i], "cosine": float(x)} for i, x in zip(ids.tolist(), sims, strict=True)]


def fit(texts: list[str], labels: list[int]) -> Model:
    """The model of a few labelled texts, all on the driver."""
    df, df1 = Counter(), Counter()
    for text, label in zip(texts, labels, strict=True):
        df.update(terms(text))
        if label:
            df1.update(terms(text))
    names = sorted(df)
    chosen = vocabulary(names, float(len(labels)), float(sum(labels)), *(np.array([c[t] for t in names], float) for c in (df, df1)))
    reader = Model(vocabulary=chosen[0])
    return build(*chosen, [reader.count(t) for t in texts], labels)


def isotonic(sums: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The rising means nearest to those of the bins: neighbours that fall are pooled."""
    pools: list[tuple[float, float, int]] = []
    for pool in zip(sums.tolist(), sizes.tolist(), [1] * len(sums), strict=True):
        while pools and pools[-1][0] * pool[1] >= pool[0] * pools[-1][1]:
            pool = tuple(x + y for x, y in zip(pools.pop(), pool, strict=True))
        pools.append(pool)
    return np.concatenate([np.full(n, total / size) for total, size, n in pools])


def build(names: dict[str, int], weights: np.ndarray, counted: list[tuple[np.ndarray, np.ndarray]], labels: list[int], ids: list | None = None) -> Model:
    """Index and calibration from the terms, their weights and the examples' counts of them."""
    y, model = np.array(labels, float), Model()
    model.ids = [str(x) for x in (range(len(labels)) if ids is None else ids)]
    model.labels, model.prior = y, float(y.mean()) if len(y) else 0.0
    if not len(y) or y.min() == y.max():
        return model
    model.vocabulary, model.weights = names, weights
    vectors = [model.vector(*c) for c in counted]
    blocks = -(-len(y) // BLOCK)
    model.starts = np.zeros((blocks, len(names) + 1), np.int32)
    model.block_max = np.zeros((len(names), blocks), np.float32)
    examples, impacts, before = [], [], 0
    for k in range(blocks):
        part = vectors[k * BLOCK : (k + 1) * BLOCK]
        at, w = (np.concatenate([v[i] for v in part]) for i in (0, 1))
        order = np.argsort(at, kind="stable")
        examples.append(np.repeat(np.arange(len(part), dtype=np.int16), [len(v[0]) for v in part])[order])
        impacts.append(w[order])
        model.starts[k] = before + np.searchsorted(at[order], np.arange(len(names) + 1))
        np.maximum.at(model.block_max[:, k], at, w)
        before += len(at)
    model.examples, model.impacts = np.concatenate(examples), np.concatenate(impacts)
    # calibration: isotonic shares of label 1 by bins of the vote among the other examples
    near = [model.nearest(*v, without=i) for i, v in enumerate(vectors)]
    has = np.array([len(ids) > 0 for ids, _ in near])
    model.prior = float((y[~has].sum() + y.mean()) / ((~has).sum() + 1))
    votes = np.array([model.vote(*x) if len(x[0]) else 0.0 for x in near])
    which = np.minimum((votes * BINS).astype(int), BINS - 1)[has]
    hits, size = np.bincount(which, y[has], BINS), np.bincount(which, minlength=BINS)
    model.bins = isotonic(2 * BINS * hits + 2 * np.arange(BINS) + 1, 2 * BINS * (size + 1))  # one example more a bin, at its middle; whole numbers
    return model


def score_texts(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """All rows and columns of ``docs`` with ``score`` and ``evidence`` (examples' ids, cosines)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        names = pa.array(m.ids, pa.string())

        for batch in freed(batches):
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                got = [m.scored(t) for t in texts_of(part.column(at)).to_pylist()]
                near = [np.concatenate([g[k] for g in got]) for k in (1, 2)] if got else [np.zeros(0, np.int64), np.zeros(0)]
                pairs = pa.StructArray.from_arrays([names.take(pa.array(near[0])), pa.array(near[1])], ["example", "cosine"])
                ends = pa.array(np.cumsum([0, *(len(g[1]) for g in got)]), pa.int32())
                cols = [*part.columns, pa.array([g[0] for g in got], pa.float64()), pa.ListArray.from_arrays(ends, pairs)]
                yield pa.RecordBatch.from_arrays(cols, [*part.schema.names, "score", "evidence"])

    schema = docs.select("*", F.lit(0.0).alias("score"), F.lit(None).cast("array<struct<example:string,cosine:double>>").alias("evidence")).schema
    return in_small_batches(docs).mapInArrow(run, schema)


def fit_on(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", limit: int = MAX_EXAMPLES) -> Model:
    """The model of at most ``limit`` labelled rows that are not held out (crc32 of the id modulo 4 is not 2).

    The sample is taken from the labels, and only its rows meet the texts, so
    no text is shuffled.
    """
    spark = docs.sparkSession
    train = labels.filter((crc_mod(F.col(id_col), 4) != 2) & F.col(label_col).isNotNull()).select(F.col(id_col).alias("_id"), (F.col(label_col) > 0).cast("int").alias("_label"))
    chosen = spark.createDataFrame(least_hash(train, [F.col("_id").isNotNull()], limit)[0], train.schema)
    texts = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    found = texts.join(F.broadcast(chosen), "_id").select("_id", "_text", "_label").distinct()  # the chosen ids are at most ``limit``
    rows = materialize(found.orderBy(F.xxhash64("_id", "_text"), "_id", "_text", "_label").limit(limit), "examples")  # ids may repeat
    size = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum("_label"), F.lit(0)).alias("n1")).first()
    n, n1 = int(size.n), int(size.n1)
    if not 0 < n1 < n:
        discard(rows)
        return build({}, np.zeros(0), [], [1] * n1 + [0] * (n - n1))

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in freed(batches):
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seen.update((t, label) for t in terms(text))
                if len(seen) > TALLY:
                    yield _tallied(seen)
                    seen.clear()
        yield _tallied(seen)

    counts = rows.select("_text", "_label").repartition(PARTS).transform(in_small_batches).mapInArrow(tally, "term string, label int, n long").groupBy("term").agg(F.sum("n").cast("double").alias("df"), F.sum(F.col("n") * F.col("label")).cast("double").alias("df1"))
    found = counts.orderBy("term").toArrow()  # no more than the sample's terms
    chosen_terms = vocabulary(found["term"].to_pylist(), float(n), float(n1), found["df"].to_numpy(), found["df1"].to_numpy())
    del found
    shared = spark.sparkContext.broadcast(chosen_terms[0])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Model(vocabulary=shared.value)
        for batch in freed(batches):
            got = [reader.count(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *(pa.array([g[k] for g in got], pa.list_(pa.int32())) for k in (0, 1))], ["id", "label", "have", "n"])

    kind = rows.schema["_id"].dataType.simpleString()
    counted = in_small_batches(rows).mapInArrow(read, f"id {kind}, label int, have array<int>, n array<int>").orderBy("id", "label", "have", "n").toArrow().combine_chunks()
    have, times = ([x.values.to_numpy() for x in counted[c]] for c in ("have", "n"))
    discard(rows)
    shared.unpersist()
    return build(*chosen_terms, list(zip(have, times, strict=True)), counted["label"].to_pylist(), counted["id"].to_pylist())


def _tallied(seen: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([k[0] for k in seen], pa.string()), pa.array([k[1] for k in seen], pa.int32()), pa.array(list(seen.values()), pa.int64())], ["term", "label", "n"])


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """(id, held_out, score, predicted, evidence): one row a document."""
    model = fit_on(docs, labels, id_col, text_col, label_col)
    rows = score_texts(docs.select(F.col(id_col), F.col(text_col).alias("_text")), model, "_text")
    return rows.select(id_col, (crc_mod(F.col(id_col), 4) == 2).alias("held_out"), "score", (F.col("score") >= TOXIC_AT).cast("int").alias("predicted"), "evidence")


def without_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """The documents that are not predicted toxic, all columns kept."""
    model = fit_on(docs, labels, id_col, text_col, label_col)
    places = [f"c{i}" for i in range(len(docs.columns))]  # the columns' own names may clash with the score's
    rows = score_texts(docs.toDF(*places), model, places[docs.columns.index(text_col)]).filter(F.col("score") < TOXIC_AT)
    return rows.select(*places).toDF(*docs.columns)
