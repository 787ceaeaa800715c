from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from jobloom.llm import toxicity
from tests.llm.fixtures import rows, table


def corpus(n=600, seed=4):
    rnd = random.Random(seed)
    plain = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(3, 8))) for _ in range(300)]
    bad = ["zorgle", "blenkish", "quarpous"]
    texts, labels = [], []
    for _ in range(n):
        toxic = rnd.random() < 0.2
        w = [rnd.choice(plain) for _ in range(rnd.randint(5, 60))]
        if toxic:
            for _ in range(rnd.randint(1, 4)):
                w[rnd.randrange(len(w))] = rnd.choice(bad) + rnd.choice(["", "s", "ing"])
        texts.append(" ".join(w))
        labels.append(int(toxic))
    return texts, labels


@pytest.fixture(scope="module")
def model():
    return toxicity.fit(*(x[:400] for x in corpus()))


def test_neighbours_are_exact(model):
    texts, _ = corpus()
    vectors = [model.vector(*model.count(t)) for t in texts[:400]]
    dense = np.zeros((400, len(model.vocabulary)))
    for i, (at, w) in enumerate(vectors):
        dense[i, at] = w
    for t in texts[400:]:
        at, w = model.vector(*model.count(t))
        q = np.zeros(dense.shape[1])
        q[at] = w
        sims = dense @ q
        want = [i for i in np.lexsort((np.arange(400), -np.round(sims, 12))) if sims[i] > 0][: toxicity.NEIGHBOURS]
        ids, got = model.nearest(at, w)
        assert ids.tolist() == want and np.allclose(got, sims[want])


def test_held_out_accuracy_and_calibration(model):
    texts, labels = corpus()
    scores = np.array([model.score(t)[0] for t in texts[400:]])
    y = np.array(labels[400:])
    assert ((scores >= toxicity.TOXIC_AT) == (y == 1)).mean() > 0.97
    assert abs(scores.mean() - y.mean()) < 0.05 and scores.min() >= 0 and scores.max() <= 1


def plain_scores(train, labels, texts):
    """Scores without an index: every cosine of every pair, term by term."""
    n, n1 = len(train), sum(labels)
    bags = []
    for text in [*train, *texts]:
        bag = Counter()
        for word in re.findall(r"[^\W\d_]+", text.lower()):
            bag.update([word, *(word[:k] + "*" for k in (4, 5, 6) if len(word) > k)])
        bags.append(bag)
    weight = {}
    for t in set().union(*bags[:n]):
        a = sum(1 for b, y in zip(bags, labels, strict=False) if y and t in b)
        d = sum(1 for b in bags[:n] if t in b)
        b, c, e = d - a, n1 - a, n - n1 - (d - a)
        value = n * (a * e - b * c) ** 2 / ((a + b) * (c + e) * (a + c) * (b + e) + 1e-9)
        share = max(0.2, min(1.0, value / 30)) if a * e > b * c else 0.2
        if share > 0.2 or not t.endswith("*"):
            weight[t] = (math.log((1 + n) / (1 + d)) + 1) * share
    vectors = []
    for bag in bags:
        v = {t: m * weight[t] for t, m in bag.items() if t in weight}
        size = math.sqrt(sum(x * x for x in v.values())) or 1.0
        vectors.append({t: x / size for t, x in v.items()})

    def vote(v, without=-1):
        sims = [(sum(x * u.get(t, 0.0) for t, x in v.items()), -i) for i, u in enumerate(vectors[:n]) if i != without]
        near = sorted((x for x in sims if x[0] > 0), reverse=True)[:25]
        return sum(x * labels[-i] for x, i in near) / sum(x for x, _ in near) if near else None

    hits, size = [0] * 10, [0] * 10
    for i in range(n):
        if (v := vote(vectors[i], i)) is not None:
            hits[min(int(v * 10), 9)] += labels[i]
            size[min(int(v * 10), 9)] += 1
    mean = lambda i, j: sum(hits[k] + (k + 0.5) / 10 for k in range(i, j + 1)) / sum(size[k] + 1 for k in range(i, j + 1))
    bins = [max(min(mean(i, j) for j in range(k, 10)) for i in range(k + 1)) for k in range(10)]
    return [float(np.interp(vote(v), (np.arange(10) + 0.5) / 10, bins)) for v in vectors[n:]]


def test_scores_equal_a_plain_version(model):
    texts, labels = corpus()
    got = [model.score(t)[0] for t in texts[400:460]]
    assert np.allclose(got, plain_scores(texts[:400], labels[:400], texts[400:460]), atol=1e-5)


def test_every_text_is_searched(model):
    texts, labels = corpus()
    clean = [t for t, y in zip(texts[400:], labels[400:], strict=True) if not y]
    assert all(len(model.score(t)[1]) == toxicity.NEIGHBOURS for t in clean) and max(model.score(t)[0] for t in clean) < toxicity.TOXIC_AT


def test_ids_that_repeat_stay_within_the_bound(spark):
    texts, labels = corpus(60)
    docs = spark.createDataFrame([(i % 20, t) for i, t in enumerate(texts)], "doc_id long, text string")
    lab = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, toxic int")
    assert len(toxicity.fit_on(docs, lab, limit=12).labels) <= 12


def test_chance_hits_in_long_texts_score_low(model):
    plain = " ".join(corpus(40, 9)[0])
    assert model.score("zorgle blenkish quarpous zorgles")[0] > 0.8
    assert model.score(plain.replace("zorgle", "x").replace("blenkish", "x").replace("quarpous", "x") + " zorgle")[0] <= model.score("zorgle")[0]


def test_degenerate_models():
    assert toxicity.fit([], []).score("anything") == (0.0, [])
    assert toxicity.fit(["a", "b"], [1, 1]).score("a") == (1.0, [])
    assert toxicity.fit(["same"] * 4, [0, 1, 0, 1]).score("same")[0] == 0.5


def test_columns_and_split(spark):
    texts, labels = corpus()
    data = [(i, t, "en", "s", 1, 1, "x", "y") for i, t in enumerate(texts)]
    lab = spark.createDataFrame([(i, int(y)) for i, y in enumerate(labels)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity(table(spark, data), lab).collect()}
    assert len(got) == len(data)
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i in got)
    held = [i for i in got if got[i].held_out]
    assert np.mean([got[i].predicted == labels[i] for i in held]) > 0.95
    kept = toxicity.without_toxic(table(spark, data), lab)
    assert kept.columns == table(spark, data).columns
    assert {r.doc_id for r in kept.collect()} == {i for i in got if not got[i].predicted}


def test_cluster_and_driver_fit_the_same_model(spark):
    texts, labels = corpus()
    data = [(i, t, "en", "s", 1, 1, "x", "y") for i, t in enumerate(texts)]
    lab = spark.createDataFrame([(i, int(y)) for i, y in enumerate(labels)], "doc_id long, toxic int")
    train = [i for i in range(len(texts)) if zlib.crc32(str(i).encode()) % 4 != 2]
    a, b = toxicity.fit_on(table(spark, data), lab), toxicity.fit([texts[i] for i in train], [labels[i] for i in train])
    assert a.vocabulary == b.vocabulary and np.allclose(a.weights, b.weights) and np.allclose(a.bins, b.bins) and a.prior == b.prior
    named = lambda got: (got[0], [{**e, "example": str(train[int(e["example"])])} for e in got[1]])
    assert all(a.score(t) == named(b.score(t)) for t in texts)
    # what the cluster returns is what the plain model gives, evidence included
    got = {r.doc_id: (r.score, [e.asDict() for e in r.evidence]) for r in toxicity.toxicity(table(spark, data), lab).collect()}
    assert got == {i: named(b.score(t)) for i, t in enumerate(texts)} and any(e for _, e in got.values())


def test_edge_rows(spark):
    lab = spark.createDataFrame([(1, 1), (2, 0), (3, None), (None, 1)], "doc_id long, toxic int")
    got = toxicity.toxicity(table(spark), lab).collect()
    assert len(got) == len(rows()) and all(0 <= r.score <= 1 for r in got)
    assert toxicity.toxicity(table(spark, []), lab).count() == 0
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.score for r in toxicity.toxicity(table(spark), none).collect()} == {0.0}


def test_samples_without_words(spark):
    docs = spark.createDataFrame([(i, None if i % 2 else "") for i in range(40)] + [(100, "some words")], "doc_id long, text string")
    lab = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(40)], "doc_id long, toxic int")
    got = toxicity.toxicity(docs, lab).collect()
    assert len(got) == 41 and len({r.score for r in got}) == 1 and 0 < got[0].score < 1 and not any(r.evidence for r in got)
