from __future__ import annotations

import zlib

import duckdb
import numpy as np

import corpus_pipeline as cp
from jobloom.llm import decontam, mixing, toxicity
from jobloom.llm.neardup import near_duplicates
from jobloom.llm.queries import word_tokenizer
from tests.llm.test_neardup import brute


def test_stages_follow_each_other(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, before = docs.columns, docs.count()
    counts = []
    for name, stage in cp.STAGES[:-1]:
        docs = cp.materialize(stage(spark, docs, sf), f"test-{name}")
        assert docs.columns == columns
        counts.append(docs.count())
        if name == "near_dedup":
            assert near_duplicates(docs).select("component_id").distinct().count() == counts[-1]
    assert counts[0] < before and counts[1] < counts[0] and counts[2] <= counts[1]
    out = cp.STAGES[-1][1](spark, docs, sf).collect()
    assert len(out) == counts[3] and {r.doc_id for r in out} <= {r.doc_id for r in docs.collect()}
    start = 0
    for r in sorted(out, key=lambda r: r.start):
        assert r.start == start
        start += r.n_tokens


def test_run_matches_stages(spark, sf):
    a, b = (sorted(map(tuple, cp.run(spark, sf).collect())) for _ in range(2))
    assert a == b and a


def test_run_matches_a_plain_version(spark, sf):
    """Each stage again without Spark's operators: scores one by one, all pairs of sets, SQL, and the tokenizer's own encoding."""
    from tokenizers import Tokenizer

    model = toxicity.fit_on(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))
    duck = duckdb.connect()
    duck.execute(f"create view benchmark as select * from read_parquet('{sf}/benchmark.parquet')")
    docs = duck.execute(f"select doc_id, text, lang, source, n_chars from read_parquet('{sf}/documents.parquet')").fetchall()
    docs = [r for r in docs if model.score(r[1] or "")[0] < toxicity.TOXIC_AT]
    docs = sorted(docs)
    chosen = {i for i, n, c in brute(docs, 5) if i == c}
    docs = [r for r in docs if r[0] in chosen]

    def keep(sql: str) -> list[tuple]:
        duck.execute("create or replace table documents (doc_id bigint, text varchar, lang varchar, source varchar, n_chars bigint)")
        duck.executemany("insert into documents values (?, ?, ?, ?, ?)", docs)
        return duck.execute(sql).fetchall()

    clean = {r[0] for r in keep(f"select doc_id from ({decontam.ORACLE}) where not contaminated")}
    docs = [r for r in docs if r[0] in clean]
    copies = {i: taken // size for i, size, taken in keep(f"select doc_id, size, taken from ({mixing.ORACLE}) where size > 0")}
    tok, want, start = Tokenizer.from_file(word_tokenizer()), [], 0
    for r in sorted(docs):
        for _ in range(copies.get(r[0], 0)):
            ids = np.array([*tok.encode(r[1], add_special_tokens=False).ids, 1], "<u4")
            want.append((r[0], start, len(ids), zlib.crc32(ids.tobytes())))
            start += len(ids)
    assert sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in cp.run(spark, sf).collect()) == sorted(want)


def test_names():
    assert [n for n, _ in cp.STAGES] == ["toxicity", "near_dedup", "decontamination", "mixing", "token_output"]
