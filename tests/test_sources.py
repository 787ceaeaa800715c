from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from jobloom.functions import scalars as S
from jobloom.sources import documents, ledger, records, writer

LADDER = [128, 256, 512]


def doc(name, seqs, seeds=(1,), **more):
    return json.dumps({"name": name, "modelSeeds": list(seeds), "sequences": seqs, **more})


def protein(n, ids="A", mods=()):
    return {"protein": {"id": ids, "sequence": "A" * n, "modifications": [{"ptmType": m, "ptmPosition": 1} for m in mods]}}


@pytest.fixture
def folder(tmp_path):
    files = {
        "a.json": doc("one job", [protein(76)]),
        "b.json": doc("ONE_JOB", [protein(9)]),
        "c.json": doc("copies", [protein(4, ["A", "B"])], seeds=(3, 4)),
        "d.json": doc("ions", [protein(149), {"ligand": {"id": ["B", "C", "D", "E"], "ccdCodes": ["CA"]}}]),
        "e.json": doc("mods", [protein(50, mods=["TPO", "PTR", "MSE"])]),
        "f.json": doc("unknown", [protein(50, mods=["XYZ"]), {"ligand": {"id": "B", "smiles": "CCO"}}]),
        "g.json": "[1, 2]",
        "h.json": "{not json",
        "i.json": doc("..", [protein(5)]),
        "j.json": doc("###", [protein(5)]),
        "k.json": json.dumps({"name": "noseeds", "sequences": []}),
        "l.json": json.dumps({"modelSeeds": [1]}),
        "m.txt": "ignored",
    }
    for k, v in files.items():
        (tmp_path / k).write_text(v)
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "n.json").write_text(doc("hidden", [protein(5)]))
    return str(tmp_path)


def test_scan(spark, folder):
    jobs, rejects = documents.scan(spark, folder, LADDER)
    got = {r.job_id: (r.tokens, r.exact, r.bucket, list(r.seeds)) for r in jobs.collect()}
    assert got == {
        "one_job": (76, True, 128, [1]),
        "copies": (8, True, 128, [3, 4]),
        "ions": (153, True, 256, [1]),
        "mods": (78, True, 128, [1]),
        "unknown": (50 + 19 + 20, False, 128, [1]),
    }
    why = {r.path.rsplit("/", 1)[1]: r.reason for r in rejects.collect()}
    assert why == {"b.json": "name is taken", "g.json": "not a JSON object", "h.json": "not a JSON object", "i.json": "unusable name", "j.json": "unusable name", "k.json": "missing seeds", "l.json": "missing name"}


def test_seed_expansion_and_resume(spark, folder):
    jobs, rejects = documents.scan(spark, folder, LADDER, num_seeds=3)
    assert list(jobs.filter("job_id = 'ions'").first().seeds) == [1, 2, 3]
    assert "one seed is needed to expand" in {r.reason for r in rejects.collect()}
    sha = {r.job_id: r.sha256 for r in documents.scan(spark, folder, LADDER)[0].collect()}
    state = spark.createDataFrame([("one_job", "done", sha["one_job"]), ("copies", "done", "old"), ("ions", "failed", sha["ions"]), ("mods", "locked", "")], "job_id string, status string, sha256 string")
    left = lambda retry: sorted(r.job_id for r in documents.scan(spark, folder, LADDER, state, retry_failed=retry)[0].collect())
    assert left(False) == ["copies", "unknown"] and left(True) == ["copies", "ions", "unknown"]


def test_record_files(spark, tmp_path):
    (tmp_path / "r.fasta").write_text("\n>one first\nACD\nEFG\n\n>two\n>three x\nA\n")
    got = [(r.id_hint, r.payload, r.description, r.line) for r in records.read_records(spark, str(tmp_path / "r.fasta")).orderBy("line").collect()]
    assert got == [("one", "ACDEFG", "one first", 2), ("two", "", "two", 6), ("three", "A", "three x", 7)]
    (tmp_path / "l.smi").write_text("# comment\nCCO ethanol\n\nC\n")
    assert [(r.id_hint, r.payload) for r in records.read_records(spark, str(tmp_path / "l.smi")).orderBy("line").collect()] == [("ethanol", "CCO"), ("lig4", "C")]
    (tmp_path / "t.csv").write_text("ID,Sequence,SMILES,CCD_codes,Type,Count\np,ACD,,,RNA,2\nq,,CCO,,,\nr,,,ATP,ligand,1\n")
    assert [(r.kind, r.payload, r["count"]) for r in records.read_records(spark, str(tmp_path / "t.csv")).orderBy("id_hint").collect()] == [("rna", "ACD", 2), ("ligand", "CCO", 1), ("ligand", "ATP", 1)]
    for bad in ("x,ACD,CCO,,,1", "x,ACD,,,peptide,1", "x,ACD,,,,0", "x,ACD,,,,1.5", "x,,,,,1"):
        (tmp_path / "bad.csv").write_text("id,sequence,smiles,ccd_codes,type,count\n" + bad + "\n")
        with pytest.raises(Exception):  # noqa: B017
            records.read_records(spark, str(tmp_path / "bad.csv")).collect()
    with pytest.raises(ValueError):
        records.read_records(spark, "x.pdb")


def test_expand(spark):
    rows = spark.createDataFrame([("protein", "p q", 'AC"D', "", 2, 1), ("ligand", "z", "CC=O", "", 1, 2), ("ligand", "z", "ATP, MG", "", 1, 3)], "kind string, id_hint string, payload string, description string, count int, line int")
    template = json.dumps({"name": "base", "modelSeeds": [1], "sequences": [protein(3, "A")]})
    got = {r.name: json.loads(r.document)["sequences"][-1] for r in records.expand(template, ["A"], "base", rows).collect()}
    assert got["base__p_q"]["protein"]["id"] == ["B", "C"] and got["base__p_q"]["protein"]["sequence"] == 'AC"D'
    assert got["base__z"]["ligand"] == {"id": "B", "smiles": "CC=O"} and got["base__z_2"]["ligand"] == {"id": "B", "ccdCodes": ["ATP", "MG"]}


def test_manifests(spark, tmp_path):
    rows = [(0, 128, False, "a", 100, 1), (0, 128, False, "b", 90, 2), (0, 256, False, "c", 200, 1), (1, 128, True, "a", 100, 1)]
    placed = spark.createDataFrame(rows, "slot long, shape long, shared boolean, job_id string, tokens long, n_seeds long")
    ledger.write_manifests(placed, str(tmp_path))
    got = sorted((r.slot, r.shape, r.shared, r.job_id, r.tokens, r.n_seeds) for r in ledger.read_manifests(spark, str(tmp_path)).collect())
    assert got == sorted(rows)


def test_measurements(spark, tmp_path):
    (tmp_path / "m.json").write_text('{"gpu_key":"k","host":"h","t_ms":[1000,200,180,220],"contaminated":true}\n{"gpu_key":"k2","t_ms":[1,2]}\nnot json\n{"t_ms":[1,1,1,1]}\n')
    r = ledger.read_measurements(spark, str(tmp_path / "m.json")).collect()
    assert [(x.gpu_key, x.s_ms, x.r_ms, x.contaminated) for x in r] == [("k", 200.0, 800.0, False)]


def test_scalars(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert [one(S.base26(F.lit(n))) for n in (0, 1, 26, 27, 52, 702, 703)] == [None, "A", "Z", "AA", "AZ", "ZZ", "AAA"]
    assert one(S.free_ids(F.array(F.lit("A"), F.lit("B")), F.lit(2))) == ["C", "D"]
    rungs = F.array(*(F.lit(x).cast("bigint") for x in (128, 256)))
    assert [one(S.bucket_for(F.lit(n).cast("bigint"), rungs)) for n in (1, 128, 129, 6000)] == [128, 128, 256, 6000]
    assert one(S.near_boundary(F.lit(122).cast("bigint"), rungs, 0.05)) and not one(S.near_boundary(F.lit(76).cast("bigint"), rungs, 0.05))
    assert one(S.gaps(F.array(*map(F.lit, (False, True, False, False, True, True))))) == [1, 2, 0]
    assert [one(S.exit_code(F.lit(c))) for c in (0, 3, -9)] == [0, 3, 137]
    with pytest.raises(Exception):  # noqa: B017
        one(S.bucket_for(F.lit(-1).cast("bigint"), rungs))


def test_records_across_byte_ranges(spark, tmp_path):
    """Small ranges cut lines and records; numbers and texts are those of the whole file."""
    text, want, line = "", [], 1
    for k in range(60):
        body = ["ACDEFGHIKL"[: 1 + (k + j) % 10] for j in range(k % 7)]
        text += f">rec{k} of {k}\n" + "".join(b + "\n" for b in body) + ("\n" if k % 3 == 0 else "")
        want.append((f"rec{k}", "".join(body), line))
        line += 1 + len(body) + (k % 3 == 0)
    (tmp_path / "big.fasta").write_text(text)
    (tmp_path / "big.smi").write_text("".join(f"C{'C' * (k % 9)} n{k} rest\n" if k % 4 else "O\n" for k in range(80)))
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    old = [spark.conf.get(n) for n in names]
    for n, v in zip(names, ("200", "0"), strict=True):
        spark.conf.set(n, v)
    try:
        assert spark.read.text(str(tmp_path / "big.fasta")).rdd.getNumPartitions() >= 4
        got = records.read_records(spark, str(tmp_path / "big.fasta"), "rna").orderBy("line").collect()
        assert [(r.id_hint, r.payload, r.line) for r in got] == want and {r.kind for r in got} == {"rna"}
        smi = records.read_records(spark, str(tmp_path / "big.smi")).orderBy("line").collect()
        assert [(r.id_hint, r.line) for r in smi] == [(f"n{k}" if k % 4 else f"lig{k + 1}", k + 1) for k in range(80)]
    finally:
        for n, v in zip(names, old, strict=True):
            spark.conf.set(n, v)
    (tmp_path / "e.fasta").write_text("")
    assert records.read_records(spark, str(tmp_path / "e.fasta")).collect() == []
    with pytest.raises(ValueError, match="ligand"):
        records.read_fasta(spark, str(tmp_path / "big.fasta"), "ligand")
    (tmp_path / "bad.fasta").write_text("ACD\n>x\n")
    with pytest.raises(Exception, match="before the first header"):
        records.read_records(spark, str(tmp_path / "bad.fasta")).collect()


def test_documents_are_written_and_wrong_records_reported(spark, tmp_path):
    spark.dataSource.register(writer.DocumentSink)
    rows = [(f"n{k}", json.dumps({"k": k}), k) for k in range(20)] + [("bad", "{", 20), ("list", "[1]", 21), (None, "{}", 22), ("none", None, 23), ("../up", "{}", 24), ("_hidden", "{}", 25)]
    df = spark.createDataFrame(rows, "name string, document string, line int").repartition(3)
    out = tmp_path / "out"

    def save(rows, mode="append", **options):
        w = rows.write.format("documents").option("path", str(out)).mode(mode)
        for k, v in options.items():
            w = w.option(k, v)
        w.save()

    save(df)
    found = {p.stem: json.loads(p.read_text()) for p in out.glob("part-*/n*.json")}
    assert found == {f"n{k}": {"k": k} for k in range(20)} and len(list(out.glob("part-*"))) == 3
    report = json.loads((out / "_report.json").read_text())
    assert (report["written"], report["wrong"]) == (20, 6)
    errors = {e["line"]: e["error"] for p in out.glob("part-*/_errors.jsonl") for e in map(json.loads, p.read_text().splitlines())}
    assert set(errors) == set(range(20, 26)) and errors[21] == "not a JSON object" and errors[25] == "unusable name"
    before = sorted(p.name for p in out.rglob("*"))
    with pytest.raises(Exception, match="not a JSON object|not JSON|no document|unusable name"):
        save(df, strict="true")
    assert sorted(p.name for p in out.rglob("*")) == before
    with pytest.raises(Exception, match="no column"):
        save(df.select("name"))
    save(df.filter("line < 2"), mode="overwrite")
    assert sorted(p.stem for p in out.glob("part-*/*.json")) == ["n0", "n1"]
    jobs, _ = documents.scan(spark, str(out / "part-*"), LADDER)
    assert jobs.count() == 0  # these documents have no jobs' fields


def test_templates_are_checked_and_expanded_documents_scan(spark, tmp_path):
    from jobloom import api

    for text, why in (("[1]", "JSON object"), ('{"name": "x"}', "modelSeeds"), ('{"modelSeeds": [1], "sequences": 3}', "a list")):
        (tmp_path / "t.txt").write_text(text)
        with pytest.raises(ValueError, match=why):
            records.read_template(spark, str(tmp_path / "t.txt"))
    template = {"name": "base", "modelSeeds": [7], "dialect": "x", "sequences": [protein(3, ["A", "C"]), 5, {}, {"rna": "odd"}, {"ligand": {"id": 4}}]}
    assert records.used_ids(template) == ["4", "A", "C"]
    template["sequences"] = [protein(3, ["A", "C"])]
    (tmp_path / "t.txt").write_text(json.dumps(template))
    rows = [("protein", "p", "ACD", "", 2, 1), ("protein", "p", "AC", "", 1, 2), ("protein", "p 2", "A", "", 1, 3), ("protein", 'q"', "A", "", 1, 4)]
    recs = spark.createDataFrame(rows, "kind string, id_hint string, payload string, description string, count int, line int")
    made = records.expand(records.read_template(spark, str(tmp_path / "t.txt")), None, "base", recs)
    got = {r.line: json.loads(r.document) for r in made.collect()}
    assert [got[k]["name"] for k in (1, 2, 3)] == ["base__p", "base__p_2", "base__p_2_2"]
    assert got[1]["sequences"][-1]["protein"]["id"] == ["B", "D"] and got[2]["sequences"][-1]["protein"]["id"] == "B"
    assert all(d["modelSeeds"] == [7] and d["dialect"] == "x" and d["sequences"][0] == protein(3, ["A", "C"]) for d in got.values())
    api.write_documents(made, str(tmp_path / "out"))
    jobs, rejects = documents.scan(spark, str(tmp_path / "out" / "part-*"), LADDER)
    assert {r.tokens for r in jobs.collect()} == {6 + 6, 6 + 2, 6 + 1} and rejects.count() == 0


def test_timing_tables_by_name(spark, tmp_path):
    from jobloom import api
    from jobloom.functions.timing import Timing, TimingTables, read_timing, table_array

    (tmp_path / "t.csv").write_text("note,Compilation_modifier,Bucket_size,Inference_modifier\nx,0.5,128,0.1\ny,1.0,64,0.05\n")
    tables = TimingTables(spark, {"fast": str(tmp_path / "t.csv"), "own": spark.createDataFrame([(10, 1.0, 2.0, "z")], "bucket long, inf double, comp double, more string")})
    assert tables.names() == ["default", "fast", "own"]
    assert table_array(tables.table("fast")) == [(64, 0.05, 1.0), (128, 0.1, 0.5)]
    assert table_array(tables.table("own")) == [(10, 1.0, 2.0)] and len(table_array(tables.table("default"))) == 80
    with pytest.raises(ValueError, match="no timing table 'slow'; there are default, fast, own"):
        tables.table("slow")
    jobs = spark.createDataFrame([("a", 60, 1), ("b", 100, 2)], "job_id string, tokens long, n_seeds long")
    executors = spark.createDataFrame([(0, 0, 0, 1000)], "slot long, kind long, compile_us long, infer_us long")
    assert {(r.job_id, r["shape"]) for r in api.plan(jobs, executors, tables.table("fast")).collect()} == {("a", 64), ("b", 128)}
    assert spark.range(1).select(Timing(table_array(tables.table("fast"))).inference_us(F.lit(1000), F.lit(64).cast("long")).alias("x")).first().x == 50
    for text, why in (("Bucket_size,Inference_modifier\n1,2\n", "Compilation_modifier"), ("Bucket_size,Inference_modifier,Compilation_modifier\n1.5,1,1\n", "no timing"), ("Bucket_size,Inference_modifier,Compilation_modifier\n64,1,1\n64,2,2\n", "more than one"), ("Bucket_size,Inference_modifier,Compilation_modifier\n64,nan,1\n", "no timing")):
        (tmp_path / "bad.csv").write_text(text)
        with pytest.raises(Exception, match=why):
            read_timing(spark, str(tmp_path / "bad.csv")).collect()


def test_only_clean_measurements_are_kept(spark, tmp_path):
    schema = "gpu_key string, host string, t_ms array<double>, at double"
    clean, noisy = [1000.0, 200.0, 180.0, 220.0], [500.0, 400.0, 100.0, 200.0]
    first = spark.createDataFrame([("a", "h", clean, 1.0), ("b", "h", noisy, 1.0), ("c", "h", [1.0, 2.0], 1.0), (None, "h", clean, 1.0), ("d", None, clean, 2.0), ("e", "h", [1.0, None, 1.0, 1.0], 1.0)], schema)
    path = str(tmp_path / "cache")
    for _ in range(2):
        assert [r.gpu_key for r in ledger.cache_measurements(first, path, 0).collect()] == ["b"]
    ledger.cache_measurements(spark.createDataFrame([("a", "h", [10.0, 10.0, 100.0, 100.0], 5.0), ("d", None, noisy, 9.0)], schema), path, 1)
    cached = ledger.cached_measurements(spark, path)
    assert sorted((r.gpu_key, r.s_ms, r.contaminated) for r in cached.collect()) == [("a", 100.0, False), ("d", 200.0, False)]
    executors = spark.createDataFrame([(0, "K", "a"), (1, "K", "x"), (2, "L", "y"), (3, "M", "d")], "slot long, kind string, gpu_key string")
    got = {r.slot: (r.s_ms, r.origin) for r in ledger.reused_measurements(executors, cached).collect()}
    assert got == {0: (100.0, "own"), 1: (100.0, "kind"), 2: (None, "none"), 3: (200.0, "own")}


def test_rankings_and_best_results(spark, tmp_path):
    rows = [("a", 1, 0, 0.5), ("a", 1, 1, 0.9), ("a", 2, 0, 0.9), ("b", 1, 0, float("nan")), ("b", 2, 0, -1.0), ("c", 1, 0, None)]
    results = spark.createDataFrame(rows, "job string, seed int, sample int, ranking_score double").repartition(3)
    assert sorted(tuple(r) for r in ledger.best_results(results).collect()) == [("a", 1, 1, 0.9), ("b", 2, 0, -1.0), ("c", 1, 0, None)]
    for _ in range(2):
        ledger.write_rankings(results, str(tmp_path))
    text = "".join(p.read_text() for p in sorted((tmp_path / "rankings" / "job=a").glob("*.csv")))
    assert text.replace("seed,sample,ranking_score\n", "").splitlines() == ["1,0,0.5", "1,1,0.9", "2,0,0.9"]
