"""Job documents: JSON files read as bytes once, parsed, checked, sized, deduplicated."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobloom.functions import scalars as S

SEQUENCE = "array<variant>"
POLYMERS = (("protein", "ptmType"), ("rna", "modificationType"), ("dna", "modificationType"))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of the ``*.json`` files of a folder, not of its subfolders, or of one file.

    Spark's file source skips names that begin with ``_`` or ``.``.
    """
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(path).select("path", "content")


def _codes(seq: Column, kind: str, key: str) -> Column:
    """The codes of a polymer's modifications, '' where one has none."""
    mods = F.coalesce(F.try_variant_get(seq, f"$.{kind}.modifications", "array<variant>"), F.array().cast("array<variant>"))
    return F.transform(mods, lambda m: F.coalesce(F.try_variant_get(m, f"$.{key}", "string"), F.lit("")))


def _sequence_tokens(seq: Column) -> Column:
    """(tokens, exact) of one single-key entity object."""
    ids = lambda kind: F.coalesce(F.size(F.try_variant_get(seq, f"$.{kind}.id", "array<string>")), F.lit(1))
    out = F.struct(F.lit(0).alias("tokens"), F.lit(True).alias("exact"))
    ccd = F.try_variant_get(seq, "$.ligand.ccdCodes", "array<string>")
    atoms = F.create_map(*(F.lit(x) for kv in S.ATOM_COUNTS.items() for x in kv))
    n_ligand = F.when(ccd.isNotNull(), F.aggregate(ccd, F.lit(0), lambda n, c: n + F.coalesce(F.try_element_at(atoms, c), F.lit(S.UNKNOWN_ATOMS)))).otherwise(S.UNKNOWN_ATOMS)
    ligand = F.struct((n_ligand * F.greatest(ids("ligand"), F.lit(1))).cast("int").alias("tokens"), F.coalesce(F.forall(ccd, lambda c: F.try_element_at(atoms, c).isNotNull()), F.lit(False)).alias("exact"))
    out = F.when(F.try_variant_get(seq, "$.ligand", "variant").isNotNull(), ligand).otherwise(out)
    for kind, key in POLYMERS:
        extra = S.modification_extra(_codes(seq, kind, key))
        n = (F.coalesce(F.length(F.try_variant_get(seq, f"$.{kind}.sequence", "string")), F.lit(0)) + extra["extra"]) * F.greatest(ids(kind), F.lit(1))
        out = F.when(F.try_variant_get(seq, f"$.{kind}", "variant").isNotNull(), F.struct(n.cast("int").alias("tokens"), extra["exact"].alias("exact"))).otherwise(out)
    return out


def parse_documents(files: DataFrame, ladder: list[int], num_seeds: int | None = None) -> DataFrame:
    """(path, job_id, sha256, tokens, bucket, seeds, exact, reason): the first failing rule is the reason."""
    text = F.col("content").cast("string")
    rows = files.select("path", F.sha2("content", 256).alias("sha256"), F.try_parse_json(text).alias("v"))
    get = lambda p, t: F.try_variant_get("v", p, t)
    rows = rows.select("path", "sha256", "v", get("$.name", "string").alias("name"), get("$.modelSeeds", "array<bigint>").alias("given"), get("$.sequences", SEQUENCE).alias("seqs"))
    rows = rows.withColumn("job_id", S.sanitise(F.col("name")))
    one = F.size("given") == 1
    seeds = F.when(one, F.sequence(F.element_at("given", 1), F.element_at("given", 1) + (num_seeds or 1) - 1)).otherwise(F.col("given"))
    reason = (
        F.when(F.col("v").isNull() | ~F.coalesce(F.schema_of_variant("v").startswith("OBJECT"), F.lit(False)), "not a JSON object")
        .when(F.col("name").isNull() | (F.col("name") == ""), "missing name")
        .when(~S.usable_id(F.col("job_id")), "unusable name")
        .when(F.col("given").isNull() | (F.size("given") == 0), "missing seeds")
        .when(F.lit(num_seeds is not None) & ~one, "one seed is needed to expand")
    )
    sizes = F.transform(F.coalesce("seqs", F.array().cast(SEQUENCE)), _sequence_tokens)
    tokens = F.aggregate(sizes, F.lit(0).cast("bigint"), lambda n, s: n + s["tokens"])
    rungs = F.array(*(F.lit(x).cast("bigint") for x in ladder))
    return rows.select("path", "job_id", "sha256", tokens.alias("tokens"), seeds.alias("seeds"), F.forall(sizes, lambda s: s["exact"]).alias("exact"), reason.alias("reason")).withColumn("bucket", S.bucket_for(F.col("tokens"), rungs))


def scan(spark: SparkSession, path: str, ladder: list[int], state: DataFrame | None = None, num_seeds: int | None = None, retry_failed: bool = False) -> tuple[DataFrame, DataFrame]:
    """(jobs in canonical order, rejects): parse, reject, first path wins a name, skip what earlier runs settled.

    ``state``: (job_id, status, sha256) of earlier runs.  A done job with other
    content runs again; names are claimed before the skip, so a finished job
    still blocks later duplicates.
    """
    parsed = parse_documents(read_documents(spark, path), ladder, num_seeds)
    good = parsed.filter("reason is null")
    first = good.groupBy(F.lower("job_id").alias("low")).agg(F.min("path").alias("first"))
    marked = good.withColumn("low", F.lower("job_id")).join(first, "low")
    jobs = marked.filter(F.col("path") == F.col("first")).drop("low", "first", "reason")
    clash = marked.filter(F.col("path") != F.col("first")).select("path", F.lit("name is taken").alias("reason"))
    if state is not None:
        s = state.select("job_id", "status", F.col("sha256").alias("old"))
        settled = ((F.col("status") == "done") & (F.col("old") == F.col("sha256"))) | (F.lit(not retry_failed) & (F.col("status") == "failed")) | (F.col("status") == "locked")
        jobs = jobs.join(s, "job_id", "left").filter(~F.coalesce(settled, F.lit(False))).drop("status", "old")
    rejects = parsed.filter("reason is not null").select("path", "reason").unionByName(clash)
    return jobs.orderBy("bucket", "tokens", "job_id", "sha256"), rejects.orderBy("path")
