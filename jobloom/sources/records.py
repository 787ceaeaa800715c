"""Record files (FASTA, SMILES, CSV, TSV) and the documents made from them."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobloom.functions import scalars as S
from jobloom.operators.naming import unique_names
from jobloom.operators.running import running_totals

KINDS = ("protein", "rna", "dna", "ligand")


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, block, at, text, one): the lines of text files of any size.

    Spark's text source cuts large files into byte ranges and gives each line
    to the range in which it begins; (block, at) orders a file's lines: the
    range's first byte, and the line's place in its task.
    """
    raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value")
    return raw.select("path", "block", "at", F.trim("value").alias("text"), F.lit(1).cast("bigint").alias("one"))


def read_fasta(spark: SparkSession, path: str, kind: str = "protein") -> DataFrame:
    """(kind, id_hint, payload, description, count, line): a record starts at each ``>``; text before the first is an error.

    Records and lines are numbered by running sums over all ranges of a file,
    so a record may lie across any number of them; its own lines meet in one row.
    """
    if kind not in KINDS or kind == "ligand":
        raise ValueError(f"no sequences of kind {kind}")
    head = F.col("text").startswith(">").cast("bigint")
    rows = running_totals(_lines(spark, path).withColumn("head", head), ["path"], ["block", "at"], {"n": "head", "line": "one"}).filter("text <> ''")
    rows = rows.withColumn("n", F.when(F.col("n") == 0, F.raise_error(F.lit("sequence before the first header")).cast("bigint")).otherwise(F.col("n")))
    parts = rows.groupBy("path", "n").agg(F.array_sort(F.collect_list(F.struct("line", "text"))).alias("p"))
    header = F.trim(F.substring(F.element_at("p", 1)["text"], 2, 1 << 20))
    body = F.array_join(F.transform(F.slice("p", F.lit(2), F.greatest(F.size("p") - 1, F.lit(0))), lambda x: x["text"]), "")
    return parts.select(F.lit(kind).alias("kind"), F.element_at(F.split(header, r"\s+"), 1).alias("id_hint"), body.alias("payload"), header.alias("description"), F.lit(1).alias("count"), F.element_at("p", 1)["line"].alias("line"))


def read_smiles(spark: SparkSession, path: str) -> DataFrame:
    """One ligand a line: SMILES and an optional name; ``#`` comments; an unnamed one is ``lig`` and its line."""
    rows = running_totals(_lines(spark, path), ["path"], ["block", "at"], {"line": "one"}).filter((F.col("text") != "") & ~F.col("text").startswith("#"))
    parts = F.split("text", r"\s+", 3)
    return rows.select(F.lit("ligand").alias("kind"), F.coalesce(F.get(parts, F.lit(1)), F.concat(F.lit("lig"), "line")).alias("id_hint"), F.get(parts, F.lit(0)).alias("payload"), F.lit("").alias("description"), F.lit(1).alias("count"), "line")


def read_table(spark: SparkSession, path: str, default_kind: str = "protein", sep: str = ",") -> DataFrame:
    """CSV or TSV with a header in any case; smiles before ccd_codes before sequence; both sequence and smiles is an error."""
    raw = spark.read.csv(path, header=True, sep=sep)
    named = raw.select(*(F.trim(F.col(f"`{c}`")).alias(c.strip().lower()) for c in raw.columns))
    have = lambda c: F.when(F.col(c) != "", F.col(c)) if c in named.columns else F.lit(None).cast("string")
    seq, smiles, ccd = have("sequence"), have("smiles"), have("ccd_codes")
    kind = F.lower(F.coalesce(have("type"), F.lit(default_kind)))
    count = F.coalesce(have("count"), F.lit("1"))
    n = count.try_cast("int")
    wrong = (
        F.when(seq.isNotNull() & smiles.isNotNull(), "both sequence and smiles")
        .when(~kind.isin(*KINDS), "unknown type")
        .when(n.isNull() | (n < 1), "count must be a positive whole number")
        .when((kind == "ligand") & smiles.isNull() & ccd.isNull(), "a ligand needs smiles or ccd_codes")
        .when(F.coalesce(smiles, ccd, seq).isNull(), "nothing to build")
    )
    real = F.when(smiles.isNotNull() | ccd.isNotNull(), F.lit("ligand")).otherwise(kind)
    checked = F.when(wrong.isNotNull(), F.raise_error(wrong).cast("string")).otherwise(real)
    return named.select(checked.alias("kind"), F.coalesce(have("id"), F.lit("")).alias("id_hint"), F.coalesce(smiles, ccd, seq).alias("payload"), F.coalesce(have("description"), F.lit("")).alias("description"), n.alias("count"))


def read_records(spark: SparkSession, path: str, default_kind: str = "protein") -> DataFrame:
    """Records by the file's suffix."""
    suffix = path.rsplit(".", 1)[-1].lower()
    if suffix in ("fa", "fasta", "faa", "fna", "fas"):
        return read_fasta(spark, path, default_kind)
    if suffix in ("smi", "smiles"):
        return read_smiles(spark, path)
    if suffix in ("csv", "tsv"):
        return read_table(spark, path, default_kind, "\t" if suffix == "tsv" else ",")
    raise ValueError(f"no reader for .{suffix} files")


def check_template(text: str) -> dict:
    """A template as an object: it needs ``modelSeeds``, and a list of ``sequences`` if any."""
    template = json.loads(text)
    if not isinstance(template, dict):
        raise ValueError("a template must be a JSON object")
    if "modelSeeds" not in template:
        raise ValueError("template is missing modelSeeds")
    if not isinstance(template.setdefault("sequences", []), list):
        raise ValueError("a template's sequences must be a list")
    return template


def read_template(spark: SparkSession, path: str) -> dict:
    """The template in a file: one small document."""
    return check_template(spark.read.text(path, wholetext=True).first().value)


def used_ids(template: dict) -> list[str]:
    """The ids of a template's entities, each a text or a list of them; parts of another form have none."""
    bodies = [next(iter(x.values())) for x in template.get("sequences") or [] if isinstance(x, dict) and x]
    ids = [b.get("id") for b in bodies if isinstance(b, dict)]
    return sorted({str(x) for i in ids for x in (i if isinstance(i, list) else [i] if i else [])})


def expand(template: str | dict, used: list[str] | None, stem: str, records: DataFrame) -> DataFrame:
    """(name, document, line): the template under each record's name, with the record's entity appended, its chains under free ids.

    ``template`` is a JSON object (``check_template``); ``used`` are ids that
    no chain may have, by default the template's own.  Equal names get the
    suffixes _2, _3 and so on, the next that no name has.
    """
    template = check_template(json.dumps(template) if isinstance(template, dict) else template)
    used = used_ids(template) if used is None else used
    others = json.dumps({k: v for k, v in template.items() if k not in ("name", "sequences")})[1:-1]
    before = "".join(json.dumps(x) + "," for x in template["sequences"])
    ids = S.free_ids(F.array(*map(F.lit, used)) if used else F.array().cast("array<string>"), F.col("count"))
    one = F.when(F.size(ids) == 1, F.concat(F.lit('"'), F.element_at(ids, 1), F.lit('"'))).otherwise(F.to_json(ids))
    quoted = lambda c: F.substring(F.to_json(F.struct(c.alias("x"))), 6, 1 << 30)  # noqa: E731  {"x":...} without its head, still with }
    value = lambda c: F.regexp_replace(quoted(c), r"\}$", "")
    codes = F.filter(F.split("payload", r"[,;\s]+"), lambda c: c != "")
    body = (
        F.when((F.col("kind") == "ligand") & F.col("payload").rlike(r"^[A-Z0-9]{1,5}([,;\s]+[A-Z0-9]{1,5})*$"), F.concat(F.lit('"ccdCodes":'), F.to_json(codes)))
        .when(F.col("kind") == "ligand", F.concat(F.lit('"smiles":'), value(F.col("payload"))))
        .otherwise(F.concat(F.lit('"sequence":'), value(F.col("payload")), F.lit(',"modifications":[],"unpairedMsa":""'), F.when(F.col("kind") == "protein", F.lit(',"pairedMsa":"","templates":[]')).otherwise("")))
    )
    entity = F.concat(F.lit('{"'), F.col("kind"), F.lit('":{"id":'), one, F.lit(","), body, F.lit("}}"))
    value = lambda c: F.regexp_replace(F.regexp_replace(F.to_json(F.struct(c.alias("x"))), r'^\{"x":', ""), r"\}$", "")
    base = F.concat(F.lit(f"{stem}__"), S.sanitise(F.col("id_hint")))
    order = "line" if "line" in records.columns else "payload"
    rows = unique_names(records.withColumn("base", base), "base", [order, "payload"], "name")
    document = F.concat(F.lit('{"name":'), value(F.col("name")), F.lit(f",{others}" + f',"sequences":[{before}'), entity, F.lit("]}"))
    line = F.col("line") if "line" in records.columns else F.lit(None).cast("int").alias("line")
    return rows.select("name", document.alias("document"), line)
