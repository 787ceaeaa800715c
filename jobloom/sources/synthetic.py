"""Seeded job documents: each depends on the seed and its number only, however the rows are dealt."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobloom.registry import query, table

#: Letters that stand for the sixteen hex digits of a hash.
LETTERS = "ACDEFGHIKLMNPQRS"
KIND_NAMES = ("protein", "rna", "dna")
MOST = 400
MOST_SEEDS = 5


def draw(seed: int, row: Column, purpose: str, below: int) -> Column:
    """A number from 0 below ``below`` for a row: the head of a hash of seed, purpose and row."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(purpose), row.cast("string")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") % below


def seeded_documents(rows: DataFrame, seed: int, number: str = "row", most: int = MOST) -> DataFrame:
    """(row, name, n_seeds, kind, sequence, document) of each row's number: a job document as JSON.

    Draws are hashes of (seed, number), so a document is the same in any
    partitioning, on any machine and in any subset; equal numbers give equal
    documents, and a null number gives none.
    """
    n = F.col(number).cast("bigint")
    length = (1 + draw(seed, n, "length", most)).alias("length")
    kinds = F.array(*map(F.lit, KIND_NAMES))
    drawn = rows.filter(n.isNotNull()).select(n.alias("row"), length, (1 + draw(seed, n, "seeds", MOST_SEEDS)).alias("n_seeds"), F.get(kinds, draw(seed, n, "kind", len(KIND_NAMES)).cast("int")).alias("kind"))
    parts = F.transform(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("length") - 1) / 32)), lambda k: F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit("letters"), F.col("row"), k)))
    sequence = F.translate(F.expr("substring(_all, 1, int(length))"), "0123456789abcdef", LETTERS)
    named = drawn.withColumn("_all", F.array_join(parts, "")).select(F.col("row"), F.concat(F.lit("job-"), F.col("row")).alias("name"), "n_seeds", "kind", sequence.alias("sequence"))
    seeds = F.array_join(F.sequence(F.lit(1).cast("bigint"), F.col("n_seeds")), ",")
    document = F.format_string('{"name":"%s","modelSeeds":[%s],"sequences":[{"%s":{"id":"A","sequence":"%s"}}]}', "name", seeds, "kind", "sequence")
    return named.select("*", document.alias("document"))


@query("""WITH d AS (SELECT doc_id AS row, 1 + ('0x' || md5('7:length:' || doc_id)[1:8])::BIGINT % 400 AS length, 1 + ('0x' || md5('7:seeds:' || doc_id)[1:8])::BIGINT % 5 AS n_seeds,
  ['protein', 'rna', 'dna'][1 + ('0x' || md5('7:kind:' || doc_id)[1:8])::BIGINT % 3] AS kind FROM documents)
SELECT row, 'job-' || row AS name, n_seeds, kind,
  translate(substr(array_to_string(list_transform(range(0, (length - 1) // 32 + 1), lambda k: md5('7:letters:' || row || ':' || k)), ''), 1, length), '0123456789abcdef', 'ACDEFGHIKLMNPQRS') AS sequence,
  '{"name":"' || name || '","modelSeeds":[' || array_to_string(range(1, n_seeds + 1), ',') || '],"sequences":[{"' || kind || '":{"id":"A","sequence":"' || sequence || '"}}]}' AS document FROM d""")
def seeded_jobs(spark: SparkSession, d: str) -> DataFrame:
    """A synthetic job document for every row of the table."""
    return seeded_documents(table(spark, d, "documents").select("doc_id"), 7, "doc_id")
