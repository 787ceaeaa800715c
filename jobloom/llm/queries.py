"""The corpus operators bound to the whole tables they are meant for."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def word_tokenizer() -> str:
    """The public vocabulary file that op3 and the pipeline write with."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_media_mpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    from jobloom.llm.media import media_features

    return media_features(read(spark, sf_dir, "documents"))


def op2_secret_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    from jobloom.llm.secrets import secret_digest

    return secret_digest(read(spark, sf_dir, "documents"))


def op3_token_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    from jobloom.llm.tokens import token_table

    return token_table(read(spark, sf_dir, "documents"), word_tokenizer())


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from jobloom.llm.suffixes import repeat_digest

    return repeat_digest(read(spark, sf_dir, "documents"))


def op5_toxicity_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from jobloom.llm.toxicity import toxicity

    scored = toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    nearest = F.array_join(F.transform("evidence", lambda e: F.concat_ws(":", e["example"], F.round(e["cosine"], 6))), ",")
    return scored.withColumn("evidence", nearest)


def op6_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from jobloom.llm.decontam import contamination_report

    return contamination_report(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op7_license_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from jobloom.llm.licenses import license_digest

    return license_digest(read(spark, sf_dir, "documents"))


def op8_bottom_k_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from jobloom.llm.neardup import near_duplicates

    return near_duplicates(read(spark, sf_dir, "documents"), width=4).drop("key", "chosen")


def op9_bloom_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from jobloom.llm.language_model import score_documents

    return score_documents(read(spark, sf_dir, "documents"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from jobloom.llm.mixing import mix

    return mix(read(spark, sf_dir, "documents")).drop("row", "copies")


def op11_delta_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    from jobloom.llm.clustering import cluster_digest

    return cluster_digest(read(spark, sf_dir, "embeddings"))


def op12_warc_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from jobloom.llm.warc import warc_digest

    return warc_digest(read(spark, sf_dir, "pages"))


def op13_rope_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    from jobloom.llm.infill import infill_digest

    return infill_digest(read(spark, sf_dir, "documents"))


OPERATORS = (
    op1_media_mpeg,
    op2_secret_field,
    op3_token_frames,
    op4_suffix_dedup,
    op5_toxicity_neighbours,
    op6_template_decontamination,
    op7_license_rules,
    op8_bottom_k_dedup,
    op9_bloom_lm,
    op10_mixing,
    op11_delta_lloyd,
    op12_warc_chunks,
    op13_rope_infill,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in OPERATORS}


def oracle_sql() -> dict[str, str]:
    from jobloom.llm import clustering, decontam, infill, mixing, neardup, warc

    return {
        "op6_template_decontamination": decontam.ORACLE,
        "op8_bottom_k_dedup": neardup.ORACLE,
        "op10_mixing": mixing.ORACLE,
        "op11_delta_lloyd": clustering.ORACLE,
        "op12_warc_chunks": warc.ORACLE,
        "op13_rope_infill": infill.ORACLE,
    }
