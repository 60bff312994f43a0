"""The operators over their whole tables, as the driver runs them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from keelson.llm.common import read


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from keelson.llm.packing import pack

    return pack(read(spark, sf_dir, "documents")).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from keelson.llm.line_dedup import clean_pages

    return clean_pages(read(spark, sf_dir, "pages"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from keelson.llm.quality import judge

    return judge(read(spark, sf_dir, "documents"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from keelson.llm.decontaminate import find_contamination

    found = find_contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from keelson.llm.pii import find_personal_data

    return find_personal_data(read(spark, sf_dir, "documents"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from keelson.llm.sharding import assign_shards

    return assign_shards(read(spark, sf_dir, "documents"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from keelson.llm.simhash import near_duplicates

    return near_duplicates(read(spark, sf_dir, "documents"))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from keelson.llm.secrets import find_secrets

    return find_secrets(read(spark, sf_dir, "documents"))


def op9_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from keelson.llm.repeats import find_repeats

    return find_repeats(read(spark, sf_dir, "documents")).drop("key")


def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    from keelson.llm.lm_score import score

    return score(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_best_fit_packing, op2_line_dedup, op3_quality_rules, op4_decontamination, op5_personal_data,
        op6_sharding, op7_simhash, op8_secrets, op9_repeats, op10_lm_score,
    )
}


def _oracle_sql() -> dict[str, str]:
    from keelson.llm import decontaminate, line_dedup, quality, repeats

    return {"op2_line_dedup": line_dedup.oracle(), "op3_quality_rules": quality.oracle(), "op4_decontamination": decontaminate.oracle(), "op9_repeats": repeats.oracle()}


#: SQL for DuckDB, where it can say the same.
ORACLE_SQL = _oracle_sql()
