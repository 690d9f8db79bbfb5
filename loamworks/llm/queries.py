"""Queries on the text problems, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamworks.llm import boilerplate, lookalike, mixing, pii, repeated_lines, residue, tokenize
from loamworks.session import read_table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return pii.found(read_table(spark, d, "scraping_result"), read_table(spark, d, "structured_card"), read_table(spark, d, "name_token"))


def p1_redacted(spark: SparkSession, d: str) -> DataFrame:
    names = read_table(spark, d, "name_token")
    texts = pii.redacted(read_table(spark, d, "scraping_result").select("result_id", "raw_text"), "raw_text", names)
    items = pii.redacted(read_table(spark, d, "structured_card").select("card_id", "content"), "content", names)
    texts = texts.select(F.lit("raw_text").alias("field"), F.col("result_id").alias("rec_id"), F.lit(0).alias("item_no"), F.col("raw_text").alias("text"))
    return texts.unionByName(items.select(F.lit("content").alias("field"), F.col("card_id").alias("rec_id"), F.posexplode("content").alias("item_no", "text")))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return boilerplate.boilerplate_lines(read_table(spark, d, "scraping_result"))


def p2_body(spark: SparkSession, d: str) -> DataFrame:
    rows = read_table(spark, d, "scraping_result").select("result_id", "url", "raw_text")
    return repeated_lines.without_lines(rows, boilerplate.boilerplate_lines(rows), out="body").select("result_id", "body")


def _p4(of: Callable, spark: SparkSession, d: str) -> DataFrame:
    names = of(read_table(spark, d, "test_data"), "name", "row_id", [F.col("feed"), F.col("load_no")], "name")
    page = lookalike.site_and_page(F.col("url"))[1]
    return names.unionByName(of(read_table(spark, d, "scraping_result"), "raw_text", "result_id", [page], "raw_text", blank_is_null=False))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _p4(lookalike.same_looking_pairs, spark, d)


def p4_classes(spark: SparkSession, d: str) -> DataFrame:
    return _p4(lookalike.look_classes, spark, d)


def p4_form(spark: SparkSession, d: str) -> DataFrame:
    names = read_table(spark, d, "test_data").select(F.lit("name").alias("field"), F.col("row_id").alias("id"), lookalike.canonical(F.col("name")).alias("form"))
    return names.unionByName(read_table(spark, d, "scraping_result").select(F.lit("raw_text").alias("field"), F.col("result_id").alias("id"), lookalike.canonical(F.col("raw_text")).alias("form")))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return repeated_lines.repeated_lines(read_table(spark, d, "scraping_result"))


def p5_kept(spark: SparkSession, d: str) -> DataFrame:
    rows = read_table(spark, d, "scraping_result").select("result_id", "url", "raw_text")
    return repeated_lines.without_lines(rows, repeated_lines.repeated_lines(rows)).select("result_id", "kept_text")


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokenize.encode_documents(read_table(spark, d, "documents"))


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mixed(read_table(spark, d, "documents"), read_table(spark, d, "mix_target"))


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(read_table(spark, d, "documents"), read_table(spark, d, "mix_target")).shares()


def p7_blocks(spark: SparkSession, d: str) -> DataFrame:
    return mixing.sharded(mixing.mix(read_table(spark, d, "documents"), read_table(spark, d, "mix_target")))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return residue.residue(read_table(spark, d, "documents"))


def p8_kept(spark: SparkSession, d: str) -> DataFrame:
    return residue.without_residue(read_table(spark, d, "documents")).select("doc_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_redacted, p2_found, p2_body, p4_found, p4_classes, p4_form, p5_found, p5_kept, p6_ids, p7_mix, p7_shares, p7_blocks, p8_found, p8_kept)}


def oracle_sql() -> dict[str, str]:
    """None: the texts' consistent form, tokens and models have no SQL; tests hold them against brute force."""
    return {}
