"""The queries of the training-data operators and the SQL of those that have one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import align, chat, codes, decontaminate, html, lines, minhash, mixing, neighbours, quality, tokens, toxicity, warc
from .common import table


def op1_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_output(table(spark, sf_dir, "documents"))


def op2_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.chat_format(table(spark, sf_dir, "conversations"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)


def op6_warc_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives all pages, copies the archive with a flipped bit in some records, and audits the two against each other."""
    records = warc.write_warc(table(spark, sf_dir, "pages"))
    return warc.audit(records, warc.copy_files(records, F.col("page_id") % 97 == 5))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.vector_codes(table(spark, sf_dir, "embeddings"))


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_dedup(table(spark, sf_dir, "documents"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.alignment(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_token_output, op2_html_extract, op3_chat_format, op4_decontaminate, op5_neighbours, op6_warc_audit, op7_toxicity, op8_mixing, op9_quality, op10_near_duplicates, op11_vector_codes, op12_line_dedup, op13_token_alignment)}
ORACLE = {"op3_chat_format": chat.ORACLE, "op6_warc_audit": warc.ORACLE, "op8_mixing": mixing.ORACLE, "op11_vector_codes": codes.ORACLE, "op12_line_dedup": lines.ORACLE}
