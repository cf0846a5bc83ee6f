"""The corpus pipeline: quality, near copies, benchmark leaks, mix, token files.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame; all but the last keep the columns of docs. The stage's
decisions take effect: what it rejects is gone for the stages behind it.

What all stages do with odd rows: extra columns, whatever their names, stay up to the last stage, which returns its digest alone.
Nulls in lang, source (a source of its own) and n_chars don't matter; a null text counts as an empty one. Very long texts are
read whole. An empty table stays empty. The rest is said at each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stakewell.llm import decontaminate, minhash, mixing, quality, tokens
from stakewell.llm.common import collect_heaps, table, written


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts; it learns from the labels of sf_dir, never from held-out ones.

    Repeated rows, and equal texts under other ids, share their fate. A null doc_id is scored like any.
    """
    collect_heaps(spark)
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one of least doc_id.

    A null doc_id comes last; of rows that tie (the same id and text) one stays. Texts without words are nobody's copies and all stay.
    """
    collect_heaps(spark)
    return minhash.deduplicated(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark.

    All rows of a doc_id go if one of them holds a passage, those without an id together. Null, empty and repeated items change nothing.
    """
    collect_heaps(spark)
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target asks: never, once or twice.

    Rows that tie in doc_id share their fate; those without one too. Texts without words cost nothing and go by the same hash.
    """
    collect_heaps(spark)
    return mixing.mixed(docs)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The digest of each document, read back from the token files.

    Repeats are documents of their own, in the order of their texts' hashes; a null doc_id comes last; an empty text is its end id alone.
    """
    collect_heaps(spark)
    return tokens.token_output(docs)


STAGES = [
    ("quality_filter", quality_filter),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mix_sources", mix_sources),
    ("token_files", token_files),
]

#: None: a trained classifier and a byte-pair encoding can't be expressed in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
