"""Substring search by an index of trigrams: texts that can't hold a term aren't read.

The index has a row for each distinct value and each of its three-letter pieces, stored sorted by piece, so that a lookup
reads the row groups of the term's pieces alone. A value is a candidate if it has all of them; `contains` verifies it. Terms
of fewer than three letters match by the start of a piece (every value's end is padded, so each of its letters begins one).
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import written
from .resolve import looked_up

#: Closes a value, so that its last letters begin pieces too.
END = "\x00\x00"


def pieces(text: Column) -> Column:
    padded = F.concat(text, F.lit(END))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text)), lambda i: F.substring(padded, i, F.lit(3))))


def trigram_index(values: DataFrame, column: str) -> DataFrame:
    """piece, value (in lower case) of the distinct values of a column; stored."""
    distinct = values.select(F.lower(column).alias("value")).where(F.length("value") > 0).distinct()
    rows = distinct.select(F.explode(pieces(F.col("value"))).alias("piece"), "value")
    return written(rows.repartitionByRange("piece", "value").sortWithinPartitions("piece", "value"), "trigrams")


def found_values(index: DataFrame, term: str) -> DataFrame:
    """The values (in lower case) that hold a term, whatever its case; all of them for a blank term."""
    q = term.strip().lower()
    if not q:
        return index.select("value").distinct()
    if len(q) < 3:
        return index.where(F.col("piece").startswith(q)).select("value").distinct()
    asked = sorted({q[i : i + 3] for i in range(len(q) - 2)})
    hits = index.where(F.col("piece").isin(asked)).groupBy("value").agg(F.count("*").alias("n"))
    return hits.where((F.col("n") == len(asked)) & F.contains("value", F.lit(q))).select("value")


def searched(rows: DataFrame, terms: list[str], indexes: dict[str, DataFrame]) -> DataFrame:
    """rows with term: one for each of the terms that one of the indexed columns holds. indexes: {column: its trigram index}.

    All terms are looked up in a column's values at once, so that rows meet each column's values one time, however many terms there are.
    """
    out, hits = rows, []
    for n, (column, index) in enumerate(indexes.items()):
        found = functools.reduce(DataFrame.unionByName, [found_values(index, t).select(F.col("value").alias(f"value_{n}"), F.lit(t).alias("t")) for t in terms])
        found = found.groupBy(f"value_{n}").agg(F.collect_set("t").alias(f"terms_{n}"))
        out = looked_up(out, found, F.lower(column) == F.col(f"value_{n}"), F.col(column).isNotNull()).drop(f"value_{n}")
        hits.append(F.coalesce(f"terms_{n}", F.array().cast("array<string>")))
    return out.select(*rows.columns, F.explode(F.array_distinct(F.flatten(F.array(*hits)))).alias("term"))


def search(rows: DataFrame, term: str, indexes: dict[str, DataFrame]) -> DataFrame:
    """Rows of which one of the indexed columns holds the term. indexes: {column: its trigram index}."""
    return searched(rows, [term], indexes).select(*rows.columns)
