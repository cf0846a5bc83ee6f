"""Dimensions that change over time, and which of their rows held at a moment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import fresh
from .scan import scan


def valid_spans(edits: DataFrame, key: str, at: str, seq: str) -> DataFrame:
    """edits with version (from 1 for each key), valid_from and valid_to (null: still). Of edits of one moment the last by seq ends up valid; those before it have empty spans."""
    rows = scan(edits.withColumn("valid_from", F.col(at)), [F.col(at).asc_nulls_first(), F.col(seq).asc()], [key], position="version", neighbours={"valid_from": ("before_", "valid_to")})
    return rows.drop("before_")


def as_of(rows: DataFrame, edits: DataFrame, key: str, at: str, edit_key: str, edit_at: str, edit_seq: str, values: list[str]) -> DataFrame:
    """rows with `values` of the edit of their key that was the last at their time (an edit at that very time counts); null before the first.

    One sorted pass over both: no pair of a row and an edit is made but the one asked for, and a key that a third of all
    rows hold is cut into ranges of time like any other. rows without a key meet no edit.
    """
    k, t, side, s, v, found = (fresh(c, rows) for c in ("asof_key", "asof_time", "asof_side", "asof_seq", "asof_value", "asof_found"))
    kind = rows.schema[at].dataType
    packed = F.struct(*values)
    mine = rows.where(F.col(key).isNotNull()).withColumns({k: F.col(key).cast("string"), t: F.col(at), side: F.lit(1), s: F.xxhash64(*rows.columns)})
    theirs = edits.where(F.col(edit_key).isNotNull()).select(F.col(edit_key).cast("string").alias(k), F.col(edit_at).cast(kind).alias(t), F.lit(0).alias(side), F.col(edit_seq).cast("long").alias(s), packed.alias(v))
    both = mine.unionByName(theirs, allowMissingColumns=True)
    done = scan(both, [F.col(t).asc_nulls_first(), F.col(side).asc(), F.col(s).asc()], [k], latest={found: v}).where(F.col(side) == 1)
    out = done.select(*rows.columns, *(F.col(f"{found}.{c}").alias(c) for c in values))
    none = rows.where(F.col(key).isNull()).select("*", *(F.lit(None).cast(edits.schema[c].dataType).alias(c) for c in values))
    return out.unionByName(none)


def snapshot(edits: DataFrame, key: str, at: str, seq: str, moment) -> DataFrame:
    """The dimension as it was at a moment: of each key the last edit up to then."""
    upto = edits.where(F.col(at) <= F.lit(moment))
    last = upto.groupBy(key).agg(F.max_by(F.struct(*upto.columns), F.struct(at, seq)).alias("e"))
    return last.select("e.*")
