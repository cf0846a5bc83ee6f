"""Orders of tables and lists. `positions` numbers rows so that an order can be stored and compared."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scan import scan


def stats_order(column: str = "net", descending: bool = True, tie: str = "name") -> list[Column]:
    """Of a table of figures: a missing value counts as 0; ties by name."""
    c = F.coalesce(F.col(column), F.lit(0))
    return [c.desc() if descending else c.asc(), F.col(tie).asc()]


def grid_order(column: str, descending: bool, at: str = "placed_at") -> list[Column]:
    """Of the grid: dates by day, then by id upwards in both directions; other columns with nulls last in both directions."""
    c = F.to_date(at) if column == at else F.col(column)
    return [c.desc_nulls_last() if descending else c.asc_nulls_last(), F.col("id").asc()]


def storage_order(inserted: bool = False, at: str = "placed_at") -> list[Column]:
    """Newest first; oldest first once a ticket was put between others."""
    return [F.col(at).asc() if inserted else F.col(at).desc(), F.col("id").asc() if inserted else F.col("id").desc()]


def rank_order(column: str, listed: list[str]) -> list[Column]:
    """In the order of a list; what it lacks comes last, by name."""
    place = F.array_position(F.array(*map(F.lit, listed)), F.col(column))
    return [(place == 0).asc(), place.asc(), F.col(column).asc()]


def timeline_order(days: str = "days", tie: str = "id") -> list[Column]:
    return [F.col(days).asc_nulls_last(), F.col(tie).asc()]


def name_order(column: str) -> list[Column]:
    """By name as people sort: accents between their letters, small letters before capitals; by the root collation."""
    return [F.collate(F.col(column), "UNICODE").asc(), F.col(column).asc()]


def positions(rows: DataFrame, order: list[Column], within: list[str] | None = None, name: str = "position") -> DataFrame:
    """Numbers rows from 1 in an order, inside each value of `within`, by a window: for few rows (a table of figures, a dimension), or few a value."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*(within or [])).orderBy(*order)))


def ranked(rows: DataFrame, order: list[Column], within: list[str] | None = None, name: str = "position") -> DataFrame:
    """As positions, for any number of rows in a value, or in all: by the distributed scan. The order has to be total."""
    return scan(rows, order, within, position=name)
