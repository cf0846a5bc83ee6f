"""Running sums and neighbours over all tickets, by the distributed scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scan import scan


def cumulative(bets: DataFrame, amount: Column, at: str = "placed_at", tie: str = "id") -> DataFrame:
    """id, at, amount and the running sum, one point a ticket in order of time; however many tickets a day has."""
    rows = bets.select(tie, at, amount.alias("amount"))
    return scan(rows, [F.col(at).asc_nulls_first(), F.col(tie).asc()], running={"running": "amount"})


def latest(bets: DataFrame, n: int = 10) -> DataFrame:
    """The n tickets placed last, newest first: a top-k, not a sort of all."""
    return bets.orderBy(F.desc("placed_at"), F.desc("id")).limit(n)


def midpoint(bets: DataFrame, by: list[str] | None = None) -> DataFrame:
    """For each ticket the times at which one could be put before and after it: half way to its neighbour (inside its values of `by`), a second beyond the ends."""
    t, back, ahead = F.col("t"), F.col("back"), F.col("ahead")
    rows = bets.select("id", "placed_at", *(by or []), F.unix_micros(F.col("placed_at").cast("timestamp")).alias("t"))
    rows = scan(rows, [F.col("placed_at").asc_nulls_first(), F.col("id").asc()], by, neighbours={"t": ("back", "ahead")})
    half = lambda b, d: F.timestamp_micros(F.coalesce(F.floor((t + b) / 2000).cast("long") * 1000, t + d))
    return rows.select("id", half(back, F.lit(-1_000_000)).alias("insert_before"), half(ahead, F.lit(1_000_000)).alias("insert_after"))
