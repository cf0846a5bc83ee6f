"""Changes to the stored tickets, each a new DataFrame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import money


def insert(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Appends tickets whose id isn't stored; equal ids inside the new ones both stay."""
    return stored.unionByName(new.join(stored.select("id"), "id", "left_anti"), allowMissingColumns=True)


def delete(stored: DataFrame, ids: DataFrame) -> DataFrame:
    return stored.join(ids.select("id").distinct(), "id", "left_anti")


def update(stored: DataFrame, changes: DataFrame, columns: list[str]) -> DataFrame:
    """Lays changes (id, set: the names that are given, and the columns) over the tickets; a name that is given may set null.

    The payout is made anew where stake, odds or result is given; an empty tail becomes none.
    """
    marks = changes.select("id", F.col("set").alias("__set"), *[F.col(c).alias(f"__{c}") for c in columns])
    rows = stored.join(marks, "id", "left")
    given = lambda c: F.coalesce(F.array_contains("__set", c), F.lit(False))
    merged = {c: F.when(given(c), F.col(f"__{c}")).otherwise(F.col(c)) for c in columns}
    if "tail" in merged:
        merged["tail"] = F.nullif(merged["tail"], F.lit(""))
    out = rows.withColumns(merged)
    priced = [c for c in ("stake", "odds", "result") if c in columns]
    again = F.lit(False)
    for c in priced:
        again = again | given(c)
    kind = stored.schema["payout"].dataType
    fresh = F.floor(money.recalculated_payout()) if kind.typeName() == "long" else money.recalculated_payout()
    out = out.withColumn("payout", F.when(again, fresh.cast(kind)).otherwise(F.col("payout")))
    return out.select(*stored.columns)


def patch_leg(legs: Column, place: int, **fields: Column) -> Column:
    """The legs with some fields of the one at `place` (from 0) replaced."""

    def patched(leg: Column) -> Column:
        for name, value in fields.items():
            leg = leg.withField(name, value)
        return leg

    return F.transform(legs, lambda leg, i: F.when(i == place, patched(leg)).otherwise(leg))


def duplicates(bets: DataFrame, copies: int, reset: bool = False) -> DataFrame:
    """Each ticket `copies` times under new ids; with reset as fresh pending tickets."""
    rows = bets.withColumn("copy_no", F.explode(F.sequence(F.lit(1), F.lit(copies))))
    rows = rows.withColumn("id", F.concat_ws("-", F.lit("manual"), F.col("id").cast("string"), F.col("copy_no").cast("string")))
    return rows.withColumns({"result": F.lit("pending"), "payout": F.lit(0).cast(bets.schema["payout"].dataType)}) if reset else rows


def blank(bets_schema: DataFrame, n: int, placed_at: Column) -> DataFrame:
    """n blank tickets: single, Props, pending, no money."""
    spark = bets_schema.sparkSession
    given = {"id": F.concat(F.lit("manual-"), F.col("n").cast("string")), "bet_type": F.lit("single"), "market_category": F.lit("Props"), "result": F.lit("pending"), "placed_at": placed_at}
    rows = spark.range(n).withColumnRenamed("id", "n")
    return rows.select(*[given.get(f.name, F.lit(0 if f.name in ("stake", "payout") else None)).cast(f.dataType).alias(f.name) for f in bets_schema.schema])


def migrated(bets: DataFrame, category: Column) -> DataFrame:
    """Old tickets: a live bet type becomes the live flag; a category that isn't known is classified anew."""
    known = F.coalesce(F.col("market_category").isin("Props", "Main Markets", "Futures", "Parlays"), F.lit(False))
    return bets.withColumns({"is_live": F.coalesce("is_live", F.col("bet_type") == "live"), "market_category": F.when(known, F.col("market_category")).otherwise(category)})


def loaded(bets: DataFrame, teams: DataFrame) -> DataFrame:
    """Stored tickets as they are loaded, with healed: whether a stored main market turned out to be another category.

    What lacks a known category is classified; what says Main Markets, which once stood for much, is classified again.
    """
    from ..functions import classify
    from . import resolve

    named = resolve.known_teams(bets, teams)
    fresh = classify.ticket_category(F.col("bet_type"), F.col("description"), F.col("name"), F.col("type"), F.col("is_team"))
    out = migrated(named, fresh).withColumn("healed", (F.col("market_category") == "Main Markets") & (fresh != "Main Markets"))
    again = F.when(F.col("market_category") == "Main Markets", fresh).otherwise(F.col("market_category"))
    return out.withColumn("market_category", again).drop("is_team")


def is_sample(ids: list[str]) -> Column:
    """Whether a ticket is one of the samples: marked so, or of a listed id."""
    return F.coalesce("is_sample", F.lit(False)) | F.col("id").cast("string").isin(*ids)


def leg_of_columns() -> Column:
    """The leg that an old ticket's name, type, line and side make; null if it has no name."""
    some = F.trim(F.coalesce("name", F.lit(""))) != ""
    return F.when(some, F.struct(F.array("name").alias("entities"), F.coalesce("type", F.lit("")).alias("market"), F.col("line").alias("target"), F.col("ou").alias("ou")))
