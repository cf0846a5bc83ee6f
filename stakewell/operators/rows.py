"""Tickets as spreadsheet and grid rows, by array functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import classify, formats, money
from . import legs as leg_ops
from .scan import scan

MOST_LEGS = 10


def over_under_flags(ou: Column, target: Column) -> tuple[Column, Column]:
    over = (F.lower(ou) == "over") | (F.coalesce(F.lower(ou), F.lit("")).isin("over", "under") == F.lit(False)) & F.coalesce(target.contains("+"), F.lit(False))
    under = F.lower(ou) == "under"
    flag = lambda mine, other: F.when(F.coalesce(mine, F.lit(False)), "1").when(F.coalesce(other, F.lit(False)), "0").otherwise("")
    return flag(over, under), flag(under, over)


def final_rows(bets: DataFrame, kept: tuple[str, ...] = ()) -> DataFrame:
    """Rows of the spreadsheet: a parlay has a header with the money and rows for its legs without; other tickets one row a leg.

    bets: nested tickets; groups of legs are opened. row 0 is a parlay's header, or a ticket that has no legs; other rows
    are numbered from 1 in the order of legs. A ticket all of whose legs are placeholders has no rows.
    kept: columns of the ticket that its rows keep.
    """
    some = ~leg_ops.none_of(F.col("legs"))
    bets = bets.withColumn("opened", F.when(some, leg_ops.expanded_legs(bets)))
    shown, n = F.slice("opened", 1, MOST_LEGS), F.when(some, F.size("opened")).otherwise(F.lit(0))
    empty = F.struct(F.lit(0).alias("row"), F.lit(None).cast("string").alias("leg_name"), F.lit(None).cast("string").alias("market"), F.lit(None).cast("string").alias("target"), F.lit(None).cast("string").alias("ou"), F.lit(None).cast("int").alias("leg_odds"), F.lit(None).cast("string").alias("leg_result"))
    listed = F.transform(shown, lambda leg, i: F.struct((i + 1).cast("int").alias("row"), F.get(leg["entities"], F.lit(0)).alias("leg_name"), leg["market"].alias("market"), leg["target"].alias("target"), leg["ou"].alias("ou"), leg["odds"].alias("leg_odds"), leg["result"].alias("leg_result")))
    rows = bets.withColumn("n", n).withColumn("r", F.explode(F.when(~some, F.array(empty)).when(n > 1, F.concat(F.array(empty), listed)).otherwise(listed)))
    header, child = (F.col("n") > 1) & (F.col("r.row") == 0), (F.col("n") > 1) & (F.col("r.row") > 0)
    label = F.concat(classify.parlay_type(F.col("bet_type"), "Parlay"), F.lit(" ("), F.least(F.col("n"), F.lit(MOST_LEGS)).cast("string"), F.lit(")"))
    over, under = over_under_flags(F.col("r.ou"), F.col("r.target"))
    # A row of a leg goes by the leg's own result, the only leg's net too; other rows by the ticket's.
    said = F.lower(F.when(F.col("r.row") > 0, F.col("r.leg_result")).otherwise(F.col("result")))
    said = F.when(said.isin("win", "loss", "push", "pending"), said).otherwise("pending")
    paid = ~child
    return rows.select(
        "id", F.col("r.row").alias("row_no"), F.when(header, label).otherwise(F.coalesce("r.leg_name", "name", F.lit(""))).alias("row_name"),
        F.when(header, "Parlays").otherwise(classify.leg_category(F.coalesce("r.market", "type"))).alias("category"),
        F.when(header, "").otherwise(over).alias("over_flag"), F.when(header, "").otherwise(under).alias("under_flag"), F.when(header, F.lit("")).otherwise(F.coalesce("r.target", F.lit(""))).alias("line"),
        F.when(child, F.col("r.leg_odds")).otherwise(F.nullif("odds", F.lit(0))).alias("row_odds"), F.when(paid, F.col("stake")).alias("row_stake"),
        F.initcap(said).alias("row_result"), F.when(paid, F.round(money.row_net(said), 4)).alias("row_net"), header.alias("is_header"), child.alias("is_child"), *kept,
    )


def stripes(rows: DataFrame, by: str) -> DataFrame:
    """Adds the running number of the group a row belongs to: headers and single rows begin one, children keep it. Runs inside each value of `by`."""
    begins = rows.withColumn("begins", (~F.col("is_child")).cast("long"))
    return scan(begins, [F.col("id").asc(), F.col("row_no").asc()], [by], running={"stripe": "begins"}).withColumn("stripe", F.col("stripe") - 1).drop("begins")


def display(bets: DataFrame) -> DataFrame:
    """Text as it is shown: date, odds, net. Amounts are in cents."""
    net = money.net() / 100
    return bets.select("id", F.date_format("placed_at", "MM/dd").alias("short_date"), F.date_format("placed_at", "yyyy-MM-dd").alias("chart_date"), formats.odds("odds").alias("odds_text"), formats.currency(F.col("stake") / 100).alias("stake_text"), F.when(F.col("result") == "pending", "").otherwise(F.format_number(net, 2)).alias("net_text"))


def grid_money(raw: Column, text: Column) -> Column:
    """A grid row's number: as stored, else as its text says, else 0."""
    said = F.regexp_extract(F.regexp_replace(F.trim(text), r"[$,\s]", ""), r"^[+-]?(?:\d+\.?\d*|\.\d+)", 0)
    return F.coalesce(raw.cast("double"), F.nullif(said, F.lit("")).cast("double"), F.lit(0.0))
