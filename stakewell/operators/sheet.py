"""Whole spreadsheet rows and grid rows of tickets: every column, with the category and type of each leg's market."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import classify, money, validators
from . import legs as leg_ops
from .resolve import looked_up, resolve_bet_types
from .rows import MOST_LEGS, over_under_flags


def classified(rows: DataFrame, types: DataFrame, market: str = "market", sport: str = "sport", given: str | None = None) -> DataFrame:
    """rows with category and kind of their market in their sport; `given` names a category that is known already.

    Distinct markets are classified once and joined back; rows without a market aren't joined.
    """
    known = F.coalesce(F.col(given), F.lit("")) if given else F.lit("")
    keyed = rows.withColumns({"m_": F.coalesce(market, F.lit("")), "s_": F.coalesce(sport, F.lit("")), "g_": known})
    some = F.col("m_") != ""
    pairs = keyed.where(some).select("m_", "s_", "g_").distinct()
    pairs = resolve_bet_types(pairs, types, "m_", "s_")
    category = F.when(F.col("g_") != "", F.col("g_")).otherwise(classify.leg_category(F.col("m_")))
    kinds = pairs.select("m_", "s_", "g_", category.alias("category"), classify.market_type(F.col("m_"), category, F.col("s_"), F.col("canonical")).alias("kind"))
    kinds = kinds.toDF("km_", "ks_", "kg_", "category", "kind")
    out = looked_up(keyed, kinds, (F.col("m_") == F.col("km_")) & (F.col("s_") == F.col("ks_")) & (F.col("g_") == F.col("kg_")), some)
    return out.withColumns({"category": F.coalesce("category", F.when(F.col("g_") != "", F.col("g_")), F.lit("Props")), "kind": F.coalesce("kind", F.lit(""))}).drop("m_", "s_", "g_", "km_", "ks_", "kg_")


def _of(bets: DataFrame, name: str, kind: str = "string") -> Column:
    return F.col(name) if name in bets.columns else F.lit(None).cast(kind)


def _whole(odds: Column) -> Column:
    """Odds that are a whole number other than 0, else null."""
    return F.when(F.coalesce(odds % 1 == 0, F.lit(False)), F.nullif(odds, F.lit(0))).cast("int")


def sheet_rows(bets: DataFrame, types: DataFrame, per: int = 1) -> DataFrame:
    """The spreadsheet's rows with all their columns; see rows.final_rows for which rows a ticket has.

    per: how many units of stake and payout make one of what is shown (100 for cents). Money is shown on headers and on rows outside parlays
    only. net is by the row's result: the ticket's on headers, the leg's own on rows of legs.
    """
    some = ~leg_ops.none_of(F.col("legs"))
    bets = bets.withColumns({"opened": F.when(some, leg_ops.expanded_legs(bets)), "stake": F.col("stake") / per, "payout": F.col("payout") / per})
    n = F.when(some, F.size("opened")).otherwise(F.lit(0))
    none = {c: F.lit(None).cast(t) for c, t in (("entities", "array<string>"), ("market", "string"), ("target", "string"), ("ou", "string"), ("odds", "int"), ("result", "string"))}
    part = lambda row, of: F.struct(F.lit(row).cast("int").alias("row") if isinstance(row, int) else row.cast("int").alias("row"), *(of[c].cast(t).alias(c) for c, t in (("entities", "array<string>"), ("market", "string"), ("target", "string"), ("ou", "string"), ("odds", "int"), ("result", "string"))))
    own = none | {"entities": F.array(F.coalesce(_of(bets, "name"), F.lit(""))), "market": _of(bets, "type"), "target": _of(bets, "line"), "ou": _of(bets, "ou"), "result": F.col("result")}
    header = none | {"result": F.col("result")}
    listed = F.transform(F.slice("opened", 1, MOST_LEGS), lambda leg, i: part(i + 1, {c: _whole(leg["odds"]) if c == "odds" else leg[c] for c in none}))
    shown = F.when(~some, F.array(part(0, own))).when(n > 1, F.concat(F.array(part(0, header)), listed)).otherwise(listed)
    rows = bets.withColumn("n", n).withColumn("r", F.explode(shown)).drop("opened")
    is_header, is_child, bare = (F.col("n") > 1) & (F.col("r.row") == 0), (F.col("n") > 1) & (F.col("r.row") > 0), F.col("n") == 0
    display = classify.display_category(_of(bets, "market_category"))
    # A ticket without legs keeps its own category; its type is looked for in that.
    given = F.when(bare, F.when(display == "Main", "Main Markets").when(display == "", "none").otherwise(display))
    rows = rows.withColumns({"is_header": is_header, "is_child": is_child, "bare": bare, "market": F.when(is_header, "").otherwise(F.coalesce("r.market", F.lit(""))), "given": given, "display": display})
    rows = classified(rows, types, "market", "sport", "given")
    count = F.least(F.col("n"), F.lit(MOST_LEGS))
    parlay = F.concat(classify.parlay_type(F.col("bet_type"), "Parlay"), F.lit(" ("), count.cast("string"), F.lit(")"))
    category = F.when(F.col("is_header"), "Parlays").when(F.col("bare"), F.col("display")).otherwise(F.col("category"))
    kind = F.when(F.col("is_header"), classify.parlay_type(F.col("bet_type"))).otherwise(F.col("kind"))
    total = ~F.col("is_header") & ~F.col("bare") & (F.col("category") == "Main Markets") & (F.col("kind") == "Total") & (F.size("r.entities") >= 2)
    over, under = over_under_flags(F.col("r.ou"), F.col("r.target"))
    paid, odds = ~F.col("is_child"), F.col("odds")
    leg_odds = F.col("is_child") & F.col("r.odds").isNotNull()
    raw_odds = F.when(leg_odds, F.col("r.odds")).when(paid, odds.cast("int"))
    said = F.coalesce("r.result", F.lit(""))
    won = money.to_win("stake", "odds", "payout")
    raw_net = money.row_net(F.lower(said), F.col("stake"), odds, F.col("payout"))
    flag = lambda c: F.when(F.coalesce(c, F.lit(False)), "1").otherwise("")
    text = lambda c: F.when(F.col("is_header"), "").otherwise(c)
    return rows.select(
        "id", F.col("r.row").alias("row_no"), F.coalesce(F.date_format("placed_at", "MM/dd/yy"), F.lit("")).alias("date"), F.col("book").alias("site"), F.coalesce("sport", F.lit("")).alias("sport"), category.alias("category"), kind.alias("type"),
        F.when(F.col("is_header"), parlay).otherwise(F.coalesce(F.get("r.entities", F.lit(0)), F.lit(""))).alias("name"), F.when(total, F.get("r.entities", F.lit(1))).alias("name2"),
        text(over).alias("over"), text(under).alias("under"), text(F.coalesce("r.target", F.lit(""))).alias("line"), F.coalesce(validators.odds_text(raw_odds), F.lit("")).alias("odds"),
        F.when(paid, validators.amount(F.col("stake"))).otherwise("").alias("bet"), F.when(paid, validators.amount(won)).otherwise("").alias("to_win"), validators.final_result(said).alias("result"),
        F.when(paid, validators.row_net_text(said, F.col("stake"), odds, F.col("payout"))).otherwise("").alias("net"), flag(F.col("is_live")).alias("live"), flag(F.coalesce(_of(bets, "tail"), F.lit("")) != "").alias("tail"),
        F.when(F.col("n") > 1, F.col("id")).alias("parlay_id"), F.when(F.col("is_child"), F.col("r.row")).alias("leg_index"), F.when(F.col("is_header"), count).alias("leg_count"), "is_header", "is_child",
        raw_odds.alias("raw_odds"), F.when(paid, F.col("stake")).alias("raw_bet"), F.when(paid, won).alias("raw_to_win"), F.when(paid, raw_net).alias("raw_net"), F.col("placed_at").alias("sort_date"),
        F.col("result").alias("ticket_result"), _of(bets, "tail").alias("ticket_tail"), F.coalesce("is_live", F.lit(False)).alias("is_live"),
    )


def grid_rows(sheet: DataFrame) -> DataFrame:
    """The grid's rows of the spreadsheet's: numbers as they are or as the text says, 0 where money is missing; an id for each leg."""
    number = lambda raw, text: F.coalesce(raw.cast("double"), F.regexp_extract(text, r"^\s*([+-]?(?:\d+\.?\d*|\.\d+))", 1).try_cast("double"), F.lit(0.0))
    odds = F.coalesce(F.col("raw_odds"), F.replace("odds", F.lit("+"), F.lit("")).try_cast("int"))
    return sheet.select(
        F.when(F.col("is_child"), F.concat_ws("-leg-", F.col("id").cast("string"), (F.col("leg_index") - 1).cast("string"))).otherwise(F.col("id").cast("string")).alias("id"), F.col("id").alias("bet_id"), F.col("sort_date").alias("date"), "site", "sport",
        number(F.col("raw_bet"), F.col("bet")).alias("bet"), number(F.col("raw_to_win"), F.col("to_win")).alias("to_win"), number(F.col("raw_net"), F.col("net")).alias("net"), F.col("ticket_result").alias("overall_result"), "type", "category", "name", "name2",
        F.when(F.col("over") == "1", "Over").when(F.col("under") == "1", "Under").alias("ou"), F.nullif("line", F.lit("")).alias("line"), odds.alias("odds"), F.lower("result").alias("result"), "is_live", F.when(F.col("tail") == "1", F.col("ticket_tail")).alias("tail"),
        "parlay_id", "leg_index", "leg_count", "is_header", "is_child",
    )
