"""Checks of tickets before import: blockers and warnings as arrays of columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import money


def _list(*checks: tuple[Column, str]) -> Column:
    return F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(True)), F.lit(name)) for c, name in checks]))


def import_blockers() -> Column:
    """What keeps a ticket out: no id, no date, a bad stake, a bad result, a win without odds, a net that can't be told."""
    r = F.col("result")
    known = r.isin("win", "loss", "push", "pending")
    return _list(
        (F.col("id").isNull() | (F.trim(F.col("id").cast("string")) == ""), "id"),
        (F.col("placed_at").isNull(), "placed_at"),
        (F.col("stake").isNull() | (F.col("stake") < 0), "stake"),
        (r.isNull() | ~known, "result"),
        ((F.coalesce(r, F.lit("")) == "win") & (F.coalesce(F.col("odds"), F.lit(0)) == 0), "odds"),
        (money.expected_net().isNull(), "net"),
    )


def import_warnings(legs: Column | None = None) -> Column:
    """What should be looked at: no sport, a prop without a type, no category, a parlay without legs; with legs also one of unknown entity type."""
    vague = [] if legs is None else [(F.coalesce(F.exists(legs, lambda leg: leg["entity_type"] == "unknown"), F.lit(False)), "entity")]
    return _list(
        (F.coalesce(F.col("sport"), F.lit("")) == "", "sport"),
        ((F.col("market_category") == "Props") & (F.coalesce(F.col("type"), F.lit("")) == ""), "type"),
        (F.coalesce(F.col("market_category"), F.lit("")) == "", "category"),
        (money.is_parlay() & (F.coalesce(F.col("n_legs"), F.lit(0)) == 0), "legs"),
        *vague,
    )


def edit_errors() -> Column:
    """Checks of an edit: a stake above 0, odds within 10,000 and not 0, a known result."""
    return _list(
        (F.col("stake").isNull() | (F.col("stake") <= 0), "stake"),
        (F.coalesce(F.col("odds"), F.lit(0)).isin(0) | (F.abs(F.col("odds")) > 10_000), "odds"),
        (F.col("placed_at").isNull(), "placed_at"),
        (~F.coalesce(F.col("result").isin("win", "loss", "push", "pending"), F.lit(False)), "result"),
    )


# What the fields of a parsed ticket may hold.
BET_TYPES = ("single", "parlay", "sgp", "sgp_plus", "live", "other")
CATEGORIES = ("Props", "Main Markets", "Futures", "Parlays")
ENTITY_TYPES = ("player", "team", "unknown")
LEG_RESULTS = ("WIN", "LOSS", "PUSH", "PENDING", "UNKNOWN")
REQUIRED = ("id", "book", "bet_id", "placed_at", "bet_type", "sport", "description", "stake", "payout", "result")


def _blank(c: Column) -> Column:
    return F.coalesce(F.trim(c.cast("string")) == "", F.lit(True))


def _by_leg(*checks: tuple) -> Column:
    """Messages 'leg <place> <what>' of all legs; checks: (leg to condition, what)."""
    say = lambda leg, i: F.array_compact(F.array(*[F.when(F.coalesce(c(leg), F.lit(False)), F.concat(F.lit("leg "), i.cast("string"), F.lit(f" {what}"))) for c, what in checks]))
    return F.flatten(F.transform(F.coalesce("legs", F.array()), say))


def contract(bets: DataFrame) -> DataFrame:
    """bets with errors and warnings: whether a parser's nested tickets keep to the schema's rules."""
    groups = "children" in bets.schema["legs"].dataType.elementType.fieldNames()
    number = F.when(F.col("legs").isNull(), F.lit(0)).otherwise(F.size("legs"))
    errors = _list(
        *[(_blank(F.col(c)), f"no {c}") for c in REQUIRED],
        (F.col("stake") <= 0, "stake"),
        (F.col("payout") < 0, "payout"),
        (~_blank(F.col("result")) & ~F.col("result").isin("win", "loss", "push", "pending"), "result"),
        (~_blank(F.col("bet_type")) & ~F.col("bet_type").isin(*BET_TYPES), "bet_type"),
        (~_blank(F.col("market_category")) & ~F.coalesce(F.col("market_category").isin(*CATEGORIES), F.lit(False)), "market_category"),
        (number == 0, "legs"),
    )
    checks = [(lambda leg: _blank(leg["market"]), "market"), (lambda leg: ~leg["entity_type"].isin(*ENTITY_TYPES), "entity_type")]
    if groups:
        checks.append((lambda leg: leg["is_group_leg"] & (F.size(leg["children"]) == 0), "children"))
    hints = _list(
        (_blank(F.col("market_category")), "no market_category"),
        ((F.col("bet_type") == "single") & (number > 1), "single"),
        ((F.col("bet_type") == "parlay") & (number == 1), "parlay"),
    )
    lower = lambda leg: (leg["result"] != F.upper(leg["result"])) & F.upper(leg["result"]).isin(*LEG_RESULTS)
    by_leg = _by_leg((lambda leg: leg["entity_type"].isNull(), "no entity_type"), (lower, "result"))
    return bets.withColumns({"errors": F.concat(errors, _by_leg(*checks)), "warnings": F.concat(hints, by_leg)})


def contract_summary(checked: DataFrame) -> DataFrame:
    """Tickets, valid and invalid ones, and how many messages they have."""
    return checked.agg(F.count("*").alias("total"), F.count_if(F.size("errors") == 0).alias("valid"), F.count_if(F.size("errors") > 0).alias("invalid"), F.coalesce(F.sum(F.size("errors")), F.lit(0)).alias("errors"), F.coalesce(F.sum(F.size("warnings")), F.lit(0)).alias("warnings"))


def contract_messages(checked: DataFrame) -> DataFrame:
    """id, level (error, warning) and message: one row for each message of each ticket."""
    named = lambda level: lambda m: F.struct(F.lit(level).alias("level"), m.alias("message"))
    said = F.concat(F.transform("errors", named("error")), F.transform("warnings", named("warning")))
    return checked.select("id", F.explode(said).alias("m")).select("id", "m.*")


def batch_summary(bets: DataFrame) -> DataFrame:
    """Totals of blockers and warnings, and of the tickets that have some."""
    rows = bets.select(F.size(import_blockers()).alias("b"), F.size(import_warnings()).alias("w"))
    return rows.agg(F.count("*").alias("total"), F.coalesce(F.sum("b"), F.lit(0)).alias("blockers"), F.coalesce(F.sum("w"), F.lit(0)).alias("warnings"), F.count_if(F.col("b") > 0).alias("blocked"), F.count_if(F.col("w") > 0).alias("warned"), F.count_if(F.col("b") == 0).alias("valid"))


def import_summary(new: DataFrame, stored: DataFrame) -> DataFrame:
    """total, blocked, duplicates and what is left of an import; a blocked duplicate is taken off twice."""
    marked = new.select("id", (F.size(import_blockers()) > 0).alias("bad")).join(stored.select("id").distinct().withColumn("old", F.lit(True)), "id", "left")
    rows = marked.agg(F.count("*").alias("total"), F.count_if("bad").alias("blocked"), F.count_if(F.col("old")).alias("duplicates"))
    return rows.withColumn("net_new", F.greatest(F.lit(0), F.col("total") - F.col("duplicates") - F.col("blocked")))
