"""Legs of a ticket as arrays: groups opened, places kept, repeated legs merged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import money

LEAF = ("entities", "market", "target", "ou", "odds", "result")


def leaf(leg: Column) -> Column:
    """The fields that groups and their children share."""
    return F.struct(*[leg[c].alias(c) for c in LEAF])


def has_groups(bets: DataFrame) -> bool:
    return "children" in bets.schema["legs"].dataType.elementType.fieldNames()


def none_of(array: Column) -> Column:
    """Whether an array is null or empty."""
    return F.coalesce(F.size(array) <= 0, F.lit(True))


def visible_legs(bets: DataFrame) -> DataFrame:
    """id, parent, child, leg: one row a leg, those of a group under its place; a group without children is a leg itself."""
    rows = bets.select("id", F.posexplode("legs").alias("parent", "of"))
    own = F.struct(F.lit(None).cast("int").alias("child"), leaf(F.col("of")).alias("leg"))
    if not has_groups(bets):
        return rows.select("id", "parent", own.alias("x")).select("id", "parent", "x.*")
    inner = F.transform("of.children", lambda c, i: F.struct(i.alias("child"), leaf(c).alias("leg")))
    group = F.coalesce(F.col("of.is_group_leg"), F.lit(False)) & ~none_of(F.col("of.children"))
    return rows.select("id", "parent", F.explode(F.when(group, inner).otherwise(F.array(own))).alias("x")).select("id", "parent", "x.*")


def expanded_legs(bets: DataFrame) -> Column:
    """The legs that rows are made of: a bare 'same game parlay' goes, a group gives its children, one level down, and goes without any."""
    groups = has_groups(bets)

    def bare(leg: Column) -> Column:
        named = F.lower(F.coalesce(leg["market"], F.lit(""))).contains("same game parlay")
        return named & none_of(leg["entities"]) & (none_of(leg["children"]) if groups else F.lit(True))

    kept = F.filter("legs", lambda leg: ~bare(leg))
    if not groups:
        return F.transform(kept, leaf)

    def opened(leg: Column) -> Column:
        children = F.coalesce(F.transform(leg["children"], leaf), F.array())
        return F.when(F.coalesce(leg["is_group_leg"], F.lit(False)), children).otherwise(F.array(leaf(leg)))

    return F.flatten(F.transform(kept, opened))


def merged_legs(legs: Column, later_wins: bool = False) -> Column:
    """Legs (leaf structs) without repeats: equal in first entity, market, side and target, or with a target on one side only.

    Of two merged legs the one with a target gives it. Results: the stronger one, odds: the first that aren't missing; with
    later_wins both come from the later leg that has them. A leg without a target joins the first leg of its name, market and
    side. A few legs a ticket: a fold over the array, no shuffle.
    """
    low = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    target = lambda x: F.trim(F.coalesce(x["target"], F.lit("")))
    name = lambda x: F.struct(low(F.get(x["entities"], F.lit(0))), low(x["market"]), F.coalesce(x["ou"], F.lit("")))
    alike = lambda x, y: name(x) == name(y)
    given = lambda c: F.nullif(c, F.lit(""))

    def entry(x: Column, first: Column) -> Column:
        return F.struct(*[x[c].alias(c) for c in LEAF], first.alias("first"))

    def merged(old: Column, new: Column) -> Column:
        odds = money.merged_odds(new["odds"], old["odds"])
        result = F.coalesce(new["result"], old["result"]) if later_wins else money.merged_result(new["result"], old["result"])
        entities = F.when(none_of(new["entities"]), old["entities"]).otherwise(new["entities"])
        side, market = F.coalesce(given(new["ou"]), old["ou"]), F.coalesce(given(new["market"]), old["market"])
        fields = {"entities": entities, "market": market, "target": F.coalesce(given(new["target"]), old["target"]), "ou": side, "odds": odds, "result": result}
        return F.struct(*[fields[c].alias(c) for c in LEAF], old["first"].alias("first"))

    def take(seen: Column, leg: Column) -> Column:
        same = lambda x: alike(x, leg) & (target(x) == target(leg))
        half = lambda x: x["first"] & alike(x, leg) & ((target(x) == "") != (target(leg) == ""))
        again = F.transform(seen, lambda x: F.when(same(x), merged(x, leg)).otherwise(x))
        # A leg that takes a target over goes to the end, as the newest.
        joined = F.concat(F.filter(seen, lambda x: ~half(x)), F.transform(F.filter(seen, half), lambda x: merged(x, leg)))
        new = F.concat(seen, F.array(entry(leg, ~F.exists(seen, lambda x: alike(x, leg)))))
        return F.when(F.exists(seen, same), again).when(F.exists(seen, half), joined).otherwise(new)

    start = F.filter(F.transform(legs, lambda x: entry(x, F.lit(True))), lambda x: F.lit(False))  # empty, of the right type
    return F.transform(F.aggregate(legs, start, take), leaf)
