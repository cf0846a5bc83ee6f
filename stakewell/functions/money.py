"""Money and outcome columns. Amounts may be decimals or whole cents; odds are American."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PARLAYS = ("parlay", "sgp", "sgp_plus")
#: Which of two results wins when legs are merged.
PRIORITY = {"win": 4, "loss": 3, "push": 2, "pending": 1}


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def net(result: Column | str = "result", stake: Column | str = "stake", payout: Column | str = "payout") -> Column:
    """The KPI net: nothing while pending, else payout less stake; odds play no part."""
    return F.when(_c(result) == "pending", F.lit(0)).otherwise(_c(payout) - _c(stake))


def is_parlay(bet_type: Column | str = "bet_type") -> Column:
    return F.coalesce(_c(bet_type).isin(*PARLAYS), F.lit(False))


def is_decided(result: Column | str = "result") -> Column:
    return F.coalesce(_c(result).isin("win", "loss", "push"), F.lit(False))


def roi(net_: Column, stake: Column) -> Column:
    """Percent of the stake; 0 without stake."""
    return F.when(stake > 0, net_ / stake * 100).otherwise(F.lit(0.0))


def win_rate(wins: Column, losses: Column) -> Column:
    """Percent of wins among wins and losses; 0 if neither."""
    return F.when(wins + losses > 0, wins / (wins + losses) * 100).otherwise(F.lit(0.0))


def decimal_odds(odds: Column | str = "odds") -> Column:
    o = _c(odds)
    return F.when(o > 0, 1 + o / 100).when(o < 0, 1 + 100 / F.abs(o)).otherwise(F.lit(1.0))


def profit(stake: Column | str = "stake", odds: Column | str = "odds") -> Column:
    """Profit of a win at the odds; 0 without a stake or odds."""
    s, o = _c(stake), _c(odds)
    return F.when(~(s > 0) | s.isNull(), F.lit(0.0)).when(o > 0, s * o / 100).when(o < 0, s * 100 / F.abs(o)).otherwise(F.lit(0.0))


def recalculated_payout(stake: Column | str = "stake", odds: Column | str = "odds", result: Column | str = "result") -> Column:
    s, r = _c(stake), _c(result)
    return F.when(r == "win", s + profit(s, odds)).when(r == "push", s.cast("double")).otherwise(F.lit(0.0))


def row_net(result: Column | str = "result", stake: Column | str = "stake", odds: Column | str = "odds", payout: Column | str = "payout") -> Column:
    """The net of a spreadsheet row: by result, and by odds where a win has no payout. Not the KPI net."""
    r, s, o, p = map(_c, (result, stake, odds, payout))
    return F.when(r == "win", F.when(p > 0, (p - s).cast("double")).when(F.coalesce(o, F.lit(0)) != 0, profit(s, o))).when(r == "loss", (-s).cast("double")).when(r == "push", F.lit(0.0))


def to_win(stake: Column | str = "stake", odds: Column | str = "odds", payout: Column | str = "payout") -> Column:
    s, o, p = map(_c, (stake, odds, payout))
    return F.when(p > 0, p.cast("double")).when(F.coalesce(o, F.lit(0)) != 0, s + profit(s, o))


def expected_net(stake: Column | str = "stake", odds: Column | str = "odds", result: Column | str = "result") -> Column:
    """The net that a result implies; null where a win has no odds or the result is unknown."""
    s, o, r = map(_c, (stake, odds, result))
    return F.when(r.isin("pending", "push"), F.lit(0.0)).when(r == "loss", (-s).cast("double")).when((r == "win") & (F.coalesce(o, F.lit(0)) != 0), profit(s, o))


def entity_stake(stake: Column | str = "stake", bet_type: Column | str = "bet_type") -> Column:
    """What a ticket adds to its entities: nothing if it is a parlay."""
    return F.when(is_parlay(bet_type), F.lit(0)).otherwise(_c(stake))


def attributed(amount: Column, legs: Column, policy: str = "ticket") -> Column:
    """policy 'ticket': the full amount; 'split': an equal part for each leg."""
    if policy not in ("ticket", "split"):
        raise ValueError(f"unknown policy {policy!r}")
    return amount if policy == "ticket" else F.when(legs > 1, amount / legs).otherwise(amount)


def leg_outcome(result: Column | str) -> Column:
    """The leg's own result in lower case, never inferred from the ticket."""
    r = F.lower(_c(result))
    return F.when(r.isin("win", "loss", "push", "pending"), r).otherwise("unknown")


def merged_result(a: Column, b: Column) -> Column:
    """Of two results the stronger; ties keep the first."""
    rank = lambda r: F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in PRIORITY.items() for x in kv]), F.lower(F.coalesce(r, F.lit("")))), F.lit(0))
    return F.when(rank(b) > rank(a), b).otherwise(a)


def merged_odds(a: Column, b: Column) -> Column:
    """The first odds that aren't missing; 0 is missing."""
    return F.coalesce(F.nullif(a, F.lit(0)), F.nullif(b, F.lit(0)))


def group_result(results: Column, push_needs_all: bool) -> Column:
    """The outcome of a group of legs: a loss loses, then pending, then unknown; pushes as the sportsbook has them."""
    low = F.transform(results, leg_outcome)
    some = lambda v: F.exists(low, lambda r: r == v)
    every = lambda v: F.forall(low, lambda r: r == v)
    push = every("push") if push_needs_all else some("push")
    return F.when(F.size(low) == 0, F.lit(None).cast("string")).when(some("loss"), "LOSS").when(some("pending"), "PENDING").when(some("unknown"), "UNKNOWN").when(push, "PUSH").otherwise("WIN")


def hedge(stake: Column, potential: Column, current_odds: Column) -> Column:
    """hedge_stake, original_profit, hedge_profit, guaranteed and advice; null without odds."""
    m = decimal_odds(current_odds)
    h = potential / m
    first, second = potential - stake - h, h * m - h - stake
    sure = F.least(first, second)
    advice = F.when(sure > 0.5 * stake, "strong").when(sure > 0, "moderate").otherwise("not_recommended")
    return F.when(F.coalesce(current_odds, F.lit(0)) != 0, F.struct(h.alias("hedge_stake"), first.alias("original_profit"), second.alias("hedge_profit"), sure.alias("guaranteed"), advice.alias("advice")))
