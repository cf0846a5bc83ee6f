"""Values of spreadsheet rows as text: formatted, checked, and parsed back."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import formats, money

NET = r"^-?\d+\.\d{2}$"
ODDS = r"^[+-]?\d+$"


def final_result(text: Column) -> Column:
    """Win, Loss, Push or Pending; what is unknown or missing is pending."""
    t = F.lower(F.trim(text))
    return F.when((t == "win") | t.startswith("won"), "Win").when((t == "loss") | t.startswith("lost") | t.startswith("lose"), "Loss").when(t.startswith("push"), "Push").otherwise("Pending")


def flag(text: Column) -> Column:
    """'1', '0' or ''."""
    return F.when(text.isin("1", "true"), "1").when(text.isin("0", "false"), "0").otherwise("")


def single_flag(text: Column) -> Column:
    return F.when(text.isin("1", "true"), "1").otherwise("")


def amount(x: Column) -> Column:
    """Two decimals, without marks between thousands; '' for none."""
    return F.when(x.isNull() | F.isnan(x.cast("double")), "").otherwise(F.replace(F.format_number(x.cast("double"), 2), F.lit(","), F.lit("")))


def parsed_amount(text: Column) -> Column:
    """An amount as it was typed, with currency sign and commas, formatted anew; '' if it doesn't begin with a number."""
    clean = F.regexp_replace(F.trim(text), r"[$,\s]", "")
    number = F.regexp_extract(clean, r"^[+-]?(?:\d+\.?\d*|\.\d+)", 0)
    return F.when(F.coalesce(number, F.lit("")) == "", "").otherwise(amount(number.cast("double")))


def parsed_odds(text: Column) -> Column:
    """Whole odds with their sign; plain digits get a plus."""
    t = F.trim(F.coalesce(text, F.lit("")))
    return F.when(t.rlike(r"^\d+$"), F.concat(F.lit("+"), t)).when(t.rlike(ODDS), t).otherwise("")


def net_text(net: Column) -> Column:
    """The net as shown: what has a mark between thousands fails the check of a row's net and is ''."""
    shown = F.format_number(net.cast("double"), 2)
    return F.when(shown.rlike(NET), shown).otherwise("")


def row_net_text(result: Column, stake: Column, odds: Column, payout: Column) -> Column:
    """The net of a row as text: '' without a valid stake, a result, or odds that a win without payout needs."""
    r, s = F.lower(F.coalesce(result, F.lit(""))), stake.cast("double")
    won = F.when(payout > 0, net_text(payout - stake)).when(odds.isNotNull(), net_text(money.profit(stake, odds))).otherwise("")
    return F.when(s.isNull() | F.isnan(s) | (s < 0), "").when(r == "win", won).when(r == "loss", net_text(-s)).when(r == "push", net_text(F.lit(0.0))).otherwise("")


def odds_text(odds: Column) -> Column:
    text = formats.odds(odds)
    return F.when(text.rlike(ODDS), text).otherwise("")
