"""Market categories and types by keyword rules, as columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that mark futures, main markets and props.
FUTURES = ["to win", "award", "mvp", "dpoy", "roy", "champion", "championship", "outright", "win total", "win totals", "make playoffs", "miss playoffs", "nba finals", "super bowl", "world series", "stanley cup"]
MAIN = ["moneyline", "ml", "spread", "point spread", "total", "totals", "over", "under", "run line", "puck line"]
PROPS = ["triple double", "triple-double", "double double", "double-double", "first basket", "first field goal", "first fg", "top scorer", "top points", "top pts", "points", "pts", "rebounds", "reb", "assists", "ast", "threes", "3pt", "3-pointers", "made threes", "steals", "stl", "blocks", "blk", "turnovers", "pra", "pr", "ra", "pa", "stocks", "player", "prop", "to record", "to score", "yards", "touchdown", "td", "receiving", "rushing", "passing", "home runs", "strikeouts", "hits", "runs", "goals", "shots on goal"]
AMBIGUOUS = ["points", "pts", "runs", "goals", "score", "total", "over", "under"]
# Type by the first phrase that a market contains.
PROP_TYPES = {"points rebounds assists": "PRA", "pts reb ast": "PRA", "points rebounds": "PR", "pts reb": "PR", "rebounds assists": "RA", "reb ast": "RA", "points assists": "PA", "pts ast": "PA", "steals blocks": "Stocks", "stl blk": "Stocks", "first basket": "FB", "first field goal": "FB", "first fg": "FB", "top scorer": "Top Pts", "top points": "Top Pts", "top pts": "Top Pts", "double double": "DD", "double-double": "DD", "triple double": "TD", "triple-double": "TD", "made threes": "3pt", "3-pointers": "3pt", "threes": "3pt", "3pt": "3pt", "points": "Pts", "pts": "Pts", "rebounds": "Reb", "reb": "Reb", "assists": "Ast", "ast": "Ast", "steals": "Stl", "stl": "Stl", "blocks": "Blk", "blk": "Blk", "turnovers": "TO"}
MAIN_TYPES = {"spread": "Spread", "total": "Total", "over": "Total", "under": "Total", "moneyline": "Moneyline", "ml": "Moneyline", "money line": "Moneyline"}
FUTURE_TYPES = {"nba finals": "NBA Finals", "super bowl": "Super Bowl", "world series": "World Series", "stanley cup": "Stanley Cup", "wcc": "WCC", "ecc": "ECC", "win total": "Win Total", "make playoffs": "Make Playoffs", "miss playoffs": "Miss Playoffs", "mvp": "MVP", "dpoy": "DPOY", "roy": "ROY", "champion": "Champion"}
BASKETBALL = ["NBA", "WNBA", "CBB", "NCAAB"]
PARLAY_TYPES = {"sgp_plus": "SGP+", "sgp": "SGP", "parlay": "Parlay"}


def whole_word(words: list[str]) -> str:
    """One pattern for any of the words, between word boundaries, whatever the case."""
    return r"(?i)\b(?:" + "|".join(map(re.escape, words)) + r")\b"


def anywhere(words: list[str]) -> str:
    return "(?:" + "|".join(map(re.escape, words)) + ")"


def _first(text: Column, table: dict[str, str]) -> Column:
    out = None
    for phrase, kind in table.items():
        out = F.when(text.contains(phrase), kind) if out is None else out.when(text.contains(phrase), kind)
    return out


def ticket_category(bet_type: Column, description: Column, name: Column, type_: Column, known_team: Column) -> Column:
    """Parlays, Futures, Main Markets or Props. known_team: whether the name is a team's."""
    d = F.coalesce(description, F.lit(""))
    named = F.coalesce(name, F.lit("")) != ""
    strong = d.rlike(whole_word([w for w in PROPS if w not in AMBIGUOUS]))
    main = ~(named & ~known_team) & ~strong & (d.rlike(whole_word(MAIN)) | F.trim(d).rlike(r"[+-]\d{1,3}(\.5)?$"))
    prop = (F.trim(F.coalesce(name, F.lit(""))) != "") | (F.trim(F.coalesce(type_, F.lit(""))) != "") | d.rlike(whole_word(PROPS))
    some = named | (F.coalesce(type_, F.lit("")) != "")
    return F.when(bet_type.isin("parlay", "sgp", "sgp_plus"), "Parlays").when(d.rlike(whole_word(FUTURES)), "Futures").when(bet_type.isin("single", "live", "other") & main, "Main Markets").when(prop | some, "Props").otherwise("Main Markets")


def leg_category(market: Column) -> Column:
    """By parts of words: 'Turnovers' holds 'over' and is a main market."""
    m = F.lower(F.coalesce(market, F.lit("")))
    main = m.rlike(anywhere(MAIN)) & ~m.contains("player") & ~m.contains("prop")
    return F.when(F.trim(m) == "", "Props").when(m.rlike(anywhere(FUTURES)), "Futures").when(main, "Main Markets").otherwise("Props")


def market_type(market: Column, category: Column, sport: Column, canonical: Column) -> Column:
    """Type of a market in its category. canonical: the bet type that the market's name resolves to, else null; no hit gives the market itself."""
    m = F.lower(market)
    td = sport.isin(*BASKETBALL) & ((F.trim(m) == "td") | m.contains(" td ") | m.startswith("td ") | m.endswith(" td"))
    exact = F.when(F.trim(m).isin("fb", "first basket", "first field goal", "first fg"), "FB").when(F.trim(m).isin("top pts", "top scorer", "top points", "top points scorer"), "Top Pts").when(F.trim(m).isin("dd", "double double", "double-double"), "DD").when(F.trim(m).isin("triple double", "triple-double"), "TD")
    known = F.when(canonical.isNotNull() & (canonical != m), canonical)
    prop = F.coalesce(known, F.when(F.trim(m) != m, F.trim(m)), exact, F.when(td, "TD"), _first(m, PROP_TYPES))
    found = F.when(category == "Props", prop).when(category == "Main Markets", _first(m, MAIN_TYPES)).when(category == "Futures", _first(m, FUTURE_TYPES))
    return F.when(F.trim(F.coalesce(market, F.lit(""))) == "", "").otherwise(F.coalesce(found, market))


def display_category(category: Column) -> Column:
    c = F.lower(F.coalesce(category, F.lit("")))
    return F.when(c == "", "").when(c.contains("parlay") | c.contains("sgp"), "Parlays").when(c.contains("prop"), "Props").when(c.contains("main"), "Main").when(c.contains("future"), "Futures").otherwise("Props")


def in_brackets(market: Column) -> Column:
    """What stands in brackets at the end of a market, null if nothing does."""
    return F.nullif(F.regexp_extract(F.coalesce(market, F.lit("")), r"\(([^)]+)\)$", 1), F.lit(""))


def parlay_type(bet_type: Column, otherwise: str = "") -> Column:
    out = F.lit(otherwise)
    for k, v in PARLAY_TYPES.items():
        out = F.when(bet_type == k, v).otherwise(out)
    return out


def inferred_bet_type(description: Column, legs: Column) -> Column:
    """From words of the description and the number of legs."""
    d = F.lower(F.coalesce(description, F.lit("")))
    return F.when(d.contains("sgp") | d.contains("same game parlay"), "sgp").when(d.contains("live"), "live").when(legs > 1, F.when(d.contains("parlay"), "parlay").otherwise("sgp")).otherwise("single")


def leg_result(text: Column) -> Column:
    """WIN, LOSS, UNKNOWN, PUSH (also of a void leg) or PENDING for all else."""
    t = F.upper(text)
    return F.when(t.isin("WIN", "LOSS", "PUSH", "UNKNOWN"), t).when(t.isin("VOID", "VOIDED"), "PUSH").otherwise("PENDING")


def type_bucket(canonical: Column, parlays: list[str], futures: list[str], main: list[str]) -> Column:
    return F.when(canonical.isin(*parlays), "parlay").when(canonical.isin(*futures), "future").when(canonical.isin(*main), "main").otherwise("props")


def migrated_category(category: Column, fresh: Column) -> Column:
    """A stored category: made anew where it is missing or unknown, and where it says Main Markets, which once stood for much."""
    return F.when(category.isin("Props", "Futures", "Parlays"), category).otherwise(fresh)
