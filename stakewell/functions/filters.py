"""Predicates over tickets, as boolean columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .money import is_parlay

DAYS = {"1d": 1, "3d": 3, "1w": 7}
MONTHS = {"1m": 1, "1y": 12}


def bet_type(kind: str) -> Column:
    """all, non-parlays or parlays."""
    return {"all": F.lit(True), "parlays": is_parlay(), "non-parlays": ~is_parlay()}[kind]


def range_start(preset: str, as_of: Column) -> Column:
    """Start of a look-back window; months clamp to the end of a shorter month."""
    return as_of - F.make_interval(days=F.lit(DAYS[preset])) if preset in DAYS else as_of - F.make_interval(months=F.lit(MONTHS[preset]))


def placed_since(preset: str, as_of: Column, at: str = "placed_at") -> Column:
    """Presets have a lower bound only; a missing date fails them."""
    return F.lit(True) if preset == "all" else F.coalesce(F.col(at) >= range_start(preset, as_of), F.lit(False))


def placed_between(start: str | None, end: str | None, at: str = "placed_at") -> Column:
    """From the start of the first day to the end of the last, either one optional; a missing date passes."""
    low = F.coalesce(F.col(at) < F.to_timestamp(F.lit(start)), F.lit(False)) if start else F.lit(False)
    high = F.coalesce(F.col(at) >= F.to_timestamp(F.lit(end)) + F.make_interval(days=F.lit(1)), F.lit(False)) if end else F.lit(False)
    return ~low & ~high


def equals(column: str, value: str) -> Column:
    """'all' or equality."""
    return F.lit(True) if value == "all" else F.coalesce(F.col(column) == value, F.lit(False))


def has_entity(entity: str | None, legs: str = "legs") -> Column:
    """Some leg names exactly this entity; None passes all."""
    return F.lit(True) if entity is None else F.coalesce(F.exists(legs, lambda leg: F.array_contains(leg["entities"], entity)), F.lit(False))


def over_under_market(kind: str, category: str = "market_category") -> Column:
    """props, totals, or all (both, but no parlays and futures)."""
    wanted = {"props": ["Props"], "totals": ["Main Markets"], "all": ["Props", "Main Markets"]}[kind]
    return F.coalesce(F.col(category).isin(*wanted), F.lit(False))


def open_futures() -> Column:
    return (F.col("market_category") == "Futures") & (F.col("result") == "pending")


def grid(term: str, columns: list[str]) -> Column:
    """Some column contains the term, whatever the case; a blank term passes all."""
    if not term.strip():
        return F.lit(True)
    out = F.lit(False)
    for c in columns:
        out = out | F.coalesce(F.lower(F.col(c)).contains(term.lower()), F.lit(False))
    return out


def display_market(kind: str, category: str = "market_category") -> Column:
    """props, main, or all: that is every ticket, parlays and futures too."""
    wanted = {"props": "Props", "main": "Main Markets"}
    return F.lit(True) if kind == "all" else F.coalesce(F.col(category) == wanted[kind], F.lit(False))


def parlay_of(kind: str, column: str = "bet_type") -> Column:
    """Parlays, of one type or of all."""
    return F.coalesce(F.col(column).isin("parlay", "sgp", "sgp_plus"), F.lit(False)) & equals(column, kind)


def named_like(term: str, column: str = "name") -> Column:
    return F.lower(F.col(column)).contains(term.strip().lower())
