"""Numbers and dates as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def odds(column: Column | str) -> Column:
    """With their sign, halves rounded up; '' for none."""
    o = F.floor((F.col(column) if isinstance(column, str) else column) + 0.5)
    return F.when(F.coalesce(o, F.lit(0)) == 0, "").when(o > 0, F.concat(F.lit("+"), o.cast("string"))).otherwise(o.cast("string"))


def currency(x: Column) -> Column:
    return F.concat(F.when(x < 0, "-$").otherwise("$"), F.format_number(F.abs(x), 2))


def percent(x: Column) -> Column:
    return F.format_string("%.1f%%", x.cast("double"))


def user_date(text: Column, year: Column) -> Column:
    """M/D, M/D/YY (20YY) or M/D/YYYY at noon; null if it is no day of the calendar."""
    part = lambda i: F.nullif(F.regexp_extract(F.trim(text), r"^(\d{1,2})/(\d{1,2})(?:/(\d{2}|\d{4}))?$", i), F.lit(""))
    y = F.when(F.length(part(3)) == 2, F.concat(F.lit("20"), part(3))).otherwise(part(3))
    whole = F.concat_ws("-", F.lpad(F.coalesce(y, year.cast("string")), 4, "0"), F.lpad(part(1), 2, "0"), F.lpad(part(2), 2, "0"))
    return F.when(part(1).isNotNull(), F.try_to_timestamp(F.concat(whole, F.lit(" 12:00:00")), F.lit("yyyy-MM-dd HH:mm:ss")))


def fanduel_date(text: Column) -> Column:
    """'M/D/YYYY h:mmAM ET', five hours behind UTC all year."""
    stamp = F.regexp_extract(text, r"(\d{1,2}/\d{1,2}/\d{4})\s+(\d{1,2}:\d{2}\s*[AP]M)", 0)
    return F.try_to_timestamp(F.concat(F.regexp_replace(F.regexp_replace(stamp, r"\s*([AP]M)$", " $1"), r"\s+", " "), F.lit(" -05:00")), F.lit("M/d/yyyy h:mm a XXX"))


def draftkings_date(text: Column) -> Column:
    """'MMM D, YYYY, h:mm:ss AM' in the session's zone."""
    return F.try_to_timestamp(F.regexp_replace(F.trim(text), r"[\s ]+", " "), F.lit("MMM d, yyyy, h:mm:ss a"))


def resolution_date(description: Column, sport: Column, year: Column) -> Column:
    """The day on which a future is usually settled in a year; null if not known."""
    d, s = F.lower(description), F.lower(sport)
    # Events, and win totals by sport, with month and day.
    events = [("super bowl", 2, 9), ("nfl championship", 2, 9), ("nba finals", 6, 15), ("nba championship", 6, 15), ("world series", 10, 30), ("mlb championship", 10, 30), ("stanley cup", 6, 20), ("nhl championship", 6, 20)]
    totals = [(("nfl", "football"), 1, 8), (("nba", "basketball"), 4, 14), (("mlb", "baseball"), 10, 1), (("nhl", "hockey"), 4, 15)]
    day = lambda m, n: F.make_date(year, F.lit(m), F.lit(n))
    known = [F.when(d.contains(e), day(m, n)) for e, m, n in events] + [F.when(d.contains("win total") & s.isin(*names), day(m, n)) for names, m, n in totals]
    return F.coalesce(*known)


def days_until(day: Column, as_of: Column) -> Column:
    n = F.date_diff(day, F.to_date(as_of))
    return F.when(n > 0, n)
