"""Text keys, searching and small parsers."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Typographic marks and what they are typed as.
SINGLE_QUOTES = "‘’‚‛′‵"
DOUBLE_QUOTES = "“”„‟″‶"
DASHES = "‐‑‒–—―−"
SPACES = "\u00a0\u202f"
BLANKS = r"[\s\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]+"


@F.pandas_udf(StringType())
def nfkc(column: pd.Series) -> pd.Series:
    return column.map(lambda s: None if s is None else unicodedata.normalize("NFKC", s))


def spaced(text: Column) -> Column:
    """White space of any kind as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, BLANKS, " "))


def lookup_key(text: Column | str) -> Column:
    """The key under which names are compared; null gives ''.

    Spark has no NFKC function: texts with other than ASCII characters go through a pandas UDF.
    """
    t = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    t = F.when(t.rlike(r"[^\x00-\x7F]"), nfkc(t)).otherwise(t)
    return ascii_key(t)


def ascii_key(t: Column) -> Column:
    t = F.translate(t, SINGLE_QUOTES + DOUBLE_QUOTES + DASHES + SPACES, "'" * len(SINGLE_QUOTES) + '"' * len(DOUBLE_QUOTES) + "-" * len(DASHES) + " " * len(SPACES))
    return F.lower(spaced(t))


def queue_id(name: Column, ticket: Column, leg: Column | None = None) -> Column:
    """Names an item of the queue of unresolved names: key of the name, ticket and leg if there is one."""
    return F.concat_ws("::", lookup_key(name), ticket.cast("string"), *([] if leg is None else [leg.cast("string")]))


def search_key(text: Column) -> Column:
    """For searching: lower case, without . - _ '."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.trim(F.coalesce(text, F.lit("")))), r"[.\-_']", ""), r"\s+", " "))


def _score(query: str, text: Column, exact: int, prefix: int) -> Column:
    t = search_key(text)
    token = F.array_contains(F.split(t, " "), query)
    return F.when(t == "", 0).when(t == query, exact).when(t.startswith(query), prefix).when(token, 40).when(t.contains(query), 10).otherwise(0)


def match_score(query: str, value: Column, label: Column, aliases: Column) -> Column:
    """How well an option answers a query: 100 for its value down to 10 for a part of a name; a blank query takes all."""
    q = " ".join("".join(c for c in query.strip().lower() if c not in ".-_'").split())
    if not q:
        return F.lit(100)
    best = F.array_max(F.transform(F.coalesce(aliases, F.array().cast("array<string>")), lambda a: _score(q, a, 80, 60)))
    return F.greatest(_score(q, value, 100, 70), _score(q, label, 90, 70), F.coalesce(best, F.lit(0)))


def future_entity(description: Column) -> Column:
    """Whom a future is about: the text before the first of some phrases; else the text itself, cut at 40 letters."""
    # Phrases in the order in which they are tried.
    phrases = [r"(?i)^(.*?)\s+to\s+win", r"(?i)^(.*?)\s+win\s+total", r"(?i)^(.*?)\s+vs\.", r"^(.*?)\s+-\s+", r"(?i)^(.*?)\s+(?:Over|Under)\s+\d", r"^(.*?)\s+\([+-]\d+\)", r"^(.*?)\s+\(", r"(?i)^(.*?)\s+(?:Finals|Championship)"]
    found = [F.trim(F.regexp_extract(description, p, 1)) for p in phrases]
    whole = F.when(F.length(description) > 40, F.concat(F.substring(description, 1, 40), F.lit("…"))).otherwise(description)
    return F.coalesce(*[F.when(F.length(f) > 1, f) for f in found], whole)


def number_prefix(text: Column) -> Column:
    """The number a text begins with, null if none."""
    return F.nullif(F.regexp_extract(F.trim(text), r"^([+-]?(?:\d+\.?\d*|\.\d+))", 1), F.lit("")).try_cast("double")


def amount(text: Column) -> Column:
    return number_prefix(F.regexp_replace(text, r"[$,\s]", ""))


def american_odds(text: Column) -> Column:
    """Odds with or without a plus; the typographic minus counts."""
    return number_prefix(F.regexp_replace(F.translate(text, "−", "-"), r"^\s*\+", "")).cast("int")


def outcome_word(text: Column) -> Column:
    t = F.lower(F.coalesce(text, F.lit("")))
    return F.when(t.contains("won") | t.contains("win"), "win").when(t.contains("lost") | t.contains("loss"), "loss").when(t.contains("push"), "push").otherwise("pending")
