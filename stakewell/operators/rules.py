"""Texts that match rules: sets of parts that a text must hold, found by an index instead of one test a rule.

A rule is a row (rule, priority, code, parts): all its parts must stand in the text. Parts are indexed by their first two
letters. Each distinct text probes with its own pairs of letters, `contains` verifies the parts that it meets, and a rule
counts whose number of met parts is all of them. The least priority wins. The number of rules is then of no matter to a text
that holds none of their parts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import spaced
from ..sources.shared import written
from .resolve import looked_up

# Statistics of market texts, in the order in which they are tried. Each has one or more sets of parts, of
# which one must stand in the text.
MARKET_RULES = [
    ("FB", [["first basket"], ["first field goal"], ["first fg"]]),
    ("Top Pts", [["top scorer"], ["top points"], ["top pts"]]),
    ("TD", [["triple double"]]),
    ("DD", [["double double"]]),
    ("PRA", [[p, r, a] for p in ("points", "pts") for r in ("reb",) for a in ("assists", "ast")]),
    ("PR", [[p, "reb"] for p in ("points", "pts")]),
    ("RA", [["reb", a] for a in ("assists", "ast")]),
    ("PA", [[p, a] for p in ("points", "pts") for a in ("assists", "ast")]),
    ("Stocks", [[s, b] for s in ("steals", "stl") for b in ("blocks", "blk")]),
    ("3pt", [["made threes"], ["3-pointers"], ["3 pointers"], ["threes"]]),
    ("Pts", [["points"], ["pts"]]),
    ("Ast", [["assists"], ["ast"]]),
    ("Reb", [["reb"]]),
    ("Stl", [["steals"], ["stl"]]),
    ("Blk", [["blocks"], ["blk"]]),
    ("TO", [["turnovers"], ["to"]]),
]


def market_rules(spark: SparkSession) -> DataFrame:
    """rule, priority, code and parts."""
    rows = [(code, priority, parts) for priority, (code, sets) in enumerate(MARKET_RULES) for parts in sets]
    return spark.createDataFrame([(n, p, c, parts) for n, (c, p, parts) in enumerate(rows)], "rule int, priority int, code string, parts array<string>")


def matched(texts: DataFrame, rules: DataFrame, text: str = "text") -> DataFrame:
    """text, code: for the distinct texts that match a rule, the code of the one with the least priority. Parts have two letters at least."""
    parts = rules.select("rule", F.explode(F.array_distinct("parts")).alias("part"))
    index = parts.select("part").distinct().withColumn("pair", F.substring("part", 1, 2))
    known = texts.select(F.col(text).alias("t")).where(F.length(text) >= 2).distinct()
    pairs = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("t") - 1), lambda i: F.substring(F.col("t"), i, F.lit(2))))
    held = known.select("t", F.explode(pairs).alias("pair")).join(index, "pair").where(F.contains("t", "part")).select("t", "part")
    met = held.join(parts, "part").groupBy("t", "rule").agg(F.count("*").alias("n"))
    needed = rules.select("rule", "priority", "code", F.size(F.array_distinct("parts")).alias("needed"))
    whole = met.join(needed, "rule").where("n = needed")
    return whole.groupBy(F.col("t").alias(text)).agg(F.min_by("code", F.struct("priority", "rule")).alias("code"))


def market_texts(rows: DataFrame, rules: DataFrame, market: str = "market") -> DataFrame:
    """rows with kind, line and side of their market text: a statistic's code, else the text without numbers; 'n+' or the first number, else ''; Over, Under or null.

    Distinct texts are read once and joined back. A null text is one without anything: '', ''.
    """
    # Stored: the optimizer drops a distinct that another follows, and would read the text of every row.
    said = written(rows.select(F.col(market).alias("said")).where(F.col("said").isNotNull()).distinct(), "market-texts")
    whole = spaced(F.col("said"))
    clean = F.trim(F.regexp_replace(whole, r"(?i)^to\s+record\s+", ""))
    plus, number = F.regexp_extract(clean, r"(\d+(?:\.\d+)?)\s*\+", 1), F.regexp_extract(clean, r"(\d+(?:\.\d+)?)", 1)
    bare = F.regexp_replace(clean, r"\d+(?:\.\d+)?\s*\+?", "")
    for pattern in (r"(?i)over\s+", r"(?i)under\s+", r"(?i)to\s+record\s+", r"(?i)to\s+score\s+"):
        bare = F.regexp_replace(bare, pattern, "")
    bare = F.trim(bare)
    side = F.when(clean.rlike(r"(?i)over\s+\d+"), "Over").when(clean.rlike(r"(?i)under\s+\d+"), "Under")
    read = said.select("said", F.when(plus != "", F.concat(plus, F.lit("+"))).otherwise(number).alias("line"), side.alias("side"), F.lower(bare).alias("stat"), F.when(bare != "", bare).otherwise(whole).alias("rest"))
    codes = matched(read, rules, "stat")
    read = read.join(codes, "stat", "left").select("said", F.coalesce("code", "rest").alias("kind"), "line", "side")
    joined = looked_up(rows, read, F.col(market) == F.col("said"), F.col(market).isNotNull()).drop("said")
    return joined.withColumns({"kind": F.coalesce("kind", F.lit("")), "line": F.coalesce("line", F.lit(""))})
