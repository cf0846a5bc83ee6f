"""Tickets from CSV: read as text, cast with care; rows that can't be cast are set aside, never an error in a job."""

from __future__ import annotations

import csv

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from .lines import numbered_lines

REQUIRED = ["Date", "Site", "Sport", "Type", "Name", "Odds", "Bet", "To Win", "Result"]


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """The file's rows as trimmed text; blank lines go, doubled quotes are quotes. A missing required column is an error before any job."""
    df = spark.read.options(header=True, inferSchema=False, quote='"', escape='"', ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True, mode="PERMISSIVE").csv(path)
    missing = [c for c in REQUIRED if c not in df.columns]
    if missing:
        raise ValueError(f"CSV is missing required headers: {', '.join(missing)}")
    return df


def cells(lines: DataFrame, header: list[str]) -> DataFrame:
    """Numbered lines (file, line_no, value) as trimmed text columns: cells end at commas outside quotes, doubled quotes are quotes."""
    found = F.regexp_extract_all("value", F.lit(r'((?:[^",]|"(?:[^"]|"")*")*)(?:,|$)'), F.lit(1))
    plain = F.transform(found, lambda c: F.trim(F.replace(F.regexp_replace(F.replace(c, F.lit('""'), F.lit("\x00")), '"', ""), F.lit("\x00"), F.lit('"'))))
    return lines.select("file", "line_no", *(F.coalesce(F.get(plain, F.lit(i)), F.lit("")).alias(c) for i, c in enumerate(header)))


def read_numbered(spark: SparkSession, path: str) -> DataFrame:
    """file, line_no and the cells of all files at a path: each has its own header, blank lines aren't counted.

    The header of the first file names the columns of all; a missing required one is an error before any job over the rows.
    """
    lines = numbered_lines(spark, path)
    first = lines.where("line_no = 1").orderBy("file").limit(1).collect()
    header = [c.strip() for c in next(csv.reader([first[0].value]))] if first else []
    missing = [c for c in REQUIRED if c not in header]
    if missing:
        raise ValueError(f"CSV is missing required headers: {', '.join(missing)}")
    return cells(lines.where("line_no > 1"), header)


def numeric_errors(rows: DataFrame) -> DataFrame:
    """rows with error: which of Odds, Bet and To Win don't begin with a number; null if all do."""
    odds, stake, win = text.american_odds(_cell(rows, "Odds")), text.amount(_cell(rows, "Bet")), text.amount(_cell(rows, "To Win"))
    bad = F.concat_ws(", ", *[F.when(c.isNull(), n) for c, n in ((odds, "Odds"), (stake, "Bet"), (win, "To Win"))])
    return rows.withColumn("error", F.when(bad != "", F.concat(F.lit("Invalid number format for "), bad, F.lit("."))))


def numbered_tickets(rows: DataFrame, sites: DataFrame, category: Column | None = None) -> DataFrame:
    """Tickets of numbered rows: the id is the file's name and the line, so that equal lines are two tickets; an error names its row.

    category: the ticket's market category (a column over name, type and bet_type), Props if not given.
    """
    told = numeric_errors(rows).select("*", F.col("error").alias("said"))
    out = csv_tickets(told, sites, kept=["file", "line_no", "said"])
    name = F.element_at(F.split("file", "/"), -1)
    out = out.withColumns({"id": F.concat_ws("-", "book", F.lit("csv"), name, F.col("line_no").cast("string")), "error": F.when(F.col("said").isNotNull(), F.concat(F.lit("Row "), F.col("line_no").cast("string"), F.lit(": "), "said"))})
    return out.withColumn("market_category", category if category is not None else F.lit("Props")).drop("said")


def _cell(df: DataFrame, name: str) -> Column:
    return F.trim(F.coalesce(F.col(f"`{name}`"), F.lit(""))) if name in df.columns else F.lit("")


def csv_date(t: Column) -> Column:
    """M/D/YYYY or an ISO date; null else. Two-digit years are refused."""
    p = r"^(\d{1,2})/(\d{1,2})/(\d{4})$"
    iso = F.concat_ws("-", F.regexp_extract(t, p, 3), F.lpad(F.regexp_extract(t, p, 1), 2, "0"), F.lpad(F.regexp_extract(t, p, 2), 2, "0"))
    return F.when(t.rlike(p), F.try_to_timestamp(iso, F.lit("yyyy-MM-dd"))).when(~t.contains("/"), t.try_cast("timestamp"))


def csv_tickets(raw: DataFrame, sites: DataFrame, app_words: bool = False, kept: list[str] | None = None) -> DataFrame:
    """Tickets with an error column naming the cells that can't be read (null: none).

    sites: name, abbreviation. Results go by how they begin: won, lost, push; anything else is pending. With app_words
    the words of this engine's own export (win, loss) count too.
    """
    r = F.lower(_cell(raw, "Result"))
    won, lost = (r.startswith("won") | (F.lit(app_words) & r.startswith("win")), r.startswith("lost") | (F.lit(app_words) & r.startswith("loss")))
    ou = F.lower(_cell(raw, "O/U"))
    rows = raw.select(
        csv_date(_cell(raw, "Date")).alias("placed_at"), _cell(raw, "Site").alias("site"), _cell(raw, "Sport").alias("sport"), _cell(raw, "Type").alias("type"), _cell(raw, "Name").alias("name"),
        F.when(ou == "over", "Over").when(ou == "under", "Under").alias("ou"), _cell(raw, "Line").alias("line"), text.american_odds(_cell(raw, "Odds")).alias("odds"),
        text.amount(_cell(raw, "Bet")).cast("decimal(18,2)").alias("stake"), text.amount(_cell(raw, "To Win")).cast("decimal(18,2)").alias("to_win"),
        F.when(won, "win").when(lost, "loss").when(r.startswith("push"), "push").otherwise("pending").alias("result"),
        F.nullif(_cell(raw, "Tail"), F.lit("")).alias("tail"), F.lower(_cell(raw, "Notes")).contains("live").alias("is_live"), *(kept or []),
    )
    known = sites.select(F.explode(F.array(F.lower("name"), F.lower("abbreviation"))).alias("k"), F.col("name").alias("book_name")).dropDuplicates(["k"])
    rows = rows.join(known, F.lower("site") == F.col("k"), "left").withColumn("book", F.coalesce("book_name", "site"))
    payout = F.when(F.col("result") == "win", F.col("stake") + F.col("to_win")).when(F.col("result") == "push", F.col("stake")).otherwise(F.lit(0))
    bad = F.concat_ws(", ", *[F.when(F.col(c).isNull(), n) for c, n in (("odds", "Odds"), ("stake", "Bet"), ("to_win", "To Win"), ("placed_at", "Date"))])
    out = rows.withColumn("payout", payout.cast("decimal(18,2)")).withColumn("error", F.nullif(bad, F.lit("")))
    # An id that depends on the row's content alone: runs again give the same.
    out = out.withColumn("id", F.concat_ws("-", "book", F.lit("csv"), F.sha2(F.to_json(F.struct("placed_at", "site", "sport", "type", "name", "ou", "line", "odds", "stake", "to_win", "result")), 256).substr(1, 16)))
    return out.withColumn("bet_type", F.lit("single")).drop("k", "book_name", "site")


def split_errors(tickets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good rows and those to look at."""
    return tickets.filter("error IS NULL").drop("error"), tickets.filter("error IS NOT NULL")
