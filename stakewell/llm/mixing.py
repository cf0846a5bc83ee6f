"""Mixing sources to target weights by hash-threshold histograms.

Every document has a 60-bit hash of its id. Words are summed by source and the
leading hash bits; where the running sum passes the source's budget lies the
boundary bucket, and only that bucket is summed again by its next bits, until
it holds one hash. A source is then cut by one comparison a row: no sort.

Nulls: a null text has size 0, a null source is a source of its own (the last),
a null doc_id hashes as ''. Repeated doc_ids share their fate. An empty table
gives an empty result. Extra columns are ignored by `mix` and kept by `mixed`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, small, written

#: Fixed values of the contract.
WEIGHTS = (3, 1, 2)
SHARE_PERCENT = 150
MOST_COPIES = 2
BITS = 12
LEVELS = 5


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def hash_of(doc_id: Column) -> Column:
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def sizes(docs: DataFrame) -> DataFrame:
    source = F.col("source").cast("string")
    return docs.select("doc_id", F.when(source.isNull(), "n").otherwise(F.concat(F.lit("s"), source)).alias("src"), source.isNull().alias("last"), size_of(F.col("text")).alias("size"), hash_of(F.col("doc_id")).alias("h"))


def targets(by_source: DataFrame, weights: tuple = WEIGHTS) -> DataFrame:
    """src, source_size, target: budgets by weight, capped at MOST_COPIES times the size, the excess shared anew.

    The sources that hit their cap are a prefix in the order of cap/weight, so the level comes from running sums
    over the one row each source has.
    """
    order = Window.orderBy("last", "src")
    cap = F.col("source_size") * MOST_COPIES
    w = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")).cast("long")
    rows = by_source.withColumn("w", w).withColumn("cap", cap)
    ratio = Window.orderBy(F.col("cap") / F.col("w"), "last", "src")
    everything = Window.partitionBy()
    rows = rows.select("*", (F.sum("source_size").over(everything) * SHARE_PERCENT).alias("whole"), (F.sum("cap").over(ratio.rowsBetween(Window.unboundedPreceding, 0)) - F.col("cap")).alias("before"), F.sum("w").over(ratio.rowsBetween(0, Window.unboundedFollowing)).alias("rest"))
    over = F.col("cap") * 100 * F.col("rest") < (F.col("whole") - 100 * F.col("before")) * F.col("w")
    rows = rows.withColumn("over", over).withColumn("level", (F.col("whole") - 100 * F.col("before")) / (100.0 * F.col("rest")))
    level = F.min(F.when(~F.col("over"), F.struct(F.col("before"), F.col("level")))).over(everything)["level"]
    return rows.select("src", "source_size", F.when(F.col("over"), F.col("cap").cast("double")).otherwise(level * F.col("w")).alias("target"))


def thresholds(sized: DataFrame, budgets: DataFrame) -> DataFrame:
    """src, base, below: a document is taken base times, once more if its hash is less than `below`."""
    base = (F.col("target") > F.col("source_size")).cast("long")
    state = budgets.select("src", "source_size", "target", base.alias("base"), (F.col("target") - base * F.col("source_size")).alias("budget"), F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("before"), F.lit(False).alias("done"), F.lit(None).cast("long").alias("below"))
    for level in range(1, LEVELS + 1):
        state = written(state, "mix-state")
        open_ = state.filter(~F.col("done")).select("src", "budget", "prefix", "before")
        n = open_.count()
        if not n:
            break
        shift = BITS * (LEVELS - level)
        key = F.shiftright("h", shift)
        mine = sized.join(small(open_, n), "src").filter(F.shiftright("h", shift + BITS) == F.col("prefix"))
        bars = mine.groupBy("src", "budget", "before", key.alias("key")).agg(F.sum("size").alias("words"), F.min("h").alias("low"), F.max("h").alias("high"))
        run = F.col("before") + F.sum("words").over(Window.partitionBy("src").orderBy("key"))
        bars = bars.withColumn("upto", run).filter(F.col("upto") > F.col("budget"))
        edge = bars.groupBy("src").agg(F.min(F.struct("key", "words", "low", "high", "upto")).alias("e")).select("src", "e.*")
        edge = edge.select("src", "key", "low", "high", "upto", (F.col("upto") - F.col("words")).alias("start"))
        single = F.col("low") == F.col("high")
        nearer = (F.col("upto") - F.col("budget")) < (F.col("budget") - F.col("start"))
        found = F.col("key").isNotNull()
        state = state.join(small(edge, n), "src", "left").select(
            "src", "source_size", "target", "base", "budget",
            F.when(~F.col("done") & found, F.col("key")).otherwise(F.col("prefix")).alias("prefix"),
            F.when(~F.col("done") & found, F.col("start")).otherwise(F.col("before")).alias("before"),
            (F.col("done") | ~found | single).alias("done"),
            F.when(F.col("done"), F.col("below")).when(~found, F.lit((1 << 60) + 1)).when(single, F.col("low") + nearer.cast("long")).alias("below"),
        )
    return written(state, "mix-state")


def mix(docs: DataFrame, weights: tuple = WEIGHTS) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies: the words the mix takes of every document."""
    sized = written(sizes(docs), "mix-sizes")
    by_source = written(sized.groupBy("src", "last").agg(F.sum("size").alias("source_size")), "mix-sources")
    n = by_source.count()
    cut = thresholds(sized, targets(by_source, weights))
    copies = F.col("base") + (F.col("h") < F.col("below")).cast("long")
    return sized.join(small(cut, n), "src").select("doc_id", "size", "source_size", "target", (F.col("size") * copies).alias("taken"), copies.alias("copies"))


def mixed(docs: DataFrame, weights: tuple = WEIGHTS) -> DataFrame:
    """The rows of docs as often as the mix takes them; all columns stay."""
    sized = written(sizes(docs), "mix-sizes")
    by_source = written(sized.groupBy("src", "last").agg(F.sum("size").alias("source_size")), "mix-sources")
    n = by_source.count()
    key, base, below, copy = (fresh(c, docs) for c in ("src", "base", "below", "copy"))
    cut = thresholds(sized, targets(by_source, weights)).select(F.col("src").alias(key), F.col("base").alias(base), F.col("below").alias(below))
    source = F.col("source").cast("string")
    src = F.when(source.isNull(), "n").otherwise(F.concat(F.lit("s"), source))
    rows = docs.join(small(cut, n), src == F.col(key))
    copies = (F.col(base) + (hash_of(F.col("doc_id")) < F.col(below)).cast("long")).cast("int")
    return rows.withColumn(copy, F.explode(F.sequence(F.lit(0), copies))).filter(F.col(copy) > 0).select(*docs.columns)


ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source, CASE WHEN source IS NULL THEN 'n' ELSE 's' || source END AS src,
         COALESCE(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(COALESCE(CAST(doc_id AS VARCHAR), '')), 1, 15))::BIGINT AS h
  FROM documents),
by_source AS (SELECT src, src = 'n' AS last, SUM(size)::BIGINT AS source_size FROM sized GROUP BY src),
weighed AS (SELECT *, source_size * 2 AS cap, [3, 1, 2][(row_number() OVER (ORDER BY last, src) - 1) % 3 + 1] AS w FROM by_source),
ordered AS (
  SELECT *, (SUM(source_size) OVER ())::BIGINT * 150 AS whole,
         (SUM(cap) OVER (ORDER BY cap / w, last, src ROWS UNBOUNDED PRECEDING))::BIGINT - cap AS before,
         (SUM(w) OVER (ORDER BY cap / w, last, src ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS rest
  FROM weighed),
leveled AS (SELECT *, cap * 100 * rest < (whole - 100 * before) * w AS over, (whole - 100 * before) / (100.0::DOUBLE * rest) AS level FROM ordered),
budgets AS (
  SELECT src, source_size,
         CASE WHEN over THEN cap::DOUBLE ELSE (SELECT level FROM leveled WHERE NOT over ORDER BY before, level LIMIT 1) * w END AS target
  FROM leveled),
ran AS (
  SELECT doc_id, size, h, source_size, target, CASE WHEN target > source_size THEN 1 ELSE 0 END AS base,
         target - CASE WHEN target > source_size THEN source_size ELSE 0 END AS budget,
         (SUM(size) OVER (PARTITION BY src ORDER BY h))::BIGINT AS upto, (SUM(size) OVER (PARTITION BY src, h))::BIGINT AS own
  FROM sized JOIN budgets USING (src))
SELECT doc_id, size, source_size, target,
       (size * (base + CASE WHEN upto <= budget OR (upto - budget) < (budget - (upto - own)) THEN 1 ELSE 0 END))::BIGINT AS taken,
       (base + CASE WHEN upto <= budget OR (upto - budget) < (budget - (upto - own)) THEN 1 ELSE 0 END)::BIGINT AS copies
FROM ran
"""
