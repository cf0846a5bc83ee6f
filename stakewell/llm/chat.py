"""Chat formatting by cumulative-snapshot collapse (DataFrame functions only).

Logged conversations often are snapshots of one another: the log of turn 2, of
turns 2..4, of turns 2..6. Each turn adds position-dependent hash words to a
rolling sum, so that the sums after turn k name the prefix of k turns. A
conversation goes if another, longer one has a prefix of the same name; of equal
conversations the least conv_id stays. What stays is rendered.

Rolling sums run in two levels, over chunks of turns and inside a chunk, so
that no task holds a whole conversation, however long. Rendered text comes in
parts of PART turns (one part for all but huge conversations).

Null role or text: as ''. Rows repeated in full count once. Rows without
conv_id are no conversation and go. Turns with the same number are ordered by
role and text; a null turn number is last. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Turns in a chunk of the rolling sums, and in a rendered part.
CHUNK = 64
PART = 1024
SUMS = ("s1", "s2", "s3", "s4")
LAST = (1 << 62) // CHUNK


def _chunked(turns: DataFrame) -> DataFrame:
    rows = turns.filter(F.col("conv_id").isNotNull()).select(F.col("conv_id").alias("c"), F.col("turn").cast("long").alias("t"), F.coalesce("role", F.lit("")).alias("r"), F.coalesce("text", F.lit("")).alias("x"))
    rows = rows.withColumn("k", F.coalesce(F.floor(F.col("t") / CHUNK), F.lit(LAST)))
    return rows.repartition("c", "k").groupBy("c", "k", "t", "r", "x").agg(F.count("*").alias("times"))


def ranked(turns: DataFrame) -> DataFrame:
    """c (conv_id), k, r, x, place (from 1) and n (turns of the conversation)."""
    rows = _chunked(turns)
    chunks = rows.groupBy("c", "k").agg(F.count("*").alias("m"))
    by_conv = Window.partitionBy("c").orderBy("k")
    chunks = chunks.select("c", "k", (F.sum("m").over(by_conv) - F.col("m")).alias("ahead"), F.sum("m").over(Window.partitionBy("c")).alias("n"))
    within = Window.partitionBy("c", "k").orderBy(F.col("t").asc_nulls_last(), "r", "x")
    return rows.withColumn("at", F.row_number().over(within)).join(chunks, ["c", "k"]).select("c", "k", "r", "x", (F.col("ahead") + F.col("at")).alias("place"), "n")


def prefixes(turns: DataFrame) -> DataFrame:
    """c, place, n and the sums that name the prefix ending at place."""
    low = F.lit(0xFFFFFFFF)
    one, two = F.xxhash64("place", "r", "x"), F.xxhash64(F.lit("two"), "x", "r", "place")
    terms = [one.bitwiseAND(low), F.shiftrightunsigned(one, 32), two.bitwiseAND(low), F.shiftrightunsigned(two, 32)]
    rows = ranked(turns).select("c", "k", "place", "n", *[t.alias(s) for t, s in zip(terms, SUMS, strict=True)])
    chunks = rows.groupBy("c", "k").agg(*[F.sum(s).alias(s) for s in SUMS])
    by_conv = Window.partitionBy("c").orderBy("k")
    chunks = chunks.select("c", "k", *[(F.sum(s).over(by_conv) - F.col(s)).alias(f"a{s}") for s in SUMS])
    run = Window.partitionBy("c", "k").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    return rows.join(chunks, ["c", "k"]).select("c", "place", "n", *[(F.col(f"a{s}") + F.sum(s).over(run)).alias(s) for s in SUMS])


def maximal(turns: DataFrame) -> DataFrame:
    """c, copies: the conversations that no other one contains as a prefix, and how many are equal to each."""
    rows = prefixes(turns)
    key = ["place", *SUMS]
    longer = rows.groupBy(*key).agg(F.max("n").alias("longest")).filter(F.col("longest") > F.col("place")).select(*key)
    whole = rows.filter(F.col("place") == F.col("n")).groupBy(*key).agg(F.min("c").alias("c"), F.count("*").alias("copies"))
    return whole.join(longer, key, "left_anti").select("c", "copies")


def chat_format(turns: DataFrame) -> DataFrame:
    """conv_id, part, n_turns, copies, text of every maximal conversation."""
    said = F.concat(F.lit("<|im_start|>"), F.col("r"), F.lit("\n"), F.col("x"), F.lit("<|im_end|>\n"))
    rows = ranked(turns).join(maximal(turns), "c")
    rows = rows.withColumn("part", F.floor((F.col("place") - 1) / PART).cast("long"))
    parts = rows.groupBy("c", "part", "n", "copies").agg(F.sort_array(F.collect_list(F.struct("place", said.alias("said")))).alias("turns"))
    return parts.select(F.col("c").alias("conv_id"), "part", F.col("n").cast("long").alias("n_turns"), "copies", F.concat_ws("", "turns.said").alias("text"))


ORACLE = """
WITH t AS (SELECT DISTINCT conv_id, turn, COALESCE(role, '') AS role, COALESCE(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
r AS (SELECT *, row_number() OVER w AS place, count(*) OVER (PARTITION BY conv_id) AS n FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS LAST, role, text)),
p AS (SELECT conv_id, place, n, list([role, text]) OVER (PARTITION BY conv_id ORDER BY place) AS said FROM r),
whole AS (SELECT said, n, min(conv_id) AS conv_id, count(*) AS copies FROM p WHERE place = n GROUP BY said, n),
kept AS (SELECT w.conv_id, w.n, w.copies FROM whole w WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.said = w.said AND p.n > w.n))
SELECT conv_id, ((place - 1) // 1024)::BIGINT AS part, any_value(kept.n)::BIGINT AS n_turns, any_value(copies)::BIGINT AS copies,
       string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY place) AS text
FROM kept JOIN r USING (conv_id) GROUP BY conv_id, part
"""
