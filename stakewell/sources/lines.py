"""Text files by numbered lines, in parallel: an error can name its row, and a row's id can be its file and line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bits of monotonically_increasing_id that number the rows of a task.
_ROW = (1 << 33) - 1


def numbered_lines(spark: SparkSession, path: str, blank: bool = False) -> DataFrame:
    """file, line_no (from 1, in each file) and value of each line; without `blank`, lines of white space aren't counted.

    Spark reads a file in blocks. A first pass counts each block's lines, which gives the number before it; a second adds
    that to a line's place in its block. What is joined is one row a block. Both passes cut files alike, as they run in one
    session with the same settings; lines end with \\n, a \\r before it goes.
    """
    text = spark.read.text(path, lineSep="\n").select(
        F.regexp_replace("value", "\r", "").alias("value"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.spark_partition_id().alias("task"),
    )
    rows = text if blank else text.where(F.trim(F.regexp_replace("value", r"\s", " ")) != "")
    rows = rows.withColumn("at", F.monotonically_increasing_id().bitwiseAND(F.lit(_ROW)))
    blocks = rows.groupBy("file", "block", "task").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    order = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = blocks.withColumn("before", F.coalesce(F.sum("n").over(order), F.lit(0))).select("file", "block", "first", "before")
    placed = rows.join(F.broadcast(before), ["file", "block"])  # one row a block of a file
    return placed.select("file", (F.col("before") + F.col("at") - F.col("first") + 1).alias("line_no"), "value")
