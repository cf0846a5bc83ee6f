"""The stored state as JSON: versions, shape, backups; and the sinks of tickets."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.scan import scan
from .schema import BET, STATE_VERSION
from .shared import discard


def state_schema() -> T.StructType:
    bet = T._parse_datatype_string(BET)
    return T.StructType([T.StructField("version", T.IntegerType()), T.StructField("updatedAt", T.StringType()), T.StructField("bets", T.ArrayType(bet)), T.StructField("_corrupt", T.StringType())])


def read_state(spark: SparkSession, path: str) -> DataFrame:
    """One row a document with status: ok, old, newer, shape or corrupt."""
    df = spark.read.schema(state_schema()).option("columnNameOfCorruptRecord", "_corrupt").option("multiLine", True).json(path)
    whole = F.col("version").isNotNull() & F.col("updatedAt").isNotNull() & F.col("bets").isNotNull() & F.coalesce(F.forall("bets", lambda b: b["id"].isNotNull() & b["stake"].isNotNull()), F.lit(False))
    status = F.when(F.col("_corrupt").isNotNull(), "corrupt").when(~whole, "shape").when(F.col("version") > STATE_VERSION, "newer").when(F.col("version") < STATE_VERSION, "old").otherwise("ok")
    return df.withColumn("status", status)


def stored_bets(state: DataFrame) -> DataFrame:
    """Tickets of the documents that may be used: the present version, and older ones, which are read as the present."""
    return state.filter(F.col("status").isin("ok", "old")).select(F.explode("bets").alias("b")).select("b.*")


def write_tickets(bets: DataFrame, path: str) -> None:
    """The tickets as JSON lines, one ticket a line, in parallel; a document for all of them would be one task's work."""
    bets.write.mode("errorifexists").json(path)


def write_backup(bets: DataFrame, path: str, exported_at: str) -> None:
    """Tickets and, beside them, one row about the backup."""
    write_tickets(bets, f"{path}/bets")
    stats = bets.agg(F.count("*").alias("totalBets"), F.max("placed_at").alias("lastUpdated"))
    stats.select(F.lit(exported_at).alias("exportedAt"), F.lit(STATE_VERSION).alias("version"), F.struct("totalBets", "lastUpdated").alias("stats")).write.json(f"{path}/about")


def backups(spark: SparkSession, folder: str) -> DataFrame:
    """name, bytes and changed of each backup below a folder: of its files, whose contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "modificationTime", "length")
    root = folder.rstrip("/").rpartition(":")[2].lstrip("/")
    name = F.regexp_extract("path", re.escape(root) + r"/+([^/]+)", 1)
    return files.groupBy(name.alias("name")).agg(F.sum("length").alias("bytes"), F.max("modificationTime").alias("changed"))


def over_budget(found: DataFrame, budget: int) -> DataFrame:
    """The backups that go if the newest may take at most `budget` bytes: from the first that doesn't fit on. The newest stays."""
    rows = scan(found, [F.col("changed").desc(), F.col("name").desc()], position="rank", running={"upto": "bytes"})
    over = scan(rows.withColumn("beyond", F.when((F.col("upto") > budget) & (F.col("rank") > 1), True)), [F.col("rank").asc()], latest={"gone": "beyond"})
    return over.where("gone").select("name", "bytes", "changed")


def keep_within(spark: SparkSession, folder: str, budget: int) -> list[str]:
    """Deletes the backups over the budget; gives their names."""
    gone = sorted(r.name for r in over_budget(backups(spark, folder), budget).collect())  # one row a backup
    for name in gone:
        discard(f"{folder.rstrip('/')}/{name}" if ":" in folder else f"file://{folder.rstrip('/')}/{name}")
    return gone


def csv_lines(bets: DataFrame) -> DataFrame:
    """value: the flat columns of each ticket as a line, strings in quotes and all else as it is; a null is nothing."""
    flat = [f for f in bets.schema if not isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType)) and f.name != "raw"]
    cell = lambda f: F.concat(F.lit('"'), F.replace(F.col(f.name), F.lit('"'), F.lit('""')), F.lit('"')) if isinstance(f.dataType, T.StringType) else F.col(f.name).cast("string")
    return bets.select(F.concat_ws(",", *(F.coalesce(cell(f), F.lit("")) for f in flat)).alias("value"))


def write_csv_lines(bets: DataFrame, path: str) -> None:
    """csv_lines as text files, each with the header line first."""
    flat = [f.name for f in bets.schema if not isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType)) and f.name != "raw"]
    head = bets.sparkSession.createDataFrame([(",".join(flat),)], "value string").coalesce(1)

    def headed(batches):
        first = True
        for b in batches:
            if first and b.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array([",".join(flat)])], schema=b.schema)
                first = False
            yield b

    lines = csv_lines(bets).mapInArrow(headed, "value string")
    (lines if bets.limit(1).count() else head).write.text(path)


def write_csv(bets: DataFrame, path: str) -> None:
    """CSV of the flat columns, quotes doubled."""
    flat = [f.name for f in bets.schema if not isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType)) and f.name != "raw"]
    bets.select(*flat).write.options(header=True, quote='"', escape='"', quoteAll=True).csv(path)


def write_tsv(rows: DataFrame, path: str) -> None:
    rows.write.options(header=True, sep="\t").csv(path)
