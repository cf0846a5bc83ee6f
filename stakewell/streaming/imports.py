"""Tickets that arrive as a stream: stored once by id, however often a batch comes again."""

from __future__ import annotations

import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import money
from ..sources.versioned import VersionedTable


#: Batches after which buckets of many files are made one file.
COMPACT = 16


def import_batches(new: DataFrame, store: str, checkpoint: str) -> StreamingQuery:
    """Appends tickets of a stream whose id isn't in the Parquet table at `store`.

    A batch is stored under its number and overwrites itself when it is run again, so a restart loses and doubles
    nothing. Equal ids inside a batch count once.
    """

    def put(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        fresh = batch.dropDuplicates(["id"])
        fs, at = pafs.FileSystem.from_uri(store if ":" in store else f"file://{store}")
        if fs.get_file_info(at).type != pafs.FileType.NotFound:
            old = spark.read.parquet(store).filter(F.col("batch") != number).select("id")
            fresh = fresh.join(old, "id", "left_anti")
        fresh.withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(store)

    return new.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def import_keyed(new: DataFrame, table: VersionedTable, checkpoint: str, writer: str = "import") -> StreamingQuery:
    """Inserts tickets of a stream into a versioned table, each id once.

    A batch reads the key column of those files alone whose bucket and range of ids it meets. Its number is stored with the
    version that it makes, so that a batch which is run again after a failure adds nothing. A batch makes few files a
    bucket; buckets with many are made one file now and then.
    """

    def put(batch: DataFrame, number: int) -> None:
        # A batch's frame belongs to a session of its own.
        store = VersionedTable(batch.sparkSession, table.path, table.key, table.buckets)
        store.insert(batch.dropDuplicates([table.key]), (writer, number))
        if number % COMPACT == COMPACT - 1:
            store.compact()

    return new.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_net(bets: DataFrame, late: str = "1 hour", window: str = "1 day") -> DataFrame:
    """Net, stake and count by window of placing and book, for tickets no later than `late`."""
    rows = bets.withWatermark("placed_at", late)
    return rows.groupBy(F.window("placed_at", window), "book").agg(F.count("*").alias("count"), F.sum("stake").alias("stake"), F.sum(money.net()).alias("net"))
