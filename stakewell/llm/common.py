"""Small helpers that the training-data operators share."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a side that was counted first may be broadcast.
BROADCAST_ROWS = 100_000


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see: spark.checkpoint.dir, or a new local one where it is unset and all runs on this machine (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="stakewell-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts the lineage and survives a lost executor."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def folder_of(df: DataFrame) -> str | None:
    """The folder of a table that `written` made."""
    files = df.inputFiles()
    return files[0].rpartition("/")[0] if files else None


def discard(folder: str | None) -> None:
    """Deletes a written table that nothing reads any more."""
    if folder:
        fs, at = pafs.FileSystem.from_uri(folder)
        fs.delete_dir(at)


def give_back() -> None:
    """Returns freed memory to the system: a Python worker waits for later tasks beside the JVM and other workers."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def collect_heaps(spark: SparkSession) -> None:
    """Has the executors' JVMs collect, one task a core: a heap that has grown shrinks only then.

    A session that runs one heavy step after another would otherwise keep the largest heap that any of them needed, beside
    the Python workers of the next.
    """
    cores = spark.sparkContext.defaultParallelism
    spark.range(0, cores, 1, cores).select(F.java_method(F.lit("java.lang.System"), F.lit("gc"))).write.format("noop").mode("overwrite").save()


def fresh(name: str, *frames: DataFrame) -> str:
    """A column name that none of the frames has, whatever their users called their columns."""
    taken = {c.lower() for f in frames for c in f.columns}
    while name.lower() in taken:
        name += "_"
    return name


def small(df: DataFrame, rows: int | None = None, most: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if its counted rows allow it, else df as it is (Spark then joins by shuffle)."""
    n = df.count() if rows is None else rows
    return F.broadcast(df) if n <= most else df


#: Rows and bytes of texts that go to Python at once; long documents fill a batch with a few rows.
ARROW_ROWS = 2_000
ARROW_BYTES = 4 << 20


def text_batches(spark: SparkSession) -> None:
    """Keeps the session's Arrow batches small, so that batches of long texts don't fill an executor's memory."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", f"{ARROW_BYTES}b")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5: 0 is held out."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


# ---- byte-level text work in numpy -------------------------------------------------

_SEED = np.random.default_rng(20240229)
#: A random odd base for rolling hashes modulo 2**64 and a random value for each byte.
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
BYTE_VALUE = _SEED.integers(1, 1 << 63, 256, dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift-multiply)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


class Powers:
    """Cached powers of the base and of its inverse."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            m = max(n, 1 << 16)
            self.up = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(m - 1, BASE, np.uint64)]), dtype=np.uint64)
            self.down = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(m - 1, INVERSE, np.uint64)]), dtype=np.uint64)
        return self.up[:n], self.down[:n]


POWERS = Powers()


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:end] for many spans, by one running sum."""
    up, down = POWERS.upto(len(data) + 1)
    run = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_VALUE[data] * up[: len(data)], dtype=np.uint64, out=run[1:])
    return mix((run[ends] - run[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def slices(texts: list, most: int = 1_000_000):
    """(first, last) ranges of texts that hold about `most` characters each; a longer text is alone."""
    first = held = 0
    for i, t in enumerate(texts):
        n = len(t)
        if held and held + n > most:
            yield first, i
            first, held = i, 0
        held += n
    if first < len(texts):
        yield first, len(texts)


#: Bytes that end a word: all ASCII but letters and digits. Bytes of other scripts belong to words.
WORD_BYTE = np.zeros(256, bool)
WORD_BYTE[[*range(48, 58), *range(97, 123), *range(65, 91), *range(128, 256)]] = True


def joined(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, a newline after each, and the offset at which each begins (and the end)."""
    raw = [t.encode("utf-8", "replace") for t in texts]
    at = np.zeros(len(raw) + 1, np.int64)
    np.cumsum([len(r) + 1 for r in raw], out=at[1:])
    return np.frombuffer(b"\n".join([*raw, b""]), np.uint8), at


def word_spans(data: np.ndarray, of_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    inside = np.concatenate([[False], of_word[data], [False]])
    change = np.flatnonzero(inside[1:] != inside[:-1])
    return change[::2], change[1::2]
