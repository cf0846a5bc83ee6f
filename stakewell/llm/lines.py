"""Line dedup: levelled sorted runs of line hashes.

A line's key is the line without ASCII white space at its ends, ASCII letters in lower case; keys are known by 128-bit
hashes. `LineRuns` keeps what is known of keys in runs: tables bucketed and sorted by hash, with the number of documents
that hold a key and the largest doc_id among them. A batch of documents is counted, loses by a merge anti-join against
every run the keys that are settled there (held by enough documents, one of them of a larger or equal doc_id: nothing
that the batch says of them matters), and what is left becomes a run of level 0. Two runs of one level are merged into one
of the next, so that there are never more runs than levels. Runs share their buckets: joins and merges don't shuffle them.

`dedup_lines` feeds a table as BATCHES ranges of doc_id, the largest first, merges what runs are left and drops from each
document the lines whose key enough documents hold, unless it has the largest doc_id of them.

Null text: as empty, which is one empty line; the result's text is ''. Rows with the same doc_id are one document when
documents are counted, and each loses its own lines; a key that stands in a document twice counts once, and where it stays
it stays twice. Rows without doc_id are together one document, smaller than all others. Very long texts are read whole,
and a document's lines that go are a list in its row. Empty table: no rows. Extra columns stay, whatever their names.
"""

from __future__ import annotations

import uuid

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BROADCAST_ROWS, discard, folder_of, fresh, give_back, new_folder, partitions, text_batches, written

#: Code points that a key needs, and documents that must hold it, for its lines to go.
POINTS = 20
DOCUMENTS = 3
BATCHES = 8
SPACE = b" \t\n\v\f\r"
HASH = ["a", "b"]


def key_of(line: bytes, points: int = POINTS) -> bytes | None:
    """The key of a line in UTF-8, or None if it is too short to be looked at."""
    key = line.strip(SPACE).lower()
    return key if len(key) >= points and (len(key) >= 4 * points or len(key.decode()) >= points) else None


def hashed_lines(docs: DataFrame, points: int = POINTS) -> DataFrame:
    """doc_id, h and k (hashes of the text), a and b (hash of a key) for each document's distinct keys."""
    text_batches(docs.sparkSession)
    schema = pa.schema([(c, pa.int64()) for c in ("doc_id", "h", "k", "a", "b")])

    def run(batches):
        for batch in batches:
            texts = batch.column("text").to_pylist()
            at, digests = [], []
            for i, text in enumerate(texts):
                mine = {xxhash.xxh3_128_digest(key) for line in (text or "").encode().split(b"\n") if (key := key_of(line, points)) is not None}
                at += [i] * len(mine)
                digests += mine
                if len(at) > 50_000:
                    yield rows(batch, at, digests)
                    at, digests = [], []
            yield rows(batch, at, digests)
            del texts
            give_back()

    def rows(batch, at, digests):
        both = pa.FixedSizeListArray.from_arrays(pa.Array.from_buffers(pa.int64(), 2 * len(digests), [None, pa.py_buffer(b"".join(digests))]), 2).flatten()
        keys = [batch.column(c).take(pa.array(at, pa.int64())) for c in ("doc_id", "h", "k")]
        return pa.RecordBatch.from_arrays([*keys, *(both.take(pa.array(range(s, 2 * len(digests), 2), pa.int64())) for s in (0, 1))], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), *text_key(docs), "text").mapInArrow(run, "doc_id long, h long, k long, a long, b long")


def text_key(docs: DataFrame) -> list:
    return [F.xxhash64(docs["text"]).alias("h"), F.xxhash64(F.lit(1), docs["text"]).alias("k")]


class LineRuns:
    """What is known of line keys, in sorted runs of growing levels; see the module."""

    def __init__(self, spark: SparkSession, least: int = DOCUMENTS, buckets: int | None = None) -> None:
        self.spark, self.least = spark, least
        self.buckets = buckets or partitions(spark)
        self.runs: list[tuple[int, str, str]] = []

    def _stored(self, level: int, df: DataFrame) -> None:
        """Writes a run: each task holds the keys of one bucket, so that a bucket is one sorted file."""
        name, folder = f"line_run_{uuid.uuid4().hex}", new_folder(self.spark, "line-run")
        conf = {"spark.sql.legacy.bucketedTableScan.outputOrdering": "true", "spark.sql.adaptive.enabled": "false"}
        before = {k: self.spark.conf.get(k, None) for k in conf}
        for k, v in conf.items():
            self.spark.conf.set(k, v)
        try:
            df.write.bucketBy(self.buckets, *HASH).sortBy(*HASH).option("path", folder).saveAsTable(name, format="parquet")
        finally:
            for k, v in before.items():
                self.spark.conf.unset(k) if v is None else self.spark.conf.set(k, v)
        self.runs.append((level, name, folder))

    def add(self, keys: DataFrame) -> None:
        """Adds a batch: doc_id, a and b, with documents that no earlier batch held."""
        own = keys.groupBy(*HASH).agg((F.count_distinct("doc_id") + F.max(F.col("doc_id").isNull().cast("int"))).alias("n"), F.max("doc_id").alias("top"))
        own = own.repartition(self.buckets, *HASH)
        for _, name, _ in self.runs:
            settled = self.spark.table(name).where(F.col("n") >= self.least).select(*(F.col(c).alias(f"{c}_") for c in HASH), F.col("top").alias("top_")).hint("merge")
            known = (own["a"] == settled["a_"]) & (own["b"] == settled["b_"]) & (own["top"].isNull() | (settled["top_"] >= own["top"]))
            own = own.join(settled, known, "left_anti")
        self._stored(0, own)
        while len(self.runs) > 1 and self.runs[-1][0] == self.runs[-2][0]:
            self._merge_last_two()

    def _merge_last_two(self) -> None:
        """Two runs become one: a full outer merge join of equal buckets."""
        (level, one, _), (_, two, _) = old = self.runs[-2:]
        x, y = self.spark.table(one), self.spark.table(two).select(*(F.col(c).alias(f"{c}_") for c in ("a", "b", "n", "top"))).hint("merge")
        both = x.join(y, (x["a"] == y["a_"]) & (x["b"] == y["b_"]), "full")
        merged = both.select(*(F.coalesce(c, f"{c}_").alias(c) for c in HASH), (F.coalesce("n", F.lit(0)) + F.coalesce("n_", F.lit(0))).alias("n"), F.greatest("top", "top_").alias("top"))
        self._stored(max(r[0] for r in old) + 1, merged)
        self.runs = [*self.runs[:-3], self.runs[-1]]
        self._forget(old)

    def _forget(self, runs: list[tuple[int, str, str]]) -> None:
        for _, name, folder in runs:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            discard(folder)

    def repeated(self) -> DataFrame | None:
        """a, b, n and top of the keys that enough documents hold, from one run into which all are merged."""
        while len(self.runs) > 1:
            self._merge_last_two()
        return self.spark.table(self.runs[0][1]).where(F.col("n") >= self.least) if self.runs else None

    def drop(self) -> None:
        self._forget(self.runs)
        self.runs = []


def ranges(keys: DataFrame, batches: int) -> list:
    """Conditions on doc_id, the largest ids first and null last, that cut the keys in about equal batches."""
    cuts = keys.agg(F.percentile_approx("doc_id", [i / batches for i in range(1, batches)], 1000)).first()[0] if batches > 1 else None
    doc, out, above = F.col("doc_id"), [], None
    for cut in sorted(set(cuts or []), reverse=True):
        out.append(doc > cut if above is None else (doc > cut) & (doc <= above))
        above = cut
    return [*out, doc.isNotNull() if above is None else doc <= above, doc.isNull()]


def dedup_lines(docs: DataFrame, least: int = DOCUMENTS, points: int = POINTS, batches: int = BATCHES) -> DataFrame:
    """docs with the text that is left, and n_lines and n_dropped (named anew if docs has such columns)."""
    spark = docs.sparkSession
    order = [F.col("doc_id").desc_nulls_last(), F.col("a")]
    keys = written(hashed_lines(docs, points).repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order), "line-keys")
    runs = LineRuns(spark, least)
    for batch in ranges(keys, batches):
        runs.add(keys.where(batch).select("doc_id", *HASH))
    known = runs.repeated()
    lists = written(lost_lines(keys, known), "line-gone")
    runs.drop()
    discard(folder_of(keys))
    return without_lines(docs, lists, points)


def lost_lines(keys: DataFrame, known: DataFrame) -> DataFrame:
    """doc_id, h, k and gone: the hashes of the keys that each document loses.

    Keys held by more than one in BROADCAST_ROWS of all rows are fewer than that: they meet their rows by broadcast, so
    that no task gets all rows of a very common line. The rest is merged.
    """
    many = F.col("n") > keys.count() / BROADCAST_ROWS
    often, seldom = F.broadcast(known.where(many)), known.where(~many)
    both = keys.join(often, HASH).unionByName(keys.join(often.select(*HASH), HASH, "left_anti").join(seldom, HASH))
    return both.where(~F.col("doc_id").eqNullSafe(F.col("top"))).groupBy("doc_id", "h", "k").agg(F.collect_set(F.struct(*HASH)).alias("gone"))


def without_lines(docs: DataFrame, lists: DataFrame, points: int = POINTS) -> DataFrame:
    """docs without the lines whose hashes stand in `gone` of their row in lists (doc_id, h, k)."""
    text_batches(docs.sparkSession)
    h, k, gone, n_lines, n_dropped = (fresh(c, docs) for c in ("h", "k", "gone", "n_lines", "n_dropped"))
    left = docs.select("*", *(c.alias(n) for c, n in zip(text_key(docs), (h, k), strict=True)))
    right = lists.select(F.col("doc_id").alias("doc_id__"), F.col("h").alias("h__"), F.col("k").alias("k__"), F.col("gone").alias("gone__"))
    same = left["doc_id"].cast("long").eqNullSafe(right["doc_id__"]) & (left[h] == right["h__"]) & (left[k] == right["k__"])
    joined = left.join(right, same, "left").select(*(left[c] for c in docs.columns), right["gone__"].alias(gone))
    schema = T.StructType([*(T.StructField(f.name, f.dataType, True) for f in docs.schema), T.StructField(n_lines, T.LongType()), T.StructField(n_dropped, T.LongType())])
    place = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            texts, lines, dropped = [], [], []
            for text, hashes in zip(batch.column(place).to_pylist(), batch.column(len(docs_columns)).to_pylist(), strict=True):
                mine = (text or "").encode().split(b"\n")
                lines.append(len(mine))
                if hashes:
                    out = {x["a"].to_bytes(8, "little", signed=True) + x["b"].to_bytes(8, "little", signed=True) for x in hashes}
                    mine = [x for x in mine if (key := key_of(x, points)) is None or xxhash.xxh3_128_digest(key) not in out]
                dropped.append(lines[-1] - len(mine))
                texts.append(b"\n".join(mine).decode())
            columns = batch.columns[:-1]
            columns[place] = pa.array(texts, columns[place].type)
            yield pa.RecordBatch.from_arrays([*columns, pa.array(lines, pa.int64()), pa.array(dropped, pa.int64())], names=names)
            del texts, columns
            give_back()

    docs_columns, names = docs.columns, schema.names
    return joined.mapInArrow(run, schema)


def line_dedup(docs: DataFrame) -> DataFrame:
    """Digest of what `dedup_lines` leaves of each document."""
    left = dedup_lines(docs.select("doc_id", "text"))
    return left.select(F.col("doc_id").cast("long").alias("doc_id"), "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


_KEY = "translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ORACLE = (
    "WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, string_split(COALESCE(text, ''), chr(10)) AS lines FROM documents), "
    f"flat AS (SELECT rid, doc_id, line, i, {_KEY} AS key FROM (SELECT rid, doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS i FROM docs)), "
    "known AS (SELECT key, max(doc_id) AS top FROM flat WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) + max((doc_id IS NULL)::INT) >= 3), "
    "marked AS (SELECT f.*, k.key IS NOT NULL AND f.doc_id IS DISTINCT FROM k.top AS gone FROM flat f LEFT JOIN known k ON k.key = f.key) "
    "SELECT any_value(doc_id) AS doc_id, count(*)::BIGINT AS n_lines, count_if(gone)::BIGINT AS n_dropped, sha256(COALESCE(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256 FROM marked GROUP BY rid"
)
