"""A stored table with versions: changes rewrite only the files that hold a changed id, and old versions can be read.

Rows lie in files by bucket (Spark's hash of the key, modulo a fixed number). A version is a manifest, one row a data file:
its bucket, rows, bytes, smallest and largest key. Data files are never changed. A change

1. finds the buckets of its keys and, by the manifest, files whose range of keys it meets;
2. reads those files' key column alone, with `_metadata.file_path`, for the files that hold one of its keys;
3. reads and rewrites these files, and adds a manifest that lists the new files and the untouched old ones.

A manifest is written aside and becomes version N by moving its folder to `versions/N`, which fails, or shows another's
mark afterwards, if someone else was first: then `Conflict` is raised and nothing has changed. Readers take a version and
are not disturbed by writers. A writer that dies leaves unlisted files at most (`sweep` deletes them).
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import discard


#: Keys up to which they are sent to the readers as a list.
FEW = 10


class Conflict(RuntimeError):
    """Another writer made the version first."""


@dataclass(frozen=True)
class Change:
    """What a change did: the version it made, files read for their keys, files rewritten, files kept as they were."""

    version: int
    looked_at: int
    rewritten: int
    kept: int


class VersionedTable:
    def __init__(self, spark: SparkSession, path: str, key: str = "id", buckets: int = 64) -> None:
        """buckets holds for a table's whole life: about its final bytes by 256 MB."""
        self.spark, self.path, self.key = spark, path.rstrip("/"), key
        self.fs, self.at = pafs.FileSystem.from_uri(self.path if "://" in self.path or self.path.startswith("file:") else f"file://{self.path}")
        self.buckets = self._about(v)["buckets"] if (v := self.latest()) is not None else buckets

    # ---- versions

    def versions(self) -> list[int]:
        found = self.fs.get_file_info(pafs.FileSelector(f"{self.at}/versions", allow_not_found=True))
        return sorted(int(f.base_name) for f in found if f.base_name.isdigit())

    def latest(self) -> int | None:
        return max(self.versions(), default=None)

    def _about(self, version: int) -> dict:
        with self.fs.open_input_file(f"{self.at}/versions/{version}/about.json") as f:
            return json.loads(f.read())

    def manifest(self, version: int | None = None) -> DataFrame:
        """file, bucket, rows, bytes, low and high (keys) of each data file."""
        version = self.latest() if version is None else version
        return self.spark.read.parquet(f"{self.path}/versions/{version}/files")

    def has_batch(self, writer: str, batch: int) -> bool:
        """Whether a stream's batch is part of the table already."""
        v = self.latest()
        return v is not None and self._about(v)["batches"].get(writer, -1) >= batch

    def read(self, version: int | None = None) -> DataFrame:
        version = self.latest() if version is None else version
        if version not in self.versions():
            raise ValueError(f"no version {version} of {self.path}")
        files = [r.file for r in self.manifest(version).select("file").collect()]  # one row a file
        return self._rows(files, T.StructType.fromJson(self._about(version)["schema"]))

    def _rows(self, files: list[str], schema: T.StructType) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*files) if files else self.spark.createDataFrame([], schema)

    # ---- changes

    def save(self, rows: DataFrame) -> Change:
        """A version that holds these rows and no others."""
        return self._commit(self.latest(), rows.schema, self._new_files(rows), 0, 0)

    def clear(self) -> Change:
        """An empty version; those before it stay."""
        base = self.latest()
        if base is None:
            raise ValueError(f"nothing is stored at {self.path}")
        return self._commit(base, T.StructType.fromJson(self._about(base)["schema"]), self._none(), 0, 0)

    def change(self, keys: DataFrame, how: Callable[[DataFrame], DataFrame], batch: tuple[str, int] | None = None) -> Change:
        """Lays `how` over the rows of the files that hold one of keys; how must leave rows of other keys as they are."""
        base, schema, looked, hit = self._meeting(keys)
        kept = self._without(base, hit)
        new = self._new_files(how(self._rows(hit, schema)).select(*schema.names)) if hit else self._none()
        return self._commit(base, schema, kept.unionByName(new), looked, len(hit), batch)

    def _without(self, version: int, files: list[str]) -> DataFrame:
        rows = self.manifest(version)
        return rows.join(self.spark.createDataFrame([(f,) for f in files], "file string"), "file", "left_anti").select(*rows.columns) if files else rows

    def compact(self, most: int = 4) -> Change:
        """Buckets of more than `most` files become one file each; the rows stay the same."""
        base = self.latest()
        many = self.manifest(base).groupBy("bucket").agg(F.count("*").alias("n"), F.collect_list("file").alias("files")).where(F.col("n") > most)
        hit = [f for r in many.collect() for f in r.files]  # at most all files
        schema = T.StructType.fromJson(self._about(base)["schema"])
        new = self._new_files(self._rows(hit, schema)) if hit else self._none()
        return self._commit(base, schema, self._without(base, hit).unionByName(new), 0, len(hit))

    def delete(self, ids: DataFrame) -> Change:
        return self.change(ids, lambda rows: rows.join(ids.select(self.key).distinct(), self.key, "left_anti"))

    def insert(self, new: DataFrame, batch: tuple[str, int] | None = None) -> Change:
        """Adds rows whose key isn't stored; of equal keys among the new rows all stay. With batch, a batch that is known adds nothing."""
        if batch and self.has_batch(*batch):
            return Change(self.latest(), 0, 0, self.manifest().count())
        if self.latest() is None:
            return self._commit(None, new.schema, self._new_files(new), 0, 0, batch)
        base, schema, looked, hit = self._meeting(new)
        fresh = new.join(self._rows(hit, schema).select(self.key), self.key, "left_anti") if hit else new
        return self._commit(base, schema, self.manifest(base).unionByName(self._new_files(fresh.select(*schema.names))), looked, 0, batch)

    def _meeting(self, keys: DataFrame) -> tuple[int, T.StructType, int, list[str]]:
        """The version to change, its schema, how many files were looked at, and the files that hold one of the keys."""
        base = self.latest()
        schema = T.StructType.fromJson(self._about(base)["schema"])
        asked = keys.select(F.col(self.key).cast(schema[self.key].dataType).alias(self.key))
        spans = asked.groupBy(self._bucket().alias("bucket")).agg(F.min(self.key).alias("from_"), F.max(self.key).alias("upto"))
        files = self.manifest(base).join(F.broadcast(spans), "bucket").where((F.col("low") <= F.col("upto")) & (F.col("high") >= F.col("from_")))  # at most a row a bucket
        files = [r.file for r in files.select("file").collect()]
        held = self._rows(files, schema).select(self.key, F.col("_metadata.file_path").alias("file")) if files else None
        few = [r[0] for r in asked.distinct().limit(FEW + 1).collect()] if files else []
        if 0 < len(few) <= FEW:
            held = held.where(F.col(self.key).isin(few))  # reaches the files' statistics and Bloom filters
        hit = [r.file for r in held.join(asked.distinct(), self.key, "left_semi").select("file").distinct().collect()] if files else []
        return base, schema, len(files), hit

    def _bucket(self):
        return F.pmod(F.hash(self.key), F.lit(self.buckets))

    def _none(self) -> DataFrame:
        return self.spark.createDataFrame([], self.manifest().schema)

    def _new_files(self, rows: DataFrame) -> DataFrame:
        """Writes rows, a bucket a file, with a Bloom filter of the keys; gives the manifest's rows."""
        folder = f"{self.path}/data/{uuid.uuid4().hex}"
        rows.repartition(self.buckets, self.key).sortWithinPartitions(self.key).write.option(f"parquet.bloom.filter.enabled#{self.key}", "true").parquet(folder)
        new = self.spark.read.schema(rows.schema).parquet(folder).select(self.key, F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("bytes"))
        return new.groupBy("file").agg(F.min(self._bucket()).alias("bucket"), F.count("*").alias("rows"), F.max("bytes").alias("bytes"), F.min(self.key).alias("low"), F.max(self.key).alias("high"))

    def _commit(self, base: int | None, schema: T.StructType, files: DataFrame, looked: int, rewritten: int, batch: tuple[str, int] | None = None) -> Change:
        version, mark = (0 if base is None else base + 1), uuid.uuid4().hex
        aside = f"{self.at}/commits/{mark}"
        files.coalesce(1).write.parquet(f"{self.path}/commits/{mark}/files")  # one row a file
        batches = (self._about(base)["batches"] if base is not None else {}) | ({batch[0]: batch[1]} if batch else {})
        about = {"version": version, "mark": mark, "schema": json.loads(schema.json()), "buckets": self.buckets, "batches": batches}
        with self.fs.open_output_stream(f"{aside}/about.json") as f:
            f.write(json.dumps(about).encode())
        self.fs.create_dir(f"{self.at}/versions", recursive=True)
        try:
            self.fs.move(aside, f"{self.at}/versions/{version}")
        except OSError as e:
            raise Conflict(f"version {version} of {self.path} exists") from e
        if self._about(version)["mark"] != mark:
            raise Conflict(f"version {version} of {self.path} is another's")
        kept = self.manifest(version).join(self.manifest(base), "file", "left_semi").count() if base is not None else 0
        return Change(version, looked, rewritten, kept)

    # ---- what may go

    def keep_within(self, budget: int) -> list[int]:
        """Drops the oldest versions so that the files of those that stay take at most `budget` bytes; the newest stays. Gives what went."""
        held, size, gone = set(), 0, []
        for v in reversed(self.versions()):  # a version's files are many, versions few
            files = {r.file: r.bytes for r in self.manifest(v).select("file", "bytes").collect()}
            more = sum(b for f, b in files.items() if f not in held)
            if gone or (held and size + more > budget):
                gone.append(v)
            else:
                held, size = held | set(files), size + more
        for v in gone:
            discard(f"{self.path}/versions/{v}" if ":" in self.path else f"file://{self.path}/versions/{v}")
        self.sweep()
        return gone

    def sweep(self) -> int:
        """Deletes data files that no version lists: those of dropped versions and of writers that failed. Not to be run beside a writer."""
        listed = {r.file.rpartition("/data/")[2] for v in self.versions() for r in self.manifest(v).select("file").collect()}
        found = self.fs.get_file_info(pafs.FileSelector(f"{self.at}/data", recursive=True, allow_not_found=True))
        loose = [f.path for f in found if f.is_file and f.base_name.endswith(".parquet") and not f.base_name.startswith(".") and f.path.rpartition("/data/")[2] not in listed]
        for path in loose:
            self.fs.delete_file(path)
        return len(loose)
