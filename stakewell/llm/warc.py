"""WARC archives and their Merkle fixity audit.

Pages are written as WARC/1.1 response records, each a gzip member, into part files by
ranges of page_id; every file has a list of its records' offsets. A replica is a second
set of files. The audit hashes every record's stored bytes, in order of
offset; FANOUT hashes of consecutive offset ranges give their range's hash, and so on up
to each file's root. Roots of two replicas are compared; below a root that differs only
the ranges that differ are opened, down to the records. Both trees are built to the same depth, whatever the replicas
hold: a record that is cut off has another hash than the whole one; one that a replica's list lacks, or
has beyond the other, has no counterpart; a lost file reads as empty, so that all its records differ.

Files are cut at about FILE_BYTES, between records. They are written under a name of the task's attempt; only names that a successful attempt returns
are read. Null html or url: as empty. Null page_id: kept, as such. Repeated rows are records of their own; rows that tie in
page_id are ordered by their hash. A very long page is one record, read whole. Extra columns are ignored. An empty table gives no files and an empty result.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import new_folder, partitions, small, text_batches, written

FANOUT = 16
#: Bytes read at once.
CHUNK = 1 << 22
#: Bytes at which a file is closed and the next one begun.
FILE_BYTES = 1 << 30
SCHEMA = "file string, ord long, offset long, length long, page_id long, url string, n_bytes long"


def record(page_id: int | None, url: str, body: bytes) -> bytes:
    """One response record as a gzip member."""
    name = uuid.uuid5(uuid.NAMESPACE_URL, f"{page_id} {url}")
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(body)
    target = url.replace("\r", "%0D").replace("\n", "%0A")
    head = f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:uuid:{name}>\r\nWARC-Date: 1970-01-01T00:00:00Z\r\nWARC-Target-URI: {target}\r\nX-Page-ID: {'' if page_id is None else page_id}\r\nWARC-Payload-Digest: sha256:{hashlib.sha256(body).hexdigest()}\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: {len(http) + len(body)}\r\n\r\n"
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress(head.encode() + http + body + b"\r\n\r\n") + z.flush()


def parse(member: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and payload of a stored record."""
    raw = zlib.decompress(member, 31)
    head, _, block = raw.partition(b"\r\n\r\n")
    headers = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in head.decode().split("\r\n")[1:])
    http = block[: int(headers["Content-Length"])]
    return headers, http.partition(b"\r\n\r\n")[2]


def write_warc(pages: DataFrame, folder: str | None = None, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes the files; the table of records (SCHEMA), stored in the shared folder."""
    folder = folder or new_folder(pages.sparkSession, "warc")
    text_batches(pages.sparkSession)

    def run(batches):
        fs, at = pafs.FileSystem.from_uri(folder)
        fs.create_dir(at, recursive=True)
        name, out, offset, n = "", None, 0, 0
        try:
            for b in batches:
                rows = []
                for page_id, url, html in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "html")), strict=True):
                    if out and offset >= file_bytes:
                        out.close()
                        out = None
                    if not out:
                        name, offset, n = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex[:8]}.warc.gz", 0, 0
                        out = fs.open_output_stream(f"{at}/{name}", compression=None)
                    body = (html or "").encode("utf-8", "replace")
                    stored = record(page_id, url or "", body)
                    out.write(stored)
                    rows.append((f"{folder}/{name}", n, offset, len(stored), page_id, url, len(body)))
                    offset, n = offset + len(stored), n + 1
                if rows:
                    yield pa.record_batch(list(map(pa.array, zip(*rows, strict=True))), names=["file", "ord", "offset", "length", "page_id", "url", "n_bytes"]).cast(_arrow())
        finally:
            if out:
                out.close()

    order = [F.col("page_id").asc_nulls_last(), F.xxhash64("url", "html")]
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").repartitionByRange(partitions(pages.sparkSession), *order).sortWithinPartitions(*order)
    return written(rows.mapInArrow(run, SCHEMA), "warc-records")


def _arrow() -> pa.Schema:
    kinds = {"string": pa.string(), "long": pa.int64()}
    return pa.schema([(n, kinds[k]) for n, k in (c.split() for c in SCHEMA.split(", "))])


class Stored:
    """Reads the records of files in the order of their offsets, one buffered stream at a time; nothing from a lost file."""

    def __init__(self) -> None:
        self.path, self.stream, self.at = None, None, 0

    def read(self, path: str, offset: int, length: int) -> bytes:
        if path != self.path or offset < self.at:
            self.close()
            fs, at = pafs.FileSystem.from_uri(path)
            there = fs.get_file_info(at).type == pafs.FileType.File
            self.path, self.stream, self.at = path, fs.open_input_stream(at, compression=None, buffer_size=CHUNK) if there else None, 0
        if not self.stream:
            return b""
        while self.at < offset and (skipped := len(self.stream.read(min(CHUNK, offset - self.at)))):
            self.at += skipped
        got = self.stream.read(length)
        self.at += len(got)
        return got

    def close(self) -> None:
        if self.stream:
            self.stream.close()
        self.path = self.stream = None


def in_order(records: DataFrame) -> DataFrame:
    """Records of a file together and in order, so that one task reads it from start to end."""
    return records.repartition(partitions(records.sparkSession), "file").sortWithinPartitions("file", "ord")


def check_payload(stored: bytes) -> tuple[str | None, bool]:
    """sha256 of the payload and whether it is the one in the record's header; None, False if it can't be read."""
    try:
        headers, body = parse(stored)
    except (zlib.error, ValueError, KeyError):
        return None, False
    digest = hashlib.sha256(body).hexdigest()
    return digest, headers.get("WARC-Payload-Digest") == f"sha256:{digest}"


def leaves(records: DataFrame, payload: bool) -> DataFrame:
    """file, ord, hash of the stored bytes of every record; with payload also sha256 of what it holds and digest_ok.

    records: file (the same for all replicas), path (where to read it), ord, offset, length.
    """

    def run(batches):
        source = Stored()
        try:
            for b in batches:
                rows = []
                for file, path, n, offset, length in zip(*(b.column(c).to_pylist() for c in ("file", "path", "ord", "offset", "length")), strict=True):
                    stored = source.read(path, offset, length)
                    rows.append((file, n, hashlib.sha256(stored).hexdigest(), *(check_payload(stored) if payload else ())))
                if rows:
                    kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.bool_()]
                    yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds)], names=["file", "ord", "hash", "sha256", "digest_ok"][: len(rows[0])])
        finally:
            source.close()

    schema = "file string, ord long, hash string" + (", sha256 string, digest_ok boolean" if payload else "")
    return in_order(records.select("file", "path", "ord", "offset", "length")).mapInArrow(run, schema)


def depth_of(*leaves_: DataFrame) -> int:
    """Levels above the leaves that the largest file of all replicas needs."""
    most = max((leaf.agg(F.max("ord")).first()[0] or 0) for leaf in leaves_)
    depth = 0
    while most > 0:
        most, depth = most // FANOUT, depth + 1
    return depth


def tree(leaf: DataFrame, depth: int) -> list[DataFrame]:
    """Levels of the trees, leaves first: file, node, hash. Node i of a level covers nodes FANOUT * i ... of the one below."""
    level = leaf.select("file", F.col("ord").alias("node"), "hash")
    levels = [level]
    for _ in range(depth):
        parts = F.sort_array(F.collect_list(F.struct("node", "hash")))
        level = level.groupBy("file", F.floor(F.col("node") / FANOUT).alias("node")).agg(parts.alias("below"))
        # A node's hash covers which of its children there are.
        level = written(level.select("file", "node", F.sha2(F.concat_ws(",", F.transform("below", lambda x: F.concat_ws(":", x["node"], x["hash"]))), 256).alias("hash")), "warc-level")
        levels.append(level)
    return levels


def differing(a: DataFrame, b: DataFrame) -> DataFrame:
    """file, ord, ours, theirs of the records that differ between two replicas' leaves (null: there is none), found from the roots downwards."""
    depth = depth_of(a, b)
    left, right = tree(a, depth), tree(b, depth)
    suspects = None
    for one, two in zip(reversed(left), reversed(right), strict=True):
        if suspects is not None:
            parent = F.floor(F.col("node") / FANOUT)
            marks = small(suspects.select(F.col("file").alias("pf"), F.col("node").alias("pn")))
            one, two = (x.join(marks, (F.col("file") == F.col("pf")) & (parent == F.col("pn")), "left_semi") for x in (one, two))
        other = two.select("file", "node", F.col("hash").alias("other"))
        suspects = written(one.join(other, ["file", "node"], "full").filter(~F.col("hash").eqNullSafe(F.col("other"))), "warc-suspects")
    return suspects.select("file", F.col("node").alias("ord"), F.col("hash").alias("ours"), F.col("other").alias("theirs"))


def flip(stored: bytes) -> bytes:
    """One bit in the middle of a record: the fault that the audit has to find."""
    k = len(stored) // 2
    return stored[:k] + bytes([stored[k] ^ 1]) + stored[k + 1 :]


def copy_files(records: DataFrame, faulty: Column) -> DataFrame:
    """records with the path of the copy; the copies of records where `faulty` holds have one bit flipped."""
    folder = new_folder(records.sparkSession, "warc-replica")

    def run(batches):
        source, file_open, out, path = Stored(), None, None, None
        try:
            for b in batches:
                rows = []
                for file, n, offset, length, bad in zip(*(b.column(c).to_pylist() for c in ("file", "ord", "offset", "length", "bad")), strict=True):
                    if file != file_open:
                        if out:
                            out.close()
                        fs, to = pafs.FileSystem.from_uri(folder)
                        fs.create_dir(to, recursive=True)
                        name = f"{uuid.uuid4().hex[:8]}-{file.rpartition('/')[2]}"
                        file_open, out, path = file, fs.open_output_stream(f"{to}/{name}", compression=None), f"{folder}/{name}"
                    stored = source.read(file, offset, length)
                    out.write(flip(stored) if bad else stored)
                    rows.append((file, path, n, offset, length))
                if rows:
                    yield pa.record_batch([pa.array(c) for c in zip(*rows, strict=True)], names=["file", "path", "ord", "offset", "length"])
        finally:
            source.close()
            if out:
                out.close()

    rows = records.select("file", "ord", "offset", "length", F.coalesce(faulty, F.lit(False)).alias("bad"))
    return written(in_order(rows).mapInArrow(run, "file string, path string, ord long, offset long, length long"), "warc-copies")


def audit(records: DataFrame, copies: DataFrame) -> DataFrame:
    """page_id, url, n_bytes, sha256, status of every record.

    'intact'; 'differs' where the replicas don't agree or a record isn't what its header says; 'missing' where the second
    replica's list lacks it; 'added' for a record that only the second has (it has no page_id, url, n_bytes or sha256).
    """
    first = written(leaves(records.withColumn("path", F.col("file")), True), "warc-leaves")
    second = written(leaves(copies, False), "warc-leaves")
    bad = differing(first.select("file", "ord", "hash"), second)
    known = records.select("file", "ord", "page_id", "url", "n_bytes").join(first.drop("hash"), ["file", "ord"])
    rows = known.join(small(bad.filter("ours IS NOT NULL")), ["file", "ord"], "left")
    status = F.when(F.col("ours").isNotNull() & F.col("theirs").isNull(), "missing").when(F.col("ours").isNotNull() | ~F.col("digest_ok"), "differs").otherwise("intact")
    out = ("page_id", "url", "n_bytes", "sha256")
    added = bad.filter("ours IS NULL").select(*[F.lit(None).cast(known.schema[c].dataType).alias(c) for c in out], F.lit("added").alias("status"))
    return rows.select(*out, status.alias("status")).unionByName(added)


ORACLE = """
SELECT page_id, url, octet_length(encode(COALESCE(html, '')))::BIGINT AS n_bytes, sha256(COALESCE(html, '')) AS sha256,
       CASE WHEN page_id % 97 = 5 THEN 'differs' ELSE 'intact' END AS status
FROM pages
"""
