"""Vector code compression: product codes of integer vectors, by Lloyd's rounds with the filtering algorithm.

Vectors are cut into PARTS equal parts, each with a codebook of its own. Rows are stored once in chunks of at most CHUNK
vectors; in each chunk a kd-tree stands over every part: points in tree order, nodes being halves of halves. A node has its
count, its componentwise sums and its bounding box. A round sends the codebooks (PARTS * ENTRIES entries, whatever the
data) to all tasks. There, an entry is out for a node if another is nearer to the whole box; a node with one entry left is
assigned at once by its count and sums, others hand what is left down to their halves. Sums of tasks are added up by Spark.

Numbers are whole throughout: floor(256 * x) and sums of them are exact, and so are ties, which go to the lower entry.
Where values are too large for 64 bits (|x| from 16,384 on), tasks go on with Python's integers; only errors beyond a
long can't be returned and raise.

Null vectors and those that hold null, NaN or infinite components are dropped, and so are vectors whose length isn't that
of most kept vectors (the shorter on a tie), with a length that PARTS doesn't divide among them: they have no equal parts.
A null vec_id comes last in the order of the first entries, equal ids go by their vectors. Repeated rows are rows of their
own. Fewer than ENTRIES rows: as many entries as rows. Empty table: no rows. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import give_back, small, text_batches, written

PARTS = 16
ENTRIES = 64
ROUNDS = 2
#: Vectors in a chunk, and points in a leaf of its trees.
CHUNK = 4096
LEAF = 8
#: Components up to which squared distances and sums of a chunk fit in 64 bits.
WIDE = 1 << 22


def whole_numbers(vectors: DataFrame, vector: str, vec_id: str, label: str) -> DataFrame:
    """vec_id, label and v, the components as floor(256 * x), of the rows that have a code."""
    v = F.col(vector).cast("array<double>")
    fine = F.coalesce(~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(False))
    kept = vectors.where(fine).select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).alias("label"), v.alias("v"))
    sizes = kept.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    n = sizes[0].n if sizes else 0
    return kept.where((F.size("v") == n) & F.lit(n > 0 and n % PARTS == 0))


def _integers(x: np.ndarray) -> np.ndarray:
    """floor(256 * x) as 64-bit integers, or as Python's where those don't hold them."""
    big = np.floor(x * 256.0)
    if not big.size or np.abs(big).max() < WIDE:
        return big.astype(np.int64)
    return np.array([int(c) if np.isfinite(c) else int(y) * 256 for c, y in zip(big.ravel(), x.ravel(), strict=True)], object).reshape(x.shape)


# ---- trees -------------------------------------------------------------------------


def levels(n: int) -> int:
    """Levels below the root until no node has more than LEAF points."""
    k = 0
    while n > LEAF << k:
        k += 1
    return k


def bounds(n: int, level: int) -> np.ndarray:
    """Where the nodes of a level begin in tree order, and the end."""
    return (np.arange((1 << level) + 1) * n) >> level


def tree_order(points: np.ndarray) -> np.ndarray:
    """For points [parts, n, d]: the order [parts, n] in which every node's points stand together, halved across its widest side."""
    parts, n, _ = points.shape
    order = np.tile(np.arange(n), (parts, 1))
    row = np.arange(parts)[:, None]
    for level in range(levels(n)):
        at = bounds(n, level)
        node = np.repeat(np.arange(1 << level), np.diff(at))
        here = points[row, order]
        side = (np.maximum.reduceat(here, at[:-1], 1) - np.minimum.reduceat(here, at[:-1], 1)).argmax(2)
        key = np.take_along_axis(here, side[:, node][..., None], 2)[..., 0]
        for p in range(parts):
            order[p] = order[p][np.lexsort((key[p], node))]
    return order


class Tree:
    """Counts, sums and boxes of all nodes of a chunk's trees, level by level: leaves are added up once, the rest is made of halves."""

    def __init__(self, points: np.ndarray) -> None:
        """points [parts, n, d] in tree order."""
        self.points, n = points, points.shape[1]
        self.depth = levels(n)
        at = bounds(n, self.depth)
        low, high, sums = (f.reduceat(points, at[:-1], 1) for f in (np.minimum, np.maximum, np.add))
        self.levels = [(at, np.diff(at), low, high, sums)]
        for level in range(self.depth - 1, -1, -1):
            at = bounds(n, level)
            low, high, sums = (f(x[:, ::2], x[:, 1::2]) for f, x in ((np.minimum, low), (np.maximum, high), (np.add, sums)))
            self.levels.insert(0, (at, np.diff(at), low, high, sums))


class Assigned:
    """What a walk down the trees of a chunk found: count and sums for each part and entry, and each point's entry if asked."""

    def __init__(self, points: np.ndarray, books: np.ndarray, codes: bool = False) -> None:
        """points [parts, n, d] in tree order, books [parts, entries, d]."""
        parts, n, d = points.shape
        k = books.shape[1]
        kind = np.int64 if points.dtype != object and books.dtype != object else object
        points, books = points.astype(kind), books.astype(kind)
        tree = Tree(points)
        self.count, self.sums = np.zeros((parts, k), np.int64), np.zeros((parts, k, d), kind)
        self.code = np.zeros((parts, n), np.uint8) if codes else None
        #: Distances of entries to single points; without trees, n * parts * k.
        self.looked = 0
        part, node = np.arange(parts), np.zeros(parts, np.int64)
        alive = np.ones((parts, k), bool)
        for level, (at, size, lows, highs, sums) in enumerate(tree.levels):
            low, high, mine = lows[part, node], highs[part, node], books[part]
            # Twice the distance to the box's middle, so that it is whole. The nearest entry that is left is surely not out.
            far = ((2 * mine - (low + high)[:, None]) ** 2).sum(2)
            best = np.where(alive, far, far.max(1, keepdims=True) + 1).argmin(1)
            near = mine[np.arange(len(part)), best]
            # At the corner farthest in the direction from `near` to an entry, that entry does best against it.
            corner = np.where(mine > near[:, None], high[:, None], low[:, None])
            behind = ((mine - corner) ** 2).sum(2) - ((near[:, None] - corner) ** 2).sum(2)
            alive &= ~((behind > 0) | ((behind == 0) & (np.arange(k) > best[:, None])))
            alive[np.arange(len(part)), best] = True
            one = alive.sum(1) == 1
            self._give(at, part[one], node[one], alive[one].argmax(1), size, sums)
            part, node, alive = part[~one], node[~one], alive[~one]
            if not len(part):
                break
            if level == tree.depth:
                self._leaves(points, books, at, part, node, alive)
            else:
                part, node, alive = np.repeat(part, 2), (2 * node[:, None] + [0, 1]).ravel(), np.repeat(alive, 2, 0)

    def _give(self, at, part, node, entry, size, sums) -> None:
        """Whole nodes go to an entry each, by their counts and sums."""
        np.add.at(self.count, (part, entry), size[node])
        np.add.at(self.sums, (part, entry), sums[part, node])
        if self.code is not None:
            for p, b, e, c in zip(part, at[node], at[node + 1], entry, strict=True):
                self.code[p, b:e] = c

    def _leaves(self, points, books, at, part, node, alive) -> None:
        """Points of undecided leaves go one by one to the nearest of the entries that are left."""
        size = np.diff(at)[node]
        row = np.repeat(np.arange(len(part)), size)
        where = np.arange(size.sum()) + np.repeat(at[node] - (np.cumsum(size) - size), size)
        for b in range(0, len(row), 1 << 14):
            r, w = row[b : b + (1 << 14)], where[b : b + (1 << 14)]
            p = points[part[r], w]
            far = ((books[part[r]] - p[:, None]) ** 2).sum(2)
            self.looked += int(alive[r].sum())
            entry = np.where(alive[r], far, far.max(1, keepdims=True) + 1).argmin(1)
            np.add.at(self.count, (part[r], entry), 1)
            np.add.at(self.sums, (part[r], entry), p)
            if self.code is not None:
                self.code[part[r], w] = entry


# ---- on Spark ----------------------------------------------------------------------


def _pack(x: np.ndarray) -> tuple[bytes, str]:
    """Whole numbers as bytes of the narrowest kind; Python's as decimal text."""
    if x.dtype == object:
        return ",".join(map(str, x.ravel())).encode(), "text"
    kind = next(k for k in ("i1", "i2", "i4", "i8") if not x.size or (np.iinfo(k).min <= x.min() and x.max() <= np.iinfo(k).max))
    return x.astype(kind).tobytes(), kind


def _unpack(raw: bytes, kind: str, shape: tuple) -> np.ndarray:
    if kind == "text":
        return np.array([int(c) for c in raw.split(b",")], object).reshape(shape)
    return np.frombuffer(raw, kind).astype(np.int64).reshape(shape)




def chunks(rows: DataFrame, label: T.DataType) -> DataFrame:
    """The rows in chunks with their trees: points [PARTS, n, d] in tree order and each part's order, in one row a chunk, stored."""
    schema = pa.schema([("n", pa.int32()), ("kind", pa.string()), ("points", pa.binary()), ("order", pa.binary()), ("vec_ids", pa.list_(pa.int64())), ("labels", pa.list_(_arrow(label)))])
    text_batches(rows.sparkSession)

    def build(batches):
        held, n = [], 0
        for b in batches:
            for i in range(0, b.num_rows, CHUNK):
                held.append(b.slice(i, CHUNK))
                n += held[-1].num_rows
                while n >= CHUNK:
                    t = pa.Table.from_batches(held)
                    yield one(t.slice(0, CHUNK))
                    held, n = t.slice(CHUNK).to_batches(), n - CHUNK
            give_back()
        if n:
            yield one(pa.Table.from_batches(held))

    def one(t: pa.Table) -> pa.RecordBatch:
        t = t.combine_chunks()
        v = t.column("v").chunk(0)
        points = _integers(v.flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, PARTS, -1)).transpose(1, 0, 2)
        order = tree_order(points)
        raw, kind = _pack(points[np.arange(PARTS)[:, None], order])
        return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((t.num_rows, kind, raw, order.astype(np.int16).tobytes(), t.column("vec_id").to_pylist(), t.column("label").to_pylist()), schema, strict=True)], schema=schema)

    made = rows.select("vec_id", "label", "v").mapInArrow(build, T.StructType([T.StructField("n", T.IntegerType()), T.StructField("kind", T.StringType()), T.StructField("points", T.BinaryType()), T.StructField("order", T.BinaryType()), T.StructField("vec_ids", T.ArrayType(T.LongType())), T.StructField("labels", T.ArrayType(label))]))
    return written(made, "codes")


def _arrow(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def _each_chunk(batches, books: list):
    """(row, points, walk) of every stored chunk."""
    array = np.array(books, object)
    if not array.size or max(abs(int(x)) for x in array.ravel()) < WIDE:
        array = array.astype(np.int64)
    for b in batches:
        for i in range(b.num_rows):
            row = b.slice(i, 1).to_pylist()[0]
            yield row, _unpack(row["points"], row["kind"], (PARTS, row["n"], array.shape[2])), array
        give_back()


def first_books(rows: DataFrame, entries: int = ENTRIES) -> list:
    """The codebooks [PARTS, entries, d] that the rows of smallest ids make."""
    got = rows.orderBy(F.col("vec_id").asc_nulls_last(), "v").select("v").limit(entries).collect()
    if not got:
        return []
    return _integers(np.array([r.v for r in got], float).reshape(len(got), PARTS, -1)).transpose(1, 0, 2).tolist()


def improved(stored: DataFrame, books: list) -> list:
    """One of Lloyd's rounds: every entry becomes its points' mean, rounded down; an entry without points stays."""
    size = len(books[0][0])

    def add(batches):
        for _, points, array in _each_chunk(batches, books):
            found = Assigned(points, array)
            part, entry = np.nonzero(found.count)
            yield pa.record_batch([pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(found.count[part, entry]), pa.array([[int(x) for x in s] for s in found.sums[part, entry]], pa.list_(pa.decimal128(38)))], names=["part", "entry", "n", "sums"])

    sums = stored.select("n", "kind", "points").mapInArrow(add, "part int, entry int, n long, sums array<decimal(38,0)>")
    total = sums.groupBy("part", "entry").agg(F.sum("n").alias("n"), *(F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(size)))
    out = [[list(e) for e in part] for part in books]
    for r in total.collect():  # at most PARTS * ENTRIES rows
        out[r.part][r.entry] = [int(r[f"s{i}"]) // r.n for i in range(size)]
    return out


def assigned(stored: DataFrame, books: list, label: T.DataType) -> DataFrame:
    """vec_id, label, code (a byte a part) and error of each row."""
    schema = pa.schema([("vec_id", pa.int64()), ("label", _arrow(label)), ("code", pa.string()), ("error", pa.int64())])

    def code(batches):
        for row, points, array in _each_chunk(batches, books):
            found = Assigned(points, array, codes=True)
            order = np.frombuffer(row["order"], np.int16).astype(np.int64).reshape(PARTS, -1)
            part = np.arange(PARTS)[:, None]
            far = ((points - array[part, found.code]) ** 2).sum(2)
            codes, error = np.empty_like(found.code), np.empty_like(far)
            codes[part, order], error[part, order] = found.code, far
            text = codes.T.tobytes().hex()
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip((row["vec_ids"], row["labels"], [text[i : i + 2 * PARTS] for i in range(0, len(text), 2 * PARTS)], [int(e) for e in error.sum(0)]), schema.types, strict=True)], schema=schema)

    return stored.mapInArrow(code, T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("label", label), T.StructField("code", T.StringType()), T.StructField("error", T.LongType())]))


def trained(stored: DataFrame, books: list, rounds: int = ROUNDS) -> list:
    for _ in range(rounds):
        books = improved(stored, books)
    return books


def compress(vectors: DataFrame, vector: str = "embedding", vec_id: str = "vec_id", label: str = "label", entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, list]:
    """(vec_id, label, code, error of each row; the codebooks [PARTS, entries, d])."""
    rows = whole_numbers(vectors, vector, vec_id, label)
    kind = rows.schema["label"].dataType
    stored = chunks(rows, kind)
    books = first_books(rows, entries)
    if not books:
        return vectors.sparkSession.createDataFrame([], T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("label", kind), T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])), []
    books = trained(stored, books, rounds)
    return written(assigned(stored, books, kind), "codes"), books


def decoded(code: Column, books: list) -> Column:
    """The vector that a code stands for, in the units of the original."""
    parts = [F.array(*(F.array(*(F.lit(x / 256) for x in e)) for e in part)) for part in books]
    at = lambda p: F.conv(F.substring(code, 2 * p + 1, 2), 16, 10).cast("int")
    return F.flatten(F.array(*(F.element_at(parts[p], at(p) + 1) for p in range(PARTS))))


def vector_codes(vectors: DataFrame, vector: str = "embedding", vec_id: str = "vec_id", label: str = "label") -> DataFrame:
    """Each row's code and error, the error of all rows of its label (nulls together), and the codebooks' hash."""
    codes, books = compress(vectors, vector, vec_id, label)
    digest = hashlib.sha256(",".join(str(x) for part in books for entry in part for x in entry).encode()).hexdigest()
    by_label = codes.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "label_")
    joined = codes.join(small(by_label), codes["label"].eqNullSafe(F.col("label_")), "left")
    return joined.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


_ASSIGNED = "(SELECT rid, part, arg_min(entry, far * 64 + entry) AS entry, min(far) AS far FROM (SELECT c.rid, c.part, b.entry, sum((c.x - b.x) * (c.x - b.x)) AS far FROM comps c JOIN {books} b ON b.part = c.part AND b.j = c.j GROUP BY 1, 2, 3) GROUP BY 1, 2)"
_MEANS = "(SELECT b.part, b.entry, b.j, COALESCE(n.x, b.x) AS x FROM {books} b LEFT JOIN (SELECT c.part, a.entry, c.j, floor(sum(c.x)::DOUBLE / count(*))::BIGINT AS x FROM comps c JOIN {codes} a ON a.rid = c.rid AND a.part = c.part GROUP BY 1, 2, 3) n ON n.part = b.part AND n.entry = b.entry AND n.j = b.j)"
#: For vectors of one length.
ORACLE = (
    "WITH kept AS (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, v) AS rid, vec_id, label, v FROM (SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)), "
    "flat AS (SELECT rid, unnest(v) AS x, unnest(range(len(v))) AS i, len(v) // 16 AS d FROM kept), comps AS MATERIALIZED (SELECT rid, x, i // d AS part, i % d AS j FROM flat), "
    "b0 AS MATERIALIZED (SELECT part, rid - 1 AS entry, j, x FROM comps WHERE rid <= 64), "
    f"a0 AS MATERIALIZED {_ASSIGNED.format(books='b0')}, b1 AS MATERIALIZED {_MEANS.format(books='b0', codes='a0')}, a1 AS MATERIALIZED {_ASSIGNED.format(books='b1')}, b2 AS MATERIALIZED {_MEANS.format(books='b1', codes='a1')}, a2 AS MATERIALIZED {_ASSIGNED.format(books='b2')}, "
    "digest AS (SELECT sha256(string_agg(x::VARCHAR, ',' ORDER BY part, entry, j)) AS h FROM b2), "
    "coded AS (SELECT rid, string_agg(format('{:02x}', entry), '' ORDER BY part) AS code, sum(far)::BIGINT AS error FROM a2 GROUP BY 1) "
    "SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, h AS codebooks_sha256 FROM kept JOIN coded USING (rid), digest"
)
