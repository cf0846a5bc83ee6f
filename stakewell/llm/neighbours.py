"""Nearest neighbours by inner product, with multi-index hashing of learned rotated binary codes.

Reduction: for a query q the order by q.x is that by q.(x - mean). Rows are parted into ranges by the length of x - mean (one range, where
lengths hardly differ), and in a range a further coordinate makes all equally long, so
that the order there is that of angles. Codes: rotations learned on a bounded sample (iterative quantisation), whose signs are BITS bits.
Index: codes are cut into PARTS substrings of 16 bits; each block of rows has, for each substring, its rows
ordered by value. Search: a code within Hamming radius r of the query differs by at
most r // PARTS bits in some substring (pigeonhole), so probing all values within that many bits
of the query's substring finds every code in the radius. Where the values' buckets would visit more rows than the block
holds, its codes are compared one by one, which finds the same codes. Only what lies in the radius is compared by floats, by the inner
products of the original vectors in double precision.

A query's radius in a range is learned on the sample: the distance of its nearest sample codes there, and what true neighbours lie beyond that.
Queries whose radius holds fewer than k rows are searched again without one.

Rows are dealt into blocks by a tree of bits that parts the sample evenly (a block of copies is dealt on by hash), so a block
shares bits, and only the queries whose radius reaches it go there. A cell is a block of about BLOCK rows and at most about QUERIES queries;
it returns its best k of each query, and the best of those are the answer.

Vectors that are null, zero, or hold null or non-finite numbers take no part. Vectors of different lengths have no inner
product: each length is searched by itself. Ties in score go to
the smaller vec_id. Rows with the same vec_id are different candidates, but none of the query's own id. An empty table gives an
empty result. Extra columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import partitions, written

BITS = 128
PARTS = 8
WORDS = BITS // 64
SAMPLE = 4_096
SAMPLE_QUERIES = 512
BLOCK = 8_192
QUERIES = 16_384
NEIGHBOURS = 20
#: Leaves of the tree that deals rows into blocks: at least 32 rows of the sample each.
LEAVES = 128
#: Ranges of lengths, where the longest row is more than UNEVEN times the median one.
RANGES = 8
UNEVEN = 1.5
#: Blocks whose lists are merged at once.
MERGED = 64
#: Share of the sample's true neighbours that the learned radius has to reach.
REACH = 0.97
#: Queries that are compared with a block at once.
STEP = 256
#: Masks of 16 bits by their number of bits; flips beyond 4 would visit more rows than a block has.
_MASKS = [np.array([sum(1 << b for b in c) for n in range(most + 1) for c in combinations(range(16), n)], np.uint16) for most in range(5)]


def valid(vector: Column) -> Column:
    """Whether a vector has only finite numbers and not only zeros."""
    number = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return vector.isNotNull() & F.forall(vector, number) & F.exists(vector, lambda x: x != 0)


def usable(vectors: DataFrame) -> DataFrame:
    """id, v (doubles) of the vectors that take part."""
    v = F.col("embedding").cast("array<double>")
    return vectors.select(F.col("vec_id").cast("long").alias("id"), v.alias("v")).filter(F.col("id").isNotNull() & F.coalesce(valid(F.col("v")), F.lit(False)))


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hamming distances of each code of a to each of b (rows of WORDS 64-bit words)."""
    out = np.zeros((len(a), len(b)), np.int16)
    for k in range(WORDS):
        out += np.bitwise_count(a[:, k, None] ^ b[None, :, k])
    return out


def rotation(x: np.ndarray, r: np.random.Generator, steps: int = 30) -> np.ndarray:
    """Directions whose signs are nearest to the rows of x: main axes, then iterative quantisation."""
    d = min(x.shape[1], BITS)
    axes = np.linalg.svd(x, full_matrices=True)[2][:d].T if len(x) < x.shape[1] else np.linalg.svd(x, full_matrices=False)[2][:d].T
    y = x @ axes
    q, _ = np.linalg.qr(r.normal(size=(d, d)))
    for _ in range(steps):
        u, _, w = np.linalg.svd(np.sign(y @ q).T @ y)
        q = w.T @ u.T
    return axes @ q


class Codes:
    """Mean, ranges, directions, trees and radii, learned from a sample; total: rows of the table, longest: of their lengths from the mean."""

    def __init__(self, sample: np.ndarray, k: int, total: int, longest: float, seed: int = 3) -> None:
        r = np.random.default_rng(seed)
        self.mean = sample.mean(0)
        length = np.sqrt(((sample - self.mean) ** 2).sum(1))
        ranges = RANGES if longest > UNEVEN * np.median(length) and len(sample) >= 64 * RANGES else 1
        edges = np.unique(np.quantile(length, np.arange(1, ranges) / ranges))
        # Longer rows than the last edge make up the last range; of none it is longer than 0.
        self.edges = np.maximum(np.append(edges[edges < longest], longest * (1 + 1e-9)), 1e-300)
        x = self._even(sample)
        parts = [rotation(x, r) for _ in range(-(-BITS // min(x.shape[1], BITS)))]
        self.turn = np.concatenate(parts, axis=1)[:, :BITS]
        codes, self.own = self.of(sample), self.range_of(sample)
        self.sample = [codes[self.own == j] for j in range(len(self.edges))]
        # Queries may be coded as they are or from the mean: whichever needs the lesser share of the sample.
        self.near = max(2, round(k * len(sample) / max(total, 1)))
        tried = [self._learn(sample, codes, shifted) for shifted in (False, True)]
        _, self.shifted, self.beyond = min(tried, key=lambda t: t[:2])
        self.trees, self.leaf_range = [], []
        for own in self.sample:
            self.trees.append(self._grow(own, round(len(own) / max(len(sample), 1) * -(-total // BLOCK))))

    def range_of(self, x: np.ndarray) -> np.ndarray:
        return np.minimum(np.searchsorted(self.edges, np.sqrt(((x - self.mean) ** 2).sum(1)), "left"), len(self.edges) - 1)

    def _even(self, x: np.ndarray) -> np.ndarray:
        y = (x - self.mean) / self.edges[self.range_of(x)][:, None]
        return np.column_stack([y, np.sqrt(np.maximum(1 - (y * y).sum(1), 0))])

    @staticmethod
    def _pack(z: np.ndarray) -> np.ndarray:
        return np.packbits(z > 0, axis=1, bitorder="little").view(np.uint64).reshape(len(z), WORDS)

    def of(self, x: np.ndarray) -> np.ndarray:
        return self._pack(self._even(x) @ self.turn)

    def of_queries(self, q: np.ndarray, shifted: bool | None = None) -> np.ndarray:
        y = q - self.mean if (self.shifted if shifted is None else shifted) else q
        return self._pack(np.column_stack([y, np.zeros(len(y))]) @ self.turn)

    def _near(self, dist: np.ndarray) -> np.ndarray:
        k = min(self.near, dist.shape[1]) - 1
        return np.partition(dist, k, axis=1)[:, k].astype(np.int64) if k >= 0 else np.full(len(dist), BITS)

    def _learn(self, sample: np.ndarray, codes: np.ndarray, shifted: bool) -> tuple[float, bool, list[int]]:
        """Share of the sample that the radii hold, the kind of code, and how far each range's radius lies beyond the nearest codes."""
        asked = np.arange(min(SAMPLE_QUERIES, len(sample)))
        k = min(self.near, len(sample) - 1)
        if k < 1:
            return 1.0, shifted, [BITS] * len(self.edges)
        score = sample[asked] @ sample.T
        score[asked, asked] = -np.inf
        true = np.zeros(score.shape, bool)
        np.put_along_axis(true, np.argpartition(-score, k - 1, axis=1)[:, :k], True, axis=1)
        dist = distances(self.of_queries(sample[asked], shifted), codes)
        dist[asked, asked] = BITS
        beyond, held = [], 0
        for j in range(len(self.edges)):
            mine = self.own == j
            d = dist[:, mine]
            over = d - self._near(d)[:, None]
            beyond.append(int(np.quantile(over[true[:, mine]], REACH, method="higher")) if true[:, mine].any() else 0)
            held += (over <= beyond[-1]).sum()
        return float(held / dist.size), shifted, beyond

    def radius(self, codes: np.ndarray) -> np.ndarray:
        """Of each query in each range."""
        out = np.zeros((len(codes), len(self.edges)), np.int64)
        for i in range(0, len(codes), STEP):
            for j, own in enumerate(self.sample):
                out[i : i + STEP, j] = self._near(distances(codes[i : i + STEP], own)) + self.beyond[j]
        return np.clip(out, 0, BITS)

    def _grow(self, codes: np.ndarray, blocks: int):
        """A range's tree: (bit, left, right) or a leaf's number; it parts the sample by the bit that halves it best."""
        bits = np.unpackbits(codes.view(np.uint8), axis=1, bitorder="little") if len(codes) else np.zeros((0, BITS), np.uint8)

        def part(rows: np.ndarray, want: int):
            share = bits[rows].mean(0) if len(rows) >= 64 else np.zeros(BITS)
            bit = int(np.argmin(np.abs(share - 0.5)))
            if want <= 1 or not 0.1 <= share[bit] <= 0.9:
                self.leaf_range.append(len(self.trees))
                return len(self.leaf_range) - 1
            return bit, part(rows[bits[rows, bit] == 0], want // 2), part(rows[bits[rows, bit] == 1], want - want // 2)

        return part(np.arange(len(bits)), min(blocks, LEAVES))

    def leaf(self, x: np.ndarray, codes: np.ndarray) -> np.ndarray:
        out, own = np.zeros(len(codes), np.int32), self.range_of(x)
        todo = [(tree, np.flatnonzero(own == j)) for j, tree in enumerate(self.trees)]
        while todo:
            node, rows = todo.pop()
            if isinstance(node, int):
                out[rows] = node
                continue
            bit, left, right = node
            one = (codes[rows, bit // 64] >> np.uint64(bit % 64)) & np.uint64(1) == 1
            todo += [(left, rows[~one]), (right, rows[one])]
        return out


class Index:
    """Substring tables of a block of codes."""

    def __init__(self, codes: np.ndarray) -> None:
        self.codes, self.n = codes, len(codes)
        parts = codes.view(np.uint16).reshape(self.n, PARTS)
        self.order = [np.argsort(parts[:, j], kind="stable") for j in range(PARTS)]
        self.sorted = [parts[o, j] for j, o in enumerate(self.order)]

    def probed(self, code: np.ndarray, radius: int) -> np.ndarray | None:
        """Rows with a substring within radius // PARTS bits of the code's; None where their buckets hold more rows than the block."""
        flips = radius // PARTS
        if flips >= len(_MASKS) or len(_MASKS[flips]) * PARTS > 4 * self.n + 64:
            return None
        spans, visited = [], 0
        for j, v in enumerate(code.view(np.uint16)):
            values = v ^ _MASKS[flips]
            a, z = np.searchsorted(self.sorted[j], values, "left"), np.searchsorted(self.sorted[j], values, "right")
            hit = z > a
            visited += int((z - a).sum())
            if visited > self.n:
                return None
            spans += [self.order[j][s:e] for s, e in zip(a[hit].tolist(), z[hit].tolist())]
        return np.unique(np.concatenate(spans)) if spans else np.zeros(0, np.int64)

    def within(self, code: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows whose codes are within the radius, and their distances: complete by the pigeonhole principle."""
        rows = self.probed(code, radius)
        rows = np.arange(self.n) if rows is None else rows
        dist = distances(code[None], self.codes[rows])[0]
        keep = dist <= radius
        return rows[keep], dist[keep]


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest scores, ties to the smaller id."""
    return np.lexsort((ids, -scores))[:k]


def search_cell(rows: tuple, asked: tuple, k: int) -> dict[str, np.ndarray]:
    """query_id, vec_id, score: the best k rows of one block for each query of one chunk.

    rows: ids, vectors, codes; asked: ids, vectors, codes, radii.
    """
    (ids, x, codes), (q_ids, q, q_codes, radii) = rows, asked
    index = Index(codes)
    out: list[tuple] = []
    for i in range(0, len(q_ids), STEP):
        part = slice(i, i + STEP)
        found = [index.probed(c, r) for c, r in zip(q_codes[part], radii[part], strict=True)]
        whole = [j for j, f in enumerate(found) if f is None]
        if whole:
            dist = distances(q_codes[part][whole], codes)
            about = q[part][whole] @ x.T
        for j, f in enumerate(found):
            at, code, r = i + j, q_codes[i + j], radii[i + j]
            if f is None:
                w = len(whole) - sum(m >= j for m in whole)
                f = np.flatnonzero(dist[w] <= r)
                near = about[w][f]
            else:
                f = f[distances(code[None], codes[f])[0] <= r]
                near = x[f] @ q[at]
            other = ids[f] != q_ids[at]
            f, near = f[other], near[other]
            if len(f) > k:
                # Products of whole matrices may differ in the last digit: those at the edge are taken along.
                edge = np.partition(near, len(near) - k)[len(near) - k]
                f = f[near >= edge - 1e-9 * (1 + abs(edge))]
            # One row's products are summed alike wherever the row stands.
            scores = np.einsum("ij,j->i", x[f], q[at])
            top = best(ids[f], scores, k)
            out.append((np.full(len(top), q_ids[at]), ids[f][top], scores[top]))
    return {c: np.concatenate(v) for c, v in zip(("query_id", "vec_id", "score"), zip(*out, strict=True), strict=True)} if out else {}


def learn(rows: DataFrame, k: int, total: int, sample: int = SAMPLE) -> Codes:
    """The codes, from at most `sample` rows of least id hash; the longest row is that of all."""
    got = rows.orderBy(F.xxhash64("id"), "id", F.xxhash64("v")).limit(sample).select("v").toPandas()["v"]
    x = np.stack(got.map(np.asarray)).astype(np.float64)
    mean = F.array(*[F.lit(float(m)) for m in x.mean(0)])
    square = F.aggregate(F.zip_with("v", mean, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda acc, y: acc + y)
    return Codes(x, k, total, float(np.sqrt(rows.agg(F.max(square)).first()[0])))


_CODE = ", ".join(f"c{i} long" for i in range(WORDS))


def _stack(column: pa.Array) -> np.ndarray:
    """Vectors of one length as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def coded(rows: DataFrame, shared) -> DataFrame:
    """id, v, the code's words and leaf of every row."""

    def run(batches):
        for b in batches:
            if len(b):
                x = _stack(b.column("v"))
                code = shared.value.of(x)
                yield pa.record_batch([b.column("id"), b.column("v"), *[pa.array(code[:, i].view(np.int64)) for i in range(WORDS)], pa.array(shared.value.leaf(x, code))], names=["id", "v", *[f"c{i}" for i in range(WORDS)], "leaf"])

    return rows.mapInArrow(run, f"id long, v array<double>, {_CODE}, leaf int")


def routed(asked: DataFrame, shared, leaves: pd.DataFrame, everywhere: bool) -> DataFrame:
    """q_id, q_v, code, radius and leaf: each query with every leaf that its radius reaches."""
    # Bits that all codes of a leaf share bound their distance from below.
    ones = np.stack([leaves[f"and{i}"].to_numpy().view(np.uint64) for i in range(WORDS)], axis=1)
    same = np.stack([~(leaves[f"and{i}"].to_numpy().view(np.uint64) ^ leaves[f"or{i}"].to_numpy().view(np.uint64)) for i in range(WORDS)], axis=1)
    numbers = leaves["leaf"].to_numpy(np.int32)

    def run(batches):
        for b in batches:
            if not len(b):
                continue
            code = shared.value.of_queries(_stack(b.column("v")))
            radius = np.full((len(code), len(numbers)), BITS) if everywhere else shared.value.radius(code)[:, np.array(shared.value.leaf_range)[numbers]]
            least = sum(np.bitwise_count((code[:, i, None] ^ ones[None, :, i]) & same[None, :, i]).astype(np.int64) for i in range(WORDS))
            row, leaf = np.nonzero(least <= radius)
            take = b.take(pa.array(row))
            yield pa.record_batch([take.column("id"), take.column("v"), *[pa.array(code[row, i].view(np.int64)) for i in range(WORDS)], pa.array(radius[row, leaf]), pa.array(numbers[leaf])], names=["q_id", "q_v", *[f"c{i}" for i in range(WORDS)], "radius", "leaf"])

    return asked.select("id", "v").mapInArrow(run, f"q_id long, q_v array<double>, {_CODE}, radius long, leaf int")


def _cells(rows: DataFrame, asked: DataFrame, shared, leaves: pd.DataFrame, k: int, block: int, everywhere: bool = False) -> DataFrame:
    """query_id, vec_id, score, block: the best k of each query in each block."""
    spark = rows.sparkSession
    chunks = max(1, -(-asked.count() // QUERIES))
    # A leaf is one or more blocks of about `block` rows, numbered through.
    parts = np.maximum(1, -(-leaves["n"].to_numpy() // block))
    table = spark.createDataFrame([(int(leaf), int(n), int(first)) for leaf, n, first in zip(leaves["leaf"], parts, np.cumsum(parts) - parts, strict=True)], "leaf int, parts int, first int")
    everyone = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    # At most LEAVES rows.
    mine = (F.col("first") + F.pmod(F.xxhash64("id", "v"), F.col("parts"))).cast("int")
    left = rows.join(F.broadcast(table), "leaf").select("id", "v", *[f"c{i}" for i in range(WORDS)], mine.alias("block"), everyone(F.lit(chunks)).alias("chunk"))
    right = routed(asked, shared, leaves, everywhere).join(F.broadcast(table), "leaf").withColumn("part", everyone(F.col("parts")))
    right = right.select("q_id", "q_v", *[f"c{i}" for i in range(WORDS)], "radius", (F.col("first") + F.col("part")).cast("int").alias("q_block"), F.pmod(F.xxhash64("q_id", "q_v"), F.lit(chunks)).cast("int").alias("q_chunk"))

    def cell(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        code = lambda f: np.ascontiguousarray(np.stack([f[f"c{i}"].to_numpy().view(np.uint64) for i in range(WORDS)], axis=1))
        got = {}
        if len(a) and len(b):
            got = search_cell((a["id"].to_numpy(), np.stack(a["v"].to_list()), code(a)), (b["q_id"].to_numpy(), np.stack(b["q_v"].to_list()), code(b), b["radius"].to_numpy()), k)
        if not got:
            return pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64"), "block": pd.Series(dtype="int32")})
        return pd.DataFrame(got).assign(block=np.int32(a["block"].iloc[0]))

    cells = int(parts.sum()) * chunks
    dealt = lambda f, *by: f.repartition(max(partitions(spark), min(cells, 10_000)), *by).groupBy(*by)
    return dealt(left, "block", "chunk").cogroup(dealt(right, "q_block", "q_chunk")).applyInPandas(cell, "query_id long, vec_id long, score double, block int")


def _merged(found: DataFrame, k: int, blocks: int) -> DataFrame:
    """query_id, place (from 0), vec_id, score: the best k of each query. MERGED blocks at a time, so that no list is longer than that."""
    while True:
        blocks = -(-blocks // MERGED)
        parts = found.groupBy("query_id", F.floor(F.col("block") / MERGED).cast("int").alias("block"))
        top = parts.agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id"))), 1, k).alias("top"))
        found = top.select("query_id", "block", F.posexplode("top").alias("place", "t")).select("query_id", "block", "place", "t.vec_id", (-F.col("t.s")).alias("score"))
        if blocks <= 1:
            return found.select("query_id", "place", "vec_id", "score")


def _nearest(rows: DataFrame, queries: Column, k: int, block: int, n: int) -> DataFrame:
    """The search among rows of one length."""
    shared = rows.sparkSession.sparkContext.broadcast(learn(rows, k, n))
    rows = written(coded(rows, shared), "ann-codes")
    asked = rows.filter(queries)
    masks = [f(f"c{i}").alias(f"{name}{i}") for i in range(WORDS) for name, f in (("and", F.bit_and), ("or", F.bit_or))]
    leaves = rows.groupBy("leaf").agg(F.count("*").alias("n"), *masks).orderBy("leaf").toPandas()
    blocks = int(np.maximum(1, -(-leaves["n"].to_numpy() // block)).sum())
    first = written(_merged(_cells(rows, asked, shared, leaves, k, block), k, blocks), "ann-found")
    # Whose radius held too few, by name: rows with the same id are one query each.
    full = first.groupBy("query_id").agg(F.count("*").alias("c")).filter(f"c >= {k}").select("query_id")
    short = written(asked.join(full, F.col("id") == F.col("query_id"), "left_anti"), "ann-short")
    if not short.limit(1).count():
        return first
    again = _merged(_cells(rows, short, shared, leaves, k, block, everywhere=True), k, blocks)
    return first.join(full, "query_id", "left_semi").unionByName(again)


def nearest(vectors: DataFrame, queries: Column, k: int = NEIGHBOURS, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows of each row that `queries` (a condition on id) selects."""
    rows = written(usable(vectors), "ann-rows")
    lengths = rows.groupBy(F.size("v").alias("d")).count().orderBy("d").collect()
    found = None
    for r in lengths:
        mine = _nearest(rows.filter(F.size("v") == r.d), queries, k, block, r["count"])
        found = mine if found is None else found.unionByName(mine)
    if found is None:
        found = vectors.sparkSession.createDataFrame([], "query_id long, place int, vec_id long, score double")
    return found.select("query_id", (F.col("place") + 1).cast("int").alias("rank"), "vec_id", "score")
