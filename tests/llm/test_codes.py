"""Vector codes against plain Lloyd rounds over Python's integers."""

import hashlib
import math

import numpy as np
import pytest

from stakewell.llm import codes

from .test_operators import SF

SCHEMA = "vec_id long, embedding array<double>, label int, code string, error long, v int"


def plain(rows, entries=64, rounds=2):
    """{(vec_id, vector): (code, error, label_error)} and the hash of the codebooks, by looking at every entry for every part."""
    kept = [(i, x, y) for i, x, y in rows if x is not None and all(c is not None and math.isfinite(c) for c in x)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    parts = [[[math.floor(256 * c) for c in x[p * len(x) // 16 : (p + 1) * len(x) // 16]] for _, x, _ in kept] for p in range(16)]
    books = [[list(v) for v in part[:entries]] for part in parts]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    nearest = lambda v, book: min(range(len(book)), key=lambda e: (far(v, book[e]), e))
    for _ in range(rounds):
        for part, book in zip(parts, books):
            found = [nearest(v, book) for v in part]
            for e in set(found):
                mine = [v for v, f in zip(part, found) if f == e]
                book[e] = [sum(c) // len(mine) for c in zip(*mine)]
    code = ["".join(f"{nearest(part[i], book):02x}" for part, book in zip(parts, books)) for i in range(len(kept))]
    error = [sum(far(part[i], book[int(c[2 * p : 2 * p + 2], 16)]) for p, (part, book) in enumerate(zip(parts, books))) for i, c in enumerate(code)]
    label = {}
    for (_, _, y), e in zip(kept, error):
        label[y] = label.get(y, 0) + e
    digest = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    return sorted(((i, c, e, label[y], digest) for (i, _, y), c, e in zip(kept, code, error)), key=str)


def result(df):
    return sorted((tuple(r) for r in codes.vector_codes(df).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()), key=str)


def test_codes_of_the_table(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    assert result(df) == plain([(r.vec_id, r.embedding, r.label) for r in df.collect()])


def test_codes_odd_rows(spark, monkeypatch):
    """Nulls everywhere, ties between entries, repeated rows, other lengths, columns with the operator's own names; small chunks."""
    monkeypatch.setattr(codes, "CHUNK", 32)
    rng = np.random.default_rng(5)
    coarse = [[float(c) / 64 for c in v] for v in rng.integers(-3, 4, (150, 32))]  # ties abound
    rows = [(i // 2, v, None if i % 3 == 0 else i % 4, "x", 1, 2) for i, v in enumerate(coarse)]
    rows += [(None, coarse[0], None, "x", 1, 2)] * 2 + rows[:3]
    bad = [(900, None, 1), (901, [None] * 32, 1), (902, [float("nan")] + [0.0] * 31, 1), (903, [float("-inf")] + [0.0] * 31, 1)]
    short = [(904, [], 1), (905, [1.0] * 31, 1), (906, [1.0] * 16, 1)]
    df = spark.createDataFrame(rows + [(*r, "y", 0, 0) for r in bad + short], SCHEMA)
    assert result(df) == plain([r[:3] for r in rows])
    assert result(spark.createDataFrame([], SCHEMA)) == []
    assert result(spark.createDataFrame([(*r, "y", 0, 0) for r in bad], SCHEMA)) == []
    few = rows[:5]
    assert result(spark.createDataFrame(few, SCHEMA)) == plain([r[:3] for r in few])


def test_codes_of_large_values(spark):
    """Beyond 64-bit squares the tasks go on with Python's integers."""
    rng = np.random.default_rng(6)
    base = rng.integers(0, 50, (90, 16)).astype(float)
    rows = [(i, [float(c) * (2.0**18 if i % 2 else 1.0) for c in v], 0) for i, v in enumerate(base)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert result(df) == plain(rows)


@pytest.mark.parametrize("d, spread", [(1, 5), (2, 1000), (4, 40)])
def test_walk_equals_all_distances(d, spread):
    rng = np.random.default_rng(d)
    n = 3000
    points = np.concatenate([rng.integers(-spread, spread, (3, n // 2, d)), rng.integers(-2, 3, (3, n - n // 2, d))], 1)
    books = np.concatenate([points[:, :30], points[:, n - 34 :]], 1)
    order = codes.tree_order(points)
    assert (np.sort(order, 1) == np.arange(n)).all()
    tree = points[np.arange(3)[:, None], order]
    got = codes.Assigned(tree, books, codes=True)
    want = ((tree[:, :, None] - books[:, None]) ** 2).sum(3).argmin(2)
    assert (got.code == want).all()
    for p in range(3):
        for e in range(64):
            assert got.count[p, e] == (want[p] == e).sum() and (got.sums[p, e] == tree[p][want[p] == e].sum(0)).all()
    assert got.looked < 0.9 * want.size * 64  # boxes did rule entries out


def test_decoded_vectors(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    coded, books = codes.compress(df)
    rows = coded.select("vec_id", "error", codes.decoded(coded.code, books).alias("back")).join(df, "vec_id").collect()
    for r in rows:
        near = np.floor(256 * np.array(r.embedding, float)) - 256 * np.array(r.back)
        assert round((near**2).sum()) == r.error
