"""Line dedup against plain loops, and the runs by themselves."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from stakewell.llm import lines

from .test_operators import DOC, EXTRA, LONG, odd_docs

SPACE = " \t\n\v\f\r"


def plain(rows, least=3, points=20):
    """(doc_id, lines, dropped, text left) of each row."""
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    split = [(i, (t or "").split("\n")) for i, t in rows]
    key = lambda x: x.strip(SPACE).translate(lower)
    holders = {}
    for i, mine in split:
        for x in mine:
            if len(key(x)) >= points:
                holders.setdefault(key(x), set()).add(i)
    top = {k: max(ids, key=lambda i: (i is not None, i or 0)) for k, ids in holders.items() if len(ids) >= least}
    out = []
    for i, mine in split:
        left = [x for x in mine if key(x) not in top or top[key(x)] == i]
        out.append((i, len(mine), len(mine) - len(left), "\n".join(left)))
    return sorted(out, key=str)


def texts(n, seed):
    """Texts of lines that recur by chance, with blanks and capitals around, some just under and at the limit of 20."""
    rng = random.Random(seed)
    pool = [f"line number {i} that recurs a lot" for i in range(30)] + ["x" * 19, "y" * 20, "é" * 19, "é" * 20, "İ" * 20, "Å common line of Ünicode LETTERS", "", " "]
    return ["\n".join(rng.choice(["", " ", "\t\r", "\x0b"]) + (x.upper() if rng.random() < 0.2 and x.isascii() else x) + rng.choice(["", "\r", "  "]) for x in rng.choices(pool, k=rng.randrange(12))) for _ in range(n)]


@pytest.mark.parametrize("batches", [1, 8])
def test_line_dedup_like_plain_loops(spark, batches):
    rows = [(None if i % 17 == 0 else i // 2, t, None, None, None, "x", "y", 1, 2, "z", 5, 0) for i, t in enumerate(texts(120, 1))] + [(None, "twice the very same line\ntwice the very same line", *[None] * 10)] * 3
    docs = spark.createDataFrame(rows, EXTRA).unionByName(odd_docs(spark)).unionByName(odd_docs(spark).withColumn("doc_id", F.col("doc_id") + 1000))
    got = sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in lines.dedup_lines(docs, batches=batches).collect()), key=str)
    want = plain([(r.doc_id, r.text) for r in docs.collect()])
    assert got == want and sum(r[2] for r in want) > 100
    digests = sorted((tuple(r) for r in lines.line_dedup(docs).collect()), key=str)
    assert digests == sorted(((i, n, d, hashlib.sha256(t.encode()).hexdigest()) for i, n, d, t in want), key=str)


def test_line_dedup_empty_and_clashing_columns(spark):
    assert lines.line_dedup(spark.createDataFrame([], DOC)).collect() == []
    docs = spark.createDataFrame([(i, LONG, 7, 8, 9, [1], 2) for i in range(4)], "doc_id int, text string, n_lines int, n_dropped int, h long, gone array<int>, top int")
    rows = lines.dedup_lines(docs).collect()
    assert [(r.n_lines, r.n_dropped, r.h, r.gone, r.top, r.n_dropped_, r.text == "") for r in sorted(rows)] == [(7, 8, 9, [1], 2, int(i < 3), i < 3) for i in range(4)]


@pytest.mark.parametrize("rising", [False, True])
def test_runs_in_any_order_of_batches(spark, rising):
    """Counts and largest ids don't depend on the order of batches; runs of one level are merged, settled keys aren't stored again."""
    batches = [[(i, k, k) for i in range(10 * b, 10 * b + 10) for k in range(i % 5 + 1)] for b in range(6)]
    runs = lines.LineRuns(spark, least=3, buckets=3)
    for b in batches if rising else batches[::-1]:
        runs.add(spark.createDataFrame(b, "doc_id long, a long, b long"))
    assert [r[0] for r in runs.runs] == [2, 1]
    if not rising:
        last = spark.table(runs.runs[-1][1])
        assert last.count() == 0  # every key was settled by batches of larger ids
    top = {r.a: r.top for r in runs.repeated().collect()}
    assert top == {k: max(i for b in batches for i, a, _ in b if a == k) for k in range(5)} and len(runs.runs) == 1
    runs.drop()
    assert lines.LineRuns(spark).repeated() is None


def test_runs_are_joined_without_shuffling_them(spark):
    runs = lines.LineRuns(spark, buckets=3)
    for b in range(2):
        runs.add(spark.createDataFrame([(b, k, k) for k in range(50)], "doc_id long, a long, b long"))
    name = runs.runs[0][1]
    spark.conf.set("spark.sql.legacy.bucketedTableScan.outputOrdering", "true")
    x = spark.table(name)
    plan = x.join(x.hint("merge").withColumnsRenamed({"a": "a_", "b": "b_", "n": "n_", "top": "top_"}), (F.col("a") == F.col("a_")) & (F.col("b") == F.col("b_")), "full")._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.legacy.bucketedTableScan.outputOrdering")
    assert "SortMergeJoin" in plan and "Exchange" not in plan and "Sort [" not in plan
    runs.drop()


def test_common_and_rare_keys_go_by_either_join(spark, monkeypatch):
    rows = [(i, t) for i, t in enumerate(texts(80, 2))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = plain(rows)
    for most in (1, 20, 10**9):
        monkeypatch.setattr(lines, "BROADCAST_ROWS", most)
        got = sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in lines.dedup_lines(docs).collect()), key=str)
        assert got == want
