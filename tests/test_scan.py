"""The distributed scan against plain loops: groups that go on over parts, parts that hold many groups, one day with nearly all rows."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from stakewell.operators import order, scan

SCHEMA = "g string, t int, id long, x int, y double, s string, part int, running long"


def plain(rows, grouped):
    out, key = [], (lambda r: r[0]) if grouped else (lambda r: 0)
    rows = sorted(rows, key=lambda r: ((r[0] is not None, r[0] or "") if grouped else 0, r[1] is not None, r[1] or 0, r[2]))
    state = {}
    for i, r in enumerate(rows):
        n, total, last = state.get(key(r), (0, 0, None))
        n, total, last = n + 1, total + (r[3] or 0), r[5] if r[5] is not None else last
        state[key(r)] = n, total, last
        back = rows[i - 1] if i and key(rows[i - 1]) == key(r) else None
        ahead = rows[i + 1] if i + 1 < len(rows) and key(rows[i + 1]) == key(r) else None
        out.append((r[2], n, total, back and back[5], ahead and ahead[5], back and back[4], ahead and ahead[4], last))
    return sorted(out)


def result(df, grouped, parts):
    out = scan.scan(
        df, [F.col("t").asc_nulls_first(), F.col("id").asc()], ["g"] if grouped else None, position="n", running={"total": "x"},
        neighbours={"s": ("s_back", "s_ahead"), "y": ("y_back", "y_ahead")}, latest={"s_last": "s"}, parts=parts,
    )
    assert out.columns[: len(df.columns)] == df.columns
    return sorted(tuple(r) for r in out.select("id", "n", "total", "s_back", "s_ahead", "y_back", "y_ahead", "s_last").collect())


@pytest.mark.parametrize("grouped", [False, True])
@pytest.mark.parametrize("groups, parts, batch", [(1, 7, 3), (4, 7, 1), (60, 3, 5), (3, 1, 10_000)])
def test_scan_like_plain_loops(spark, grouped, groups, parts, batch):
    rng = random.Random(groups)
    rows = [(rng.choice([None, *map(str, range(groups))]), rng.choice([None, 1, 2, 3]), i, rng.choice([None, -5, 2, 9]), rng.random(), rng.choice([None, None, None, f"v{i}"]), 1, 2) for i in range(150)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        assert result(spark.createDataFrame(rows, SCHEMA).repartition(5), grouped, parts) == plain(rows, grouped)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_scan_of_few_or_no_rows(spark):
    assert result(spark.createDataFrame([], SCHEMA), True, 4) == []
    one = [("a", 1, 1, 5, 0.5, None, 1, 2)]
    assert result(spark.createDataFrame(one, SCHEMA), False, 4) == plain(one, False)


def test_a_day_with_most_rows_is_many_tasks(spark, monkeypatch):
    """90 % of the rows are of one day and one book: parts stay even, and positions are those of a sort."""
    kept = []
    monkeypatch.setattr(scan, "written", lambda df, name, w=scan.written: kept.append(w(df, name)) or kept[-1])
    rows = spark.range(40_000).select("id", F.when(F.col("id") % 10 == 0, F.col("id") % 400).otherwise(7).alias("day"), F.when(F.col("id") % 10 == 0, F.col("id") % 3).otherwise(1).alias("book"))
    out = order.ranked(rows, [F.col("day").desc(), F.col("id").asc()], ["book"])
    sizes = [r["count"] for r in kept[0].groupBy("scan_part").count().collect()]
    assert len(sizes) > 2 and max(sizes) <= 2 * statistics.median(sizes)
    found = {r.id: r.position for r in out.collect()}
    for b in range(3):
        mine = sorted((-r.day, r.id) for r in rows.where(F.col("book") == b).collect())
        assert [found[i] for _, i in mine] == list(range(1, len(mine) + 1))


def test_the_plan_shuffles_rows_once(spark):
    rows = spark.range(1000).withColumn("x", F.col("id") % 7)
    plan = scan.scan(rows, [F.col("id").asc()], running={"total": "x"})._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan


@pytest.mark.parametrize("kind", ["decimal(18,2)", "double", "short"])
def test_sums_of_any_kind_of_number(spark, kind):
    rows = spark.range(50).withColumn("x", (F.col("id") - 20).cast(kind))
    got = scan.scan(rows, [F.col("id").asc()], running={"total": "x"}, parts=4).collect()
    assert [(r.id, int(r.x), int(r.total)) for r in sorted(got)] == [(i, i - 20, sum(range(-20, i - 19))) for i in range(50)]
    assert type(got[0].total) is {"decimal(18,2)": __import__("decimal").Decimal, "double": float, "short": int}[kind]
