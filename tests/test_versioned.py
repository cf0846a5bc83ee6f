"""The versioned table: files rewritten, versions, lost races, retention, imports that are run again."""

import pytest
from pyspark.sql import functions as F

from stakewell.operators import store
from stakewell.sources.versioned import Conflict, VersionedTable
from stakewell.streaming import imports


def tickets(spark, n, first=0):
    return spark.range(first, first + n).select("id", (F.col("id") % 50).cast("int").alias("odds"), F.lit("win").alias("result"), F.col("id").alias("stake"), F.lit(0).cast("long").alias("payout"), F.lit("x").alias("tail"))


def ids(df):
    return sorted(r.id for r in df.select("id").collect())


def test_an_update_rewrites_only_the_files_of_its_ids(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"))
    table.save(tickets(spark, 150_000))
    before = {r.file for r in table.manifest().collect()}
    changes = spark.createDataFrame([(i, ["result"], "push") for i in range(7, 150_000, 15_000)], "id long, set array<string>, result string")
    assert changes.count() == 10
    done = table.change(changes, lambda rows: store.update(rows, changes, ["result"]))
    assert done.version == 1 and done.rewritten <= 10 and done.looked_at <= 10 and done.kept == len(before) - done.rewritten
    assert len(before & {r.file for r in table.manifest().collect()}) == done.kept
    now = {r.id: r for r in table.read().where("result = 'push'").collect()}
    assert sorted(now) == ids(changes) and all(r.payout == r.stake for r in now.values()) and table.read().count() == 150_000
    assert table.read(0).where("result = 'push'").count() == 0


def test_changes_like_a_plain_dictionary(spark, tmp_path):
    """Inserts, deletes and updates one after another; each version stays readable."""
    table = VersionedTable(spark, str(tmp_path / "t"), buckets=5)
    table.insert(tickets(spark, 40))
    table.insert(tickets(spark, 30, 25))
    table.delete(spark.createDataFrame([(3,), (60,), (999,), (3,)], "id long"))
    table.insert(tickets(spark, 2, 3))  # 3 comes again, 4 is there
    want = [set(range(40)), set(range(55)), set(range(55)) - {3}, set(range(55))]
    assert [ids(table.read(v)) for v in range(4)] == [sorted(w) for w in want]
    empty = table.clear()
    assert ids(table.read()) == [] and ids(table.read(3)) == sorted(want[3]) and empty.kept == 0
    assert table.delete(spark.createDataFrame([(1,)], "id long")).rewritten == 0
    table.insert(tickets(spark, 3))
    assert ids(table.read()) == [0, 1, 2]
    with pytest.raises(ValueError):
        table.read(77)


def test_null_keys_are_kept_and_never_met(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"), buckets=3)
    rows = tickets(spark, 5).unionByName(tickets(spark, 1).withColumn("id", F.lit(None).cast("long")))
    table.save(rows)
    table.delete(spark.createDataFrame([(None,), (2,)], "id long"))
    assert [r.id for r in table.read().orderBy("id").collect()] == [None, 0, 1, 3, 4]


def test_who_comes_second_loses_and_nothing_changes(spark, tmp_path):
    path = str(tmp_path / "t")
    one, two = VersionedTable(spark, path), VersionedTable(spark, path)
    one.save(tickets(spark, 5))
    first = two.latest()
    one.delete(spark.createDataFrame([(1,)], "id long"))
    two.latest = lambda: first  # has not seen the other's version
    with pytest.raises(Conflict):
        two.delete(spark.createDataFrame([(2,)], "id long"))
    del two.latest
    assert ids(two.read()) == [0, 2, 3, 4]
    two.delete(spark.createDataFrame([(2,)], "id long"))  # tried again
    assert ids(one.read()) == [0, 3, 4] and one.sweep() > 0 and ids(one.read(0)) == [0, 1, 2, 3, 4]


def test_buckets_of_many_files_become_one(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"), buckets=2)
    for i in range(6):
        table.insert(tickets(spark, 10, 10 * i))
    done = table.compact(most=3)
    assert done.rewritten == 12 and table.manifest().count() == 2 and ids(table.read()) == list(range(60))
    assert VersionedTable(spark, str(tmp_path / "t"), buckets=9).buckets == 2  # of the table, not of the caller


def test_old_versions_go_beyond_a_budget(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"), buckets=4)
    for i in range(5):
        table.save(tickets(spark, 2000, i))
    size = table.manifest().agg(F.sum("bytes")).first()[0]
    assert table.keep_within(int(2.5 * size)) == [2, 1, 0]
    assert table.versions() == [3, 4] and ids(table.read(3)) == list(range(3, 2003)) and ids(table.read()) == list(range(4, 2004))
    assert table.keep_within(1) == [3] and table.versions() == [4] and table.read().count() == 2000


def test_keyed_import_restarted_and_replayed(spark, tmp_path):
    source = str(tmp_path / "in")
    table = VersionedTable(spark, str(tmp_path / "t"), buckets=32)
    table.save(tickets(spark, 3000))
    for n, first in enumerate((2995, 3000)):
        tickets(spark, 8, first).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(tickets(spark, 1).schema).parquet(source)
        imports.import_keyed(stream, table, str(tmp_path / "cp")).awaitTermination()
        assert table.has_batch("import", n) and not table.has_batch("import", n + 1)
    assert ids(table.read()) == list(range(3008))
    again = table.insert(tickets(spark, 9, 5000), ("import", 1))  # the number of a batch that was committed
    assert again.looked_at == 0 and table.read().count() == 3008
    few = table.insert(tickets(spark, 3, 2990), ("import", 2))
    assert few.looked_at <= 3 * 3 and table.read().count() == 3008  # at most its buckets' files
