"""Books by a registry, pages from files at once and as a stream, exports and backups."""

import os
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from stakewell.sources import parsers, state

from .test_wagers import CARD, FANDUEL


def put(folder, name, text, at):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text(text)
    os.utime(folder / name, (at, at))


def test_pages_from_files_and_the_registry(spark, tmp_path):
    spark.dataSource.register(parsers.PageFiles)
    put(tmp_path / "DraftKings", "a.html", CARD, 100)
    put(tmp_path / "FanDuel", "b.html", FANDUEL, 200)
    put(tmp_path / "Other", "c.html", "<p>", 300)
    put(tmp_path / "DraftKings", "d.htm", "<p>none</p>", 400)
    put(tmp_path / "DraftKings", "notes.txt", "no page", 500)
    pages = spark.read.format("betting_pages").option("path", str(tmp_path)).option("taskBytes", "10").load()
    assert pages.count() == 4 and pages.rdd.getNumPartitions() == 4
    tickets, outcomes = parsers.parse(pages)
    assert sorted((r.book, r.bet_id, float(r.stake), r.result) for r in tickets.collect()) == [("DraftKings", "Q1", 20.0, "win"), ("FanDuel", "O/7700001/0000042", 5.0, "win")]
    names = {r.page_id: r.path.rpartition("/")[2] for r in pages.select("page_id", "path").collect()}
    assert {names[r.page_id]: r.error_code for r in outcomes.collect()} == {"a.html": None, "b.html": None, "c.html": "PARSER_NOT_AVAILABLE", "d.htm": "NO_BETS_FOUND"}
    only = {**parsers.PARSERS, "FanDuel": parsers.Parser(parsers.PARSERS["FanDuel"].tickets, False, "in_progress")}
    assert parsers.enabled(only) == ["DraftKings"]
    tickets, outcomes = parsers.parse(pages, only)
    assert tickets.count() == 1 and outcomes.where("error_code = 'PARSER_NOT_AVAILABLE'").count() == 2
    with pytest.raises(ValueError):
        parsers.parse(pages, {})


def test_pages_as_a_stream_go_on_where_they_stopped(spark, tmp_path):
    spark.dataSource.register(parsers.PageFiles)
    source, out = tmp_path / "in", str(tmp_path / "out")

    def run():
        stream = spark.readStream.format("betting_pages").option("path", str(source)).load()
        stream.select("path", "book", F.length("html").alias("n")).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
        return sorted((r.path.rpartition("/")[2], r.n) for r in spark.read.parquet(out).collect())

    put(source / "FanDuel", "a.html", "aa", 100)
    put(source / "FanDuel", "b.html", "b", 200)
    assert run() == [("a.html", 2), ("b.html", 1)]
    assert run() == [("a.html", 2), ("b.html", 1)]
    put(source / "DraftKings", "c.html", "ccc", 300)
    put(source / "FanDuel", "a.html", "aaaa", 400)  # a page that has changed is read again
    assert run() == [("a.html", 2), ("a.html", 4), ("b.html", 1), ("c.html", 3)]


def test_backups_beyond_a_budget_go(spark, tmp_path):
    for n, (size, at) in enumerate(((100, 10), (50, 20), (30, 30), (40, 40))):
        for part in range(2):
            put(tmp_path / f"backup-{n}" / "bets", f"part-{part}", "x" * size, at)
    found = {r.name: r.bytes for r in state.backups(spark, str(tmp_path)).collect()}
    assert found == {"backup-0": 200, "backup-1": 100, "backup-2": 60, "backup-3": 80}
    assert state.keep_within(spark, str(tmp_path), 150) == ["backup-0", "backup-1"]
    assert sorted(os.listdir(tmp_path)) == ["backup-2", "backup-3"]
    assert state.keep_within(spark, str(tmp_path), 1) == ["backup-2"] and state.keep_within(spark, str(tmp_path), 1) == []


def test_strings_are_quoted_and_numbers_are_not(spark, tmp_path):
    rows = spark.createDataFrame([("a", 'say "x", y', Decimal("1.50"), True, [1], None), (None, "", None, False, None, "raw")], "id string, name string, stake decimal(18,2), is_live boolean, legs array<int>, raw string")
    state.write_csv_lines(rows.coalesce(1), str(tmp_path / "out"))
    assert [r.value for r in spark.read.text(str(tmp_path / "out")).collect()] == ["id,name,stake,is_live", '"a","say ""x"", y",1.50,true', ',"",,false']
    state.write_csv_lines(rows.limit(0), str(tmp_path / "none"))
    assert [r.value for r in spark.read.text(str(tmp_path / "none")).collect()] == ["id,name,stake,is_live"]
