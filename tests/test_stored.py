"""Numbered lines, documents of any version, dimensions in time, rules, trigrams: against plain loops and made cases."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from stakewell.operators import history, rules, search
from stakewell.sources import csv_tickets, documents, lines, seed


@pytest.mark.parametrize("block", [64, 1000, 1 << 20])
def test_lines_are_numbered_over_blocks_and_files(spark, tmp_path, block):
    rng = random.Random(block)
    want = {}
    for f in range(3):
        texts = [rng.choice(["", "  ", f"line {i} of {f}", "x" * rng.randrange(90), "same line", "crlf\r"]) for i in range(rng.choice([0, 1, 80, 200]) if f else 150)]
        (tmp_path / f"{f}.txt").write_bytes("".join(t + "\n" for t in texts).encode())
        want[f"{f}.txt"] = texts
    (tmp_path / "open.txt").write_text("a\n\nb")  # no line end at the end
    want["open.txt"] = ["a", "", "b"]
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(block))
    try:
        for blank in (True, False):
            got = {}
            for r in lines.numbered_lines(spark, str(tmp_path), blank).collect():
                got.setdefault(r.file.rpartition("/")[2], {})[r.line_no] = r.value
            for name, texts in want.items():
                kept = [t.replace("\r", "") for t in texts if blank or t.strip()]
                assert got.get(name, {}) == dict(enumerate(kept, 1)), (name, blank)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_csv_rows_have_their_line_in_id_and_error(spark, tmp_path):
    head = "Date,Site,Sport,Type,Name,O/U,Line,Odds,Bet,To Win,Result,Tail,Notes"
    rows = ['1/2/2024,FD,NBA,Pts,"Dame ""D"" Cole, Jr",Over,5.5,+110,"$1,000.50",9.1,won,,', "1/2/2024,FD,NBA,Pts,A,,,-105,10,9,lost,,live bet", "1/2/2024,FD,NBA,Pts,A,,,-105,10,9,lost,,live bet", "", "1/2/2024,FD,NBA,Pts,B,,,x,y,9,lost,,", "1/2/24,DK,NBA,Pts,C,,,100,5,,push"]
    (tmp_path / "one.csv").write_text("\n".join([head, *rows]))
    (tmp_path / "two.csv").write_text("\n".join([head, rows[1]]))
    read = csv_tickets.read_numbered(spark, str(tmp_path))
    got = {r.id: r for r in csv_tickets.numbered_tickets(read, seed.sites(spark)).collect()}
    assert sorted(got) == ["DraftKings-csv-one.csv-6", "FanDuel-csv-one.csv-2", "FanDuel-csv-one.csv-3", "FanDuel-csv-one.csv-4", "FanDuel-csv-one.csv-5", "FanDuel-csv-two.csv-2"]
    first = got["FanDuel-csv-one.csv-2"]
    assert (first.name, float(first.stake), first.odds, first.ou, first.error, first.market_category) == ('Dame "D" Cole, Jr', 1000.5, 110, "Over", None, "Props")
    assert got["FanDuel-csv-one.csv-5"].error == "Row 5: Invalid number format for Odds, Bet." and got["DraftKings-csv-one.csv-6"].error == "Row 6: Invalid number format for To Win."
    assert got["FanDuel-csv-one.csv-3"].is_live
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "x.csv").write_text("Date,Site\n1,2\n")
    with pytest.raises(ValueError, match="Sport, Type, Name, Odds"):
        csv_tickets.read_numbered(spark, str(tmp_path / "bad"))


def test_documents_of_any_version(spark):
    bet = {"id": "a", "stake": 5, "later": {"field": [1]}}
    cases = {
        "list": ([bet, bet], "upgraded", 0, 2), "old": ({"version": 0, "updatedAt": "t", "bets": [bet]}, "upgraded", 0, 1), "ok": ({"version": 1, "updatedAt": "t", "bets": []}, "ok", 1, 0), "more": ({"version": 1, "updatedAt": "t", "bets": [bet], "new": 1}, "ok", 1, 1),
        "newer": ({"version": 2, "updatedAt": "t", "bets": [bet]}, "newer", 2, 0), "no stake": ({"version": 1, "updatedAt": "t", "bets": [bet, {"id": "b"}]}, "shape", 1, 0), "no date": ({"version": 1, "bets": [bet]}, "shape", 1, 0), "word": ("text", "shape", None, 0), "bets": ({"version": 1, "updatedAt": "t", "bets": 5}, "shape", 1, 0),
    }
    rows = [(k, json.dumps(v[0])) for k, v in cases.items()] + [("cut", '{"version": 1, "bets": ['), ("none", None), ("blank", "  ")]
    read = documents.read_documents(spark.createDataFrame(rows, "name string, value string"))
    got = {r.name: (r.status, r.was) for r in read.select("name", "status", "was").collect()}
    assert got == {k: (v[1], v[2]) for k, v in cases.items()} | {"cut": ("corrupt", None), "none": ("missing", None), "blank": ("missing", None)}
    bets = documents.tickets_of(read, stake="stake:int", deep="later.field:array<int>").groupBy("name").agg(F.count("*").alias("n"), F.max("stake").alias("s"), F.first("deep").alias("d")).collect()
    assert {r.name: (r.n, r.s, r.d) for r in bets} == {k: (v[3], 5, [1]) for k, v in cases.items() if v[3]}


def test_a_chain_of_upgrades(spark):
    """Each step once, from the version found; a version without a step passes."""
    steps = documents.UPGRADES | {1: lambda t: F.replace(t, F.lit('"odds"'), F.lit('"price"')), 3: lambda t: F.replace(t, F.lit('"price"'), F.lit('"american"'))}
    bet = [{"id": 1, "stake": 1, "odds": 7}]
    rows = [("list", json.dumps(bet))] + [(f"v{v}", json.dumps({"version": v, "updatedAt": "t", "bets": bet})) for v in range(1, 6)]
    read = documents.read_documents(spark.createDataFrame(rows, "name string, value string"), present=4, upgrades=steps)
    got = {r.name: (r.status, r.odds, r.price, r.american) for r in documents.tickets_of(read, odds="odds:int", price="price:int", american="american:int").collect()}
    assert got == {"list": ("upgraded", None, None, 7), "v1": ("upgraded", None, None, 7), "v2": ("upgraded", 7, None, None), "v3": ("upgraded", 7, None, None), "v4": ("ok", 7, None, None)}


def test_as_of_like_a_loop(spark):
    rng = random.Random(3)
    day = lambda: dt.datetime(2024, 1, 1 + rng.randrange(20))
    edits = [(rng.choice("abc"), day(), i, rng.choice([None, f"v{i}"])) for i in range(40)]
    rows = [(i, rng.choice(["a", "a", "a", "b", "d", None]), day()) for i in range(200)]
    frame, changes = spark.createDataFrame(rows, "id int, k string, t timestamp"), spark.createDataFrame(edits, "k string, at timestamp, seq int, value string")
    got = {r.id: r.value for r in history.as_of(frame, changes, "k", "t", "k", "at", "seq", ["value"]).collect()}
    for i, k, t in rows:
        known = sorted((e[1], e[2], e[3] or "") for e in edits if e[0] == k and e[1] <= t)
        assert got[i] == ((known[-1][2] or None) if known else None)
    spans = history.valid_spans(changes, "k", "at", "seq").collect()
    for r in spans:
        later = sorted((e[1], e[2]) for e in edits if e[0] == r.k and (e[1], e[2]) > (r["at"], r.seq))
        assert r.valid_from == r["at"] and r.valid_to == (later[0][0] if later else None)
    moment = dt.datetime(2024, 1, 10)
    snap = {r.k: r.seq for r in history.snapshot(changes, "k", "at", "seq", moment).collect()}
    assert snap == {k: max((e[1], e[2]) for e in edits if e[0] == k and e[1] <= moment)[1] for k in "abc" if any(e[0] == k and e[1] <= moment for e in edits)}


def test_rules_like_a_chain(spark):
    rng = random.Random(4)
    words = ["points", "PTS", "Reb", "rebounds", "assists", "ast", "stl", "steals", "blk", "blocks", "first fg", "top pts", "to", "threes", "3 pointers", "double double", "triple double", "+", "and", "yards", "x"]
    texts = [" ".join(rng.sample(words, rng.randrange(1, 4))) for _ in range(300)] + ["", "a", "  ", "12", "Over 5", "to"]
    frame = spark.createDataFrame([(t,) for t in texts] + [(None,)], "market string")
    got = {r.market: r.kind for r in rules.market_texts(frame, rules.market_rules(spark)).collect()}
    for t in texts:
        low = "".join(" ".join(t.split()).replace("3 ", "").split("Over 5")).strip().lower()
        hit = [code for code, sets in rules.MARKET_RULES if any(all(p in low for p in parts) for parts in sets)]
        if hit:
            assert got[t] == hit[0], t
    assert got[None] == "" and got["a"] == "a" and got["12"] == "12" and got["x" if "x" in got else "a"] in ("x", "a")


@pytest.mark.parametrize("term", ["ab", "A", "abc", "bcab", " b", "ca ", "zzz", "", "é"])
def test_indexed_search_like_a_scan(spark, term):
    rng = random.Random(5)
    rows = [(i, "".join(rng.choices("abcABC é", k=rng.randrange(6))) if i % 9 else None, rng.choice(["abcab", "x", None])) for i in range(200)]
    frame = spark.createDataFrame(rows, "id int, a string, b string")
    got = sorted(r.id for r in search.search(frame, term, {c: search.trigram_index(frame, c) for c in "ab"}).collect())
    q = term.strip().lower()
    assert got == [i for i, a, b in rows if any(x and q in x.lower() for x in (a, b))]


def test_a_lookup_reads_few_rows_of_the_index(spark):
    names = spark.range(20_000).select(F.concat(F.lit("name "), F.conv("id", 10, 36)).alias("n"))
    index = search.trigram_index(names, "n")
    found = search.found_values(index, "zebra")
    assert found.count() == 0
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(piece, [ebr,bra,zeb])" in plan or "In(piece" in plan
    asked = index.where(F.col("piece").isin("zeb", "ebr", "bra")).count()
    assert asked < 100 < index.count()
