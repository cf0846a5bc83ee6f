"""Whole rows, disabled names, issues of imports: cases worked out by hand."""

import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from stakewell.operators import dims, resolve, sheet, store, validate
from stakewell.sources import seed



def rows_of(spark, *bets):
    frame = spark.createDataFrame(bets, "id string, book string, sport string, bet_type string, market_category string, placed_at timestamp_ntz, stake decimal(18,2), payout decimal(18,2), odds int, result string, name string, type string, line string, ou string, tail string, is_live boolean, legs array<struct<entities: array<string>, market: string, target: string, ou: string, odds: double, result: string>>")
    return sheet.sheet_rows(frame, seed.bet_types(spark))


def test_whole_rows(spark):
    day = dt.datetime(2024, 3, 9, 20, 0)
    leg = lambda who, market, target=None, ou=None, odds=None, result="WIN": (who, market, target, ou, odds, result)
    got = rows_of(
        spark,
        ("1", "FD", "NBA", "single", "Main Markets", day, Decimal(10), Decimal(0), -110, "win", "Suns", "Spread", "-3.5", None, "Pat", True, None),
        ("2", "DK", "NBA", "single", "Main Markets", day, Decimal(10), Decimal(25), 150, "win", None, None, None, None, "", False, [leg(["Suns", "Heat"], "Total", "220.5", "Over", 150.0)]),
        ("3", "DK", "NBA", "sgp", "Parlays", None, Decimal(5), Decimal(0), 400, "loss", None, None, None, None, None, None, [leg(["A"], "Points", "10+", None, 0.0), leg(["B"], "Assists", "4", "Under", -120.5, "LOSS"), leg(["C"], None, None, None, 135.0, "VOID")]),
        ("4", "DK", None, "single", None, day, Decimal("0.01"), None, None, "pending", None, None, None, None, None, None, []),
    )
    by_row = {(r.id, r.row_no): r for r in got.collect()}
    one = by_row["1", 0]
    assert (one.date, one.category, one.type, one.name, one.line, one.odds, one.bet, one.to_win, one.net, one.live, one.tail) == ("03/09/24", "Main", "Spread", "Suns", "-3.5", "-110", "10.00", "19.09", "9.09", "1", "1")
    two = by_row["2", 1]
    assert (two.category, two.type, two.name, two.name2, two.over, two.under, two.net, two.raw_net, two.parlay_id, two.leg_index, two.tail) == ("Main Markets", "Total", "Suns", "Heat", "1", "0", "15.00", 15.0, None, None, "")
    head, a, b, c = (by_row["3", i] for i in range(4))
    assert (head.date, head.category, head.type, head.name, head.leg_count, head.odds, head.result, head.net, head.over, head.is_header) == ("", "Parlays", "SGP", "SGP (3)", 3, "+400", "Loss", "-5.00", "", True)
    assert (a.type, a.over, a.under, a.odds, a.raw_odds, a.bet, a.net, a.result, a.leg_index, a.is_child) == ("Pts", "1", "0", "", None, "", "", "Win", 1, True)
    assert (b.type, b.over, b.under, b.odds, b.raw_odds) == ("Ast", "0", "1", "", None)  # odds that are no whole number are none
    assert (c.category, c.type, c.odds, c.result) == ("Props", "", "+135", "Pending")
    four = by_row["4", 0]
    assert (four.category, four.type, four.sport, four.odds, four.bet, four.to_win, four.net, four.result) == ("", "", "", "", "0.01", "", "", "Pending")
    grid = {r.id: r for r in sheet.grid_rows(got).collect()}
    assert set(grid) == {"1", "2", "3", "3-leg-0", "3-leg-1", "3-leg-2", "4"}
    assert (grid["3-leg-1"].bet, grid["3-leg-1"].net, grid["3-leg-1"].ou, grid["3-leg-1"].overall_result, grid["3-leg-1"].result, grid["3-leg-0"].ou) == (0.0, 0.0, "Under", "loss", "loss", "Over")
    assert (grid["1"].tail, grid["2"].tail, grid["1"].to_win, grid["4"].to_win, grid["4"].odds, grid["4"].line) == ("Pat", None, 10 + 1000 / 110, 0.0, None, None)


def test_disabled_names_resolve_to_nobody(spark):
    teams = seed.teams(spark).withColumn("disabled", F.col("canonical") == "Atlanta Hawks")
    names = spark.createDataFrame([("Hawks",), ("ATL",), ("Atlanta Hawks",), ("ATL Hawks",), ("Suns",), (None,)], "name string")
    got = {r.name: (r.canonical, r.status) for r in resolve.resolve_teams(names, teams).collect()}
    assert got["Hawks"] == ("Seattle Seahawks", "resolved") and got["ATL"] == ("Atlanta Falcons", "resolved")  # no longer shared
    assert got["Atlanta Hawks"][1] == "unresolved" and got["ATL Hawks"][0] != "Atlanta Hawks" and got["Suns"][1] == "resolved" and got[None] == (None, "unresolved")
    players = spark.createDataFrame([("1", "Ann Lee", "NBA", ["AL"], None), ("2", "Al Lee", "NBA", ["AL"], True), ("3", "Bo Ek", "NFL", [], True)], "seq string, canonical string, sport string, aliases array<string>, disabled boolean")
    asked = spark.createDataFrame([("al", "NBA"), ("Bo Ek", "NFL"), ("AL LEE", None)], "name string, sport string")
    got = {r.name: (r.canonical, r.status) for r in dims.resolve_players(asked, players).collect()}
    assert got == {"al": ("Ann Lee", "resolved"), "Bo Ek": ("Bo Ek", "unresolved"), "AL LEE": ("AL LEE", "unresolved")}
    types = seed.bet_types(spark).withColumn("disabled", F.col("canonical") == "Pts")
    assert resolve.resolve_bet_types(spark.createDataFrame([("pts", "NBA")], "market string, sport string"), types).first().canonical is None


def test_issues_of_tickets(spark):
    listed = spark.createDataFrame([("Ann Lee", "NBA")], "canonical string, sport string")
    leg = lambda who, market: ([who] if who else [], market)
    cases = {
        1: ("NBA", "single", "Props", "Ann Lee", "Pts", None, []), 2: ("NBA", "single", "Props", "ann lee", None, None, ["player unknown", "type missing"]), 3: ("NBA", "single", "Main Markets", "Hawks", "Spread", None, ["team ambiguous"]),
        4: ("Go", "single", "Main Markets", "Nobody", None, None, ["sport unknown", "team unknown"]), 5: (None, "parlay", "Parlays", None, None, [leg("x", "Points"), leg("y", "Points")], ["sport missing"]), 6: ("NBA", "parlay", "Parlays", None, None, [leg("Suns", "Moneyline")], []), 7: ("NBA", "single", None, None, None, [leg(None, "Points")], []),
    }
    frame = spark.createDataFrame([(i, *c[:6]) for i, c in cases.items()], "id int, sport string, bet_type string, market_category string, name string, type string, legs array<struct<entities: array<string>, market: string>>")
    got = {r.id: r.issues for r in dims.ticket_issues(frame, ["NBA"], seed.teams(spark), listed).collect()}
    assert got == {i: c[6] for i, c in cases.items()}


def test_loading_looks_at_main_markets_again(spark):
    rows = [(1, "single", "Main Markets", "LeBron James", None, "LeBron Over 25.5", None), (2, "single", "Main Markets", "Suns", None, "Suns Moneyline", None), (3, "live", None, "Suns", None, "Suns Moneyline", None), (4, "parlay", "weird", None, None, "x", True), (5, "single", "Props", "Suns", None, "Suns Moneyline", False)]
    frame = spark.createDataFrame(rows, "id int, bet_type string, market_category string, name string, type string, description string, is_live boolean")
    got = {r.id: (r.market_category, r.healed or False, r.is_live) for r in store.loaded(frame, seed.teams(spark)).collect()}
    assert got == {1: ("Props", True, False), 2: ("Main Markets", False, False), 3: ("Main Markets", False, True), 4: ("Parlays", False, True), 5: ("Props", False, False)}


def test_contract_messages_one_a_row(spark):
    checked = spark.createDataFrame([(1, ["a", "b"], []), (2, [], ["c"]), (3, [], [])], "id int, errors array<string>, warnings array<string>")
    assert sorted(tuple(r) for r in validate.contract_messages(checked).collect()) == [(1, "error", "a"), (1, "error", "b"), (2, "warning", "c")]


def test_edits_of_names(spark):
    dim = spark.createDataFrame([("Ann Lee", "NBA", ["AL"], False), ("Bo Ek", "NFL", [], False), ("Cy Oh", "NFL", [], True)], "canonical string, sport string, aliases array<string>, disabled boolean")
    rows = [("ann lee", "rename", None, "Anna Lee", 2), ("Ann Lee", "remove", None, None, 1), ("Bo Ek", "alias", None, "Bobo", 1), ("cy oh", "enable", None, None, 1), ("CY OH", "add", "MLB", None, 0), ("Di Po", "add", "MLB", None, 1)]
    got = {r.canonical: (r.sport, r.aliases, r.disabled) for r in dims.edited(dim, spark.createDataFrame(rows, "canonical string, action string, sport string, alias string, seq int")).collect()}
    assert got == {"Anna Lee": ("NBA", ["AL", "Ann Lee"], False), "Bo Ek": ("NFL", ["Bobo"], False), "Cy Oh": ("NFL", [], False), "Di Po": ("MLB", [], False)}


def test_sport_is_told_by_the_first_leg_that_can(spark):
    leg = lambda market, *who: (list(who), market)
    cases = {1: ([leg("Points", "Nobody", "Suns"), leg("Passing Yards", "x")], None, "NBA"), 2: ([leg(None, "Nobody"), leg("Passing Yards", "x")], "nba night", "NFL"), 3: ([leg("Odd", "x")], "Wimbledon", "Tennis"), 4: ([], None, "Other"), 5: (None, "NHL game", "NHL"), 6: ([leg("Shots", None)], None, "NHL"), 7: ([leg("Shots")], "x", "Other")}
    frame = spark.createDataFrame([(i, c[0], c[1]) for i, c in cases.items()], "id int, legs array<struct<entities: array<string>, market: string>>, description string")
    got = {r.id: r.sport for r in dims.sport_of_legs(frame, seed.teams(spark), seed.bet_types(spark)).collect()}
    assert got == {i: c[2] for i, c in cases.items()}
