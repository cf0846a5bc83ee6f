"""The wager operators: every named query against its SQL, and hand-made cases."""

import os
import sys
from decimal import Decimal

import duckdb
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from stakewell.functions import classify, filters, formats, money, text
from stakewell.operators import aggregate, legs, resolve, rows, store, timeseries, validate
from stakewell.plans import wagers
from stakewell.sources import csv_tickets, pages, seed, state
from stakewell.streaming import imports

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(wagers.QUERIES))
def test_query_equals_sql(spark, duck, name):
    got = wagers.QUERIES[name](spark, SF)
    want = duck.sql(wagers.ORACLE[name]).to_arrow_table()
    columns = sorted(got.columns)
    assert sorted(want.column_names) == columns
    mine = got.toArrow()
    rows = lambda t: sorted(map(repr, zip(*[t[c].to_pylist() for c in columns])))
    assert rows(mine) == rows(want)


def bets_of(spark, rows):
    return spark.createDataFrame(rows, "id long, bet_type string, result string, stake decimal(18,2), payout decimal(18,2), is_live boolean, name string")


#: Tickets of our own, worked out by hand: type, result, stake, payout.
EDGES = [("single", "win", 40, 76), ("single", "loss", 25, 0), ("single", "push", 30, 30), ("single", "pending", 15, 0), ("parlay", "loss", 8, 0), ("sgp", "win", 4, 46), ("sgp_plus", "win", 6, 21), ("parlay", "pending", 9, 0), ("single", "win", 12, 20)]


def test_edge_tickets_total(spark):
    bets = bets_of(spark, [(i, t, r, Decimal(s), Decimal(p), i == 8, None) for i, (t, r, s, p) in enumerate(EDGES)])
    got = aggregate.overall_stats(bets).first()
    assert (got.total_bets, got.total_wagered, got.net_profit, got.wins, got.losses, got.pushes, got.pendings) == (9, 149, 68, 4, 2, 1, 2)
    assert round(float(got.roi), 2) == 45.64 and round(got.win_rate, 2) == 66.67
    assert {r.name: r["count"] for r in aggregate.live_or_before(bets).collect()} == {"live": 1, "pre": 8}
    none = aggregate.overall_stats(bets.limit(0)).first()
    assert none.total_bets == 0 and none.net_profit == 0 and none.roi == 0
    assert [r["count"] for r in aggregate.over_under(bets.limit(0), spark.createDataFrame([], "id long, ou string")).collect()] == [0, 0]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from(["single", "parlay", "sgp"]), st.sampled_from(["win", "loss", "push", "pending"]), st.integers(0, 500), st.integers(0, 900), st.sampled_from(["a", "b", "c"])), min_size=1, max_size=30))
def test_sums_by_key_are_the_total(spark, rows):
    bets = bets_of(spark, [(i, t, r, Decimal(s), Decimal(p), None, n) for i, (t, r, s, p, n) in enumerate(rows)]).withColumn("placed_at", F.timestamp_seconds(F.col("id") % 5 * 86_400))
    total = aggregate.overall_stats(bets).first()
    parts = aggregate.stats_by(bets, F.col("name")).agg(F.sum("net").alias("n"), F.sum("count").alias("c"), F.sum("stake").alias("s")).first()
    assert (parts.n, parts.c, parts.s) == (total.net_profit, total.total_bets, total.total_wagered)
    last = timeseries.cumulative(bets, money.net()).orderBy(F.desc("placed_at"), F.desc("id")).first()
    assert last.running == total.net_profit


def one(spark, column, **values):
    frame = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return frame.select(column.alias("x")).first().x


def test_money(spark):
    assert one(spark, money.decimal_odds("odds"), odds=150) == 2.5 and one(spark, money.decimal_odds("odds"), odds=-200) == 1.5
    assert one(spark, money.profit(), stake=10, odds=-200) == 5 and one(spark, money.profit(), stake=0, odds=100) == 0
    assert one(spark, money.row_net(), result="win", stake=10, odds=0, payout=0) is None
    assert one(spark, money.net(), result="loss", stake=10, payout=3) == -7 and one(spark, money.row_net(), result="loss", stake=10, odds=1, payout=3) == -10
    assert one(spark, money.merged_result(F.lit("push"), F.lit("win"))) == "win" and one(spark, money.merged_result(F.lit("loss"), F.lit("pending"))) == "loss"
    assert one(spark, money.merged_odds(F.lit(0), F.lit(120))) == 120
    win_push = F.array(F.lit("WIN"), F.lit("PUSH"))
    assert one(spark, money.group_result(win_push, True)) == "WIN" and one(spark, money.group_result(win_push, False)) == "PUSH"
    h = one(spark, money.hedge(F.lit(10.0), F.lit(60.0), F.lit(-150)))
    assert h.advice == "strong" and abs(h.guaranteed - 14) < 1e-9
    assert one(spark, money.hedge(F.lit(10.0), F.lit(60.0), F.lit(0))) is None


def test_text_and_dates(spark):
    assert one(spark, text.lookup_key(F.lit("  O’Neal  ﬁve – X "))) == "o'neal five - x"
    assert one(spark, text.future_entity(F.lit("Lakers to win NBA Finals"))) == "Lakers"
    assert one(spark, text.future_entity(F.lit("x" * 50))) == "x" * 40 + "…"
    assert one(spark, text.amount(F.lit("$1,234.50"))) == 1234.5 and one(spark, text.amount(F.lit("abc"))) is None
    assert one(spark, text.american_odds(F.lit("−110"))) == -110
    assert one(spark, formats.odds(F.lit(-110.5))) == "-110" and one(spark, formats.odds(F.lit(0))) == ""
    assert one(spark, formats.currency(F.lit(-1234.5))) == "-$1,234.50"
    assert str(one(spark, formats.user_date(F.lit("2/29/24"), F.lit(2020)))) == "2024-02-29 12:00:00" and one(spark, formats.user_date(F.lit("2/30"), F.lit(2024))) is None
    assert str(one(spark, formats.fanduel_date(F.lit("PLACED: 2/3/2026 6:40PM ET")))) == "2026-02-03 23:40:00"
    score = lambda q: one(spark, text.match_score(q, F.lit("Pts"), F.lit("Points"), F.array(F.lit("Total Points"))))
    assert [score(q) for q in ("pts", "points", "total points", "po", "tot", "oint", "zzz", " ")] == [100, 90, 80, 70, 60, 10, 0, 100]


def test_classification(spark):
    cat = lambda d, t="single", n=None, team=False: one(spark, classify.ticket_category(F.lit(t), F.lit(d), F.lit(n).cast("string"), F.lit(None).cast("string"), F.lit(team)))
    assert cat("Lakers MVP") == "Futures" and cat("x", "sgp") == "Parlays" and cat("widespread", n="LeBron James") == "Props"
    assert cat("Lakers -7.5", n="Lakers", team=True) == "Main Markets" and cat("Over 25.5 Passing Yards") == "Props" and cat("") == "Main Markets"
    assert one(spark, classify.leg_category(F.lit("Turnovers"))) == "Main Markets" and one(spark, classify.leg_category(F.lit("Player Points Total"))) == "Props"


def test_date_filters(spark):
    frame = spark.createDataFrame([(1, "2024-03-31 00:00:00"), (2, "2024-02-29 00:00:00"), (3, "2024-02-28 23:59:59"), (4, None), (5, "2025-01-01 00:00:00")], "id long, t string").select("id", F.to_timestamp("t").alias("placed_at"))
    as_of = F.to_timestamp(F.lit("2024-03-31 00:00:00"))
    ids = lambda c: {r.id for r in frame.filter(c).collect()}
    assert ids(filters.placed_since("1m", as_of)) == {1, 2, 5} and ids(filters.placed_since("all", as_of)) == {1, 2, 3, 4, 5}
    assert ids(filters.placed_between("2024-02-29", "2024-03-31")) == {1, 2, 4} and ids(filters.placed_between(None, None)) == {1, 2, 3, 4, 5}


def test_teams(spark):
    names = spark.createDataFrame([("PHO Suns",), ("suns phx",), ("Hawks",), ("xyz",), (None,), ("",), ("GS Steph Warriors",)], "name string")
    got = {r.name: (r.canonical, r.status) for r in resolve.resolve_teams(names, seed.teams(spark)).collect()}
    assert got["PHO Suns"] == ("Phoenix Suns", "resolved") and got["suns phx"][0] == "Phoenix Suns" and got["Hawks"] == ("Atlanta Hawks", "ambiguous")
    assert got["xyz"] == ("xyz", "unresolved") and got[None][1] == "unresolved" and got["GS Steph Warriors"] == ("Golden State Warriors", "resolved")
    assert len(seed.team_rows()) == 62 and len(seed.bet_type_rows()) == 73


def test_store_changes(spark):
    bets = spark.createDataFrame([(1, "win", 10, 100, 20, "x"), (2, "loss", 10, 100, 0, "y")], "id long, result string, stake long, odds int, payout long, tail string")
    new = spark.createDataFrame([(2, "win", 1, 1, 1, ""), (3, "win", 1, 1, 1, ""), (3, "win", 1, 1, 1, "")], bets.schema)
    assert sorted(r.id for r in store.insert(bets, new).collect()) == [1, 2, 3, 3]
    changes = spark.createDataFrame([(1, ["stake", "tail"], 30, "")], "id long, set array<string>, stake long, tail string")
    got = {r.id: r for r in store.update(bets, changes, ["stake", "tail"]).collect()}
    assert (got[1].stake, got[1].payout, got[1].tail) == (30, 60, None) and got[2].payout == 0 and got[2].tail == "y"
    legs = F.array(*[F.struct(F.lit(m).alias("market"), F.lit("WIN").alias("result")) for m in "ab"])
    assert [x.result for x in one(spark, store.patch_leg(legs, 1, result=F.lit("LOSS")))] == ["WIN", "LOSS"]
    assert store.blank(bets, 3, F.lit(None)).filter("stake = 0 AND result = 'pending'").count() == 3


def test_import_checks(spark):
    rows = [(1, "2024-01-01", 0.0, "win", 100), (2, None, 5.0, "win", 0), (3, "2024-01-01", -1.0, "odd", 5), (None, "2024-01-01", 1.0, "loss", None)]
    frame = spark.createDataFrame(rows, "id long, t string, stake double, result string, odds int").withColumn("placed_at", F.to_timestamp("t"))
    got = [sorted(r.b) for r in frame.select(validate.import_blockers().alias("b")).collect()]
    assert got == [[], ["net", "odds", "placed_at"], ["net", "result", "stake"], ["id"]]


def test_csv(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text('Date,Site,Sport,Type,Name,O/U,Line,Odds,Bet,To Win,Result,Net,Tail,Notes\n\n1/2/2024,fd,NBA,Pts,"Le ""Bron"", J",Over,25.5,+150,"$1,000.50",$10,Won,,,Live bet\n1/2/24,XX,NBA,Pts,A,,,12abc,5,x,Lost,,t,\n')
    good, bad = csv_tickets.split_errors(csv_tickets.csv_tickets(csv_tickets.read_csv(spark, str(path)), seed.sites(spark)))
    r = good.first()
    assert (r.book, r.name, r.ou, r.odds, r.stake, r.payout, r.result, r.is_live) == ("FanDuel", 'Le "Bron", J', "Over", 150, Decimal("1000.50"), Decimal("1010.50"), "win", True)
    assert bad.first().error == "To Win, Date" and bad.first().odds == 12
    (tmp_path / "u.csv").write_text("a,b\n1,2\n")
    with pytest.raises(ValueError):
        csv_tickets.read_csv(spark, str(tmp_path / "u.csv"))


def test_state(spark, tmp_path):
    cases = {"a": '{"version":1,"updatedAt":"x","bets":[{"id":"1","stake":2.5}]}', "b": '{"version":9,"updatedAt":"x","bets":[]}', "c": '{"version":1,"updatedAt":"x","bets":[{"id":"1"}]}', "d": "{oops"}
    for k, v in cases.items():
        (tmp_path / f"{k}.json").write_text(v)
    got = {k: state.read_state(spark, str(tmp_path / f"{k}.json")).first().status for k in cases}
    assert got == {"a": "ok", "b": "newer", "c": "shape", "d": "corrupt"}
    bets = state.stored_bets(state.read_state(spark, str(tmp_path / "a.json")))
    assert bets.first().stake == Decimal("2.50")
    state.write_backup(bets, str(tmp_path / "backup"), "2024-01-01T00:00:00Z")
    assert spark.read.json(str(tmp_path / "backup/about")).first().stats.totalBets == 1
    state.write_csv(bets, str(tmp_path / "out"))
    assert spark.read.csv(str(tmp_path / "out"), header=True).first().id == "1"


CARD = '<div data-test-id="bet-card-1"><span data-test-id="bet-details-title-1">DEN Nuggets -4.5</span><span data-test-id="bet-details-displayOdds-1">+135</span><span data-test-id="bet-details-subtitle-1">Live Spread</span><div data-test-id="bet-details-status-1">Won</div><span data-test-id="bet-stake-1">Wager: $20.00</span><span data-test-id="bet-returns-1">Paid: $47.00</span><img src="https://x/teams/nba/DEN.png"><span data-test-id="bet-reference-1-0">Jan 5, 2026, 9:03:07 AM</span><span data-test-id="bet-reference-1-1">Q1</span></div>'
ITEM = '<div data-test-id="selection-list-item"><svg aria-label="{icon}"></svg><div data-test-id="bet-selection-title-{n}">{title}</div>{more}</div>'
LEG = '<div data-test-id="bet-selection-subtitle-{n}">{who}</div>'
PARLAY = (
    '<div data-test-id="bet-card-2"><span data-test-id="sgp-extra-2">SGPx</span><span data-test-id="bet-details-title-2">3 Picks Parlay</span><div data-test-id="bet-details-status-2">Lost</div><span data-test-id="bet-stake-2">Wager: $3.00</span><span data-test-id="bet-reference-2-1">Q2</span>'
    + ITEM.format(icon="checkmark icon", n=1, title="12+", more=LEG.format(n=1, who="Marta Ilves Rebounds"))
    + ITEM.format(icon="X sign", n=2, title="2 Pick SGP", more=ITEM.format(icon="X sign", n=3, title="3+", more=LEG.format(n=3, who="Otto Brandt Steals")) + ITEM.format(icon="checkmark", n=4, title="1+", more=LEG.format(n=4, who="Lena Aho Blocks")))
    + "</div>"
)
FANDUEL = '<ul><li><span>Same Game Parlay™</span><span aria-label="Odds +915">+915</span><span>Turku Elks @ Oulu Bears</span><span>Finished</span><span>Ida Novak</span><span>To Record 7+ Rebounds</span><span>Per Lund</span><span>2+ Made Threes</span></li><li><span>$5.00</span><span>TOTAL WAGER</span><span>$50.75</span><span>WON ON FANDUEL</span><span>BET ID: O/7700001/0000042</span><span>PLACED: 2/3/2026 6:40PM ET</span></li></ul>'


def test_pages(spark):
    raw = spark.createDataFrame([(1, "DraftKings", CARD + PARLAY), (2, "FanDuel", FANDUEL), (3, "Other", "<p>"), (4, "DraftKings", " "), (5, "DraftKings", "<p>none</p>")], "page_id long, book string, html string")
    routed = pages.route(raw)
    assert {r.page_id: r.error_code for r in routed.collect()} == {1: None, 2: None, 3: "PARSER_NOT_AVAILABLE", 4: "EMPTY_HTML", 5: None}
    found = pages.fields(routed.filter("error_code IS NULL"))
    dk = {r.id: r for r in pages.draftkings_tickets(found.filter("book = 'DraftKings'")).collect()}
    a, b = dk["Q1"], dk["Q2"]
    assert (a.name, a.line, a.type, a.odds, a.stake, a.payout, a.result, a.bet_type, a.sport, a.is_live, str(a.placed_at)) == ("DEN Nuggets", "-4.5", "Spread", 135, 20, Decimal("47.00"), "win", "single", "NBA", True, "2026-01-05 09:03:07")
    assert b.bet_type == "sgp_plus" and b.result == "loss" and [x.market for x in b.legs] == ["Reb", "2 Pick SGP"]
    assert [(c.entities, c.market, c.target, c.result) for c in b.legs[1].children] == [(["Otto Brandt"], "Stl", "3+", "loss"), (["Lena Aho"], "Blk", "1+", "win")]
    assert b.legs[1].result == "loss" and b.description == "Reb 12+, Stl 3+, Blk 1+"
    fd = pages.fanduel_tickets(found.filter("book = 'FanDuel'")).first()
    assert (fd.bet_id, fd.bet_type, fd.odds, fd.stake, fd.payout, fd.result) == ("O/7700001/0000042", "sgp", 915, 5, Decimal("50.75"), "win")
    assert [(x.entities[0], x.market, x.target) for x in fd.legs] == [("Ida Novak", "Reb", "7+"), ("Per Lund", "3pt", "2+")]
    codes = {r.page_id: r.error_code for r in pages.without_tickets(routed, pages.draftkings_tickets(found.filter("book = 'DraftKings'")).select("page_id").union(pages.fanduel_tickets(found.filter("book = 'FanDuel'")).select("page_id"))).collect()}
    assert codes[5] == "NO_BETS_FOUND" and codes[1] is None


def test_statistics_of_markets(spark):
    said = {"Points + Rebounds + Assists": "PRA", "Points + Rebounds": "PR", "Points + Assists": "PA", "Rebounds + Assists": "RA", "Steals + Blocks": "Stocks", "3 Pointers": "3pt", "Pts": "Pts", "Double Double": "DD", "First FG": "FB", "Money Line": "Moneyline", "Odd": None}
    for market, kind in said.items():
        assert one(spark, pages.stat_type(F.lit(market))) == kind, market


def test_broken_pages_and_row_numbers(spark, tmp_path, monkeypatch):
    def fail(self, data):
        raise AssertionError("broken")

    raw = spark.createDataFrame([(1, "DraftKings", "<!--x")], "page_id long, book string, html string")
    found = pages._listed("DraftKings", None)
    assert found == []
    monkeypatch.setattr(pages._Fields, "feed", fail)
    assert pages._listed("DraftKings", "<p>")[0][2] == "failed"
    failed = spark.createDataFrame([(1, "DraftKings", -1, "", "failed", "AssertionError", 0)], pages.FIELDS)
    codes = pages.without_tickets(pages.route(raw), spark.createDataFrame([], "page_id long"), failed).collect()
    assert codes[0].error_code == "PARSER_FAILED"


def test_stream_import_is_idempotent(spark, tmp_path):
    source, target = tmp_path / "in", str(tmp_path / "store")
    frame = lambda ids: spark.createDataFrame([(i, "b", "win", 10, 20) for i in ids], "id long, book string, result string, stake long, payout long")
    for ids in ([1, 2, 2], [2, 3]):
        frame(ids).coalesce(1).write.mode("append").parquet(str(source))
        imports.import_batches(spark.readStream.schema(frame([1]).schema).parquet(str(source)), target, str(tmp_path / "cp")).awaitTermination()
    assert sorted(r.id for r in spark.read.parquet(target).collect()) == [1, 2, 3]


LEG_FIELDS = "entities array<string>, market string, target string, ou string, odds int, result string"


def test_rows_of_groups_and_placeholders(spark):
    leg = lambda who, market="Points", group=None, children=None: ([who] if who else [], market, "5", "Over", 110, "WIN", group, children)
    leaf = lambda who: ([who], "Points", "5", "Over", 110, "WIN")
    cases = {1: None, 2: [], 3: [leg("a")], 4: [leg(None, "Same Game Parlay"), leg("a")], 5: [leg(None, "2 Pick SGP", True, [leaf("a"), leaf("b")]), leg("c")], 6: [leg(None, "1 Pick SGP", True, [])], 7: [leg(f"p{i}") for i in range(12)]}
    bets = spark.createDataFrame([(i, "sgp_plus", "win", 10, 100, 20, "ticket", "Pts", v) for i, v in cases.items()], f"id long, bet_type string, result string, stake long, odds int, payout long, name string, type string, legs array<struct<{LEG_FIELDS}, is_group_leg boolean, children array<struct<{LEG_FIELDS}>>>>")
    got = {}
    for r in rows.final_rows(bets).orderBy("id", "row_no").collect():
        got.setdefault(r.id, []).append(r.row_name)
    assert got == {1: ["ticket"], 2: ["ticket"], 3: ["a"], 4: ["a"], 5: ["SGP+ (3)", "a", "b", "c"], 7: ["SGP+ (10)", *[f"p{i}" for i in range(10)]]}
    seen = [(r.id, r.parent, r.child, r.leg.entities) for r in legs.visible_legs(bets.filter("id IN (5, 6)")).orderBy("id", "parent", "child").collect()]
    assert seen == [(5, 0, 0, ["a"]), (5, 0, 1, ["b"]), (5, 1, None, ["c"]), (6, 0, None, [])]


def test_repeated_legs_merge(spark):
    a = lambda target, result, odds, who="A": ([who], "Pts", target, None, odds, result)
    cases = {
        1: [a("5+", "PENDING", 0), a("5+", "WIN", 120)],  # equal
        2: [a(None, "WIN", 100), a("5+", "LOSS", None)],  # one of them has a target
        3: [a("5+", "WIN", 1), a("6+", "LOSS", 2)],  # two targets: two legs
        4: [a("5+", "WIN", 1), a("6+", "LOSS", 2), a("", "PENDING", 3)],  # joins the first, which goes to the end
        5: [a("5+", "WIN", 1), a("5+", "LOSS", 2, "B"), a("5+", "PUSH", 3, "a")],
        6: [],
    }
    frame = spark.createDataFrame([(i, v) for i, v in cases.items()], f"id int, legs array<struct<{LEG_FIELDS}>>")
    merged = lambda later: {r.id: [(x.entities[0], x.target, x.result, x.odds) for x in r.x] for r in frame.select("id", legs.merged_legs(F.col("legs"), later).alias("x")).collect()}
    got = merged(False)
    assert got == {1: [("A", "5+", "WIN", 120)], 2: [("A", "5+", "WIN", 100)], 3: [("A", "5+", "WIN", 1), ("A", "6+", "LOSS", 2)], 4: [("A", "6+", "LOSS", 2), ("A", "5+", "WIN", 3)], 5: [("a", "5+", "WIN", 3), ("B", "5+", "LOSS", 2)], 6: []}
    assert merged(True)[1] == [("A", "5+", "WIN", 120)] and merged(True)[2] == [("A", "5+", "LOSS", 100)]


def test_contract(spark):
    leg = (["a"], "Points", "5", None, 110, "win", "robot")
    rows_ = [(None, "b", "1", "single", "NBA", "d", 0, -1, "odd", "Props", [leg, (["a"], None, None, None, None, None, None)]), (1, "b", "1", "parlay", "NBA", "d", 5, 0, "win", None, None)]
    bets = spark.createDataFrame(rows_, f"id long, book string, bet_id string, bet_type string, sport string, description string, stake long, payout long, result string, market_category string, legs array<struct<{LEG_FIELDS}, entity_type string>>").withColumn("placed_at", F.current_timestamp())
    got = validate.contract(bets).collect()
    assert got[0].errors == ["no id", "stake", "payout", "result", "leg 0 entity_type", "leg 1 market"] and got[0].warnings == ["single", "leg 0 result", "leg 1 no entity_type"]
    assert got[1].errors == ["legs"] and got[1].warnings == ["no market_category"]


def test_entry_without_the_extra_folder(spark):
    import __spark_entry__

    assert set(wagers.QUERIES) <= set(__spark_entry__.queries()) and set(wagers.ORACLE) <= set(__spark_entry__.oracle_sql())
    assert __spark_entry__.entry(spark).count() == 1
