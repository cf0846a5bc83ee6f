"""More named queries over tickets: legs in groups, resolved teams, suggestions, the queue, edits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import money, text
from ..operators import aggregate, legs as leg_ops, resolve, rows, validate
from ..sources import seed
from ..sources.adapter import grouped, legs, tickets
from .wagers import COUNTS, ROI, ROWS_SQL, by, query, rounded

#: What the names of the adapter resolve to; names of two teams and unknown ones resolve to nothing.
TEAM_SQL = "CASE trim(name) WHEN 'PHO Suns' THEN 'Phoenix Suns' WHEN 'lakers' THEN 'Los Angeles Lakers' WHEN 'Suns PHO' THEN 'Phoenix Suns' WHEN 'Los Angeles  Chargers' THEN 'Los Angeles Chargers' WHEN 'NE' THEN 'New England Patriots' WHEN 'Giants' THEN 'New York Giants' WHEN 'Bos Celtics' THEN 'Boston Celtics' WHEN 'GS' THEN 'Golden State Warriors' ELSE '[Unresolved]' END"


# ---- figures


@query("WITH p AS (SELECT * FROM kpi WHERE parlay) " + by("book", "p"))
def agg_parlay_by_book(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(aggregate.stats_by(tickets(spark, sf_dir).filter(money.is_parlay()), F.col("book")), "roi")


@query("WITH p AS (SELECT * FROM kpi WHERE parlay) " + by("sport", "p"))
def agg_parlay_by_sport(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(aggregate.stats_by(tickets(spark, sf_dir).filter(money.is_parlay()), F.col("sport")), "roi")


@query(
    f"WITH t AS (SELECT id, result, stake, net, {TEAM_SQL} AS name FROM kpi WHERE NOT parlay AND name IS NOT NULL) "
    f"SELECT name, count(*)::BIGINT AS tickets, {COUNTS}, sum(stake)::BIGINT AS stake, sum(net)::BIGINT AS net, " + ROI.format(s="sum(stake)", n="sum(net)") + " FROM t GROUP BY name"
)
def agg_by_team(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By the team that a ticket's name resolves to; all that resolve to no one team are one row."""
    bets = tickets(spark, sf_dir).filter(F.col("name").isNotNull() & ~money.is_parlay()).select("name", "bet_type", "result", "stake", "payout")
    named = resolve.resolve_teams(bets, seed.teams(spark))
    return rounded(aggregate.named_stats(named, resolve.aggregation_key(F.col("canonical"), F.col("status"))), "roi")


@query("SELECT DISTINCT entity FROM legs WHERE contains(lower(entity), 'red') ORDER BY entity LIMIT 10", True)
def lim_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first ten names that hold a text."""
    return legs(spark, sf_dir).select("entity").distinct().filter(F.lower("entity").contains("red")).orderBy("entity").limit(10)


@query("SELECT market AS value FROM legs UNION SELECT type FROM bets WHERE type <> '' UNION SELECT tail FROM bets WHERE tail <> ''", True)
def set_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct markets, types and tails in one list."""
    bets = tickets(spark, sf_dir)
    parts = [legs(spark, sf_dir).select(F.col("market").alias("value")), bets.select(F.col("type").alias("value")), bets.select(F.col("tail").alias("value"))]
    return parts[0].distinct().union(parts[1].distinct()).union(parts[2].distinct()).filter("value <> ''").distinct()


# ---- legs in groups


@query("SELECT id, CASE WHEN bet_type = 'sgp_plus' THEN leg_no // 2 ELSE leg_no END::INTEGER AS parent, CASE WHEN bet_type = 'sgp_plus' THEN leg_no % 2 END::INTEGER AS child, entity AS leg_name, market FROM bets JOIN legs USING (id)", True)
def prj_visible_legs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leg_ops.visible_legs(grouped(spark, sf_dir)).select("id", "parent", "child", F.get("leg.entities", F.lit(0)).alias("leg_name"), "leg.market")


@query(ROWS_SQL, True)
def prj_final_rows_of_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups give their children, so the rows are those of the flat legs."""
    return rows.final_rows(grouped(spark, sf_dir))


@query(
    "WITH g AS (SELECT id, (leg_no // 2)::INTEGER AS parent, list(leg_result) AS r FROM bets JOIN legs USING (id) WHERE bet_type = 'sgp_plus' GROUP BY 1, 2) "
    "SELECT id, parent, CASE WHEN list_contains(r, 'LOSS') THEN 'LOSS' WHEN list_contains(r, 'PENDING') THEN 'PENDING' WHEN list_contains(r, 'PUSH') THEN 'PUSH' ELSE 'WIN' END AS push_needs_one, "
    "CASE WHEN list_contains(r, 'LOSS') THEN 'LOSS' WHEN list_contains(r, 'PENDING') THEN 'PENDING' WHEN list_contains(r, 'WIN') THEN 'WIN' ELSE 'PUSH' END AS push_needs_all FROM g",
    True,
)
def n_group_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The outcome of a group of legs, as either sportsbook has it."""
    groups = grouped(spark, sf_dir).filter("bet_type = 'sgp_plus'").select("id", F.posexplode("legs").alias("parent", "leg"))
    results = F.transform("leg.children", lambda c: c["result"])
    return groups.select("id", "parent", money.group_result(results, False).alias("push_needs_one"), money.group_result(results, True).alias("push_needs_all"))


# ---- teams of one sport


IN_SPORT = {"PHO Suns": ("Phoenix Suns", None), "Hawks": ("Atlanta Hawks", "Seattle Seahawks"), "lakers": ("Los Angeles Lakers", None), "Suns PHO": ("Phoenix Suns", None), "ATL": ("Atlanta Hawks", "Atlanta Falcons"), "Los Angeles  Chargers": (None, "Los Angeles Chargers"), "NE": (None, "New England Patriots"), "Giants": (None, "New York Giants"), "Bos Celtics": ("Boston Celtics", None), "GS": ("Golden State Warriors", None)}
IN_SPORT_SQL = "CASE " + " ".join(f"WHEN trim(name) = '{n}' AND league = '{s}' THEN '{c}'" for n, both in IN_SPORT.items() for s, c in zip(("NBA", "NFL"), both) if c) + " END"


@query(f"WITH l AS (SELECT id, name, CASE WHEN id % 5 < 3 THEN 'NBA' ELSE 'NFL' END AS league FROM bets), f AS (SELECT *, {IN_SPORT_SQL} AS found FROM l) SELECT id, name, league, COALESCE(found, trim(name)) AS canonical, CASE WHEN found IS NULL THEN 'unresolved' ELSE 'resolved' END AS status FROM f")
def res_teams_in_sport(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = tickets(spark, sf_dir).select("id", "name", F.when(F.col("id") % 5 < 3, "NBA").otherwise("NFL").alias("league"))
    return resolve.resolve_teams_in_sport(named, seed.teams(spark), sport="league").select("id", "name", "league", "canonical", "status")


# ---- edits and the queue


ODD_SQL = "SELECT id, bet_type, stake, n_legs, CASE WHEN id % 11 <> 0 THEN description END AS description, CASE WHEN id % 17 = 0 THEN NULL WHEN id % 13 = 0 THEN 'Odd' ELSE market_category END AS market_category FROM bets"
CONTRACT_SQL = (
    "list_filter([CASE WHEN description IS NULL THEN 'no description' END, CASE WHEN stake <= 0 THEN 'stake' END, CASE WHEN market_category = 'Odd' THEN 'market_category' END, CASE WHEN n_legs = 0 THEN 'legs' END], lambda x: x IS NOT NULL) AS errors, "
    "list_filter([CASE WHEN market_category IS NULL THEN 'no market_category' END, CASE WHEN bet_type = 'single' AND n_legs > 1 THEN 'single' END], lambda x: x IS NOT NULL) AS warnings"
)


def _parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tickets as a careless parser might give them."""
    category = F.when(F.col("id") % 17 == 0, F.lit(None)).when(F.col("id") % 13 == 0, F.lit("Odd")).otherwise(F.col("market_category"))
    return grouped(spark, sf_dir).withColumns({"bet_id": F.col("id").cast("string"), "description": F.when(F.col("id") % 11 != 0, F.col("description")), "market_category": category})


# The groups of SGP+ tickets have no entity type, which is a warning for each.
@query(f"WITH o AS ({ODD_SQL}), c AS (SELECT id, bet_type, n_legs, {CONTRACT_SQL} FROM o) SELECT id, array_to_string(errors, ',') AS errors, array_to_string(list_concat(warnings, CASE WHEN bet_type = 'sgp_plus' THEN list_transform(range((n_legs + 1) // 2), lambda i: 'leg ' || i || ' no entity_type') ELSE [] END), ',') AS warnings FROM c")
def flt_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.contract(_parsed(spark, sf_dir)).select("id", F.concat_ws(",", "errors").alias("errors"), F.concat_ws(",", "warnings").alias("warnings"))


@query(f"WITH o AS ({ODD_SQL}), c AS (SELECT bet_type, n_legs, {CONTRACT_SQL} FROM o) SELECT count(*)::BIGINT AS total, count_if(len(errors) = 0)::BIGINT AS valid, count_if(len(errors) > 0)::BIGINT AS invalid, sum(len(errors))::BIGINT AS errors, sum(len(warnings) + CASE WHEN bet_type = 'sgp_plus' THEN (n_legs + 1) // 2 ELSE 0 END)::BIGINT AS warnings FROM c")
def agg_contract_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.contract_summary(validate.contract(_parsed(spark, sf_dir)))


@query(
    "WITH e AS (SELECT id, CASE WHEN id % 9 = 0 THEN 0 ELSE stake END AS stake, odds * 30 AS odds FROM bets) "
    "SELECT id, array_to_string(list_filter([CASE WHEN stake <= 0 THEN 'stake' END, CASE WHEN abs(odds) > 10000 THEN 'odds' END], lambda x: x IS NOT NULL), ',') AS errors FROM e"
)
def flt_edit_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edits that take the stake of some tickets away and make odds thirty times as long."""
    edits = tickets(spark, sf_dir).withColumns({"stake": F.when(F.col("id") % 9 == 0, F.lit(0)).otherwise(F.col("stake")), "odds": F.col("odds") * 30})
    return edits.select("id", F.concat_ws(",", validate.edit_errors()).alias("errors"))


@query("SELECT lower(entity) || '::' || id || '::' || leg_no AS item_id, entity AS raw_value FROM legs WHERE leg_result = 'PENDING' AND leg_no % 2 = 1", True)
def jn_queue_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of open legs that the queue (every other leg) doesn't have."""
    items = legs(spark, sf_dir).filter("leg_result = 'PENDING'").select(text.queue_id(F.col("entity"), F.col("id"), F.col("leg_no")).alias("item_id"), F.col("entity").alias("raw_value"), "leg_no")
    return items.join(items.filter("leg_no % 2 = 0").select("item_id"), "item_id", "left_anti").select("item_id", "raw_value")
