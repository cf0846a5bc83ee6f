"""The named queries over tickets, each beside the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import classify, filters, formats, money, text
from ..operators import aggregate, resolve, rows, sheet, store, timeseries, validate
from ..operators.scan import scan
from ..sources import seed
from ..sources.adapter import BETS_SQL, LEGS_SQL, legs, nested, tickets

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
LONGS = ("total_wagered", "net_profit", "stake", "net")


def query(sql: str | None = None, with_legs: bool = False) -> Callable:
    """Registers a query under its function's name; sql goes behind the definitions of bets (and legs)."""

    def register(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            heads = BETS_SQL + (", " + LEGS_SQL if with_legs else "")
            body = sql.strip()
            ORACLE[f.__name__] = f"WITH {heads}, {body[5:]}" if body.startswith("WITH ") else f"WITH {heads} {body}"
        return f

    return register


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


ROI = "round(CASE WHEN {s} > 0 THEN {n}::DOUBLE / {s} * 100 ELSE 0 END, 6) AS roi"
COUNTS = "COALESCE(count_if(result = 'win'), 0)::BIGINT AS wins, COALESCE(count_if(result = 'loss'), 0)::BIGINT AS losses"
OVERALL = (
    "SELECT count(*)::BIGINT AS total_bets, COALESCE(sum(stake), 0)::BIGINT AS total_wagered, COALESCE(sum(net), 0)::BIGINT AS net_profit, " + COUNTS + ", count_if(result = 'push')::BIGINT AS pushes, count_if(result = 'pending')::BIGINT AS pendings, "
    "round(CASE WHEN count_if(result IN ('win', 'loss')) > 0 THEN count_if(result = 'win')::DOUBLE / count_if(result IN ('win', 'loss')) * 100 ELSE 0 END, 6) AS win_rate, "
    "round(CASE WHEN sum(stake) > 0 THEN sum(net)::DOUBLE / sum(stake) * 100 ELSE 0 END, 6) AS roi FROM {rows}"
)


def by(key: str, rows_: str = "kpi") -> str:
    return f"SELECT {key} AS name, count(*)::BIGINT AS count, {COUNTS}, count_if(result = 'push')::BIGINT AS pushes, sum(stake)::BIGINT AS stake, sum(net)::BIGINT AS net, " + ROI.format(s="sum(stake)", n="sum(net)") + f" FROM {rows_} WHERE {key} <> '' GROUP BY 1"


# ---- totals and breakdowns


@query(OVERALL.format(rows="kpi"))
def agg_overall_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(aggregate.overall_stats(tickets(spark, sf_dir)), "win_rate", "roi")


@query(by("book"))
def agg_by_book(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(aggregate.stats_by(tickets(spark, sf_dir), F.col("book")), "roi")


@query(by("replace(market_category, 'Main Markets', 'Main')"))
def agg_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(aggregate.stats_by(tickets(spark, sf_dir), classify.display_category(F.col("market_category"))), "roi")


@query(by("sport"))
def agg_by_sport(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(aggregate.stats_by(tickets(spark, sf_dir), F.col("sport")), "roi")


@query(by("trim(tail)"))
def agg_by_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(aggregate.stats_by(tickets(spark, sf_dir), F.trim("tail")), "roi")


@query(
    "WITH named AS (SELECT DISTINCT k.id, entity AS name, result, stake, net FROM kpi k JOIN legs USING (id) WHERE NOT parlay UNION SELECT id, name, result, stake, net FROM kpi k WHERE NOT parlay AND n_legs = 0) "
    f"SELECT name, count(*)::BIGINT AS tickets, {COUNTS}, sum(stake)::BIGINT AS stake, sum(net)::BIGINT AS net, " + ROI.format(s="sum(stake)", n="sum(net)") + " FROM named WHERE name <> '' GROUP BY name",
    True,
)
def agg_entity_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(aggregate.nested_entity_stats(nested(spark, sf_dir)), "roi")


SIDES = (
    "WITH sides AS (SELECT lower(ou) AS name, k.* EXCLUDE (name) FROM kpi k JOIN legs USING (id) WHERE {where}) SELECT name, count(id)::BIGINT AS count, " + COUNTS + ", COALESCE(sum(stake), 0)::BIGINT AS stake, COALESCE(sum(net), 0)::BIGINT AS net, " + ROI.format(s="sum(stake)", n="sum(net)")
    + " FROM (VALUES ('over'), ('under')) v(name) LEFT JOIN sides USING (name) GROUP BY name"
)


@query(SIDES.format(where="NOT parlay AND ou IS NOT NULL"), True)
def agg_over_under(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(aggregate.nested_over_under(nested(spark, sf_dir)), "roi")


@query(SIDES.format(where="ou IS NOT NULL AND market_category = 'Props' AND entity = 'red widget'"), True)
def agg_over_under_props_of_entity(spark: SparkSession, sf_dir: str) -> DataFrame:
    bets = nested(spark, sf_dir).filter(filters.over_under_market("props"))
    return rounded(aggregate.nested_over_under(bets, parlays=True, entity="red widget"), "roi")


@query("SELECT CASE WHEN is_live THEN 'live' ELSE 'pre' END AS name, count(*)::BIGINT AS count, " + COUNTS + ", sum(stake)::BIGINT AS stake, sum(net)::BIGINT AS net, " + ROI.format(s="sum(stake)", n="sum(net)") + " FROM kpi GROUP BY 1")
def agg_live_vs_pre(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(aggregate.live_or_before(tickets(spark, sf_dir)), "roi")


@query("SELECT " + ", ".join(f"COALESCE(sum(CASE WHEN placed_at >= as_of - INTERVAL {i} THEN net END), 0)::BIGINT AS net_{p}" for p, i in (("1d", "1 DAY"), ("3d", "3 DAY"), ("1w", "7 DAY"), ("1m", "1 MONTH"), ("1y", "1 YEAR"))) + " FROM kpi, (SELECT max(placed_at) AS as_of FROM kpi)")
def agg_quick_net(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregate.quick_net(tickets(spark, sf_dir), F.max("placed_at"))


@query("WITH m AS (SELECT COALESCE(nullif(regexp_extract(market, '\\(([^)]+)\\)$', 1), ''), market) AS market, k.* FROM kpi k JOIN legs USING (id)) " + by("market", "m"), True)
def agg_by_market(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parlays aren't left out: each leg counts the ticket's money."""
    short = F.transform("legs", lambda leg: F.coalesce(classify.in_brackets(leg["market"]), leg["market"]))
    return rounded(aggregate.stats_by(nested(spark, sf_dir), short, many=True), "roi")


@query("WITH m AS (SELECT market, k.* FROM kpi k JOIN legs USING (id) WHERE entity = 'red widget') " + by("market", "m"), True)
def agg_player_markets(spark: SparkSession, sf_dir: str) -> DataFrame:
    mine = F.transform(F.filter("legs", lambda leg: F.array_contains(leg["entities"], "red widget")), lambda leg: leg["market"])
    return rounded(aggregate.stats_by(nested(spark, sf_dir), mine, many=True), "roi")


@query("SELECT count(*)::BIGINT AS total_bets, COALESCE(count_if(result = 'win'), 0) || '-' || COALESCE(count_if(result = 'loss'), 0) || '-' || COALESCE(count_if(result = 'push'), 0) AS record FROM kpi WHERE n_legs <= 1 AND id IN (SELECT id FROM legs WHERE entity = 'red widget')", True)
def agg_player_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = aggregate.overall_stats(nested(spark, sf_dir).filter("n_legs <= 1").filter(filters.has_entity("red widget")))
    return stats.select("total_bets", F.concat_ws("-", "wins", "losses", "pushes").alias("record"))


@query("SELECT book, sport, sum(net)::BIGINT AS profit FROM kpi GROUP BY book, sport")
def agg_sportsbook_profit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tickets(spark, sf_dir).groupBy("book", "sport").agg(F.sum(money.net()).alias("profit"))


@query("WITH p AS (SELECT * FROM kpi WHERE parlay) SELECT o.*, round((SELECT avg(n_legs) FROM p), 6) AS avg_legs FROM (" + OVERALL.format(rows="p") + ") o")
def agg_parlay_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(aggregate.parlay_summary(tickets(spark, sf_dir)), "win_rate", "roi", "avg_legs")


@query("WITH p AS (SELECT *, CASE WHEN n_legs <= 2 THEN '2-leg' WHEN n_legs <= 4 THEN n_legs || '-leg' ELSE '5+ legs' END AS bucket FROM kpi WHERE parlay) " + by("bucket", "p"))
def agg_parlay_by_leg_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(aggregate.stats_by(tickets(spark, sf_dir).filter(money.is_parlay()), aggregate.leg_bucket(F.col("n_legs"))), "roi")


@query("WITH p AS (SELECT *, CASE bet_type WHEN 'sgp' THEN 'SGP' WHEN 'sgp_plus' THEN 'SGP+' ELSE 'Standard Parlay' END AS kind FROM kpi WHERE parlay) " + by("kind", "p"))
def agg_parlay_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(aggregate.stats_by(tickets(spark, sf_dir).filter(money.is_parlay()), aggregate.parlay_name(F.col("bet_type"))), "roi")


EXPOSURE = "count(*)::BIGINT AS count, COALESCE(sum(stake), 0)::BIGINT AS exposure, COALESCE(sum(payout), 0)::BIGINT AS potential, (COALESCE(sum(payout), 0) - COALESCE(sum(stake), 0))::BIGINT AS max_profit FROM kpi WHERE market_category = 'Futures' AND result = 'pending'"


@query("SELECT " + EXPOSURE)
def agg_futures_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregate.futures_exposure(tickets(spark, sf_dir))


@query("SELECT COALESCE(nullif(sport, ''), 'Unknown') AS name, " + EXPOSURE + " GROUP BY 1")
def agg_futures_by_sport(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregate.futures_exposure(tickets(spark, sf_dir), F.coalesce(F.nullif("sport", F.lit("")), F.lit("Unknown")))


ENTITY_SQL = "CASE id % 10 WHEN 0 THEN 'Lakers' WHEN 1 THEN 'Over 220.5 Total Points' WHEN 2 THEN 'Celtics' WHEN 3 THEN 'Warriors' WHEN 4 THEN 'Player rebounds' WHEN 5 THEN 'Chiefs Spread -7.5' WHEN 6 THEN 'Patrick Mahomes' WHEN 7 THEN 'Lakers' WHEN 8 THEN 'Moneyline' ELSE 'An odd market without any of the usual w…' END"


@query(f"SELECT COALESCE(name, {ENTITY_SQL}) AS name, " + EXPOSURE + " GROUP BY 1")
def agg_futures_by_entity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregate.futures_exposure(tickets(spark, sf_dir), F.coalesce("name", text.future_entity(F.col("description"))))


@query("SELECT DISTINCT entity_type, entity FROM legs", True)
def agg_entity_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return legs(spark, sf_dir).select("entity_type", "entity").distinct()


@query("SELECT DISTINCT 'book' AS kind, book AS value FROM bets UNION ALL SELECT DISTINCT 'sport', sport FROM bets")
def agg_distinct_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    bets = tickets(spark, sf_dir)
    return bets.select(F.lit("book").alias("kind"), F.col("book").alias("value")).distinct().union(bets.select(F.lit("sport"), "sport").distinct())


@query("SELECT entity AS name, count(*)::BIGINT AS legs, " + ", ".join(f"count_if(leg_result = '{k.upper()}')::BIGINT AS leg_{k}" for k in ("win", "loss", "push", "pending")) + ", 0::BIGINT AS leg_unknown FROM legs GROUP BY entity", True)
def agg_leg_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregate.leg_accuracy(legs(spark, sf_dir), F.col("entity"))


@query(
    "WITH q AS (SELECT lower(entity) AS lookup_key, entity, entity_type, sport, book, market, placed_at, id * 100 + leg_no AS seq FROM legs JOIN bets USING (id) WHERE leg_result = 'PENDING'), "
    "g AS (SELECT entity_type || '::' || sport || '::' || lookup_key AS group_key, * FROM q), m AS (SELECT group_key, book || '|' || market AS context, min(seq) AS s FROM g GROUP BY ALL), c AS (SELECT group_key, list(context ORDER BY s)[1:3] AS contexts FROM m GROUP BY 1) "
    "SELECT group_key, count(*)::BIGINT AS count, max(placed_at) AS last_seen, arg_min(entity, seq) AS raw_value, array_to_string(any_value(contexts), ';') AS contexts FROM g JOIN c USING (group_key) GROUP BY group_key",
    True,
)
def agg_unresolved_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    queue = legs(spark, sf_dir, "sport", "book", "placed_at").filter("leg_result = 'PENDING'")
    queue = queue.select(text.lookup_key("entity").alias("lookup_key"), F.col("entity").alias("raw_value"), "entity_type", "sport", "book", "market", F.col("placed_at").alias("encountered_at"), (F.col("id") * 100 + F.col("leg_no")).alias("seq"))
    return aggregate.unresolved_groups(queue).withColumn("contexts", F.concat_ws(";", F.transform("contexts", lambda c: F.concat_ws("|", c["book"], c["market"]))))


# ---- running sums and latest


@query("SELECT id, placed_at, net AS amount, (sum(net) OVER (ORDER BY placed_at, id ROWS UNBOUNDED PRECEDING))::BIGINT AS running FROM kpi")
def win_cumulative_profit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeseries.cumulative(tickets(spark, sf_dir), money.net())


@query("SELECT id, placed_at, stake AS amount, (sum(stake) OVER (ORDER BY placed_at, id ROWS UNBOUNDED PRECEDING))::BIGINT AS running FROM kpi")
def win_cumulative_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeseries.cumulative(tickets(spark, sf_dir), F.col("stake"))


@query("SELECT id, placed_at, book, net FROM kpi ORDER BY placed_at DESC, id DESC LIMIT 10")
def win_recent_bets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A top-10 report."""
    return timeseries.latest(tickets(spark, sf_dir)).select("id", "placed_at", "book", money.net().alias("net"))


@query(
    "WITH t AS (SELECT id, placed_at, epoch_us(placed_at) AS t, lag(epoch_us(placed_at)) OVER w AS b, lead(epoch_us(placed_at)) OVER w AS a FROM bets WINDOW w AS (PARTITION BY book, sport ORDER BY placed_at, id)) "
    "SELECT id, make_timestamp(COALESCE((t + b) // 2000 * 1000, t - 1000000)) AS insert_before, make_timestamp(COALESCE((t + a) // 2000 * 1000, t + 1000000)) AS insert_after FROM t"
)
def win_midpoint_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = timeseries.midpoint(tickets(spark, sf_dir), ["book", "sport"])
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("insert_before", "insert_after")})


@query(
    "WITH t AS (SELECT id, epoch_us(placed_at) AS t, lag(epoch_us(placed_at)) OVER w AS b, lead(epoch_us(placed_at)) OVER w AS a FROM bets WINDOW w AS (ORDER BY placed_at, id)) "
    "SELECT id, make_timestamp(COALESCE((t + b) // 2000 * 1000, t - 1000000)) AS insert_before, make_timestamp(COALESCE((t + a) // 2000 * 1000, t + 1000000)) AS insert_after FROM t"
)
def win_insert_between(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours among all tickets: days hold many, and one range of them is one task whatever a day holds."""
    out = timeseries.midpoint(tickets(spark, sf_dir))
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("insert_before", "insert_after")})


@query("SELECT id, book, (sum(net) OVER (PARTITION BY book ORDER BY placed_at, id ROWS UNBOUNDED PRECEDING))::BIGINT AS running, last_value(tail IGNORE NULLS) OVER (PARTITION BY book ORDER BY placed_at, id ROWS UNBOUNDED PRECEDING) AS last_tail FROM kpi")
def win_book_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each book's balance after every ticket, and whom it last followed."""
    rows_ = tickets(spark, sf_dir).select("id", "book", "placed_at", "tail", money.net().alias("net"))
    return scan(rows_, [F.col("placed_at").asc(), F.col("id").asc()], ["book"], running={"running": "net"}, latest={"last_tail": "tail"}).select("id", "book", "running", "last_tail")


# ---- filters


@query("SELECT id FROM bets WHERE bet_type = 'single'")
def flt_non_parlays(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tickets(spark, sf_dir).filter(filters.bet_type("non-parlays")).select("id")


@query("SELECT id FROM bets, (SELECT max(placed_at) AS as_of FROM bets) WHERE placed_at >= as_of - INTERVAL 1 MONTH")
def flt_date_preset(spark: SparkSession, sf_dir: str) -> DataFrame:
    bets = tickets(spark, sf_dir)
    latest = bets.agg(F.max("placed_at").alias("as_of"))  # one row
    return bets.crossJoin(F.broadcast(latest)).filter(filters.placed_since("1m", F.col("as_of"))).select("id")


@query("SELECT id, book FROM bets WHERE placed_at >= TIMESTAMP '1996-02-01' AND placed_at < TIMESTAMP '1996-04-01' AND sport = 'ASIA'")
def flt_custom_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tickets(spark, sf_dir).filter(filters.placed_between("1996-02-01", "1996-03-31") & filters.equals("sport", "ASIA") & filters.equals("book", "all")).select("id", "book")


@query("SELECT DISTINCT id FROM legs WHERE entity = 'red widget'", True)
def flt_entity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested(spark, sf_dir).filter(filters.has_entity("red widget")).select("id")


@query("SELECT id FROM bets WHERE (lower(name) LIKE '%hawks%' OR lower(sport) LIKE '%hawks%' OR lower(tail) LIKE '%hawks%' OR lower(market_category) LIKE '%hawks%') AND result = 'win'")
def flt_grid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tickets(spark, sf_dir).filter(filters.grid("HAWKS", ["name", "sport", "tail", "market_category"]) & filters.equals("result", "win")).select("id")


BLOCK_SQL = "list_filter([CASE WHEN stake IS NULL OR stake < 0 THEN 'stake' END, CASE WHEN result = 'win' AND COALESCE(odds, 0) = 0 THEN 'odds' END], x -> x IS NOT NULL)".replace("x -> ", "lambda x: ")
WARN_SQL = "list_filter([CASE WHEN market_category = 'Props' AND type IS NULL THEN 'type' END, CASE WHEN parlay AND n_legs = 0 THEN 'legs' END], lambda x: x IS NOT NULL)"


@query(f"SELECT id, array_to_string({BLOCK_SQL}, ',') AS blockers, array_to_string({WARN_SQL}, ',') AS warnings FROM kpi")
def flt_import_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tickets(spark, sf_dir).select("id", F.concat_ws(",", validate.import_blockers()).alias("blockers"), F.concat_ws(",", validate.import_warnings()).alias("warnings"))


@query(f"SELECT count(*)::BIGINT AS total, sum(len({BLOCK_SQL}))::BIGINT AS blockers, sum(len({WARN_SQL}))::BIGINT AS warnings, count_if(len({BLOCK_SQL}) > 0)::BIGINT AS blocked, count_if(len({WARN_SQL}) > 0)::BIGINT AS warned, count_if(len({BLOCK_SQL}) = 0)::BIGINT AS valid FROM kpi")
def flt_batch_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.batch_summary(tickets(spark, sf_dir))


@query("SELECT count(*)::BIGINT AS total, 0::BIGINT AS blocked, count_if(id % 3 = 0)::BIGINT AS duplicates, count_if(id % 3 <> 0)::BIGINT AS net_new FROM bets WHERE book = 'MACHINERY'")
def agg_import_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An import of one book's tickets into a store that has every third ticket."""
    bets = tickets(spark, sf_dir)
    return validate.import_summary(bets.filter("book = 'MACHINERY'"), bets.filter("id % 3 = 0"))


# ---- money


WIN_SQL = "CASE WHEN odds > 0 THEN stake * odds / 100.0::DOUBLE ELSE stake * 100.0::DOUBLE / abs(odds) END"


@query(
    f"SELECT id, net, round(CASE WHEN odds > 0 THEN 1 + odds / 100.0::DOUBLE ELSE 1 + 100.0::DOUBLE / abs(odds) END, 6) AS decimal_odds, round({WIN_SQL}, 4) AS profit, "
    f"round(CASE result WHEN 'win' THEN stake + {WIN_SQL} WHEN 'push' THEN stake ELSE 0 END, 4) AS payout_again, round(CASE result WHEN 'win' THEN CASE WHEN payout > 0 THEN payout - stake ELSE {WIN_SQL} END WHEN 'loss' THEN -stake WHEN 'push' THEN 0 END, 4) AS row_net, "
    f"round(CASE WHEN payout > 0 THEN payout ELSE stake + {WIN_SQL} END, 4) AS to_win, round(CASE WHEN result IN ('pending', 'push') THEN 0 WHEN result = 'loss' THEN -stake ELSE {WIN_SQL} END, 4) AS expected FROM kpi"
)
def n_money(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tickets(spark, sf_dir).select(
        "id", money.net().alias("net"), F.round(money.decimal_odds(), 6).alias("decimal_odds"), F.round(money.profit(), 4).alias("profit"), F.round(money.recalculated_payout(), 4).alias("payout_again"),
        F.round(money.row_net(), 4).alias("row_net"), F.round(money.to_win(), 4).alias("to_win"), F.round(money.expected_net(), 4).alias("expected"),
    )


HEDGE_ODDS = "CASE WHEN id % 2 = 0 THEN 150 + id % 100 ELSE -(110 + id % 50) END"


@query(
    f"WITH h AS (SELECT id, stake, stake + {WIN_SQL} AS potential, {HEDGE_ODDS} AS o FROM kpi), m AS (SELECT *, potential / CASE WHEN o > 0 THEN 1 + o / 100.0::DOUBLE ELSE 1 + 100.0::DOUBLE / abs(o) END AS hedge FROM h) "
    "SELECT id, floor(hedge)::BIGINT AS hedge_stake, floor(potential - stake - hedge)::BIGINT AS guaranteed, CASE WHEN potential - stake - hedge > 0.5 * stake THEN 'strong' WHEN potential - stake - hedge > 0 THEN 'moderate' ELSE 'not_recommended' END AS advice FROM m"
)
def n_hedge(spark: SparkSession, sf_dir: str) -> DataFrame:
    odds = F.expr(HEDGE_ODDS).cast("int")
    h = money.hedge(F.col("stake"), F.col("stake") + money.profit(), odds)
    rows_ = tickets(spark, sf_dir).withColumn("h", h)
    return rows_.select("id", F.floor("h.hedge_stake").alias("hedge_stake"), F.floor("h.original_profit").alias("guaranteed"), F.when(F.col("h.original_profit") > 0.5 * F.col("stake"), "strong").when(F.col("h.original_profit") > 0, "moderate").otherwise("not_recommended").alias("advice"))


@query("SELECT id, round(stake::DOUBLE / CASE WHEN n_legs > 1 THEN n_legs ELSE 1 END, 6) AS leg_stake, round(net::DOUBLE / CASE WHEN n_legs > 1 THEN n_legs ELSE 1 END, 6) AS leg_net, CASE WHEN parlay THEN 0 ELSE stake END::BIGINT AS entity_stake FROM kpi")
def n_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    split = lambda x: F.round(money.attributed(x.cast("double"), F.col("n_legs"), "split"), 6)
    return tickets(spark, sf_dir).select("id", split(F.col("stake")).alias("leg_stake"), split(money.net()).alias("leg_net"), money.entity_stake().cast("long").alias("entity_stake"))


# ---- rows


ROWS_SQL = f"""
WITH shown AS (SELECT * FROM legs WHERE leg_no < 10),
r AS (
  SELECT b.*, 0 AS row_no, NULL AS entity, NULL AS market, NULL AS target, NULL AS ou, NULL AS leg_odds, NULL AS leg_result FROM bets b WHERE n_legs <> 1
  UNION ALL SELECT b.*, leg_no + 1, s.entity, s.market, s.target, s.ou, s.leg_odds, s.leg_result FROM bets b JOIN shown s USING (id)),
f AS (SELECT *, n_legs > 1 AND row_no = 0 AS is_header, n_legs > 1 AND row_no > 0 AS is_child, lower(COALESCE(market, type, '')) AS m, CASE WHEN row_no > 0 THEN lower(leg_result) ELSE result END AS said FROM r)
SELECT id, row_no::INTEGER AS row_no,
  CASE WHEN is_header THEN CASE bet_type WHEN 'sgp_plus' THEN 'SGP+' WHEN 'sgp' THEN 'SGP' ELSE 'Parlay' END || ' (' || least(n_legs, 10) || ')' ELSE COALESCE(entity, name, '') END AS row_name,
  CASE WHEN is_header THEN 'Parlays' WHEN m = 'nba mvp' THEN 'Futures' WHEN regexp_matches(m, 'moneyline|ml|spread|total|over|under') AND NOT contains(m, 'player') THEN 'Main Markets' ELSE 'Props' END AS category,
  CASE WHEN is_header THEN '' WHEN ou = 'Over' THEN '1' WHEN ou = 'Under' THEN '0' ELSE '' END AS over_flag, CASE WHEN is_header THEN '' WHEN ou = 'Over' THEN '0' WHEN ou = 'Under' THEN '1' ELSE '' END AS under_flag,
  CASE WHEN is_header THEN '' ELSE COALESCE(target, '') END AS line, CASE WHEN is_child THEN leg_odds ELSE odds END::INTEGER AS row_odds, CASE WHEN NOT is_child THEN stake END AS row_stake,
  CASE said WHEN 'win' THEN 'Win' WHEN 'loss' THEN 'Loss' WHEN 'push' THEN 'Push' ELSE 'Pending' END AS row_result,
  CASE WHEN NOT is_child THEN round(CASE said WHEN 'win' THEN CASE WHEN payout > 0 THEN (payout - stake)::DOUBLE ELSE {WIN_SQL} END WHEN 'loss' THEN (-stake)::DOUBLE WHEN 'push' THEN 0::DOUBLE END, 4) END AS row_net, is_header, is_child
FROM f"""


@query(ROWS_SQL, True)
def prj_final_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows.final_rows(nested(spark, sf_dir))


@query("WITH r AS (SELECT id, book, 0 AS row_no, false AS is_child FROM bets WHERE n_legs <> 1 UNION ALL SELECT id, book, leg_no + 1, n_legs > 1 FROM bets JOIN legs USING (id) WHERE leg_no < 10) SELECT id, row_no::INTEGER AS row_no, (sum((NOT is_child)::INTEGER) OVER (PARTITION BY book ORDER BY id, row_no ROWS UNBOUNDED PRECEDING) - 1)::BIGINT AS stripe FROM r", True)
def prj_stripes(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = rows.final_rows(nested(spark, sf_dir), ("book",)).select("id", "row_no", "is_child", "book")
    return rows.stripes(flat, "book").select("id", "row_no", "stripe")


@query("SELECT id, strftime(placed_at, '%m/%d') AS short_date, strftime(placed_at, '%Y-%m-%d') AS chart_date, CASE WHEN odds > 0 THEN '+' || odds ELSE odds::VARCHAR END AS odds_text, '$' || format('{:,.2f}', stake / 100.0::DOUBLE) AS stake_text, CASE WHEN result = 'pending' THEN '' ELSE format('{:,.2f}', net / 100.0::DOUBLE) END AS net_text FROM kpi")
def fmt_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows.display(tickets(spark, sf_dir))


@query("WITH d AS (SELECT id, year(max(placed_at) OVER ()) AS y, CAST(max(placed_at) OVER () AS DATE) AS today FROM bets), r AS (SELECT id, today, CASE WHEN id % 10 = 0 THEN make_date(y, 6, 15) WHEN id % 10 = 2 THEN make_date(y, 4, 14) END AS resolves FROM d) SELECT id, resolves, CASE WHEN resolves > today THEN date_diff('day', today, resolves) END::INTEGER AS days FROM r")
def dt_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    bets = tickets(spark, sf_dir)
    bets = bets.crossJoin(F.broadcast(bets.agg(F.max("placed_at").alias("as_of"))))  # one row
    return bets.select("id", formats.resolution_date(F.col("description"), F.lit("NBA"), F.year("as_of")).alias("resolves"), "as_of").select("id", "resolves", formats.days_until(F.col("resolves"), F.col("as_of")).alias("days"))


# ---- classification and resolution


@query("WITH c AS (SELECT id, bet_type, name, type, id % 10 AS d, name IS NULL OR name NOT IN ('Unknown FC', 'LeBron James', 'Suns PHO') AS free FROM bets) SELECT id, CASE WHEN bet_type <> 'single' THEN 'Parlays' WHEN d IN (0, 2) THEN 'Futures' WHEN free AND d IN (1, 5, 6, 8) THEN 'Main Markets' WHEN name IS NOT NULL OR type IS NOT NULL OR d = 4 THEN 'Props' ELSE 'Main Markets' END AS category FROM c")
def cls_ticket_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    bets = tickets(spark, sf_dir)
    rows_ = resolve.known_teams(bets, seed.teams(spark))
    return rows_.select("id", classify.ticket_category(F.col("bet_type"), F.col("description"), F.col("name"), F.col("type"), F.col("is_team")).alias("category"))


@query(
    "SELECT id, leg_no::INTEGER AS leg_no, CASE market WHEN 'NBA MVP' THEN 'Futures' WHEN 'Moneyline' THEN 'Main Markets' WHEN 'Spread' THEN 'Main Markets' WHEN 'Total Rebounds' THEN 'Main Markets' WHEN 'Turnovers' THEN 'Main Markets' ELSE 'Props' END AS category, "
    "CASE market WHEN 'Points' THEN 'Pts' WHEN 'Total Rebounds' THEN 'Total' WHEN 'Made Threes' THEN '3pt' WHEN 'Turnovers' THEN 'Total' WHEN 'Passing Yards' THEN 'Pass Yds' WHEN 'NBA MVP' THEN 'MVP' WHEN 'Player Points Total' THEN 'Pts' WHEN 'Double Double (DD)' THEN 'DD' WHEN 'First Basket' THEN 'FB' WHEN 'Shots' THEN 'SOG' ELSE market END AS kind FROM legs",
    True,
)
def cls_leg_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows_ = sheet.classified(legs(spark, sf_dir).withColumn("sport", F.lit("NBA")), seed.bet_types(spark))
    return rows_.select("id", "leg_no", "category", "kind")


@query(
    "SELECT id, name, CASE trim(name) WHEN 'PHO Suns' THEN 'Phoenix Suns' WHEN 'Hawks' THEN 'Atlanta Hawks' WHEN 'lakers' THEN 'Los Angeles Lakers' WHEN 'Suns PHO' THEN 'Phoenix Suns' WHEN 'ATL' THEN 'Atlanta Hawks' WHEN 'Los Angeles  Chargers' THEN 'Los Angeles Chargers' WHEN 'NE' THEN 'New England Patriots' WHEN 'Giants' THEN 'New York Giants' WHEN 'Bos Celtics' THEN 'Boston Celtics' WHEN 'GS' THEN 'Golden State Warriors' ELSE trim(name) END AS canonical, "
    "CASE WHEN trim(name) IN ('Hawks', 'ATL') THEN 'ambiguous' WHEN trim(name) IN ('Unknown FC', 'LeBron James') THEN 'unresolved' WHEN name IS NULL THEN 'unresolved' ELSE 'resolved' END AS status FROM bets"
)
def res_teams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.resolve_teams(tickets(spark, sf_dir).select("id", "name"), seed.teams(spark)).select("id", "name", "canonical", "status")


@query("SELECT c.id, c.name, s.id AS stored FROM bets c LEFT JOIN (SELECT id FROM bets WHERE id % 3 = 0) s USING (id) WHERE s.id IS NULL UNION ALL SELECT id, name, id FROM bets WHERE id % 3 = 0")
def jn_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    bets = tickets(spark, sf_dir).select("id", "name")
    stored = bets.filter("id % 3 = 0").withColumn("stored", F.col("id"))
    return store.insert(stored, bets)


@query("SELECT id, CASE WHEN id % 4 = 1 THEN 'push' ELSE result END AS result, CASE WHEN id % 4 = 1 THEN NULL ELSE tail END AS tail, CASE WHEN id % 4 = 1 THEN stake ELSE payout END AS payout FROM bets")
def jn_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fourth ticket becomes a push without tail and is priced anew."""
    bets = tickets(spark, sf_dir)
    changes = bets.filter("id % 4 = 1").select("id", F.array(F.lit("result"), F.lit("tail")).alias("set"), F.lit("push").alias("result"), F.lit("").alias("tail"))
    return store.update(bets, changes, ["result", "tail"]).select("id", "result", "tail", "payout")


@query("SELECT id, book FROM bets WHERE result <> 'loss'")
def jn_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    bets = tickets(spark, sf_dir)
    return store.delete(bets, bets.filter("result = 'loss'")).select("id", "book")


@query("SELECT 'manual-' || id || '-' || n AS id, 'pending' AS result, 0::BIGINT AS payout FROM bets, (VALUES (1), (2)) v(n) WHERE market_category = 'Futures'")
def set_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    bets = tickets(spark, sf_dir).filter("market_category = 'Futures'")
    return store.duplicates(bets, 2, reset=True).select("id", "result", "payout")


@query("SELECT DISTINCT market, CASE WHEN lower(market) LIKE 'total rebounds' THEN 40 WHEN lower(market) = 'points' THEN 100 WHEN lower(market) LIKE 'player points total' THEN 40 END AS score FROM legs WHERE lower(market) IN ('points', 'player points total')", True)
def str_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    options = legs(spark, sf_dir).select("market").distinct().select(F.col("market").alias("value"), F.col("market").alias("label"), F.array().cast("array<string>").alias("aliases"))
    return resolve.ranked_options(options, "Points").select(F.col("value").alias("market"), "score")
