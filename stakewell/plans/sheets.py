"""Named queries over whole rows, loading and imports, with data that breaks the rules now and then."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import filters, text
from ..operators import aggregate, dims, resolve, sheet, store, validate
from ..sources import seed
from ..sources.adapter import legs, nested, tickets
from .registry import PLAYERS_SQL
from .wagers import WIN_SQL, by, query, rounded

# ---- whole rows


def odd_tickets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tickets with sports that have their own types, some without a date, legs of two teams, with 'n+' targets and without odds."""
    n = F.col("id")
    fix = lambda leg: leg.withField("entities", F.when(leg["market"] == "Total Rebounds", F.concat(leg["entities"], F.array(F.lit("Other FC")))).otherwise(leg["entities"])).withField("target", F.when(leg["ou"].isNull(), F.concat(leg["target"], F.lit("+"))).otherwise(leg["target"])).withField("odds", F.when(leg["odds"] % 10 == 0, F.lit(0)).otherwise(leg["odds"]))
    return nested(spark, sf_dir).withColumns({"sport": F.when(n % 3 == 0, "NBA").when(n % 3 == 1, "NFL").otherwise(F.col("sport")), "placed_at": F.when(n % 19 != 0, F.col("placed_at")), "legs": F.transform("legs", fix), "market_category": F.when(n % 23 != 0, F.col("market_category"))})


TYPES_SQL = (
    "CASE market WHEN 'Points' THEN 'Pts' WHEN 'Total Rebounds' THEN 'Total' WHEN 'Moneyline' THEN 'Moneyline' WHEN 'Spread' THEN 'Spread' WHEN 'Made Threes' THEN '3pt' WHEN 'Turnovers' THEN 'Total' WHEN 'Passing Yards' THEN 'Pass Yds' WHEN 'NBA MVP' THEN 'MVP' "
    "WHEN 'Player Points Total' THEN 'Pts' WHEN 'Double Double (DD)' THEN 'DD' WHEN 'First Basket' THEN 'FB' WHEN 'Shots' THEN 'SOG' ELSE '' END"
)
SHEET_SQL = f"""
ob AS (SELECT * REPLACE (CASE id % 3 WHEN 0 THEN 'NBA' WHEN 1 THEN 'NFL' ELSE sport END AS sport, CASE WHEN id % 19 <> 0 THEN placed_at END AS placed_at, CASE WHEN id % 23 <> 0 THEN market_category END AS market_category), stake / 100.0::DOUBLE AS s, payout / 100.0::DOUBLE AS p FROM bets),
ol AS (SELECT *, CASE WHEN ou IS NULL THEN target || '+' ELSE target END AS t, CASE WHEN leg_odds % 10 <> 0 THEN leg_odds END AS lo, CASE WHEN market = 'Total Rebounds' THEN 'Other FC' END AS second FROM legs WHERE leg_no < 10),
pr AS (SELECT b.*, 0 AS row_no, NULL AS entity, NULL AS second, COALESCE(CASE WHEN n_legs = 0 THEN type END, '') AS market, NULL AS t, NULL AS ou, NULL AS lo, result AS said FROM ob b WHERE n_legs <> 1
  UNION ALL SELECT b.*, leg_no + 1, entity, second, market, t, ou, lo, leg_result FROM ob b JOIN ol USING (id)),
fl AS (SELECT *, n_legs > 1 AND row_no = 0 AS is_header, n_legs > 1 AND row_no > 0 AS is_child, n_legs = 0 AS bare, lower(said) AS r, {WIN_SQL.replace('stake', 's')} AS won FROM pr),
ty AS (SELECT *, CASE WHEN is_header THEN CASE bet_type WHEN 'sgp_plus' THEN 'SGP+' WHEN 'sgp' THEN 'SGP' WHEN 'parlay' THEN 'Parlay' ELSE '' END WHEN bare THEN CASE WHEN market = 'Pts' THEN 'Pts' ELSE market END ELSE {TYPES_SQL} END AS kind,
  CASE WHEN is_header THEN 'Parlays' WHEN bare THEN CASE WHEN market_category IS NULL THEN '' ELSE replace(market_category, 'Main Markets', 'Main') END WHEN market = 'NBA MVP' THEN 'Futures' WHEN market IN ('Moneyline', 'Spread', 'Total Rebounds', 'Turnovers') THEN 'Main Markets' ELSE 'Props' END AS category,
  CASE r WHEN 'win' THEN CASE WHEN p > 0 THEN p - s ELSE won END WHEN 'loss' THEN -s WHEN 'push' THEN 0 END AS rn, CASE WHEN is_child THEN lo ELSE odds END AS ro FROM fl),
sh AS (SELECT id, row_no::INTEGER AS row_no, COALESCE(strftime(placed_at, '%m/%d/%y'), '') AS date, book AS site, sport, category, kind AS type, CASE WHEN is_header THEN CASE bet_type WHEN 'sgp_plus' THEN 'SGP+' WHEN 'sgp' THEN 'SGP' ELSE 'Parlay' END || ' (' || least(n_legs, 10) || ')' ELSE COALESCE(entity, CASE WHEN bare THEN name END, '') END AS name,
  CASE WHEN category = 'Main Markets' AND kind = 'Total' AND NOT bare THEN second END AS name2, CASE WHEN is_header THEN '' WHEN ou = 'Over' OR (ou IS NULL AND contains(t, '+')) THEN '1' WHEN ou = 'Under' THEN '0' ELSE '' END AS over, CASE WHEN is_header THEN '' WHEN ou = 'Under' THEN '1' WHEN ou = 'Over' OR (ou IS NULL AND contains(t, '+')) THEN '0' ELSE '' END AS under,
  COALESCE(t, '') AS line, CASE WHEN ro IS NULL THEN '' WHEN ro > 0 THEN '+' || ro ELSE ro::VARCHAR END AS odds, CASE WHEN is_child THEN '' ELSE printf('%.2f', s) END AS bet, CASE WHEN is_child THEN '' ELSE printf('%.2f', CASE WHEN p > 0 THEN p ELSE s + won END) END AS to_win,
  CASE r WHEN 'win' THEN 'Win' WHEN 'loss' THEN 'Loss' WHEN 'push' THEN 'Push' ELSE 'Pending' END AS result, CASE WHEN is_child OR rn IS NULL OR abs(round(rn, 2)) >= 1000 THEN '' ELSE printf('%.2f', rn) END AS net, CASE WHEN is_live THEN '1' ELSE '' END AS live, CASE WHEN tail <> '' THEN '1' ELSE '' END AS tail,
  CASE WHEN n_legs > 1 THEN id END AS parlay_id, CASE WHEN is_child THEN row_no END::INTEGER AS leg_index, CASE WHEN is_header THEN least(n_legs, 10) END::INTEGER AS leg_count, is_header, is_child, ro::INTEGER AS raw_odds, CASE WHEN NOT is_child THEN s END AS raw_bet, CASE WHEN NOT is_child THEN CASE WHEN p > 0 THEN p ELSE s + won END END AS raw_to_win, CASE WHEN NOT is_child THEN rn END AS raw_net, placed_at AS sort_date,
  tail AS t_tail, bets_result, is_live AS t_live FROM (SELECT ty.*, b.result AS bets_result FROM ty JOIN bets b USING (id)))"""


@query(f"WITH {SHEET_SQL} SELECT * EXCLUDE (t_tail, bets_result, t_live) REPLACE (round(raw_bet, 7) AS raw_bet, round(raw_to_win, 7) AS raw_to_win, round(raw_net, 7) AS raw_net) FROM sh", True)
def prj_sheet_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All columns of the spreadsheet."""
    out = sheet.sheet_rows(odd_tickets(spark, sf_dir), seed.bet_types(spark), 100).drop("ticket_result", "ticket_tail", "is_live")
    return out.withColumns({c: F.round(c, 7) for c in ("raw_bet", "raw_to_win", "raw_net")})


@query(
    f"WITH {SHEET_SQL} SELECT CASE WHEN is_child THEN id || '-leg-' || (leg_index - 1) ELSE id::VARCHAR END AS id, id AS bet_id, sort_date AS date, site, sport, round(COALESCE(raw_bet, 0), 7) AS bet, round(COALESCE(raw_to_win, 0), 7) AS to_win, round(COALESCE(raw_net, 0), 7) AS net, bets_result AS overall_result, type, category, name, name2, CASE WHEN over = '1' THEN 'Over' WHEN under = '1' THEN 'Under' END AS ou, nullif(line, '') AS line, raw_odds AS odds, lower(result) AS result, t_live AS is_live, CASE WHEN tail = '1' THEN t_tail END AS tail, parlay_id, leg_index, leg_count, is_header, is_child FROM sh",
    True,
)
def prj_whole_grid_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All columns of the grid."""
    out = sheet.grid_rows(sheet.sheet_rows(odd_tickets(spark, sf_dir), seed.bet_types(spark), 100))
    return out.withColumns({c: F.round(c, 7) for c in ("bet", "to_win", "net")})


# ---- loading


CATEGORY_SQL = "CASE WHEN bet_type <> 'single' THEN 'Parlays' WHEN id % 10 IN (0, 2) THEN 'Futures' WHEN free AND id % 10 IN (1, 5, 6, 8) THEN 'Main Markets' WHEN name IS NOT NULL OR type IS NOT NULL OR id % 10 = 4 THEN 'Props' ELSE 'Main Markets' END"


@query(
    f"WITH o AS (SELECT *, CASE WHEN id % 6 = 0 THEN 'Main Markets' WHEN id % 6 = 1 THEN NULL WHEN id % 6 = 2 THEN 'odd' ELSE market_category END AS stored, name IS NULL OR name NOT IN ('Unknown FC', 'LeBron James', 'Suns PHO') AS free FROM bets), c AS (SELECT *, {CATEGORY_SQL} AS fresh FROM o) "
    "SELECT id, CASE WHEN stored IN ('Props', 'Futures', 'Parlays') THEN stored ELSE fresh END AS category, COALESCE(stored = 'Main Markets' AND fresh <> 'Main Markets', false) AS healed FROM c"
)
def prj_loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored tickets as they are loaded: what has no known category is classified, and what was stored as a main market is looked at again."""
    n = F.col("id")
    stored = F.when(n % 6 == 0, "Main Markets").when(n % 6 == 2, "odd").when(n % 6 != 1, F.col("market_category"))
    old = tickets(spark, sf_dir).withColumn("market_category", stored)
    out = store.loaded(old, seed.teams(spark))
    return out.select("id", F.col("market_category").alias("category"), F.coalesce("healed", F.lit(False)).alias("healed"))


# ---- imports


ISSUE_SQL = f"""
teams(k, status) AS (VALUES ('pho suns', 'resolved'), ('hawks', 'ambiguous'), ('lakers', 'resolved'), ('suns pho', 'resolved'), ('atl', 'ambiguous'), ('los angeles chargers', 'resolved'), ('ne', 'resolved'), ('giants', 'resolved'), ('bos celtics', 'resolved'), ('gs', 'resolved')),
lst AS (SELECT DISTINCT p_name AS who, CASE WHEN length(p_name) % 2 = 0 THEN 'NBA' ELSE 'NFL' END AS league FROM part WHERE length(p_name) % 5 <> 0),
al AS (SELECT l.id, l.leg_no, CASE WHEN l.id % 7 <> 0 THEN l.market END AS market, CASE WHEN l.leg_no % 2 = 0 THEN b.name ELSE l.entity END AS who, CASE l.id % 4 WHEN 0 THEN 'NBA' WHEN 1 THEN 'NFL' WHEN 2 THEN 'Chess' END AS league FROM legs l JOIN bets b USING (id)),
ac AS (SELECT a.*, COALESCE(market, '') IN ('Moneyline', 'Spread', 'Total Rebounds', 'Turnovers') AS main, COALESCE(t.status, 'unresolved') AS status, lst.who IS NOT NULL AS listed FROM al a LEFT JOIN teams t ON lower(trim(regexp_replace(a.who, ' +', ' ', 'g'))) = t.k LEFT JOIN lst ON a.who = lst.who AND a.league = lst.league)"""


@query(
    f"WITH {ISSUE_SQL} SELECT id, leg_no::INTEGER AS leg_no, array_to_string(list_filter([CASE WHEN league IS NULL THEN 'sport missing' WHEN league = 'Chess' THEN 'sport unknown' END, CASE WHEN trim(COALESCE(who, '')) = '' THEN NULL WHEN main THEN CASE status WHEN 'unresolved' THEN 'team unknown' WHEN 'ambiguous' THEN 'team ambiguous' END WHEN NOT listed THEN 'player unknown' END, CASE WHEN market IS NULL THEN 'type missing' END], lambda x: x IS NOT NULL), ',') AS issues FROM ac",
    True,
)
def res_leg_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an import finds wrong with each leg: a team's name where its category is a main market, else a player of the sport's list."""
    from .registry import players

    n = F.col("id")
    rows = legs(spark, sf_dir, "name").select("id", "leg_no", F.when(n % 7 != 0, F.col("market")).alias("market"), F.when(F.col("leg_no") % 2 == 0, F.col("name")).otherwise(F.col("entity")).alias("who"), F.when(n % 4 == 0, "NBA").when(n % 4 == 1, "NFL").when(n % 4 == 2, "Chess").alias("league"))
    out = dims.leg_issues(rows, ["NBA", "NFL", "MLB", "NHL"], seed.teams(spark), players(spark, sf_dir).select("canonical", "sport"), name="who", sport="league")
    return out.select("id", "leg_no", F.concat_ws(",", "issues").alias("issues"))


ODD_SQL = "odd AS (SELECT k.* REPLACE (CASE WHEN id % 31 = 0 THEN NULL WHEN id % 37 = 0 THEN -stake ELSE stake END AS stake, CASE WHEN id % 29 = 0 THEN 'void' ELSE result END AS result, CASE WHEN id % 5 = 0 THEN 0 ELSE odds END AS odds, CASE WHEN id % 41 <> 0 THEN placed_at END AS placed_at), id % 3 = 0 AND n_legs > 0 AS vague FROM kpi k)"
ODD_BLOCKS = "list_filter([CASE WHEN placed_at IS NULL THEN 'placed_at' END, CASE WHEN stake IS NULL OR stake < 0 THEN 'stake' END, CASE WHEN result = 'void' THEN 'result' END, CASE WHEN result = 'win' AND odds = 0 THEN 'odds' END, CASE WHEN CASE result WHEN 'loss' THEN -stake WHEN 'win' THEN CASE WHEN odds <> 0 THEN COALESCE(stake, 0) END WHEN 'void' THEN NULL ELSE 0 END IS NULL THEN 'net' END], lambda x: x IS NOT NULL)"


def broken_tickets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tickets as a bad import has them: stakes missing or below 0, results unknown, wins without odds, days missing, legs of nobody known."""
    n = F.col("id")
    vague = F.transform("legs", lambda leg: leg.withField("entity_type", F.when((n % 3 == 0) & (leg["leg_no"] == 0), "unknown").otherwise(leg["entity_type"])))
    changed = {"stake": F.when(n % 31 == 0, F.lit(None)).when(n % 37 == 0, -F.col("stake")).otherwise(F.col("stake")), "result": F.when(n % 29 == 0, "void").otherwise(F.col("result")), "odds": F.when(n % 5 == 0, 0).otherwise(F.col("odds")), "placed_at": F.when(n % 41 != 0, F.col("placed_at")), "legs": vague}
    return nested(spark, sf_dir).withColumns(changed)


@query(f"WITH {ODD_SQL} SELECT id, array_to_string({ODD_BLOCKS}, ',') AS blockers, array_to_string(list_filter([CASE WHEN market_category = 'Props' AND type IS NULL THEN 'type' END, CASE WHEN parlay AND n_legs = 0 THEN 'legs' END, CASE WHEN vague THEN 'entity' END], lambda x: x IS NOT NULL), ',') AS warnings FROM odd")
def flt_broken_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    return broken_tickets(spark, sf_dir).select("id", F.concat_ws(",", validate.import_blockers()).alias("blockers"), F.concat_ws(",", validate.import_warnings(F.col("legs"))).alias("warnings"))


@query(f"WITH {ODD_SQL}, m AS (SELECT len({ODD_BLOCKS}) > 0 AS bad, id % 3 = 0 AS old FROM odd WHERE book = 'MACHINERY') SELECT count(*)::BIGINT AS total, count_if(bad)::BIGINT AS blocked, count_if(old)::BIGINT AS duplicates, greatest(0, count(*) - count_if(old) - count_if(bad))::BIGINT AS net_new FROM m")
def agg_broken_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bad import of one book's tickets into a store that has every third ticket."""
    return validate.import_summary(broken_tickets(spark, sf_dir).where("book = 'MACHINERY'"), tickets(spark, sf_dir).where("id % 3 = 0"))


@query(f"WITH m AS (SELECT CASE WHEN contains(market, '(DD)') THEN 'DD' ELSE CASE market WHEN 'Points' THEN 'Pts' WHEN 'Turnovers' THEN 'TO' WHEN 'Passing Yards' THEN 'Pass Yds' WHEN 'Shots' THEN 'SOG' WHEN 'Made Threes' THEN '3pt' WHEN 'First Basket' THEN 'FB' WHEN 'Total Rebounds' THEN 'Reb' ELSE market END END AS market, k.* FROM kpi k JOIN legs USING (id)) " + by("market", "m"), True)
def agg_by_short_market(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By market in short: what stands in brackets, else the bet type that the market is a name of."""
    rows = nested(spark, sf_dir)
    short = resolve.short_markets(rows.select(F.explode("legs.market").alias("market"), "sport"), seed.bet_types(spark))
    short = short.toDF("m_", "s_", "short")
    pairs = rows.select("id", "result", "stake", "payout", "sport", F.explode("legs.market").alias("market"))
    pairs = resolve.looked_up(pairs, short, (F.col("market") == F.col("m_")) & (F.col("sport") == F.col("s_")), F.col("market").isNotNull())
    return rounded(aggregate.stats_by(pairs, F.col("short")), "roi")


@query(
    "WITH q AS (SELECT entity_type || '::' || sport || '::' || lower(entity) AS group_key, entity, leg_no, id, book, market, placed_at FROM legs JOIN bets USING (id) WHERE leg_result = 'PENDING') "
    "SELECT group_key, count(*)::BIGINT AS count, array_to_string(list_sort(list(lower(entity) || '::' || id || '::' || leg_no)), ',') AS item_ids FROM q GROUP BY 1",
    True,
)
def agg_queue_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The items of each entity of the queue, which a decision about the entity settles."""
    queue = legs(spark, sf_dir, "book", "sport", "placed_at").where("leg_result = 'PENDING'").select(
        "entity_type", "sport", text.lookup_key("entity").alias("lookup_key"), F.col("entity").alias("raw_value"), "book", "market", F.col("placed_at").alias("encountered_at"), F.struct("id", "leg_no").alias("seq"), text.queue_id(F.col("entity"), F.col("id"), F.col("leg_no")).alias("item_id"),
    )
    items = aggregate.queue_items(queue)
    return items.groupBy("group_key").agg(F.count("*").alias("count"), F.array_join(F.sort_array(F.collect_list("item_id")), ",").alias("item_ids"))


@query("WITH o AS (SELECT id, description IS NULL OR id % 11 = 0 AS d, stake <= 0 AS s, id % 13 = 0 AND id % 17 <> 0 AS m, n_legs = 0 AS l FROM bets), e AS (SELECT id, unnest(list_filter([CASE WHEN d THEN 'no description' END, CASE WHEN s THEN 'stake' END, CASE WHEN m THEN 'market_category' END, CASE WHEN l THEN 'legs' END], lambda x: x IS NOT NULL)) AS message FROM o) SELECT message, count(*)::BIGINT AS tickets, min(id) AS first_ticket FROM e GROUP BY 1")
def agg_contract_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The messages of all tickets that break the contract, by message."""
    from .ledger import _parsed

    messages = validate.contract_messages(validate.contract(_parsed(spark, sf_dir)))
    return messages.where("level = 'error'").groupBy("message").agg(F.count("*").alias("tickets"), F.min("id").alias("first_ticket"))


# ---- merged legs, dates of books


@query(
    "WITH d AS (SELECT id, leg_no, entity, market, target, CASE WHEN leg_odds % 5 <> 0 THEN leg_odds END AS o, leg_result AS r FROM legs), "
    # Each leg stands twice, the second time with another result and without odds: one leg is left of both.
    "m AS (SELECT *, CASE WHEN r = 'PENDING' AND leg_no % 2 = 0 THEN 'WIN' ELSE r END AS merged FROM d), k AS (SELECT id, entity, market, target, min(leg_no) AS first_no, arg_max(merged, (CASE merged WHEN 'WIN' THEN 4 WHEN 'LOSS' THEN 3 WHEN 'PUSH' THEN 2 ELSE 1 END) * 100 - leg_no) AS result, arg_max(o, leg_no) FILTER (o IS NOT NULL) AS odds FROM m GROUP BY 1, 2, 3, 4) "
    "SELECT id, string_agg(entity || '|' || market || '|' || target || '|' || result || '|' || COALESCE(odds::VARCHAR, ''), ';' ORDER BY first_no) AS legs FROM k GROUP BY 1",
    True,
)
def arr_merged_legs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tickets whose legs were read twice, once without odds: each is one leg with the stronger result and the odds that there are."""
    from ..operators import legs as leg_ops

    fields = lambda leg, odds, result: F.struct(leg["entities"].alias("entities"), leg["market"].alias("market"), leg["target"].alias("target"), F.lit(None).cast("string").alias("ou"), odds.cast("int").alias("odds"), result.alias("result"))
    once = F.transform("legs", lambda leg: fields(leg, F.when(leg["odds"] % 5 != 0, leg["odds"]), leg["result"]))
    again = F.transform("legs", lambda leg: fields(leg, F.lit(0), F.when((leg["result"] == "PENDING") & (leg["leg_no"] % 2 == 0), "WIN").otherwise(leg["result"])))
    rows = nested(spark, sf_dir).where("legs IS NOT NULL").select("id", leg_ops.merged_legs(F.concat(once, again)).alias("m"))
    said = F.transform("m", lambda x: F.concat_ws("|", x["entities"][0], x["market"], x["target"], x["result"], F.coalesce(x["odds"].cast("string"), F.lit(""))))
    return rows.select("id", F.array_join(said, ";").alias("legs"))


@query(
    "SELECT id, CASE id % 4 WHEN 0 THEN make_timestamp(2024, month(placed_at), day(placed_at), 12, 0, 0) WHEN 3 THEN NULL ELSE placed_at + INTERVAL 12 HOUR END AS typed, placed_at + INTERVAL 7 HOUR + INTERVAL 5 MINUTE + INTERVAL 5 HOUR AS fanduel, placed_at + INTERVAL 19 HOUR + INTERVAL 5 MINUTE + INTERVAL 9 SECOND AS draftkings FROM bets WHERE NOT (month(placed_at) = 2 AND day(placed_at) = 29)"
)
def dt_book_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days as people type them (with and without a year, short, impossible) and as either book writes them."""
    from ..functions import formats

    n, at = F.col("id") % 4, F.col("placed_at")
    rows = tickets(spark, sf_dir).where(~((F.month(at) == 2) & (F.dayofmonth(at) == 29)))
    typed = F.when(n == 0, F.date_format(at, "M/d")).when(n == 1, F.date_format(at, "M/d/yyyy")).when(n == 2, F.when(F.year(at) >= 2000, F.date_format(at, "MM/dd/yy")).otherwise(F.date_format(at, "MM/dd/yyyy"))).otherwise("13/45/2020")
    stamp = lambda c: c.cast("timestamp_ntz")
    return rows.select(
        "id", stamp(formats.user_date(typed, F.lit(2024))).alias("typed"), stamp(formats.fanduel_date(F.concat(F.lit("PLACED: "), F.date_format(at, "M/d/yyyy"), F.lit(" 7:05AM ET")))).alias("fanduel"),
        stamp(formats.draftkings_date(F.concat(F.date_format(at, "MMM d, yyyy"), F.lit(", 7:05:09 PM")))).alias("draftkings"),
    )



SPORTS_SQL = "CASE market WHEN 'Passing Yards' THEN 'NFL' WHEN 'Shots' THEN 'NHL' WHEN 'Moneyline' THEN 'Other' WHEN 'Spread' THEN 'Other' WHEN 'Player Points Total' THEN NULL WHEN 'Double Double (DD)' THEN NULL ELSE 'NBA' END"


@query(
    "WITH team(k, s) AS (VALUES ('hawks', 'NBA'), ('lakers', 'NBA'), ('atl', 'NBA'), ('los angeles chargers', 'NFL'), ('ne', 'NFL'), ('giants', 'NFL'), ('gs', 'NBA'), ('bos celtics', 'NBA')), "
    "l AS (SELECT b.id, leg_no, market, CASE WHEN leg_no % 2 = 0 THEN b.name ELSE entity END AS who FROM bets b JOIN legs USING (id) WHERE b.id % 3 <> 0 OR market IN ('Player Points Total', 'Double Double (DD)')), "
    f"f AS (SELECT l.id, arg_min(COALESCE(t.s, {SPORTS_SQL}), leg_no) FILTER (COALESCE(t.s, {SPORTS_SQL}) IS NOT NULL) AS told FROM l LEFT JOIN team t ON lower(trim(regexp_replace(who, '\\s+', ' ', 'g'))) = t.k WHERE who IS NOT NULL GROUP BY 1) "
    "SELECT b.id, COALESCE(told, CASE WHEN contains(lower(description), 'nba') THEN 'NBA' END, 'Other') AS sport FROM bets b LEFT JOIN f USING (id)",
    True,
)
def str_sport_of_legs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sport that a ticket's legs tell, by a team's name or a market of one sport; some tickets have only markets that tell nothing."""
    kept = F.filter("legs", lambda leg: (F.col("id") % 3 != 0) | leg["market"].isin("Player Points Total", "Double Double (DD)"))
    named = F.transform(kept, lambda leg: leg.withField("entities", F.when(leg["leg_no"] % 2 == 0, F.array("name")).otherwise(leg["entities"])))
    rows = nested(spark, sf_dir).withColumn("legs", F.transform(named, lambda leg: leg.withField("entities", F.filter(leg["entities"], lambda e: e.isNotNull()))))
    return dims.sport_of_legs(rows, seed.teams(spark), seed.bet_types(spark))


# ---- teams, players and legs


@query(
    "WITH t(n, team, s, short) AS (VALUES ('PHO Suns', 'Phoenix Suns', 'NBA', 'PHO'), ('Hawks', 'Atlanta Hawks', 'NBA', 'ATL'), ('lakers', 'Los Angeles Lakers', 'NBA', 'LAL'), ('Suns PHO', 'Phoenix Suns', 'NBA', 'PHO'), ('ATL', 'Atlanta Hawks', 'NBA', 'ATL'), ('Los Angeles  Chargers', 'Los Angeles Chargers', 'NFL', 'LAC'), "
    "('NE', 'New England Patriots', 'NFL', 'NE'), ('Giants', 'New York Giants', 'NFL', 'NYG'), ('Bos Celtics', 'Boston Celtics', 'NBA', 'BOS'), ('GS', 'Golden State Warriors', 'NBA', 'GSW')) SELECT id, name, team, s AS team_sport, short FROM bets LEFT JOIN t ON trim(name) = t.n"
)
def str_team_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Team, sport and abbreviation of a ticket's name, by an alias or by its parts."""
    return resolve.team_info(tickets(spark, sf_dir).select("id", "name"), seed.teams(spark))


@query("WITH p AS (SELECT DISTINCT p_name AS c FROM part), s AS (SELECT c, CASE WHEN length(c) % 2 = 0 THEN 'NBA' ELSE 'NFL' END AS sport FROM p UNION SELECT upper(c), 'MLB' FROM p WHERE length(c) % 3 = 0 UNION SELECT c, 'MLB' FROM p WHERE length(c) % 7 = 0) SELECT lower(c) AS name, array_to_string(list_sort(list(DISTINCT sport)), ',') AS sports FROM s GROUP BY 1 HAVING count(DISTINCT sport) > 1")
def jn_cross_sport_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Players' names that stand in more than one sport, whatever their case."""
    names, n = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_name").alias("c")).distinct(), F.length("c")
    rows = names.select(F.col("c").alias("canonical"), F.when(n % 2 == 0, "NBA").otherwise("NFL").alias("sport"))
    rows = rows.unionByName(names.where(n % 3 == 0).select(F.upper("c").alias("canonical"), F.lit("MLB").alias("sport"))).unionByName(names.where(n % 7 == 0).select(F.col("c").alias("canonical"), F.lit("MLB").alias("sport")))
    return resolve.cross_sport_names(rows).select("name", F.concat_ws(",", "sports").alias("sports"))


@query("SELECT id, string_agg(CASE WHEN leg_no = 1 THEN 'half' ELSE target END || '|' || CASE WHEN leg_no = 1 THEN 'PUSH' ELSE leg_result END, ';' ORDER BY leg_no) AS legs FROM legs GROUP BY 1", True)
def set_patched_legs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every ticket's second leg gets another target and result; tickets with one leg stay."""
    patched = store.patch_leg(F.col("legs"), 1, target=F.lit("half"), result=F.lit("PUSH"))
    rows = nested(spark, sf_dir).where("legs IS NOT NULL").select("id", patched.alias("legs"))
    return rows.select("id", F.array_join(F.transform("legs", lambda x: F.concat_ws("|", x["target"], x["result"])), ";").alias("legs"))


@query("SELECT id, id % 7 = 0 OR id IN (1, 2, 33) AS sample FROM bets")
def prj_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tickets(spark, sf_dir).withColumn("is_sample", F.when(F.col("id") % 7 == 0, True)).select("id", store.is_sample(["1", "2", "33"]).alias("sample"))


@query(f"WITH {PLAYERS_SQL} SELECT id, placed_at FROM bets WHERE n_legs <= 1 AND id IN (SELECT id FROM found WHERE status = 'resolved' AND canonical IN ('hot gizmo', 'blue widget', 'green bolt') AND entity_type = 'player') AND placed_at >= TIMESTAMP '1995-01-01'", True)
def flt_known_player_bets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tickets of at most one leg whose player resolves to one of three."""
    from .registry import asked_players, players

    known = dims.resolve_players(asked_players(spark, sf_dir).where("entity_type = 'player'"), players(spark, sf_dir)).where(F.col("canonical").isin("hot gizmo", "blue widget", "green bolt") & (F.col("status") == "resolved"))
    return tickets(spark, sf_dir).where("n_legs <= 1").where(filters.placed_between("1995-01-01", None)).join(known.select("id").distinct(), "id", "left_semi").select("id", "placed_at")
