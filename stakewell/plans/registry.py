"""Named queries over reference dimensions, orders, row text and stored tickets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import classify, filters, money, validators
from ..functions.text import ascii_key
from ..operators import aggregate, dims, order, resolve
from ..sources import seed
from ..sources.adapter import legs, tickets
from .wagers import COUNTS, ROI, by, query, rounded


def players(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Players made of the parts' names: most are known, in a sport each; those with the same first word share an alias."""
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_name").alias("canonical")).distinct().filter(F.length("canonical") % 5 != 0)
    first = F.split("canonical", " ")[0]
    return rows.select(F.col("canonical").alias("seq"), "canonical", F.when(F.length("canonical") % 2 == 0, "NBA").otherwise("NFL").alias("sport"), F.array(F.concat(first, F.lit(" jr"))).alias("aliases"), F.when(first == "red", "Boston Celtics").when(first == "blue", "Atlanta Hawks").alias("team"), (first == "small").alias("disabled"))


def asked_players(spark: SparkSession, sf_dir: str, *of_ticket: str) -> DataFrame:
    """Legs with their entity written in several ways and a sport, or none."""
    n = F.col("id") % 4
    name = F.when(n == 0, F.col("entity")).when(n == 1, F.upper("entity")).when(n == 2, F.concat(F.split("entity", " ")[0], F.lit(" Jr"))).otherwise(F.concat(F.lit("  "), F.replace("entity", F.lit(" "), F.lit("   "))))
    return legs(spark, sf_dir, *of_ticket).select("id", "leg_no", "entity_type", name.alias("name"), F.when(F.col("id") % 3 == 0, "NBA").when(F.col("id") % 3 == 1, "NFL").alias("sport"), *of_ticket)


PLAYERS_SQL = """
players AS (SELECT DISTINCT p_name AS canonical, CASE WHEN length(p_name) % 2 = 0 THEN 'NBA' ELSE 'NFL' END AS sport, split_part(p_name, ' ', 1) || ' jr' AS alias FROM part WHERE length(p_name) % 5 <> 0 AND split_part(p_name, ' ', 1) <> 'small'),
keys AS (SELECT canonical, sport, canonical AS k FROM players UNION SELECT canonical, sport, alias FROM players),
scoped AS (SELECT k, sport, min(canonical) AS c, count(DISTINCT canonical) AS n FROM keys GROUP BY ALL),
anyone AS (SELECT k, min(canonical) AS c, count(DISTINCT canonical) AS n FROM keys GROUP BY ALL),
asked AS (
  SELECT id, leg_no, entity_type, CASE id % 4 WHEN 0 THEN entity WHEN 1 THEN upper(entity) WHEN 2 THEN split_part(entity, ' ', 1) || ' Jr' ELSE '  ' || replace(entity, ' ', '   ') END AS name,
         CASE id % 3 WHEN 0 THEN 'NBA' WHEN 1 THEN 'NFL' END AS sport FROM legs),
plain AS (SELECT *, trim(regexp_replace(name, ' +', ' ', 'g')) AS said FROM asked),
found AS (
  SELECT p.*, COALESCE(s.c, a.c, said) AS canonical, CASE WHEN s.n > 1 OR a.n > 1 THEN 'ambiguous' WHEN s.c IS NOT NULL OR a.c IS NOT NULL THEN 'resolved' ELSE 'unresolved' END AS status
  FROM plain p LEFT JOIN scoped s ON lower(said) = s.k AND p.sport = s.sport LEFT JOIN anyone a ON lower(said) = a.k)"""


# ---- names


@query(f"WITH {PLAYERS_SQL} SELECT id, leg_no::INTEGER AS leg_no, name, canonical, status FROM found", True)
def res_players(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dims.resolve_players(asked_players(spark, sf_dir), players(spark, sf_dir)).select("id", "leg_no", "name", "canonical", "status")


@query(
    f"WITH {PLAYERS_SQL}, entity_keys AS (SELECT DISTINCT id, CASE WHEN entity_type = 'player' AND status = 'resolved' THEN canonical ELSE '[Unresolved]' END AS name FROM found), t AS (SELECT e.name, k.result, k.stake, k.net FROM kpi k JOIN entity_keys e USING (id) WHERE NOT parlay) "
    f"SELECT name, count(*)::BIGINT AS tickets, {COUNTS}, sum(stake)::BIGINT AS stake, sum(net)::BIGINT AS net, " + ROI.format(s="sum(stake)", n="sum(net)") + " FROM t GROUP BY name",
    True,
)
def agg_by_player_or_team(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ticket counts once for each of its players and teams; all that resolve to no single one are one row."""
    keyed = dims.entity_keys(asked_players(spark, sf_dir), players(spark, sf_dir), seed.teams(spark))
    return rounded(aggregate.entity_stats(tickets(spark, sf_dir).withColumn("name", F.lit(None).cast("string")), keyed.drop("name"), F.col("key")), "roi")


FUTURE_ASKED = ["MVP", "mvp ", "Rookie of the Year", "win conference", "Season Wins", "Coach of the Year", "A cup"]


@query(
    "WITH a AS (SELECT id, ['MVP', 'mvp ', 'Rookie of the Year', 'win conference', 'Season Wins', 'Coach of the Year', 'A cup'][id % 7 + 1] AS market, ['NBA', 'NFL', 'NHL', NULL][id % 4 + 1] AS sport FROM bets), "
    "own(sport, k, f) AS (VALUES ('NBA', 'mvp', 'NBA MVP'), ('NFL', 'mvp', 'NFL MVP'), ('NHL', 'mvp', 'Hart Trophy'), ('NBA', 'rookie of the year', 'NBA ROY'), ('NHL', 'rookie of the year', 'Calder Trophy'), ('NBA', 'win conference', 'NBA Conference Winner'), ('NFL', 'win conference', 'NFL Conference Winner'), ('NBA', 'coach of the year', 'NBA COTY'), ('NFL', 'coach of the year', 'NFL COTY')), "
    "anyone(k, f) AS (VALUES ('mvp', 'Hart Trophy'), ('rookie of the year', 'Calder Trophy'), ('win conference', 'NFL Conference Winner'), ('season wins', 'Win Total'), ('coach of the year', 'NFL COTY')) "
    "SELECT id, a.sport, market, COALESCE(o.f, y.f, trim(market)) AS future FROM a LEFT JOIN own o ON lower(trim(market)) = o.k AND a.sport = o.sport LEFT JOIN anyone y ON lower(trim(market)) = y.k"
)
def str_future_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = len(FUTURE_ASKED)
    sport = F.element_at(F.array(*map(F.lit, ("NBA", "NFL", "NHL", None))), (F.col("id") % 4 + 1).cast("int"))
    rows = tickets(spark, sf_dir).select("id", F.element_at(F.array(*map(F.lit, FUTURE_ASKED)), (F.col("id") % n + 1).cast("int")).alias("market"), sport.alias("sport"))
    return dims.canonical_futures(rows, seed.future_types(spark)).select("id", "sport", "market", "future")


@query(
    "WITH a AS (SELECT id, ['Boston Celtics', 'NYJ', 'nobody', NULL][id % 4 + 1] AS team, ['RBIs', 'Assists', 'Saves', ' ml '][id % 5 % 4 + 1] AS market, ['college football game', 'NCAAB final', 'Wimbledon', 'a game', 'MLS cup', 'hockey night'][id % 6 + 1] AS description FROM bets) "
    "SELECT id, CASE WHEN team = 'Boston Celtics' THEN 'NBA' WHEN team = 'NYJ' THEN 'NFL' WHEN market = 'RBIs' THEN 'MLB' WHEN market = 'Saves' THEN 'NHL' WHEN market = ' ml ' THEN 'Other' "
    "WHEN contains(lower(description), 'football') THEN 'NFL' WHEN contains(lower(description), 'hockey') THEN 'NHL' WHEN contains(lower(description), 'ncaab') THEN 'NCAAB' WHEN contains(lower(description), 'mls') THEN 'Soccer' WHEN contains(lower(description), 'wimbledon') THEN 'Tennis' END AS inferred FROM a"
)
def str_infer_sport(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda options, i: F.element_at(F.array(*map(F.lit, options)), (i + 1).cast("int"))
    rows = tickets(spark, sf_dir).select(
        "id", pick(["Boston Celtics", "NYJ", "nobody", None], F.col("id") % 4).alias("team"), pick(["RBIs", "Assists", "Saves", " ml "], F.col("id") % 5 % 4).alias("market"),
        pick(["college football game", "NCAAB final", "Wimbledon", "a game", "MLS cup", "hockey night"], F.col("id") % 6).alias("description"),
    )
    return dims.inferred_sport(rows, seed.teams(spark), seed.bet_types(spark)).select("id", "inferred")


@query("SELECT DISTINCT p_name AS name, CASE WHEN length(p_name) % 2 = 0 THEN 'NBA:' || upper(left(p_name, 2)) ELSE 'NFL:' || left(upper(replace(p_name, ' ', '')), 6) END AS team_id FROM part")
def str_team_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_name").alias("name")).distinct()
    even = F.length("name") % 2 == 0
    short = F.when(even, F.array(F.upper(F.substring("name", 1, 2)))).otherwise(F.array().cast("array<string>"))
    return rows.select("name", dims.team_id(F.when(even, "NBA").otherwise("NFL"), short, F.col("name")).alias("team_id"))


@query("SELECT id, lower(book) || ',' || CASE WHEN upper(sport) <> book THEN upper(sport) ELSE '' END AS kept FROM bets")
def str_dedupe_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    aliases = F.array(F.lit("  "), F.lower("book"), F.col("book"), F.upper("sport"), F.col("sport"), F.concat(F.lit(" "), F.col("book")))
    return tickets(spark, sf_dir).select("id", F.concat_ws(",", dims.deduped_aliases(aliases, ascii_key)).alias("kept"))


@query("SELECT DISTINCT market AS value, CASE WHEN market IN ('Points', 'Shots') OR market = upper(market) THEN market ELSE market || ' — ' || upper(market) END AS display, lower(replace(market, '.', '')) = 'double double (dd)' AS found FROM legs", True)
def str_option_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = legs(spark, sf_dir).select(F.col("market").alias("value")).distinct()
    label = F.when(F.col("value").isin("Points", "Shots"), F.col("value")).otherwise(F.upper("value"))
    return rows.select("value", resolve.option_display(F.col("value"), label).alias("display"), resolve.option_is(F.col("value"), " Double.  double (DD)").alias("found"))


# ---- classes


@query(
    "WITH a AS (SELECT id, CASE id % 6 WHEN 0 THEN 'A Same Game Parlay' WHEN 1 THEN 'Live now' WHEN 2 THEN 'a parlay' ELSE description END AS d, n_legs, ['win', 'Void', 'VOIDED', 'push', 'odd', NULL, 'Unknown'][id % 7 + 1] AS r, ['SGP', 'Cy Young', 'Spread', 'Pts', 'Win Total'][id % 5 + 1] AS t FROM bets) "
    "SELECT id, CASE WHEN contains(lower(d), 'same game parlay') THEN 'sgp' WHEN contains(lower(d), 'live') THEN 'live' WHEN n_legs > 1 THEN CASE WHEN contains(lower(d), 'parlay') THEN 'parlay' ELSE 'sgp' END ELSE 'single' END AS bet_type, "
    "CASE WHEN lower(r) IN ('void', 'voided', 'push') THEN 'PUSH' WHEN lower(r) IN ('win', 'unknown') THEN upper(r) ELSE 'PENDING' END AS leg_result, CASE t WHEN 'SGP' THEN 'parlay' WHEN 'Spread' THEN 'main' WHEN 'Pts' THEN 'props' ELSE 'future' END AS bucket FROM a"
)
def cls_inferred(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda options: F.element_at(F.array(*map(F.lit, options)), (F.col("id") % len(options) + 1).cast("int"))
    n = F.col("id") % 6
    d = F.when(n == 0, "A Same Game Parlay").when(n == 1, "Live now").when(n == 2, "a parlay").otherwise(F.col("description"))
    bucket = classify.type_bucket(pick(["SGP", "Cy Young", "Spread", "Pts", "Win Total"]), [p[0] for p in seed.PARLAY_TYPES], [f[0] for f in seed.FUTURE_TYPES], [m[0] for m in seed.MAIN_MARKETS])
    return tickets(spark, sf_dir).select("id", classify.inferred_bet_type(d, F.col("n_legs")).alias("bet_type"), classify.leg_result(pick(["win", "Void", "VOIDED", "push", "odd", None, "Unknown"])).alias("leg_result"), bucket.alias("bucket"))


# ---- filters


@query("SELECT id FROM bets WHERE bet_type = 'sgp_plus'")
def flt_parlay_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tickets(spark, sf_dir).filter(filters.parlay_of("sgp_plus")).select("id")


@query("SELECT CASE WHEN is_live THEN 'live' ELSE 'pre' END AS name, count(*)::BIGINT AS count, " + COUNTS + ", sum(stake)::BIGINT AS stake, sum(net)::BIGINT AS net, " + ROI.format(s="sum(stake)", n="sum(net)") + " FROM kpi WHERE market_category = 'Main Markets' GROUP BY 1")
def flt_live_pre_market(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(aggregate.live_or_before(tickets(spark, sf_dir).filter(filters.display_market("main"))), "roi")


@query(f"WITH {PLAYERS_SQL} SELECT id, placed_at FROM bets WHERE n_legs <= 1 AND id IN (SELECT id FROM found WHERE status = 'resolved' AND canonical = 'red widget' AND entity_type = 'player') AND placed_at >= TIMESTAMP '1995-01-01'", True)
def flt_player_bets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tickets of at most one leg whose player resolves to the one asked for."""
    known = dims.resolve_players(asked_players(spark, sf_dir).filter("entity_type = 'player'"), players(spark, sf_dir)).filter("status = 'resolved' AND canonical = 'red widget'")
    return tickets(spark, sf_dir).filter("n_legs <= 1").filter(filters.placed_between("1995-01-01", None)).join(known.select("id").distinct(), "id", "left_semi").select("id", "placed_at")


@query("WITH p AS (SELECT DISTINCT p_name, split_part(p_name, ' ', 1) AS w FROM part WHERE length(p_name) % 5 <> 0) SELECT p_name AS canonical FROM p WHERE length(p_name) % 2 = 0 AND w <> 'small' AND (contains(p_name, 'celt') OR contains(w || ' jr', 'celt') OR w = 'red')")
def flt_reference_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dims.searched(players(spark, sf_dir), " Celt", "NBA").select("canonical")


# ---- orders


@query("WITH s AS (" + by("book") + "), f AS (SELECT * FROM s WHERE lower(name) LIKE '%u%') SELECT name, net, (row_number() OVER (ORDER BY net DESC, name))::INTEGER AS position, (row_number() OVER (ORDER BY roi, name))::INTEGER AS by_roi FROM f")
def srt_stats_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = rounded(aggregate.stats_by(tickets(spark, sf_dir), F.col("book")), "roi").filter(filters.named_like(" U"))
    return order.positions(order.positions(table, order.stats_order()), order.stats_order("roi", False), name="by_roi").select("name", "net", "position", "by_roi")


@query("SELECT id, (row_number() OVER (PARTITION BY book, sport ORDER BY placed_at::DATE DESC, id))::INTEGER AS newest, (row_number() OVER (PARTITION BY book, sport ORDER BY placed_at::DATE, id))::INTEGER AS oldest, (row_number() OVER (PARTITION BY book, sport ORDER BY tail DESC NULLS LAST, id))::INTEGER AS by_tail, (row_number() OVER (PARTITION BY book, sport ORDER BY placed_at DESC, id DESC))::INTEGER AS stored FROM bets")
def srt_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, within = tickets(spark, sf_dir).select("id", "book", "sport", "placed_at", "tail"), ["book", "sport"]
    for name, by_ in (("newest", order.grid_order("placed_at", True)), ("oldest", order.grid_order("placed_at", False)), ("by_tail", order.grid_order("tail", True)), ("stored", order.storage_order())):
        rows = order.ranked(rows, by_, within, name)
    return rows.select("id", *(F.col(c).cast("int").alias(c) for c in ("newest", "oldest", "by_tail", "stored")))


@query("SELECT id, row_number() OVER (ORDER BY placed_at::DATE DESC, id) AS newest, row_number() OVER (ORDER BY tail DESC NULLS LAST, id) AS by_tail, row_number() OVER (ORDER BY placed_at DESC, id DESC) AS stored FROM bets")
def srt_grid_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions in the whole grid."""
    rows = tickets(spark, sf_dir).select("id", "placed_at", "tail")
    for name, by_ in (("newest", order.grid_order("placed_at", True)), ("by_tail", order.grid_order("tail", True)), ("stored", order.storage_order())):
        rows = order.ranked(rows, by_, name=name)
    return rows.select("id", "newest", "by_tail", "stored")


@query("WITH s AS (SELECT DISTINCT CASE WHEN n_legs <= 2 THEN '2-leg' WHEN n_legs <= 4 THEN n_legs || '-leg' ELSE '5+ legs' END AS name FROM bets WHERE bet_type <> 'single') SELECT name, CASE name WHEN '5+ legs' THEN 1 WHEN '2-leg' THEN 2 WHEN '3-leg' THEN 3 ELSE 4 END::INTEGER AS position FROM s")
def srt_leg_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In an order of one's own: the long ones first, then those that the list lacks by name."""
    buckets = tickets(spark, sf_dir).filter(money.is_parlay()).select(aggregate.leg_bucket(F.col("n_legs")).alias("name")).distinct()
    return order.positions(buckets, order.rank_order("name", ["5+ legs", "2-leg"]))


@query("WITH f AS (SELECT id, book, sport, CASE WHEN id % 10 = 0 THEN id % 90 WHEN id % 10 = 2 THEN 400 - id % 90 END AS days FROM bets WHERE market_category = 'Futures' AND result = 'pending') SELECT id, (row_number() OVER (PARTITION BY book, sport ORDER BY days NULLS LAST, id))::INTEGER AS position FROM f")
def srt_futures_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("id") % 10
    rows = tickets(spark, sf_dir).filter(filters.open_futures()).select("id", "book", "sport", F.when(n == 0, F.col("id") % 90).when(n == 2, 400 - F.col("id") % 90).alias("days"))
    return order.ranked(rows, order.timeline_order(), ["book", "sport"]).select("id", F.col("position").cast("int").alias("position"))


@query("WITH f AS (SELECT id, CASE WHEN id % 10 = 0 THEN id % 90 WHEN id % 10 = 2 THEN 400 - id % 90 END AS days FROM bets WHERE market_category = 'Futures' AND result = 'pending') SELECT id, row_number() OVER (ORDER BY days NULLS LAST, id) AS position FROM f")
def srt_timeline_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The timeline of all open futures."""
    n = F.col("id") % 10
    rows = tickets(spark, sf_dir).filter(filters.open_futures()).select("id", F.when(n == 0, F.col("id") % 90).when(n == 2, 400 - F.col("id") % 90).alias("days"))
    return order.ranked(rows, order.timeline_order()).select("id", "position")


@query("WITH p AS (SELECT DISTINCT p_name, CASE split_part(p_name, ' ', 1) WHEN 'red' THEN 'Boston Celtics' WHEN 'blue' THEN 'Atlanta Hawks' END AS team FROM part WHERE length(p_name) % 5 <> 0) SELECT p_name AS canonical, CASE team WHEN 'Boston Celtics' THEN 'NBA:BOS' WHEN 'Atlanta Hawks' THEN 'NBA:ATL' END AS team_id, (row_number() OVER (ORDER BY team NULLS LAST, p_name))::INTEGER AS position FROM p")
def srt_players_by_team(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Players with their team's id, by team, then by name."""
    teams = seed.teams(spark).select(F.col("canonical").alias("team"), dims.team_id(F.col("sport"), F.col("abbreviations"), F.col("canonical")).alias("team_id"))
    rows = players(spark, sf_dir).join(teams, "team", "left")
    return order.positions(rows, [F.lower("team").asc_nulls_last(), *order.name_order("canonical")]).select("canonical", "team_id", "position")


# ---- text of rows


@query(
    "WITH a AS (SELECT *, ['Won 5', 'lose', 'PUSH ', 'odd', NULL, 'Loss', 'win'][id % 7 + 1] AS r, ['1', 'true', '0', 'x', NULL][id % 5 + 1] AS f, ['$1,234.5', ' ', 'abc', '-7', '12.345x', '.5'][id % 6 + 1] AS m, ['+110', '150', '-105', '1.5', '', NULL][id % 6 + 1] AS o, "
    "stake / 100.0::DOUBLE AS s, payout / 100.0::DOUBLE AS p, CASE WHEN id % 11 <> 0 THEN odds END AS od FROM bets), "
    "n AS (SELECT *, CASE result WHEN 'win' THEN CASE WHEN id % 2 = 0 AND p > 0 THEN p - s WHEN od > 0 THEN s * od / 100 WHEN od < 0 THEN s * 100 / -od END WHEN 'loss' THEN -s WHEN 'push' THEN 0 END AS net FROM a) "
    "SELECT id, CASE WHEN lower(trim(r)) LIKE 'w%' THEN 'Win' WHEN lower(r) LIKE 'lo%' THEN 'Loss' WHEN lower(r) LIKE 'push%' THEN 'Push' ELSE 'Pending' END AS result_text, CASE WHEN f IN ('1', 'true') THEN '1' WHEN f = '0' THEN '0' ELSE '' END AS flag, CASE WHEN f IN ('1', 'true') THEN '1' ELSE '' END AS single, "
    "CASE m WHEN '$1,234.5' THEN '1234.50' WHEN '-7' THEN '-7.00' WHEN '12.345x' THEN '12.35' WHEN '.5' THEN '0.50' ELSE '' END AS amount, CASE o WHEN '150' THEN '+150' WHEN '1.5' THEN '' ELSE COALESCE(o, '') END AS odds_again, "
    "CASE WHEN result = 'pending' OR net IS NULL OR abs(round(net, 2)) >= 1000 THEN '' ELSE printf('%.2f', net) END AS net_text FROM n"
)
def fmt_row_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda options: F.element_at(F.array(*map(F.lit, options)), (F.col("id") % len(options) + 1).cast("int"))
    stake, payout = F.col("stake") / 100, F.when(F.col("id") % 2 == 0, F.col("payout") / 100)
    flag = pick(["1", "true", "0", "x", None])
    return tickets(spark, sf_dir).select(
        "id", validators.final_result(pick(["Won 5", "lose", "PUSH ", "odd", None, "Loss", "win"])).alias("result_text"), validators.flag(flag).alias("flag"), validators.single_flag(flag).alias("single"),
        validators.parsed_amount(pick(["$1,234.5", " ", "abc", "-7", "12.345x", ".5"])).alias("amount"), validators.parsed_odds(pick(["+110", "150", "-105", "1.5", "", None])).alias("odds_again"),
        validators.row_net_text(F.col("result"), stake, F.when(F.col("id") % 11 != 0, F.col("odds")), payout).alias("net_text"),
    )


# ---- stored tickets and imports


@query("SELECT id FROM bets WHERE result = 'pending' AND id % 4 <> 1")
def jn_queue_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queue items less those that were settled."""
    queue = tickets(spark, sf_dir).filter("result = 'pending'").select("id")
    return queue.join(queue.filter("id % 4 = 1"), "id", "left_anti")


@query("WITH s AS (SELECT entity AS name, count(*)::BIGINT AS legs FROM legs JOIN bets USING (id) WHERE sport = 'ASIA' GROUP BY 1) SELECT name, legs FROM s WHERE name IN (SELECT entity FROM legs WHERE entity_type = 'team')", True)
def jn_entity_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the entities of filtered tickets those that any ticket at all has as a team."""
    all_legs = legs(spark, sf_dir, "sport")
    mine = all_legs.filter("sport = 'ASIA'").groupBy(F.col("entity").alias("name")).agg(F.count("*").alias("legs"))
    return mine.join(all_legs.filter("entity_type = 'team'").select(F.col("entity").alias("name")).distinct(), "name", "left_semi")


@query(
    f"WITH {PLAYERS_SQL} SELECT f.id, leg_no::INTEGER AS leg_no, array_to_string(list_filter([CASE WHEN f.sport IS NULL OR f.sport <> 'NBA' THEN 'sport' END, CASE WHEN entity_type = 'team' THEN 'team unresolved' END, CASE WHEN entity_type = 'player' AND status <> 'resolved' THEN 'player' END, CASE WHEN market_category = 'Props' AND type IS NULL THEN 'type' END], lambda x: x IS NOT NULL), ',') AS issues FROM found f JOIN bets USING (id)",
    True,
)
def res_import_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = asked_players(spark, sf_dir, "market_category", "type")
    of_player = dims.resolve_players(rows.filter("entity_type = 'player'"), players(spark, sf_dir))
    of_team = resolve.resolve_teams(rows.filter("entity_type = 'team'"), seed.teams(spark)).drop("candidates")
    return dims.import_issues(of_player.unionByName(of_team), ["NBA"]).select("id", "leg_no", F.concat_ws(",", "issues").alias("issues"))


@query("SELECT DISTINCT entity AS name, entity_type FROM legs JOIN bets USING (id) WHERE book = 'MACHINERY' AND (entity_type <> 'player' OR length(entity) % 5 = 0)", True)
def res_added_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = legs(spark, sf_dir, "book").filter("book = 'MACHINERY'").select(F.col("entity").alias("name"), "entity_type")
    return dims.added_entities(new, players(spark, sf_dir).select(F.col("canonical").alias("name"), F.lit("player").alias("entity_type")))


@query(
    "WITH p AS (SELECT DISTINCT p_name AS c, split_part(p_name, ' ', 1) AS w FROM part WHERE length(p_name) % 5 <> 0) SELECT c AS canonical, CASE WHEN length(c) % 2 = 0 THEN 'NBA' ELSE 'NFL' END AS sport, w || ' jr' || CASE WHEN w = 'blue' THEN ',Bluey' ELSE '' END AS aliases, CASE WHEN w = 'green' THEN true ELSE w = 'small' END AS disabled FROM p WHERE w <> 'red' "
    "UNION ALL SELECT DISTINCT upper(p_name), 'MLB', '', false FROM part WHERE length(p_name) % 5 = 0"
)
def res_dim_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Red ones go, green ones are disabled, blue ones get an alias; all names are added, which the known ones ignore."""
    dim = players(spark, sf_dir).select("canonical", "sport", "aliases", "disabled")
    word = F.split("canonical", " ")[0]
    edits = dim.select(F.upper("canonical").alias("canonical"), F.when(word == "red", "remove").when(word == "green", "disable").when(word == "blue", "alias").otherwise("add").alias("action"), F.lit("MLB").alias("sport"), F.lit("Bluey").alias("alias"), F.lit(2).alias("seq"))
    more = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.upper("p_name").alias("canonical"), F.lit("add").alias("action"), F.lit("MLB").alias("sport"), F.lit(None).cast("string").alias("alias"), F.lit(1).alias("seq"))
    return dims.edited(dim, edits.unionByName(more)).withColumn("aliases", F.concat_ws(",", "aliases"))


@query("SELECT DISTINCT p_name AS canonical, 'NBA' AS sport FROM part WHERE length(p_name) % 5 <> 0 AND length(p_name) % 2 = 0")
def res_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored rows replace the seed; those of no known sport are dropped."""
    stored = players(spark, sf_dir).select("canonical", F.when(F.col("sport") == "NBA", "NBA").otherwise("?").alias("sport"))
    return dims.overlay(seed.teams(spark).select("canonical", "sport"), stored, F.col("sport").isin("NBA", "NFL", "MLB", "NHL"))


@query(
    "WITH m AS (SELECT id, CASE WHEN id % 6 = 0 THEN 'Main Markets' WHEN id % 6 = 1 THEN NULL WHEN id % 6 = 2 THEN 'odd' ELSE market_category END AS stored, CASE WHEN id % 9 = 0 THEN 'live' ELSE bet_type END AS kind, id % 4 = 0 AS no_live, is_live, name FROM bets) "
    "SELECT id, CASE WHEN stored IN ('Props', 'Futures', 'Parlays') THEN stored ELSE 'again' END AS category, CASE WHEN no_live THEN kind = 'live' ELSE is_live END AS live, CASE WHEN id % 5 = 0 AND name IS NOT NULL THEN name || '|Pts|' || id % 30 END AS leg, id % 7 = 0 OR id IN (1, 2) AS sample FROM m"
)
def prj_migrated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored tickets as they are loaded: category, live mark, a leg made of the old columns, sample mark."""
    from ..operators import store

    n = F.col("id")
    old = tickets(spark, sf_dir).select(
        "id", "name", F.when(n % 5 == 0, "Pts").alias("type"), F.when(n % 5 == 0, (n % 30).cast("string")).alias("line"), F.when(n % 9 == 0, "live").otherwise(F.col("bet_type")).alias("bet_type"), F.when(n % 4 != 0, F.col("is_live")).alias("is_live"),
        F.when(n % 6 == 0, "Main Markets").when(n % 6 == 2, "odd").when(n % 6 != 1, F.col("market_category")).alias("market_category"), (n % 7 == 0).alias("is_sample"), F.lit(None).cast("string").alias("ou"),
    )
    leg = store.leg_of_columns()
    live = F.coalesce("is_live", F.col("bet_type") == "live")
    text = F.when((F.col("id") % 5 == 0) & leg.isNotNull(), F.concat_ws("|", F.get(leg["entities"], F.lit(0)), leg["market"], leg["target"]))
    sample = F.coalesce("is_sample", F.lit(False)) | F.col("id").isin(1, 2)
    return old.select("id", classify.migrated_category(F.col("market_category"), F.lit("again")).alias("category"), live.alias("live"), text.alias("leg"), sample.alias("sample"))


@query("SELECT id, CASE WHEN id % 3 = 0 THEN stake / 100.0::DOUBLE WHEN id % 3 = 1 THEN round(stake / 100.0::DOUBLE, 2) ELSE 0 END AS stake, CASE WHEN id % 2 = 0 THEN tail ELSE NULL END AS tail FROM bets")
def prj_grid_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw number where a row has one, else what its text says, else 0; the tail only where it is marked."""
    from ..operators import rows

    n = F.col("id") % 3
    text = F.when(n == 1, F.concat(F.lit("$"), F.format_number(F.col("stake") / 100, 2))).when(n == 2, "none")
    flat = tickets(spark, sf_dir).select("id", F.when(n == 0, F.col("stake") / 100).alias("raw"), text.alias("text"), "tail", (F.col("id") % 2 == 0).alias("tailed"))
    return flat.select("id", rows.grid_money(F.col("raw"), F.col("text")).alias("stake"), F.when(F.col("tailed"), F.col("tail")).alias("tail"))


@query("SELECT event_type AS operation, count(*)::BIGINT AS count, sum(user_id)::BIGINT AS total, round(avg(user_id), 6) AS mean, max(user_id)::BIGINT AS most, min(user_id)::BIGINT AS least FROM events GROUP BY 1")
def snk_timing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_type").alias("operation"), F.col("user_id").cast("long").alias("ms"))
    return rounded(aggregate.timing_summary(rows), "mean")
