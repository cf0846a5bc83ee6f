"""Named queries over stored tables, versions in time, documents, numbered files, rules and indexes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import lookup_key, queue_id
from ..operators import dims, history, order, rules, search, store
from ..sources import documents, lines
from ..sources.adapter import legs, tickets
from ..sources.shared import new_folder
from ..sources.versioned import VersionedTable
from .wagers import query


def _one_of(options: list, by) -> Column:
    return F.element_at(F.array(*map(F.lit, options)), (by % len(options) + 1).cast("int"))


# ---- the versioned table


def _stored(spark: SparkSession, sf_dir: str) -> VersionedTable:
    table = VersionedTable(spark, new_folder(spark, "ticket-table"), buckets=32)
    table.save(tickets(spark, sf_dir).select("id", "stake", "odds", "result", "payout", "tail", "book"))
    return table


@query("SELECT id, CASE WHEN id % 1000 = 7 THEN 'push' ELSE result END AS result, CASE WHEN id % 1000 = 7 THEN stake ELSE payout END AS payout, tail FROM bets WHERE id % 1000 <> 11 UNION ALL SELECT id + 100000000, 'pending', 0, tail FROM bets WHERE id % 500 = 3")
def jn_stored_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One ticket in a thousand becomes a push, one goes, and new ones come, some of which are there already: three versions of a stored table."""
    table, bets = _stored(spark, sf_dir), tickets(spark, sf_dir)
    changes = bets.where("id % 1000 = 7").select("id", F.array(F.lit("result")).alias("set"), F.lit("push").alias("result"))
    table.change(changes, lambda rows: store.update(rows, changes, ["result"]))
    table.delete(bets.where("id % 1000 = 11").select("id"))
    new = bets.where("id % 500 = 3").select((F.col("id") + 100_000_000).alias("id"), "stake", "odds", F.lit("pending").alias("result"), F.lit(0).cast("long").alias("payout"), "tail", "book")
    table.insert(new.unionByName(bets.where("id % 500 = 4").select(*new.columns)))
    return table.read().select("id", "result", "payout", "tail")


@query("SELECT 0 AS version, book, count(*)::BIGINT AS n, sum(stake)::BIGINT AS stake FROM bets GROUP BY 2 UNION ALL SELECT 1, book, count(*)::BIGINT, sum(stake)::BIGINT FROM bets WHERE result <> 'loss' GROUP BY 2")
def jn_stored_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table before and after losses were deleted, read after it was cleared."""
    table = _stored(spark, sf_dir)
    table.delete(tickets(spark, sf_dir).where("result = 'loss'").select("id"))
    table.clear()
    out = None
    for version in table.versions():
        rows = table.read(version).groupBy("book").agg(F.count("*").alias("n"), F.sum("stake").alias("stake")).select(F.lit(version).alias("version"), "book", "n", "stake")
        out = rows if out is None else out.unionByName(rows)
    return out


# ---- dimensions in time


ALIAS_EDITS = [("gs", "Golden State Warriors", "1990-01-01", 1), ("gs", "Boston Celtics", "1995-06-15", 2), ("gs", "Golden State Warriors", "1997-02-01", 3), ("ne", "New England Patriots", "1994-03-01", 4), ("ne", None, "1996-01-01", 5), ("atl", "Atlanta Hawks", "1995-06-15", 6), ("atl", "Atlanta Falcons", "1995-06-15", 7)]


def alias_edits(spark: SparkSession) -> DataFrame:
    """Whom an alias stands for from a day on; no name: it stands for nobody any more."""
    return spark.createDataFrame(ALIAS_EDITS, "alias string, team string, day string, seq int").withColumn("day", F.col("day").cast("timestamp_ntz"))


@query(
    "WITH e(alias, team, day, seq) AS (VALUES " + ", ".join(f"('{a}', {repr(t) if t else 'NULL'}, TIMESTAMP '{d}', {n})" for a, t, d, n in ALIAS_EDITS) + "), "
    "s AS (SELECT *, lead(day) OVER (PARTITION BY alias ORDER BY day, seq) AS upto, row_number() OVER (PARTITION BY alias ORDER BY day, seq) AS version FROM e) "
    "SELECT b.id, b.name, s.team, s.version FROM bets b LEFT JOIN s ON lower(trim(b.name)) = s.alias AND b.placed_at >= s.day AND (s.upto IS NULL OR b.placed_at < s.upto)"
)
def res_alias_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each ticket's name as it was meant when the ticket was placed."""
    edits = history.valid_spans(alias_edits(spark), "alias", "day", "seq")
    rows = tickets(spark, sf_dir).select("id", "name", F.col("placed_at").cast("timestamp_ntz").alias("placed_at"), F.nullif(lookup_key("name"), F.lit("")).alias("k"))
    return history.as_of(rows, edits, "k", "placed_at", "alias", "day", "seq", ["team", "version"]).select("id", "name", "team", "version")


@query(
    "WITH q AS (SELECT book || '|' || sport AS k, placed_at AS t, arg_max(odds, id) AS quoted FROM bets WHERE is_live GROUP BY 1, 2), m AS (SELECT *, book || '|' || sport AS k FROM bets) "
    "SELECT m.id, m.odds, q.quoted FROM m ASOF LEFT JOIN q ON m.k = q.k AND m.placed_at >= q.t"
)
def jn_quote_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beside each ticket the odds that its book last gave live in its sport."""
    rows = tickets(spark, sf_dir).select("id", "odds", "placed_at", "is_live", F.concat_ws("|", "book", "sport").alias("k"))
    quotes = rows.where("is_live").select(F.col("k").alias("qk"), F.col("placed_at").alias("qt"), F.col("id").alias("qs"), F.col("odds").alias("quoted"))
    return history.as_of(rows, quotes, "k", "placed_at", "qk", "qt", "qs", ["quoted"]).select("id", "odds", "quoted")


@query("SELECT CASE WHEN length(p_name) % 2 = 0 THEN 'NBA:' || upper(left(p_name, 2)) ELSE 'NFL:' || left(upper(replace(p_name, ' ', '')), 6) END AS team_id, min(p_name) AS team, count(*)::BIGINT AS legs FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1")
def res_team_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Legs that hold a team's id instead of its name, by the team: the first by name of those that share an id."""
    names = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_name").alias("name")).distinct()
    even = F.length("name") % 2 == 0
    short = F.when(even, F.array(F.upper(F.substring("name", 1, 2)))).otherwise(F.array().cast("array<string>"))
    ids = names.select("name", dims.team_id(F.when(even, "NBA").otherwise("NFL"), short, F.col("name")).alias("team_id"))
    asked = legs(spark, sf_dir).select(F.col("entity").alias("name")).join(ids, "name").select("team_id")
    return dims.teams_by_id(asked, ids).groupBy("team_id", "team").agg(F.count("*").alias("legs"))


# ---- documents of any version


_KIND = "CASE WHEN (year(placed_at) + month(placed_at)) % 7 = 0 THEN 'list' WHEN (year(placed_at) + month(placed_at)) % 7 = 1 THEN 'newer' WHEN (year(placed_at) + month(placed_at)) % 7 = 2 THEN 'corrupt' WHEN (year(placed_at) + month(placed_at)) % 7 = 3 THEN 'shape' WHEN (year(placed_at) + month(placed_at)) % 7 = 4 THEN 'blank' WHEN (year(placed_at) + month(placed_at)) % 7 = 5 THEN 'old' ELSE 'present' END"


@query(
    f"WITH d AS (SELECT book, sport, placed_at::DATE AS day, {_KIND} AS kind, count(*)::BIGINT AS n, sum(stake)::BIGINT AS stake, count(tail)::BIGINT AS tails FROM bets GROUP BY ALL) "
    "SELECT CASE kind WHEN 'list' THEN 'upgraded' WHEN 'old' THEN 'upgraded' WHEN 'blank' THEN 'missing' WHEN 'present' THEN 'ok' ELSE kind END AS status, CASE kind WHEN 'list' THEN 0 WHEN 'old' THEN 0 WHEN 'newer' THEN 9 WHEN 'present' THEN 1 WHEN 'shape' THEN 1 END AS was, count(*)::BIGINT AS documents, "
    "sum(CASE WHEN kind IN ('list', 'old', 'present') THEN n ELSE 0 END)::BIGINT AS bets, sum(CASE WHEN kind IN ('list', 'old', 'present') THEN stake ELSE 0 END)::BIGINT AS stake, sum(CASE WHEN kind IN ('list', 'old', 'present') THEN tails ELSE 0 END)::BIGINT AS tails FROM d GROUP BY 1, 2"
)
def src_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored document for each book, sport and day: bare lists, old, present and newer versions, some without stakes, cut off or blank."""
    when = F.col("placed_at")
    kind = _one_of(["list", "newer", "corrupt", "shape", "blank", "old", "present"], F.year(when) + F.month(when))
    rows = tickets(spark, sf_dir).select("book", "sport", F.to_date(when).alias("day"), kind.alias("kind"), F.struct("id", "stake", "odds", "result", "tail", F.struct("name", "type").alias("more")).alias("bet"))
    docs = rows.groupBy("book", "sport", "day", "kind").agg(F.collect_list("bet").alias("bets"))
    listed = F.to_json("bets")
    whole = lambda version, body: F.concat(F.lit(f'{{"version":{version},"updatedAt":"2024-01-01","bets":'), body, F.lit("}"))
    text = F.when(F.col("kind") == "list", listed).when(F.col("kind") == "newer", whole(9, listed)).when(F.col("kind") == "corrupt", F.concat(F.lit("["), listed)).when(F.col("kind") == "shape", whole(1, F.regexp_replace(listed, '"stake"', '"amount"')))
    text = text.when(F.col("kind") == "blank", " ").when(F.col("kind") == "old", whole(0, listed)).otherwise(whole(1, listed))
    read = documents.read_documents(docs.select(F.monotonically_increasing_id().alias("doc_no"), text.alias("value"))).drop("value")
    bets = documents.tickets_of(read, stake="stake:bigint", tail="tail:string")
    totals = bets.groupBy("status", "was").agg(F.count("*").alias("bets"), F.sum("stake").alias("stake"), F.count("tail").alias("tails"))
    counted = read.groupBy("status", "was").agg(F.count("*").alias("documents"))
    both = counted.withColumns({c: F.lit(0).cast("long") for c in ("bets", "stake", "tails")}).unionByName(totals.withColumn("documents", F.lit(0).cast("long")))
    return both.groupBy("status", "was").agg(*(F.sum(c).alias(c) for c in ("documents", "bets", "stake", "tails")))


# ---- files by lines


@query(
    "WITH m AS (SELECT id, id % 7 = 0 AS o, id % 11 = 0 AS s, id % 13 = 0 AS w FROM bets WHERE id % 5 <> 0) "
    "SELECT id, true AS in_order, CASE WHEN o OR s OR w THEN 'Invalid number format for ' || array_to_string(list_filter([CASE WHEN o THEN 'Odds' END, CASE WHEN s THEN 'Bet' END, CASE WHEN w THEN 'To Win' END], lambda x: x IS NOT NULL), ', ') || '.' END AS error FROM m UNION ALL SELECT id, true, NULL FROM m WHERE id % 3 = 0"
)
def src_numbered_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tickets written as text files, some lines twice and blank ones between, and read again: every line has its number, bad cells are named."""
    from ..sources import csv_tickets

    folder = new_folder(spark, "csv-lines")
    n = F.col("id")
    bets = tickets(spark, sf_dir).where(n % 5 != 0).select("id", "stake", "odds", F.explode(F.when(n % 3 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("again"))
    # The second of two equal lines is read like the first: its cells are all good.
    cell = lambda bad, good: F.when(bad & (F.col("again") == 0), F.lit("abc")).otherwise(good)
    line = F.concat_ws(",", F.lit("1/2/2024"), F.lit("FD"), F.lit("NBA"), F.lit("Pts"), n.cast("string"), cell(n % 7 == 0, F.concat(F.lit("+"), F.abs("odds"))), cell(n % 11 == 0, F.concat(F.lit("$"), F.col("stake").cast("string"))), cell(n % 13 == 0, F.lit("10")), F.lit("won"))
    blank = F.when(n % 4 == 0, F.array(line, F.lit("  "))).otherwise(F.array(line))
    ordered = bets.repartitionByRange("id", "again").sortWithinPartitions("id", "again")
    ordered.select(F.explode(blank).alias("value")).write.text(folder)
    rows = csv_tickets.cells(lines.numbered_lines(spark, folder), csv_tickets.REQUIRED)
    told = csv_tickets.numeric_errors(rows)
    place = F.row_number().over(Window.partitionBy("file").orderBy(F.col("Name").cast("long"), "line_no"))  # a file's rows: a check of the query, not of the reader
    return told.select(F.col("Name").cast("long").alias("id"), (place == F.col("line_no")).alias("in_order"), "error")


# ---- rules and indexes


_STATS = ["Points", "Total Rebounds", "Points + Rebounds", "Pts + Reb + Ast", "Steals + Blocks", "Made Threes", "Turnovers", "Rebounds and Assists", "First Basket", "Yards", "Double Double", "PTS & AST", "Top Scorer", "Shots on Goal", "3-Pointers"]
_FORMS = ["Over {n}.5 {s}", "To Record {n}+ {s}", "{s}", "Under  {n} {s}", "To Score {n} + {s}"]


@query(
    "WITH a AS (SELECT l_orderkey AS id, l_linenumber AS line_no, [" + ", ".join(f"'{s}'" for s in _STATS) + f"][l_partkey % {len(_STATS)} + 1] AS s, (l_quantity::INTEGER)::VARCHAR AS n, l_suppkey % {len(_FORMS) + 1} AS f FROM lineitem), "
    "m AS (SELECT id, line_no, CASE f " + " ".join(f"WHEN {i} THEN '{x}'".replace("{n}", "' || n || '").replace("{s}", "' || s || '") for i, x in enumerate(_FORMS)) + " END AS market FROM a), "
    "c AS (SELECT *, trim(regexp_replace(regexp_replace(market, '\\s+', ' ', 'g'), '^to\\s+record\\s+', '', 'i')) AS t FROM m), "
    "b AS (SELECT *, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '\\d+(\\.\\d+)?\\s*\\+?', '', 'g'), 'over\\s+', '', 'gi'), 'under\\s+', '', 'gi'), 'to\\s+score\\s+', '', 'gi')) AS bare FROM c), l AS (SELECT *, lower(bare) AS x FROM b), "
    "h AS (SELECT *, contains(x, 'points') OR contains(x, 'pts') AS p, contains(x, 'reb') AS r, contains(x, 'assists') OR contains(x, 'ast') AS a FROM l) "
    "SELECT id, line_no::INTEGER AS line_no, market, CASE WHEN market IS NULL THEN '' WHEN contains(x, 'first basket') THEN 'FB' WHEN contains(x, 'top scorer') THEN 'Top Pts' WHEN contains(x, 'double double') THEN 'DD' WHEN p AND r AND a THEN 'PRA' WHEN p AND r THEN 'PR' WHEN r AND a THEN 'RA' WHEN p AND a THEN 'PA' "
    "WHEN contains(x, 'steals') AND contains(x, 'blocks') THEN 'Stocks' WHEN contains(x, 'threes') OR contains(x, '3-pointers') THEN '3pt' WHEN p THEN 'Pts' WHEN a THEN 'Ast' WHEN r THEN 'Reb' WHEN contains(x, 'turnovers') OR contains(x, 'to') THEN 'TO' WHEN bare <> '' THEN bare ELSE t END AS kind, "
    "CASE WHEN market IS NULL THEN '' WHEN regexp_matches(t, '\\d\\s*\\+') THEN regexp_extract(t, '(\\d+(\\.\\d+)?)\\s*\\+', 1) || '+' ELSE regexp_extract(t, '(\\d+(\\.\\d+)?)', 1) END AS line, CASE WHEN regexp_matches(t, 'over\\s+\\d+', 'i') THEN 'Over' WHEN regexp_matches(t, 'under\\s+\\d+', 'i') THEN 'Under' END AS side FROM h"
)
def str_market_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Market texts of lines, sides and one or more statistics, read by the rule table."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    s, n = _one_of(_STATS, F.col("l_partkey")), F.col("l_quantity").cast("int").cast("string")
    made = F.array(*[F.concat(*[n if p == "{n}" else s if p == "{s}" else F.lit(p) for p in _split(x)]) for x in _FORMS])
    rows = li.select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").cast("int").alias("line_no"), F.get(made, (F.col("l_suppkey") % (len(_FORMS) + 1)).cast("int")).alias("market"))
    return rules.market_texts(rows, rules.market_rules(spark)).select("id", "line_no", "market", "kind", "line", "side")


def _split(form: str) -> list[str]:
    import re

    return [p for p in re.split(r"(\{n\}|\{s\})", form) if p]


@query("SELECT id, term FROM bets, (VALUES ('HAWKS'), ('rs'), ('c'), ('a odd'), ('zebra')) v(term) WHERE contains(lower(COALESCE(name, '')), lower(term)) OR contains(lower(COALESCE(tail, '')), lower(term)) OR contains(lower(description), lower(term))")
def flt_indexed_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tickets that hold a term in a name, a tail or a description, by trigrams of the distinct values."""
    bets = tickets(spark, sf_dir).select("id", "name", "tail", "description")
    indexes = {c: search.trigram_index(bets, c) for c in ("name", "tail", "description")}
    return search.searched(bets, ["HAWKS", "rs", "c", "a odd", "zebra"], indexes).select("id", "term")


@query("WITH p AS (SELECT DISTINCT CASE WHEN length(p_name) % 3 = 0 THEN replace(p_name, 'e', 'é') WHEN length(p_name) % 3 = 1 THEN upper(left(p_name, 1)) || substr(p_name, 2) ELSE p_name END AS name FROM part UNION SELECT p_name FROM part) SELECT name, (row_number() OVER (ORDER BY lower(strip_accents(name)), strip_accents(name) <> name, name = lower(name) DESC))::INTEGER AS position FROM p")
def srt_collated_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names with accents and capitals in the order of a dictionary."""
    name, n = F.col("p_name"), F.length("p_name") % 3
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    other = F.when(n == 0, F.replace(name, F.lit("e"), F.lit("é"))).when(n == 1, F.concat(F.upper(F.substring(name, 1, 1)), F.substring(name, 2, 999))).otherwise(name)
    rows = part.select(other.alias("name")).union(part.select(name)).distinct()
    return order.positions(rows, order.name_order("name"))


# ---- dimensions and queues as stored tables


@query(
    "WITH p AS (SELECT DISTINCT p_name AS c, split_part(p_name, ' ', 1) AS w FROM part WHERE length(p_name) % 5 <> 0) "
    "SELECT 0 AS version, c AS canonical, w || ' jr' AS aliases, w = 'small' AS disabled FROM p UNION ALL SELECT 1, CASE WHEN w = 'blue' THEN 'The ' || c ELSE c END, w || ' jr' || CASE WHEN w = 'blue' THEN ',' || c ELSE '' END, CASE WHEN w = 'green' THEN true ELSE w = 'small' END FROM p WHERE w <> 'red'"
)
def res_dim_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Players before and after edits, as versions of a stored table: red ones go, green ones are disabled, blue ones get another name."""
    from .registry import players

    table = VersionedTable(spark, new_folder(spark, "players"), key="canonical", buckets=4)
    table.save(players(spark, sf_dir).select("canonical", "sport", "aliases", "disabled"))
    dim, word = table.read(), F.split("canonical", " ")[0]
    action = F.when(word == "red", "remove").when(word == "green", "disable").when(word == "blue", "rename")
    edits = dim.select("canonical", action.alias("action"), "sport", F.concat(F.lit("The "), F.col("canonical")).alias("alias"), F.lit(1).alias("seq")).where("action IS NOT NULL")
    table.save(dims.edited(dim, edits))
    both = [table.read(v).select(F.lit(v).alias("version"), "canonical", F.concat_ws(",", "aliases").alias("aliases"), "disabled") for v in table.versions()]
    return both[0].unionByName(both[1])


@query(
    "WITH q AS (SELECT lower(entity) || '::' || id || '::' || leg_no AS item_id, entity, entity_type FROM legs WHERE leg_result = 'PENDING') SELECT item_id, entity AS raw_value FROM q WHERE NOT (entity_type = 'player' AND entity IN (SELECT entity FROM q WHERE entity_type = 'player' GROUP BY entity HAVING count(*) >= (SELECT avg(n) FROM (SELECT count(*) AS n FROM q WHERE entity_type = 'player' GROUP BY entity))))",
    True,
)
def jn_queue_settled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The queue after the players that stand in it most often were settled: all items of a settled entity leave the stored queue."""
    queue = legs(spark, sf_dir).where("leg_result = 'PENDING'").select(queue_id(F.col("entity"), F.col("id"), F.col("leg_no")).alias("item_id"), F.col("entity").alias("raw_value"), "entity_type")
    table = VersionedTable(spark, new_folder(spark, "queue"), key="item_id", buckets=16)
    table.save(queue)
    counted = table.read().where("entity_type = 'player'").groupBy("raw_value").agg(F.count("*").alias("n"))
    often = counted.join(F.broadcast(counted.agg(F.avg("n").alias("mean"))), F.col("n") >= F.col("mean")).select("raw_value")  # the mean is one row
    table.delete(table.read().where("entity_type = 'player'").join(often, "raw_value", "left_semi").select("item_id"))
    return table.read().select("item_id", "raw_value")
