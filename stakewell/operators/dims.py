"""Reference dimensions: players, futures, sports, edits, and what an import finds wrong with them.

Dimensions are seeds with a user's additions, of whatever size: whether one is broadcast is left to Spark.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import lookup_key, spaced
from ..sources.shared import written
from . import resolve


def player_index(players: DataFrame) -> DataFrame:
    """scope (a sport, or '' for any), lookup_key, canonical (the first), n (canonicals that share the key).

    players: seq, canonical, sport, aliases and, it may be, disabled: those have no names.
    """
    players = resolve.enabled(players)
    names = F.array_union(F.array("canonical"), F.coalesce("aliases", F.array().cast("array<string>")))
    keys = players.select("seq", "canonical", F.explode(F.array("sport", F.lit(""))).alias("scope"), names.alias("names")).select("seq", "canonical", "scope", F.explode("names").alias("name"))
    keys = keys.select("seq", "canonical", "scope", lookup_key("name").alias("lookup_key")).filter("lookup_key <> '' AND scope IS NOT NULL")
    return keys.groupBy("scope", "lookup_key").agg(F.min_by("canonical", "seq").alias("canonical"), F.countDistinct("canonical").alias("n"))


def resolve_players(names: DataFrame, players: DataFrame, raw: str = "name", sport: str = "sport") -> DataFrame:
    """names with canonical and status.

    The player of the row's sport comes before one of any sport; a name that several players share, in the sport or at all, is
    ambiguous. Distinct (name, sport) are resolved once and joined back; rows without a name aren't joined at all.
    """
    index = player_index(players)
    asked = names.filter(F.col(raw).isNotNull()).select(F.col(raw).alias("r"), F.coalesce(F.col(sport), F.lit("")).alias("s")).distinct().withColumn("k", lookup_key("r"))
    own = index.filter("scope <> ''").select(F.col("scope").alias("s"), F.col("lookup_key").alias("k"), F.col("canonical").alias("own"), F.col("n").alias("own_n"))
    anyone = index.filter("scope = ''").select(F.col("lookup_key").alias("k"), F.col("canonical").alias("any"), F.col("n").alias("any_n"))
    found = asked.join(own, ["s", "k"], "left").join(anyone, "k", "left")
    several = F.greatest(F.coalesce("own_n", F.lit(0)), F.coalesce("any_n", F.lit(0))) > 1
    status = F.when(F.trim("r") == "", "unresolved").when(several, "ambiguous").when(F.coalesce("own", "any").isNotNull(), "resolved").otherwise("unresolved")
    found = found.select("r", "s", F.coalesce("own", "any", spaced(F.col("r"))).alias("canonical"), status.alias("status"))
    same = (F.col(raw) == F.col("r")) & (F.coalesce(F.col(sport), F.lit("")) == F.col("s"))
    return resolve.looked_up(names, found, same, F.col(raw).isNotNull()).withColumns({"canonical": F.coalesce("canonical", F.lit("")), "status": F.coalesce("status", F.lit("unresolved"))}).drop("r", "s")


def entity_keys(legs: DataFrame, players: DataFrame, teams: DataFrame, raw: str = "name") -> DataFrame:
    """legs with key: the player's or team's canonical name by entity_type, one bucket for all that resolve to no single one.

    An entity of unknown type is a team if a team has the name, else a player. Distinct names with sport and type are stored
    and resolved once, then joined back; legs are read twice and shuffled only if there are very many such names.
    """
    asked = legs.where(F.col(raw).isNotNull()).select(F.col(raw).alias("n_"), F.coalesce("sport", F.lit("")).alias("s_"), F.coalesce("entity_type", F.lit("unknown")).alias("e_")).distinct()
    asked = written(asked, "asked-names")
    known = resolve.alias_index(teams).select(F.col("lookup_key").alias("tk"))
    rows = asked.withColumn("k", lookup_key("n_")).join(known, F.col("k") == F.col("tk"), "left")
    rows = rows.withColumn("is_team", (F.col("e_") == "team") | (F.col("e_") == "unknown") & F.col("tk").isNotNull()).drop("k", "tk")
    of_team = resolve.resolve_teams(rows.filter("is_team"), teams, "n_").drop("candidates")
    of_player = resolve_players(rows.filter("NOT is_team"), players, "n_", "s_")
    keys = of_team.unionByName(of_player).select("n_", "s_", "e_", resolve.aggregation_key(F.col("canonical"), F.col("status")).alias("key"))
    same = (F.col(raw) == F.col("n_")) & (F.coalesce("sport", F.lit("")) == F.col("s_")) & (F.coalesce("entity_type", F.lit("unknown")) == F.col("e_"))
    return resolve.looked_up(legs, keys, same, F.col(raw).isNotNull()).select(*legs.columns, F.coalesce("key", F.lit(resolve.UNRESOLVED)).alias("key"))


def sport_of_legs(bets: DataFrame, teams: DataFrame, types: DataFrame) -> DataFrame:
    """id, sport of nested tickets: of the first leg whose entity is a team, or whose market only one sport has, that sport; else what the description's words tell, else Other.

    Entities go one by one through all legs in order; at each the team is asked before the market. Distinct names and
    markets are looked up once.
    """
    by_team = resolve.alias_index(teams).select(F.col("lookup_key").alias("tk"), F.col("sport").alias("of_team"))
    by_type = sports_of_types(resolve.enabled(types)).filter(F.size("sports") == 1).select(F.col("bet_key").alias("bk"), F.col("sports")[0].alias("of_type"))
    legs = bets.select("id", F.posexplode("legs").alias("leg_no", "leg")).select("id", "leg_no", F.col("leg.market").alias("market"), F.posexplode("leg.entities").alias("place", "entity"))
    pairs = legs.select("entity", "market").distinct().withColumns({"ek": lookup_key("entity"), "mk": F.lower(F.trim("market"))})
    found = pairs.join(by_team, F.col("ek") == F.col("tk"), "left").join(by_type, F.col("mk") == F.col("bk"), "left").select(F.col("entity").alias("e_"), F.col("market").alias("m_"), F.coalesce("of_team", "of_type").alias("told")).where("told IS NOT NULL")
    said = resolve.looked_up(legs, found, F.col("entity").eqNullSafe(F.col("e_")) & F.col("market").eqNullSafe(F.col("m_")), F.lit(True)).where("told IS NOT NULL")
    first = said.groupBy("id").agg(F.min_by("told", F.struct("leg_no", "place")).alias("told"))
    return bets.join(first, "id", "left").select("id", F.coalesce("told", sport_of_words(F.col("description")), F.lit("Other")).alias("sport"))


def canonical_futures(rows: DataFrame, futures: DataFrame, text: str = "market", sport: str = "sport") -> DataFrame:
    """rows with future: the sport's own future of that name, else that of any sport (the last listed), else the text itself.

    futures is the seed: a few dozen rows.
    """
    keys = futures.select("seq", "canonical", "sport", F.explode(F.transform(F.array_union(F.array("canonical"), "aliases"), F.lower)).alias("fk"))
    own = keys.filter("sport IS NOT NULL").groupBy("fk", F.col("sport").alias("fs")).agg(F.max_by("canonical", "seq").alias("own"))
    anyone = keys.groupBy(F.col("fk").alias("ak")).agg(F.max_by("canonical", "seq").alias("any"))
    key = F.lower(F.trim(text))
    out = rows.join(own, (key == F.col("fk")) & (F.col(sport) == F.col("fs")), "left").join(anyone, key == F.col("ak"), "left")
    return out.withColumn("future", F.coalesce("own", "any", F.trim(text))).drop("fk", "fs", "own", "ak", "any")


# Words of a description that tell the sport, in the order in which the first wins.
SPORT_WORDS = [
    ("NBA", ["nba", "basketball"]),
    ("NFL", ["nfl", "football"]),
    ("MLB", ["mlb", "baseball"]),
    ("NHL", ["nhl", "hockey"]),
    ("NCAAB", ["ncaab", "college basketball", "march madness"]),
    ("NCAAF", ["ncaaf", "college football"]),
    ("UFC", ["ufc", "mma", "mixed martial arts"]),
    ("Soccer", ["soccer", "football", "premier league", "champions league", "mls"]),
    ("Tennis", ["tennis", "wimbledon", "us open", "french open", "australian open"]),
]


def sport_of_words(description: Column) -> Column:
    d = F.lower(description)
    return F.coalesce(*[F.when(d.rlike("|".join(words)), sport) for sport, words in SPORT_WORDS])


def sports_of_types(types: DataFrame) -> DataFrame:
    """bet_key, sports: the sports that have a bet type of that name."""
    names = F.array_union(F.array("canonical"), "aliases")
    return types.select("sport", F.explode(names).alias("name")).groupBy(F.lower("name").alias("bet_key")).agg(F.sort_array(F.collect_set("sport")).alias("sports"))


def inferred_sport(rows: DataFrame, teams: DataFrame, types: DataFrame, team: str = "team", bet_type: str = "market", description: str = "description") -> DataFrame:
    """rows with inferred: the team's sport, else that of a bet type which one sport alone has, else what the description's words tell."""
    by_team = resolve.alias_index(teams).select(F.col("lookup_key").alias("tk"), F.col("sport").alias("team_sport"))
    by_type = sports_of_types(types).filter(F.size("sports") == 1).select("bet_key", F.col("sports")[0].alias("type_sport"))
    out = rows.join(by_team, lookup_key(team) == F.col("tk"), "left").join(by_type, F.lower(F.trim(bet_type)) == F.col("bet_key"), "left")
    return out.withColumn("inferred", F.coalesce("team_sport", "type_sport", sport_of_words(F.col(description)))).drop("tk", "team_sport", "bet_key", "type_sport")


def team_id(sport: Column, abbreviations: Column, canonical: Column) -> Column:
    """sport:ABBR; without an abbreviation the first six letters and digits of the name."""
    own = F.substring(F.upper(F.regexp_replace(canonical, "[^a-zA-Z0-9]", "")), 1, 6)
    return F.concat_ws(":", sport, F.coalesce(F.get(abbreviations, F.lit(0)), own))


def teams_by_id(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """rows with team: the name of the team of their team_id, the first by name where teams share one; null if there is none."""
    return rows.join(ids.groupBy("team_id").agg(F.min("name").alias("team")), "team_id", "left")


def deduped_aliases(aliases: Column, key) -> Column:
    """The first alias of each key, in order; blank ones go. key: the function that makes a name's key."""
    # Bound once by the outer lambda: named inside the inner one, all keys would be made again for each alias.
    chosen = lambda keys: F.filter(aliases, lambda a, i: (F.get(keys, i) != "") & (F.array_position(keys, F.get(keys, i)) == i + 1))
    return F.get(F.transform(F.array(F.transform(aliases, key)), chosen), F.lit(0))


def overlay(seed: DataFrame, stored: DataFrame, valid: Column) -> DataFrame:
    """The stored dimension's valid rows; the seed if it has none."""
    good = stored.filter(valid)
    return good.unionByName(seed.join(good.select(F.lit(1).alias("one")).limit(1), F.lit(True), "left_anti"))


def edited(dim: DataFrame, edits: DataFrame) -> DataFrame:
    """The dimension after edits, the last by seq of each name (whatever its case): add (if new), alias, rename, disable, enable or remove.

    edits: canonical, action, sport, alias, seq. A rename takes the new name from alias and keeps the old one as an alias, so
    that what was stored under it still resolves.
    """
    last = edits.groupBy(F.lower("canonical").alias("k")).agg(F.max_by(F.struct("canonical", "action", "sport", "alias"), "seq").alias("e"))
    both = dim.join(last, F.lower(dim["canonical"]) == F.col("k"), "left")
    action = F.col("e.action")
    more = F.when(action == "alias", F.array("e.alias")).when(action == "rename", F.array(dim["canonical"]))
    changed = both.filter(F.coalesce(action, F.lit("")) != "remove").select(
        F.when(action == "rename", F.col("e.alias")).otherwise(dim["canonical"]).alias("canonical"), dim["sport"], F.when(more.isNotNull(), F.array_union(dim["aliases"], more)).otherwise(dim["aliases"]).alias("aliases"),
        F.when(action == "disable", True).when(action == "enable", False).otherwise(dim["disabled"]).alias("disabled"),
    )
    new = last.filter("e.action = 'add'").join(dim.select(F.lower("canonical").alias("dk")), F.col("k") == F.col("dk"), "left_anti")
    return changed.unionByName(new.select("e.canonical", "e.sport", F.array().cast("array<string>").alias("aliases"), F.lit(False).alias("disabled")))


def added_entities(legs: DataFrame, known: DataFrame) -> DataFrame:
    """name, entity_type of the players and teams that an import adds to the pick lists; those of unknown type never."""
    rows = legs.filter(F.col("entity_type").isin("player", "team") & (F.trim("name") != "")).select("name", "entity_type").distinct()
    return rows.join(known.select("name", "entity_type"), ["name", "entity_type"], "left_anti")


def import_issues(rows: DataFrame, sports: list[str]) -> DataFrame:
    """rows with issues: what keeps a leg from being understood. rows hold entity_type, status (of the name), sport, type and market_category."""
    messages = F.array(
        F.when(~F.coalesce(F.col("sport").isin(*sports), F.lit(False)), "sport"),
        F.when((F.col("entity_type") == "team") & (F.col("status") == "ambiguous"), "team ambiguous").when((F.col("entity_type") == "team") & (F.col("status") != "resolved"), "team unresolved"),
        F.when((F.col("entity_type") == "player") & (F.col("status") != "resolved"), "player"),
        F.when((F.col("market_category") == "Props") & (F.coalesce(F.trim("type"), F.lit("")) == ""), "type"),
    )
    return rows.withColumn("issues", F.array_compact(messages))


def leg_issues(rows: DataFrame, sports: list[str], teams: DataFrame, listed: DataFrame, market: str = "market", name: str = "name", sport: str = "sport") -> DataFrame:
    """rows with issues: what keeps a leg from being understood, and category (by its market).

    A name in a main market is a team's and is resolved; any other has to stand, letter by letter, in the list of its
    sport's players (listed: canonical, sport). A leg without a name has no issue of it.
    """
    from ..functions import classify

    m = F.lower(F.coalesce(market, F.lit("")))
    category = classify.leg_category(F.col(market))
    team = (category == "Main Markets") | m.isin("spread", "total", "moneyline")
    some = F.trim(F.coalesce(name, F.lit(""))) != ""
    known = listed.select(F.col("canonical").alias("who_"), F.col("sport").alias("of_"), F.lit(True).alias("on_")).distinct()
    marked = rows.withColumns({"category": category, "team_": team, "some_": some})
    resolved = resolve.resolve_teams(marked.where("some_ AND team_"), teams, name).drop("canonical", "candidates").withColumn("on_", F.lit(None).cast("boolean"))
    players = resolve.looked_up(marked.where("some_ AND NOT team_"), known, (F.col(name) == F.col("who_")) & (F.col(sport) == F.col("of_")), F.col(sport).isNotNull()).drop("who_", "of_").withColumn("status", F.lit(None).cast("string"))
    none = marked.where("NOT some_").withColumns({"on_": F.lit(None).cast("boolean"), "status": F.lit(None).cast("string")})
    said = F.when(F.trim(F.coalesce(sport, F.lit(""))) == "", "sport missing").when(~F.col(sport).isin(*sports), "sport unknown")
    who = F.when(F.col("some_") & F.col("team_"), F.when(F.col("status") == "unresolved", "team unknown").when(F.col("status") == "ambiguous", "team ambiguous")).when(F.col("some_") & F.col("on_").isNull(), "player unknown")
    kind = F.when((F.coalesce(market, F.lit("")) == "") & (F.col("category") == "Props"), "type missing")
    out = resolved.unionByName(players).unionByName(none)
    return out.withColumn("issues", F.array_compact(F.array(said, F.when(F.trim(F.col("category")) == "", "category missing"), who, kind))).drop("team_", "some_", "on_", "status")


def ticket_issues(bets: DataFrame, sports: list[str], teams: DataFrame, listed: DataFrame) -> DataFrame:
    """id, issues of tickets: sport, and for singles the name (their own, else their first leg's) and the type of a prop.

    bets: nested tickets. A single's name is a team's if its leg's market, or its own category, is a main market.
    """
    first = F.get("legs", F.lit(0))
    single = (F.col("bet_type") == "single") | (F.coalesce(F.size("legs"), F.lit(0)) <= 1)
    main = F.lower(F.coalesce("market_category", F.lit(""))).contains("main")
    market = F.coalesce(F.nullif(first["market"], F.lit("")), F.nullif("type", F.lit("")))
    rows = bets.select("id", "sport", F.when(single, F.coalesce(F.nullif("name", F.lit("")), F.get(first["entities"], F.lit(0)))).alias("name"), F.when(main, "moneyline").otherwise(market).alias("market"), (single & (F.coalesce("type", F.lit("")) == "") & F.lower(F.coalesce("market_category", F.lit(""))).contains("prop")).alias("untyped"))
    out = leg_issues(rows, sports, teams, listed)
    kept = F.filter("issues", lambda i: i != "type missing")
    return out.select("id", F.when(F.col("untyped"), F.array_append(kept, F.lit("type missing"))).otherwise(kept).alias("issues"))


def searched(dim: DataFrame, query: str, sport: str | None = None, disabled: bool = False) -> DataFrame:
    """Rows of a dimension that hold a term in their name, an alias, an abbreviation or their team."""
    q = query.strip().lower()
    has = lambda c: F.coalesce(F.lower(c).contains(q), F.lit(False))
    lists = [F.exists(F.coalesce(F.col(c), F.array().cast("array<string>")), has) for c in ("aliases", "abbreviations") if c in dim.columns]
    hit = has(F.col("canonical"))
    for more in [*lists, *([has(F.col("team"))] if "team" in dim.columns else [])]:
        hit = hit | more
    rows = dim if sport is None else dim.filter(F.col("sport") == sport)
    rows = rows if disabled else rows.filter(~F.coalesce(F.col("disabled"), F.lit(False)))
    return rows.filter(hit) if q else rows
