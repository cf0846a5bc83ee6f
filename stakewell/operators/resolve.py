"""Names to canonical entities: an index of aliases, an equi-join, and a part match for the rest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import lookup_key
from ..sources.shared import written

UNRESOLVED = "[Unresolved]"
#: Distinct values with what they resolve to that are broadcast at most; they are counted before.
MOST_BROADCAST = 100_000


def looked_up(rows: DataFrame, known: DataFrame, same: Column, asked: Column) -> DataFrame:
    """rows with the columns of known where `same` holds, nulls else; asked: rows that can have a match at all.

    known is stored and counted. A few distinct values are broadcast, so that rows are read once and stay where they are,
    whatever share of them has one value; of many, only rows that ask are shuffled.
    """
    known = written(known, "known")
    if known.count() <= MOST_BROADCAST:
        return rows.join(F.broadcast(known), same, "left")
    return rows.where(asked).join(known, same, "left").unionByName(rows.where(~asked), allowMissingColumns=True)


def alias_index(entities: DataFrame, with_abbreviations: bool = True) -> DataFrame:
    """lookup_key, canonical, sport (of the first definition) and candidates (all canonicals of the key, sorted).

    entities: seq, canonical, sport, aliases and, for teams, abbreviations. seq is the order of definition.
    """
    names = F.array_union(F.array("canonical"), F.array_union("aliases", "abbreviations") if with_abbreviations else F.col("aliases"))
    rows = enabled(entities).select("seq", "canonical", "sport", F.explode(names).alias("alias")).select("seq", "canonical", "sport", lookup_key("alias").alias("lookup_key")).filter("lookup_key <> ''")
    first = F.min_by(F.struct("canonical", "sport"), "seq")
    return rows.groupBy("lookup_key").agg(first.alias("f"), F.sort_array(F.collect_set("canonical")).alias("candidates")).select("lookup_key", "f.canonical", "f.sport", "candidates")


def enabled(entities: DataFrame) -> DataFrame:
    """Entities that may be resolved to: disabled ones have no names."""
    return entities.where(~F.coalesce(F.col("disabled"), F.lit(False))) if "disabled" in entities.columns else entities


def known_teams(rows: DataFrame, teams: DataFrame, name: str = "name") -> DataFrame:
    """rows with is_team: whether their name is a team's. Distinct names are looked up once; rows without one aren't joined."""
    said = rows.select(F.col(name).alias("n_")).where(F.col("n_").isNotNull()).distinct()
    hit = said.withColumn("lookup_key", lookup_key("n_")).join(alias_index(teams).select("lookup_key"), "lookup_key").select("n_", F.lit(True).alias("t_"))
    return looked_up(rows, hit, F.col(name) == F.col("n_"), F.col(name).isNotNull()).withColumn("is_team", F.coalesce("t_", F.lit(False))).drop("n_", "t_")


def short_markets(rows: DataFrame, types: DataFrame) -> DataFrame:
    """market, sport, short of the distinct markets: what stands in brackets at the end, else the bet type of that name, else the text."""
    from ..functions import classify

    pairs = resolve_bet_types(rows.select("market", "sport").distinct(), types)
    return pairs.select("market", "sport", F.coalesce(classify.in_brackets(F.col("market")), "canonical", F.trim("market")).alias("short"))


def part_matches(names: DataFrame, entities: DataFrame) -> DataFrame:
    """raw, canonical of names that begin or end with a team's abbreviation and hold a part of one of its aliases.

    names: distinct raw names that no alias matched. The abbreviation is an equality on the first or last word, so
    this is two equi-joins; aliases are compared only inside such a pair. The first team in seed order wins.
    """
    words = F.split(F.trim("raw"), r"\s+")
    ends = names.select("raw", words.alias("words")).filter(F.size("words") > 1)
    ends = ends.select("raw", "words", F.explode(F.array_distinct(F.array(F.lower(F.get("words", F.lit(0))), F.lower(F.element_at("words", -1))))).alias("abbr"))
    short = enabled(entities).select("seq", "canonical", "aliases", F.explode("abbreviations").alias("a")).select("seq", "canonical", "aliases", F.lower("a").alias("abbr"))
    pairs = ends.join(short, "abbr")
    others = F.filter(F.transform("words", F.lower), lambda w: w != F.col("abbr"))
    fits = F.exists(others, lambda w: F.exists(F.transform("aliases", F.lower), lambda a: a.contains(w) | w.contains(a)))
    return pairs.filter(fits).groupBy("raw").agg(F.min_by("canonical", "seq").alias("canonical"))


def resolve_teams(names: DataFrame, entities: DataFrame, raw: str = "name") -> DataFrame:
    """names with canonical, candidates and status: resolved, ambiguous or unresolved.

    Distinct names are resolved once and joined back, so a name that a third of all rows hold is looked up once.
    """
    distinct = names.select(F.col(raw).alias("raw")).filter(F.col("raw").isNotNull()).distinct().withColumn("lookup_key", lookup_key("raw"))
    exact = distinct.join(alias_index(entities), "lookup_key", "left")
    rest = part_matches(exact.filter("canonical IS NULL").select("raw"), entities).withColumnRenamed("canonical", "part")
    found = exact.join(rest, "raw", "left")
    canonical = F.coalesce("canonical", "part", F.trim("raw"))
    status = F.when(F.trim("raw") == "", "unresolved").when(F.size(F.coalesce("candidates", F.array().cast("array<string>"))) > 1, "ambiguous").when(F.col("canonical").isNotNull() | F.col("part").isNotNull(), "resolved").otherwise("unresolved")
    known = found.select(F.col("raw").alias("__raw"), canonical.alias("canonical"), "candidates", status.alias("status"))
    return looked_up(names, known, F.col(raw) == F.col("__raw"), F.col(raw).isNotNull()).withColumn("status", F.coalesce("status", F.lit("unresolved"))).drop("__raw")


def team_info(names: DataFrame, entities: DataFrame, raw: str = "name") -> DataFrame:
    """names with team, team_sport and short (its first abbreviation) of the team that a name resolves to, by an alias or by its parts; null if to none."""
    known = entities.select(F.col("canonical").alias("c_"), F.col("sport").alias("team_sport"), F.get("abbreviations", F.lit(0)).alias("short"))
    named = resolve_teams(names, entities, raw).withColumn("team", F.when(F.col("status") != "unresolved", F.col("canonical")))
    return looked_up(named, known, F.col("team") == F.col("c_"), F.col("team").isNotNull()).select(*names.columns, "team", "team_sport", "short")


def resolve_teams_in_sport(names: DataFrame, entities: DataFrame, raw: str = "name", sport: str = "sport") -> DataFrame:
    """As resolve_teams, but only teams of the row's sport count: one of several candidates may be left, a team of another sport is none."""
    rows = resolve_teams(names, entities, raw)
    dim = entities.agg(F.map_from_entries(F.collect_list(F.struct("canonical", "sport"))).alias("__sports"))  # one row: the seed
    rows = rows.crossJoin(F.broadcast(dim))
    mine = F.filter(F.coalesce("candidates", F.array().cast("array<string>")), lambda c: F.element_at("__sports", c) == F.col(sport))
    several = F.size(F.coalesce("candidates", F.array().cast("array<string>"))) > 1
    anyone = F.coalesce(F.col(sport), F.lit("")) == ""
    own = F.coalesce(F.try_element_at("__sports", F.col("canonical")) == F.col(sport), F.lit(False))
    status = F.when(anyone, F.col("status")).when(several & (F.size(mine) > 1), "ambiguous").when((several & (F.size(mine) == 1)) | own, "resolved").otherwise("unresolved")
    rows = rows.withColumn("__status", status)
    canonical = F.when(anyone | (F.col("__status") == "ambiguous"), F.col("canonical")).when(several & (F.size(mine) == 1), mine[0]).when(F.col("__status") == "resolved", F.col("canonical")).otherwise(F.trim(raw))
    return rows.withColumn("canonical", canonical).withColumn("status", F.col("__status")).drop("__status", "__sports")


def aggregation_key(canonical: Column, status: Column) -> Column:
    return F.when(status == "resolved", canonical).otherwise(UNRESOLVED)


def resolve_bet_types(rows: DataFrame, types: DataFrame, market: str = "market", sport: str = "sport") -> DataFrame:
    """rows with canonical: of the same sport if it has the name, else of the first sport that does, else null."""
    keyed = enabled(types).select("seq", "canonical", "sport", F.explode(F.array_distinct(F.transform(F.array_union(F.array("canonical"), F.col("aliases")), F.lower))).alias("k"))
    any_sport = keyed.groupBy("k").agg(F.min_by("canonical", "seq").alias("any_canonical")).withColumnRenamed("k", "__k")
    own_sport = keyed.groupBy("k", "sport").agg(F.min_by("canonical", "seq").alias("own_canonical")).select(F.col("k").alias("__k2"), F.col("sport").alias("__s"), "own_canonical")
    out = rows.withColumn("__key", lookup_key(market))
    out = out.join(any_sport, F.col("__key") == F.col("__k"), "left").join(own_sport, (F.col("__key") == F.col("__k2")) & (F.col(sport) == F.col("__s")), "left")
    return out.withColumn("canonical", F.coalesce("own_canonical", "any_canonical")).drop("__key", "__k", "__k2", "__s", "any_canonical", "own_canonical")


def cross_sport_names(players: DataFrame) -> DataFrame:
    """Names that players of more than one sport have."""
    return players.groupBy(F.lower("canonical").alias("name")).agg(F.sort_array(F.collect_set("sport")).alias("sports")).filter(F.size("sports") > 1)


def ranked_options(options: DataFrame, query: str, limit: int | None = None) -> DataFrame:
    """Options that answer a query, best first. options: value, label, aliases."""
    from ..functions.text import match_score

    rows = options.withColumn("score", match_score(query, F.col("value"), F.col("label"), F.col("aliases"))).filter("score > 0")
    rows = rows.orderBy(F.desc("score"), F.length("label"), F.size(F.split(F.trim("label"), r"\s+")), F.length("value"), "label", "value")
    return rows.limit(limit) if limit else rows


def first_per_key(rows: DataFrame, key: Column, seq: str) -> DataFrame:
    order = Window.partitionBy(key).orderBy(seq)
    return rows.withColumn("__n", F.row_number().over(order)).filter("__n = 1").drop("__n")


def option_display(value: Column, label: Column) -> Column:
    """value and label, once if they are the same."""
    return F.when(value == label, value).otherwise(F.concat(value, F.lit(" — "), label))


def option_is(value: Column, asked: str) -> Column:
    """Whether a value is the one asked for, in the way searches compare."""
    from ..functions.text import search_key

    return search_key(value) == search_key(F.lit(asked))
