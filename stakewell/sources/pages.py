"""Tickets from sportsbook pages. A small helper lists the fields of a page; what they mean is said in columns."""

from __future__ import annotations

import functools
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import formats, money, text

MOST_CHARS = 5 * 1024 * 1024
BOOKS = ("DraftKings", "FanDuel")
FIELDS = "page_id long, book string, card int, item string, name string, value string, seq int"
CARDS = "page_id long, book string, card int, fields array<struct<seq: int, item: string, name: string, value: string>>"
#: Fields that are held in Python before they are handed on.
FIELDS_AT_ONCE = 20_000
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}

# Patterns of markets' names and the short name of the statistic, the first that fits; those of several statistics come first.
# fmt: off
STATS = [
    (r"(?i)points.*rebounds.*assists|pts.*reb.*ast|pra", "PRA"),
    (r"(?i)points.*rebounds|pts.*reb", "PR"),
    (r"(?i)points.*assists|pts.*ast", "PA"),
    (r"(?i)rebounds.*assists|reb.*ast", "RA"),
    (r"(?i)steals.*blocks|stl.*blk|stocks", "Stocks"),
    (r"(?i)three\s*pointers?\s*made|made\s*threes|3[\s-]*pointers?|threes", "3pt"),
    (r"(?i)points|pts", "Pts"),
    (r"(?i)assists|ast", "Ast"),
    (r"(?i)rebounds|reb", "Reb"),
    (r"(?i)steals|stl", "Stl"),
    (r"(?i)blocks|blk", "Blk"),
    (r"(?i)turnovers", "TO"),
    (r"(?i)first\s*(basket|field\s*goal|fg)", "FB"),
    (r"(?i)double\s*double", "DD"),
    (r"(?i)triple\s*double", "TD"),
    (r"(?i)spread", "Spread"),
    (r"(?i)total", "Total"),
    (r"(?i)moneyline|money\s*line|ml", "Moneyline"),
]
# fmt: on


class _Fields(HTMLParser):
    """Lists (card, item, name, value): marked elements of DraftKings cards, spans and labels of FanDuel list entries."""

    def __init__(self, book: str) -> None:
        super().__init__(convert_charrefs=True)
        self.book, self.rows, self.open = book, [], []
        self.card, self.items, self.counts = -1, [], [0]

    def _add(self, name: str, value: str) -> None:
        value = " ".join(value.replace(" ", " ").split())
        if value:
            self.rows.append((self.card, ".".join(map(str, self.items)), name, value, len(self.rows)))

    def handle_starttag(self, tag, attrs) -> None:
        a = {k: v or "" for k, v in attrs}
        mark, role = a.get("data-test-id", ""), ""
        if self.book == "DraftKings":
            if mark.startswith("bet-card-"):
                self.card, role, self.items, self.counts = self.card + 1, "card", [], [0]
            elif mark == "selection-list-item":
                role = "item"
                self.items, self.counts = [*self.items, self.counts[-1]], [*self.counts[:-1], self.counts[-1] + 1, 0]
            if mark.startswith("sgp"):
                self._add("sgp", mark)
            if tag == "img" and "/teams/" in a.get("src", ""):
                self._add("logo", a["src"])
            if tag == "svg" and a.get("aria-label"):
                self._add("icon", a["aria-label"])
        elif tag == "li":
            self.card += 1
        if self.book == "FanDuel" and a.get("aria-label"):
            self._add("label", a["aria-label"])
        if tag not in VOID:
            self.open.append((tag, mark, role, []))

    def handle_endtag(self, tag) -> None:
        if not any(o[0] == tag for o in self.open):
            return
        while self.open:
            name, mark, role, said = self.open.pop()
            if mark and self.book == "DraftKings" and not role:
                self._add(mark, "".join(said))
            if self.book == "FanDuel" and name == "span":
                self._add("span", "".join(said))
            if role == "item":
                self.items, self.counts = self.items[:-1], self.counts[:-1]
            if self.open:
                self.open[-1][3].extend(said)
            if name == tag:
                break

    def handle_data(self, data) -> None:
        if self.open:
            self.open[-1][3].append(data)


def _listed(book: str, source: str | None) -> list[tuple]:
    """A page's fields; of one that can't be read a field that says so."""
    p = _Fields(book)
    try:
        p.feed(source or "")
        p.close()
    except Exception as e:  # noqa: BLE001: one page must not end the job
        return [(-1, "", "failed", type(e).__name__, 0)]
    return p.rows


def _of_cards(rows: list[tuple]) -> pa.RecordBatch:
    """Fields (page_id, book, card, item, name, value, seq), in order, as one row a card."""
    page, book, card, item, name, value, seq = zip(*rows)
    new = [0, *(i for i in range(1, len(rows)) if (page[i], card[i]) != (page[i - 1], card[i - 1]))]
    at = pa.StructArray.from_arrays([pa.array(seq, pa.int32()), pa.array(item), pa.array(name), pa.array(value)], ["seq", "item", "name", "value"])
    listed = pa.ListArray.from_arrays(pa.array([*new, len(rows)], pa.int32()), at)
    return pa.RecordBatch.from_arrays([pa.array([page[i] for i in new], pa.int64()), pa.array([book[i] for i in new], pa.string()), pa.array([card[i] for i in new], pa.int32()), listed], ["page_id", "book", "card", "fields"])


def cards(pages: DataFrame) -> DataFrame:
    """One row a card of all pages (page_id, book, html) with its fields in order; what stands before the first is card -1.

    A page that can't be read has a field named 'failed'. A task holds one page's text and about FIELDS_AT_ONCE fields.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for b in batches:
            for i in range(b.num_rows):
                page_id, book, source = (c[i].as_py() for c in b.columns)
                held.extend((page_id, book, *row) for row in _listed(book, source))
                if len(held) >= FIELDS_AT_ONCE:
                    yield _of_cards(held)
                    held = []
        if held:
            yield _of_cards(held)

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "book", "html").mapInArrow(run, CARDS)


def fields(pages: DataFrame) -> DataFrame:
    """The fields of all pages (page_id, book, html), a row each; a page that can't be read has one named 'failed'."""
    return cards(pages).select("page_id", "book", "card", F.explode("fields").alias("f")).select("page_id", "book", "card", "f.item", "f.name", "f.value", "f.seq")


def gathered(found: DataFrame) -> DataFrame:
    """found by cards: as it is, if it comes of `cards`; else the rows of `fields`, put together again."""
    if "fields" in found.columns:
        return found
    return found.groupBy("page_id", "card").agg(F.sort_array(F.collect_list(F.struct("seq", "item", "name", "value"))).alias("fields"))


def route(pages: DataFrame, books: list[str] | tuple = BOOKS) -> DataFrame:
    """pages with error_code: empty, too large, or of a book that isn't read; null if it may be parsed."""
    code = F.when(F.trim(F.coalesce("html", F.lit(""))) == "", "EMPTY_HTML").when(F.length("html") > MOST_CHARS, "INPUT_TOO_LARGE").when(~F.coalesce(F.col("book").isin(*books), F.lit(False)), "PARSER_NOT_AVAILABLE")
    return pages.withColumn("error_code", code)


def without_tickets(pages: DataFrame, tickets: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """Routed pages with NO_BETS_FOUND where no ticket came of them, PARSER_FAILED where their fields (found) say so."""
    some = tickets.select("page_id").distinct().withColumn("some", F.lit(True))
    rows = pages.join(some, "page_id", "left").withColumn("failed", F.lit(None).cast("boolean"))
    if found is not None:
        failed = found.filter(F.exists("fields", lambda f: f["name"] == "failed") if "fields" in found.columns else F.col("name") == "failed")
        rows = rows.drop("failed").join(failed.select("page_id", F.lit(True).alias("failed")).distinct(), "page_id", "left")
    code = F.coalesce("error_code", F.when(F.col("failed"), "PARSER_FAILED"), F.when(F.col("some").isNull(), "NO_BETS_FOUND"))
    return rows.withColumn("error_code", code).drop("some", "failed", "html")


def bet_type_text(t: Column) -> Column:
    low = F.lower(F.coalesce(t, F.lit("")))
    return F.when(low.rlike(r"sgpx|sgp\+|sgp plus"), "sgp_plus").when(low.rlike(r"\bsgp\b|same game parlay"), "sgp").when(low.contains("parlay"), "parlay")


def stat_type(market: Column) -> Column:
    out = F.lit(None).cast("string")
    for pattern, short in reversed(STATS):
        out = F.when(market.rlike(pattern), short).otherwise(out)
    return out


def _first(of: Column, fits) -> Column:
    """The value of the first of a card's fields whose name fits."""
    return F.get(F.filter(of, lambda f: fits(f["name"])), F.lit(0))["value"]


def _starts(*of: str):
    return lambda name: functools.reduce(lambda a, b: a | b, (name.startswith(o) for o in of))


def _selections() -> Column:
    """The selections of a card in the order of their first fields: item path and what stands in them; one that holds others is a group."""
    items = F.array_distinct(F.transform(F.filter("fields", lambda f: f["item"] != ""), lambda f: f["item"]))
    above = F.transform(F.filter(items, lambda i: i.contains(".")), lambda i: F.regexp_replace(i, r"\.\d+$", ""))

    def one(item: Column) -> Column:
        mine = F.filter("fields", lambda f: f["item"] == item)
        return F.struct(
            item.alias("item"), F.get(mine, F.lit(0))["seq"].alias("seq"), _first(mine, _starts("bet-selection-title-")).alias("title"), _first(mine, _starts("bet-selection-subtitle-")).alias("subtitle"),
            _first(mine, _starts("bet-selection-displayOdds-")).alias("odds_text"), F.lower(F.coalesce(_first(mine, lambda n: n == "icon"), F.lit(""))).alias("icon"), F.array_contains(above, item).alias("group"),
        )

    return F.transform(items, one)


def _read_selection(s: Column) -> Column:
    """Item path, entity, market, target, odds and result of a selection."""
    result = F.when(s["icon"].contains("success") | s["icon"].contains("check"), "WIN").when(s["icon"].contains("x sign") | s["icon"].contains("cross"), "LOSS").when(s["icon"].contains("void"), "PUSH").otherwise("PENDING")
    suffix = "(?i)\\s+(?:points \\+ rebounds \\+ assists|points|rebounds|assists|made threes|threes|three pointers made|steals|blocks|turnovers|double-?double|triple-?double)(?:\\s*o/u)?$"
    line = F.nullif(F.regexp_extract(s["title"], r"(\d+\+|[+-]?\d+(?:\.\d+)?)\s*$", 1), F.lit(""))
    ou = F.initcap(F.nullif(F.regexp_extract(s["title"], r"(?i)^(over|under)\b", 1), F.lit("")))
    group = s["group"]
    return F.struct(
        s["item"].alias("item"), s["seq"].alias("seq"), group.alias("is_group_leg"), F.when(~group, F.regexp_replace(s["subtitle"], suffix, "")).alias("entity"),
        F.when(group, s["title"]).otherwise(F.coalesce(stat_type(s["subtitle"]), s["subtitle"])).alias("market"), F.when(~group, line).alias("target"), F.when(~group, ou).alias("ou"),
        text.american_odds(s["odds_text"]).alias("odds"), result.alias("result"),
    )


def draftkings_legs(found: DataFrame) -> DataFrame:
    """One row a selection: item path, entity, market, target, odds and result; a selection that holds others is a group."""
    rows = gathered(found).select("page_id", "card", _selections().alias("s")).select("page_id", "card", F.explode(F.transform("s", _read_selection)).alias("x"))
    return rows.select("page_id", "card", "x.item", "x.seq", "x.is_group_leg", "x.entity", "x.market", "x.target", "x.ou", "x.odds", "x.result")


def draftkings_tickets(found: DataFrame) -> DataFrame:
    """One row a bet card, its selections as legs (children of groups one level down). Made inside each card: nothing is shuffled if found is by cards."""
    named = {
        "placed_text": lambda n: n.rlike(r"^bet-reference-.*-0$"), "bet_id": lambda n: n.rlike(r"^bet-reference-.*-1$"), "stake_text": _starts("bet-stake-"), "paid_text": lambda n: n.rlike(r"^bet-returns-\d"), "status": _starts("bet-details-status-"),
        "title": _starts("bet-details-title-"), "subtitle": _starts("bet-details-subtitle-"), "odds_text": _starts("bet-details-displayOdds-"), "logo": lambda n: n == "logo",
    }
    card = gathered(found).filter("card >= 0").withColumns({c: _first(F.col("fields"), fits) for c, fits in named.items()}).filter("bet_id IS NOT NULL")
    card = card.withColumns({"sgp": F.exists("fields", lambda f: (f["name"] == "sgp") & (f["item"] == "")), "sgpx": F.exists("fields", lambda f: F.lower(f["value"]).contains("sgpx")), "s_": _selections()})
    cash = lambda c: F.coalesce(text.amount(F.regexp_extract(c, r"\$([\d,]+(?:\.\d+)?)", 1)), F.lit(0.0)).cast("decimal(18,2)")
    status = F.lower(F.trim("status"))
    bet_type = F.when(F.col("sgpx"), "sgp_plus").when(F.col("sgp"), "sgp").otherwise(F.coalesce(bet_type_text(F.col("subtitle")), bet_type_text(F.col("title")), F.lit("single")))
    card = card.withColumns({"bet_type": bet_type, "l_": F.transform("s_", _read_selection)})
    given = lambda x: (x["seq"].alias("seq"), F.array_compact(F.array(x["entity"])).alias("entities"))
    leaf = lambda x: F.struct(*given(x), F.lit("player").alias("entity_type"), x["market"].alias("market"), x["target"].alias("target"), x["ou"].alias("ou"), x["odds"].alias("odds"), F.lower(x["result"]).alias("result"))

    def head(x: Column) -> Column:
        """A leg of its own with those below it; null where none are."""
        below = F.transform(F.filter("l_", lambda y: y["item"].contains(".") & (F.substring_index(y["item"], ".", 1) == x["item"])), leaf)
        return F.struct(x.alias("x"), F.when(F.size(below) > 0, below).alias("children"))

    def leg(h: Column) -> Column:
        x, children = h["x"], h["children"]
        # The outcome of a group is that of its children, as this book has it: a push needs all of them.
        of_children = F.lower(money.group_result(F.transform(F.coalesce(children, F.array()), lambda c: c["result"]), True))
        own = F.when(x["is_group_leg"], F.coalesce(of_children, F.lower(x["result"]))).otherwise(F.lower(x["result"]))
        kind = F.when(x["is_group_leg"], "unknown").otherwise("player")
        return F.struct(*given(x), kind.alias("entity_type"), x["market"].alias("market"), x["target"].alias("target"), x["ou"].alias("ou"), x["odds"].alias("odds"), own.alias("result"), x["is_group_leg"].alias("is_group_leg"), children.alias("children"))

    heads = F.transform(F.filter("l_", lambda x: ~x["item"].contains(".")), head)
    rows = card.withColumn("h_", heads).withColumn("legs", F.when(F.size("h_") > 0, F.transform("h_", leg)))
    parlay = money.is_parlay()
    live = F.coalesce(F.col("subtitle").rlike(r"(?i)\blive\b"), F.lit(False))
    market = F.trim(F.regexp_replace("subtitle", r"(?i)\blive\b", ""))
    line = F.nullif(F.regexp_extract("title", r"([+-]?\d+(?:\.\d+)?)\s*$", 1), F.lit(""))
    described = F.array_join(F.flatten(F.transform("legs", lambda x: F.when(x["is_group_leg"], F.transform(x["children"], lambda c: F.concat_ws(" ", c["market"], c["target"]))).otherwise(F.array(F.concat_ws(" ", x["market"], x["target"]))))), ", ")
    return rows.select(
        "page_id", F.col("bet_id").alias("id"), F.lit("DraftKings").alias("book"), "bet_id", formats.draftkings_date(F.col("placed_text")).alias("placed_at"), "bet_type",
        F.coalesce(F.upper(F.nullif(F.regexp_extract("logo", r"(?i)/teams/([a-z]+)/", 1), F.lit(""))), F.lit("Unknown")).alias("sport"),
        F.when(parlay, F.coalesce(described, "subtitle")).otherwise(market).alias("description"), F.when(~parlay, F.trim(F.regexp_replace("title", r"\s*[+-]?\d+(?:\.\d+)?\s*$", ""))).alias("name"),
        F.when(~parlay, F.coalesce(stat_type(market), market)).alias("type"), F.when(~parlay, line).alias("line"), F.when(~parlay, F.initcap(F.nullif(F.regexp_extract("title", r"(?i)^(over|under)\b", 1), F.lit("")))).alias("ou"),
        text.american_odds(F.col("odds_text")).alias("odds"), cash("stake_text").alias("stake"), cash("paid_text").alias("payout"),
        F.when(status == "won", "win").when(status == "lost", "loss").when(status == "void", "push").otherwise("pending").alias("result"), live.alias("is_live"), "legs",
    )


def fanduel_tickets(found: DataFrame) -> DataFrame:
    """One row a footer with a bet id, with the header entry above it.

    Legs are read from the spans of the header: a name, and behind it a text that holds a line and a statistic.
    """
    of = lambda name: F.transform(F.filter("fields", lambda f: f["name"] == name), lambda f: f["value"])
    spans = gathered(found).select("page_id", "card", of("span").alias("spans"), F.array_join(of("label"), " | ").alias("labels")).where(F.size("spans") > 0)
    cards = spans.select("page_id", "card", "spans", F.array_join("spans", " ").alias("said"), "labels")
    cards = cards.withColumn("bet_id", F.nullif(F.regexp_extract("said", r"(?i)BET\s*ID[:\s]+([A-Z0-9/]+)", 1), F.lit("")))
    from pyspark.sql import Window

    above = Window.partitionBy("page_id").orderBy("card").rowsBetween(Window.unboundedPreceding, -1)
    head = F.last(F.when(F.col("bet_id").isNull(), F.struct("spans", "said", "labels")), ignorenulls=True).over(above)
    rows = cards.withColumn("head", head).filter("bet_id IS NOT NULL AND head IS NOT NULL")

    def labelled(*names: str) -> Column:
        """The amount beside the first of the labels that has one above zero."""
        beside = [F.coalesce(text.amount(F.regexp_extract("said", rf"\$([\d,]+\.\d\d)\s+{n}\b", 1)), text.amount(F.regexp_extract("said", rf"\b{n}\s+\$([\d,]+\.\d\d)", 1))) for n in names]
        return F.coalesce(*[F.nullif(b, F.lit(0.0)) for b in beside])

    # Read once, in steps: what is used several times below isn't put into each of its uses.
    rows = rows.withColumns({"stake_": labelled("TOTAL WAGER", "WAGER", "STAKE"), "won_": labelled("WON ON FANDUEL", "WON", "PAID"), "back_": labelled("RETURNED", "REFUNDED"), "upper_": F.upper("said"), "stamp_": formats.fanduel_date(F.col("said")), "whole_": F.concat_ws(" ", "head.said", "head.labels")})
    stake, said, said_won = F.col("stake_"), F.col("upper_"), F.col("upper_").contains("WON ON FANDUEL")
    rows = rows.withColumn("paid_", F.coalesce("won_", "back_", F.lit(0.0)))
    payout = F.col("paid_")
    settled = said.contains("SETTLED") | F.col("head.said").rlike(r"(?i)\bfinished\b")
    result = F.when(said_won & (payout > 0), "win").when(said.contains("RETURNED"), F.when(F.abs(payout - stake) < 1e-4, "push").when(payout == 0, "loss").otherwise("win")).when(settled & (payout == 0), "loss").when(payout > stake, "win").when(F.abs(payout - stake) < 1e-4, "push").otherwise("pending")
    whole = F.col("whole_")
    bet_type = F.when(whole.rlike(r"(?i)same game parlay\s*(?:plus|\+)|includes:? \d same game"), "sgp_plus").when(whole.rlike("(?i)same game parlay"), "sgp").when(whole.rlike(r"(?i)\d+[- ]leg parlay|\bparlay\b"), "parlay").otherwise("single")
    stamp = F.col("stamp_")
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.size("head.spans") - 1, F.lit(1))), lambda i: F.struct(F.get("head.spans", i - 1).alias("entity"), F.get("head.spans", i).alias("market")))
    leg_text = r"(?i)(?:to record |to score )?(\d+\+) (?:made )?(points|rebounds|assists|threes|steals|blocks)|(?:over|under) \d+(?:\.\d+)?"
    chosen = F.filter(pairs, lambda p: p["market"].rlike(leg_text) & p["entity"].rlike(r"^[A-Z][\p{L}.'-]+(?: [A-Z][\p{L}.'-]+)+$"))
    legs = F.transform(chosen, lambda p: F.struct(F.array(p["entity"]).alias("entities"), F.lit("player").alias("entity_type"), F.coalesce(stat_type(p["market"]), p["market"]).alias("market"), F.coalesce(F.nullif(F.regexp_extract(p["market"], r"(\d+\+)", 1), F.lit("")), F.nullif(F.regexp_extract(p["market"], r"(\d+(?:\.\d+)?)", 1), F.lit(""))).alias("target"), F.when(p["market"].rlike(r"(?i)under"), "Under").otherwise("Over").alias("ou")))
    odds = text.american_odds(F.regexp_extract(F.translate(whole, "−", "-"), r"Odds\s+([+-]\d+)", 1))
    return rows.select(
        "page_id", F.concat_ws(":", F.lit("FanDuel"), "bet_id", F.date_format(stamp, "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("id"), F.lit("FanDuel").alias("book"), "bet_id", stamp.alias("placed_at"), bet_type.alias("bet_type"),
        F.regexp_extract(whole, r"([A-Z0-9][\w.]*(?: [A-Z0-9][\w.]*)* @ [A-Z0-9][\w.]*(?: [A-Z0-9][\w.]*)*)", 1).alias("matchup"), odds.alias("odds"),
        F.coalesce(stake, F.lit(0.0)).cast("decimal(18,2)").alias("stake"), payout.cast("decimal(18,2)").alias("payout"), result.alias("result"), legs.alias("legs"),
    )
