"""What must not grow faster than the input: shuffles of whole tickets, pages, tasks that hold a group."""

from pyspark.sql import functions as F

from stakewell.operators import dims, resolve, search
from stakewell.plans import pages as plans_pages
from stakewell.plans import wagers
from stakewell.sources import adapter, pages

SF = "/root/testdata/sf0.001"


def planned(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_lines_go_once_to_their_order_and_tickets_nowhere(spark):
    plan = planned(adapter.made_nested(spark, SF))
    assert plan.count("Exchange hashpartitioning(l_orderkey") == 1
    assert "rangepartitioning" not in plan and "Window" not in plan
    # Words are made behind the shuffle: what is shuffled has no column of them.
    assert "market" not in plan[plan.index("Exchange hashpartitioning(l_orderkey") :]


def test_the_store_is_in_order_of_time_inside_each_file(spark):
    rows = adapter.nested(spark, SF).select(F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("n"), "placed_at").orderBy("n").collect()
    for file in {r.file for r in rows}:
        at = [r.placed_at for r in rows if r.file == file]
        assert at == sorted(at)


def test_groups_of_legs_are_made_inside_tickets(spark):
    assert "Exchange" not in planned(adapter.grouped(spark, SF))


def test_a_day_of_many_tickets_is_on_many_pages(spark):
    rows = spark.range(2_000).select(F.lit("2024-01-01").cast("date").alias("day"), "id", F.concat(F.lit("<i>"), "id", F.lit("</i>")).alias("card"))
    found = plans_pages._pages(rows, "DraftKings", 0, lambda html: html).select("page_id", F.size(F.split("html", "<i>")).alias("n"), "html").collect()
    assert len(found) > 40 and max(r.n for r in found) < 100 and {r.page_id >> plans_pages.PAGE_BITS for r in found} == {19_723}
    assert sum(r.html.count("<i>") for r in found) == 2_000


def test_tasks_that_make_and_read_pages_grow_in_number_not_in_size(spark, monkeypatch):
    monkeypatch.setattr(plans_pages, "TICKETS_A_PART", 100, raising=False)
    rows = spark.range(2_000).select(F.lit("2024-01-01").cast("date").alias("day"), "id", F.concat(F.lit("<li><span>"), "id", F.lit("</span></li>")).alias("card"))
    found = plans_pages._pages(rows, "FanDuel", 0, lambda html: html)
    assert planned(found).count("Exchange") == 1
    dealt = pages.cards(found).groupBy(F.spark_partition_id().alias("part")).count().collect()
    assert sum(r["count"] for r in dealt) == 2_000 and max(r["count"] for r in dealt) < 400


def test_cards_are_read_without_a_shuffle(spark):
    from .test_wagers import CARD, PARLAY

    raw = spark.createDataFrame([(1, "DraftKings", (CARD + PARLAY) * 50)], "page_id long, book string, html string")
    assert "Exchange" not in planned(pages.draftkings_tickets(pages.cards(raw)))
    by_card, by_field = (sorted(map(str, pages.draftkings_tickets(found).collect())) for found in (pages.cards(raw), pages.fields(raw)))
    assert by_card == by_field and len(by_card) == 100


def test_rows_stay_where_few_values_are_looked_up(spark, monkeypatch):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, None), (4, "a")], "id long, k string")
    known = spark.createDataFrame([("a", 10), ("z", 20)], "key string, n long")
    ask = lambda: resolve.looked_up(rows, known, F.col("k") == F.col("key"), F.col("k").isNotNull()).select("id", "n")
    few = ask()
    assert "BroadcastHashJoin" in planned(few) and "Exchange hashpartitioning" not in planned(few)
    monkeypatch.setattr(resolve, "MOST_BROADCAST", 0)
    assert sorted(map(tuple, ask().collect()), key=str) == sorted(map(tuple, few.collect()), key=str) == [(1, 10), (2, None), (3, None), (4, 10)]


def test_lookups_of_queries_leave_rows_where_they_are(spark):
    for name in ("str_team_info", "res_players", "str_market_texts", "prj_sheet_rows", "agg_queue_items", "jn_entity_members", "prj_stripes", "agg_by_team", "res_import_issues", "flt_indexed_search", "n_group_result", "agg_contract_messages"):
        assert "SortMergeJoin" not in planned(wagers.QUERIES[name](spark, SF)), name


def test_all_terms_are_searched_at_once(spark):
    rows = spark.createDataFrame([(1, "Red Hawks", None), (2, None, "hawk eye"), (3, "Owls", "red"), (4, None, None)], "id long, a string, b string")
    indexes = {c: search.trigram_index(rows, c) for c in ("a", "b")}
    assert sorted((r.id, r.term) for r in search.searched(rows, ["hawk", "RED", "x"], indexes).collect()) == [(1, "RED"), (1, "hawk"), (2, "hawk"), (3, "RED")]


def test_keys_of_aliases_are_made_once(spark):
    # Twice: the planned expression and its name. It was 6.
    made = planned(spark.createDataFrame([(["A", "a ", "", "b"],)], "x array<string>").select(dims.deduped_aliases(F.col("x"), lambda c: F.lower(F.trim(c)))))
    assert made.count("lower(trim(") == 2
