"""A third of all rows on one key: results stay whole, and no join leaves the key in one task."""

import contextlib
import io
from collections import Counter

import pytest
from pyspark.sql import functions as F

from cardloom.operators import audit, codes, paging, products, summaries

ROWS = 30_000
SETTINGS = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.shuffle.partitions": "16",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k",
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "4k",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "16k",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
}


@pytest.fixture()
def small_limits(spark):
    """Cluster conditions in small: nothing is broadcast by size, and partitions count as hot early."""
    before = {name: spark.conf.get(name, None) for name in SETTINGS}
    for name, value in SETTINGS.items():
        spark.conf.set(name, value)
    yield spark
    for name, value in before.items():
        spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def hot(spark, other=2000):
    """Row numbers with a key: every third row has the key ``hot``."""
    key = F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise((F.col("id") % other).cast("string"))
    return spark.range(0, ROWS, 1, 8).withColumn("key", key)


def run(table):
    rows = table.collect()
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        table.explain()
    return rows, text.getvalue()


def test_backfill_splits_a_hot_card(small_limits):
    cards = hot(small_limits).select(
        F.col("id").cast("string").alias("deck_id"), F.lit(0).alias("pos"), F.col("key").alias("card_id"),
        F.when(F.col("id") % 5 == 0, F.lit("X 1/1")).otherwise(F.lit(" ")).alias("card_code"), F.lit("n").alias("card_name"),
    )
    known = small_limits.range(2000).select(F.col("id").cast("string").alias("card_id"), F.lit("N 2/2").alias("card_code"))
    known = known.unionByName(small_limits.createDataFrame([("hot", "H 3/3")], "card_id string, card_code string"))
    rows, plan = run(codes.backfill_codes(cards, known.groupBy("card_id").agg(F.max("card_code").alias("card_code"))))
    assert "skew=true" in plan
    expected = Counter("X 1/1" if n % 5 == 0 else "H 3/3" if n % 3 == 0 else "N 2/2" for n in range(ROWS))
    assert Counter(r["card_code"] for r in rows) == expected


def test_prices_split_a_hot_code(small_limits):
    items = hot(small_limits).select(
        F.lit("hk").alias("price_language"), F.col("key").alias("code"), F.lit("").alias("price"), F.col("id").alias("pos")
    )
    page = '<section class="section-product"><div class="data-product">建議零售價：5元</div></section>'
    pages = small_limits.createDataFrame([("hk", "HOT", page)] * 3, "lang string, code string, html string")
    rows, plan = run(products.with_prices(items, products.detail_prices(pages)))
    assert "skew=true" in plan and len(rows) == ROWS
    assert Counter(r["price"] for r in rows) == {"5元": ROWS // 3, "": ROWS - ROWS // 3}


def test_missing_decks_split_a_hot_event(small_limits):
    results = hot(small_limits).select(
        F.col("key").alias("event_id"), F.lit("1位").alias("rank"), F.col("key").alias("deck_id"), F.col("id").alias("pos")
    )
    stored = hot(small_limits).where("key <> 'hot'").select(
        F.col("key").alias("event_id"), F.concat(F.lit("deck_1st_"), "key", F.lit(".json")).alias("deck_file")
    )
    rows, plan = run(audit.missing_decks(results, stored))
    assert "skew=true" in plan
    assert len(rows) == ROWS // 3 and {r["event_id"] for r in rows} == {"hot"}


def test_reading_stops_for_a_hot_event(small_limits):
    pages = hot(small_limits).select(F.col("key").alias("event_id"), F.col("id").alias("page_no"), F.lit("x").alias("results"))
    marked = pages.withColumns({"is_empty": F.col("page_no") == 29_000, "is_last": F.col("page_no") == 15_000})
    stops = paging.reading_stops(marked, "event_id").withColumn("first_gap", F.lit(None).cast("long"))
    rows, plan = run(paging.read_until(pages, stops, "event_id"))
    # page 15000 is the hot event's last page, page 29000 an empty one of event 1000
    keys = [(n, "hot" if n % 3 == 0 else str(n % 2000)) for n in range(ROWS)]
    expected = [n for n, key in keys if not (key == "hot" and n > 15_000) and not (key == "1000" and n >= 29_000)]
    assert sorted(r["page_no"] for r in rows) == expected and "skew=true" in plan


def test_a_deck_with_a_third_of_all_cards(small_limits):
    cards = hot(small_limits).select(
        F.col("key").alias("deck_id"), F.col("id").alias("pos"), (F.col("id") % 700).cast("string").alias("card_name"),
        F.lit(1).alias("quantity"),
    )
    rows, plan = run(summaries.deck_key_cards(cards, 2))
    assert plan.count("WindowGroupLimit") >= 2  # one before the shuffle on the deck, one after
    counts = {}
    for n in range(ROWS):
        deck = counts.setdefault("hot" if n % 3 == 0 else str(n % 2000), {})
        deck[str(n % 700)] = deck.get(str(n % 700), 0) + 1
    expected = {d: [name for name, _ in sorted(c.items(), key=lambda x: -x[1])[:2]] for d, c in counts.items()}
    found = {}
    for row in sorted(rows, key=lambda r: r["rank"]):
        found.setdefault(row["deck_id"], []).append(row["card_name"])
    assert found == expected


def test_a_player_with_a_third_of_all_results(small_limits):
    results = hot(small_limits).select(
        F.col("key").alias("player_id"), F.lit("2025-01-01").alias("event_date"), F.lpad(F.col("id").cast("string"), 6, "0").alias("event_id"),
        F.lit(0).alias("pos"), F.lit("1位").alias("rank"), F.lit("d").alias("deck_id"),
        F.concat(F.lit("name"), F.col("id")).alias("player_name"), F.lit("a").alias("player_area"),
    )
    (row,) = summaries.player_stats(results).where("player_id = 'hot'").collect()
    assert (row["player_name"], row["appearances"], row["first_places"]) == ("name29997", ROWS // 3, ROWS // 3)
    assert summaries.player_appearances(results).where("player_id = 'hot'").count() == ROWS // 3


def test_many_products_with_one_date_spread_over_the_sort(small_limits):
    source = hot(small_limits).select(
        F.lit(1).alias("page_no"), F.col("id").alias("pos"), F.col("key").alias("product_name"), F.lit("").alias("release_date")
    )
    ordered = products.sort_products(products.union_products(source))
    sizes = ordered.select(F.spark_partition_id().alias("part")).groupBy("part").count().collect()
    assert len(sizes) > 4 and max(r["count"] for r in sizes) < ROWS // 3


def test_tasks_of_a_spread_table_grow_with_its_rows(spark, monkeypatch):
    from cardloom.sources import landed

    table = spark.range(1000)
    assert landed.spread(table).rdd.getNumPartitions() == 4
    monkeypatch.setattr(landed, "ROWS_PER_TASK", 90)
    spread = landed.spread(table)
    assert spread.rdd.getNumPartitions() == 12
    assert sorted(row["id"] for row in spread.collect()) == list(range(1000))
