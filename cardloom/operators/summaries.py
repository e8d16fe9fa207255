"""Summaries of events, players and decks. All group by hash with map-side combine; top lists never sort everything."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cardloom.constants import ENERGY_MARKERS, FIRST_PLACE, UNKNOWN
from cardloom.functions.cards import card_key, is_key_card
from cardloom.functions.text import truncate
from cardloom.operators.paging import number_rows

# ---- events ----------------------------------------------------------------------------------------------------------

NESTED_RESULTS = "coalesce(size(results), 0)"


def _count() -> Column:
    return F.count(F.lit(1))


def _first(counts: DataFrame, n: int | None, *order: str | Column) -> DataFrame:
    """The first ``n`` rows in the given order; without ``n`` all rows, not sorted."""
    return counts if n is None else counts.orderBy(*order).limit(n)


def event_totals(events: DataFrame, participants: str | Column = NESTED_RESULTS) -> DataFrame:
    """Number of events and of participants, and participants per event to one decimal (NULL without events)."""
    people = F.expr(participants) if isinstance(participants, str) else participants
    totals = events.agg(
        _count().alias("total_events"), F.coalesce(F.sum(people.cast("bigint")), F.lit(0)).alias("total_participants")
    )
    return with_participants_per_event(totals)


def with_participants_per_event(totals: DataFrame) -> DataFrame:
    average = F.try_divide(F.col("total_participants").cast("double"), F.col("total_events"))
    return totals.withColumn("avg_participants", F.round(average, 1))


def events_by_date(
    events: DataFrame,
    n: int | None = 10,
    first_date: str | None = None,
    last_date: str | None = None,
    count: Column | None = None,
) -> DataFrame:
    """The ``n`` latest dates (all with ``None``) with their number of events, optionally between two dates (inclusive).

    ``count`` is the aggregate that counts, where rows stand for several events.
    """
    dated = events.withColumn("event_date", F.coalesce("event_date", F.lit(UNKNOWN)))
    if first_date is not None:
        dated = dated.where(F.col("event_date") >= first_date)
    if last_date is not None:
        dated = dated.where(F.col("event_date") <= last_date)
    counts = dated.groupBy("event_date").agg((_count() if count is None else count).alias("event_count"))
    return _first(counts, n, F.desc("event_date"))


def top_hosts(
    events: DataFrame, n: int | None = 10, width: int | None = 50, count: Column | None = None
) -> DataFrame:
    """The ``n`` hosts with the most events. Names are cut to ``width`` characters first, which merges hosts; ``None`` lifts either limit.

    ``count`` as in :func:`events_by_date`.
    """
    host = F.coalesce("event_host", F.lit(UNKNOWN))
    hosts = events.withColumn("host", host if width is None else truncate(host, width))
    counts = hosts.groupBy("host").agg((_count() if count is None else count).alias("event_count"))
    return _first(counts, n, F.desc("event_count"), "host")


# ---- players ---------------------------------------------------------------------------------------------------------


def player_appearances(results: DataFrame) -> DataFrame:
    """History of every player as rows: one per result with a player id.

    A player's events, ranks and decks are kept as rows, not as one array, because one player may own a large part of
    all results and an array of them would have to fit one task.
    """
    return results.where("player_id <> ''").select("player_id", "event_date", "event_id", "pos", "rank", "deck_id")


def player_stats(results: DataFrame) -> DataFrame:
    """Per player: name and area of the latest result, number of results, number of first places."""
    return named_players(results.where("player_id <> ''").groupBy("player_id").agg(*player_measures()))


def player_measures() -> list[Column]:
    """What is kept of a player's results: the latest one, their number, the first places. All three can be merged."""
    latest = F.struct("event_date", "event_id", F.col("pos").cast("int").alias("pos"), "player_name", "player_area")
    return [
        F.max(latest).alias("latest"),
        _count().alias("appearances"),
        F.count_if(F.col("rank") == FIRST_PLACE).alias("first_places"),
    ]


def named_players(measures: DataFrame) -> DataFrame:
    return measures.select("player_id", "latest.player_name", "latest.player_area", "appearances", "first_places")


def player_total(results: DataFrame) -> DataFrame:
    """Number of players."""
    return results.where("player_id <> ''").agg(F.count_distinct("player_id").alias("total_players"))


def top_players(stats: DataFrame, n: int = 20) -> DataFrame:
    """The ``n`` players with the most results, ranked from 1."""
    return _top_players(stats, "appearances", n)


def first_places(stats: DataFrame, n: int = 20) -> DataFrame:
    """The ``n`` players with the most first places, at least one, ranked from 1."""
    return _top_players(stats.where("first_places > 0"), "first_places", n)


def _top_players(stats: DataFrame, measure: str, n: int) -> DataFrame:
    top = stats.orderBy(F.desc(measure), "player_id").limit(n)
    rank = number_rows(F.desc(measure), "player_id")
    return top.select(rank.alias("rank"), "player_id", "player_name", "player_area", measure)


def first_place_total(results: DataFrame) -> DataFrame:
    """Number of players with a first place."""
    winners = results.where((F.col("rank") == FIRST_PLACE) & (F.col("player_id") != ""))
    return winners.agg(F.count_distinct("player_id").alias("total_first_place_players"))


# ---- decks -----------------------------------------------------------------------------------------------------------

NESTED_CARDS = "coalesce(size(cards), 0)"


def card_usage(cards: DataFrame, n: int | None = 30) -> DataFrame:
    """The ``n`` cards with the most copies over all decks, by name and code."""
    return _first(card_copies_by_key(cards), n, F.desc("copies"), "card_key")


def card_copies_by_key(cards: DataFrame, *keys: str) -> DataFrame:
    """Copies by name and code, and by ``keys`` where given."""
    keyed = cards.where("card_name <> ''").select(
        *keys, card_key(F.col("card_name"), F.col("card_code")).alias("card_key"), F.col("quantity").cast("bigint")
    )
    return keyed.groupBy(*keys, "card_key").agg(F.sum("quantity").alias("copies"))


def most_copies(copies: DataFrame, n: int | None = 30) -> DataFrame:
    """:func:`card_usage` of counts such as :func:`card_copies_by_key` gives, added up by card."""
    return _first(copies.groupBy("card_key").agg(F.sum("copies").alias("copies")), n, F.desc("copies"), "card_key")


def deck_size_stats(decks: DataFrame, entries: str | Column = NESTED_CARDS) -> DataFrame:
    """Number of decks; mean, least and most entries per deck. Sizes count entries, not copies; 0 without decks."""
    size = (F.expr(entries) if isinstance(entries, str) else entries).cast("bigint")
    average = F.coalesce(F.round(F.avg(size), 1), F.lit(0.0))
    return decks.agg(
        _count().alias("total_decks"),
        average.alias("avg_size"),
        F.coalesce(F.min(size), F.lit(0)).alias("min_size"),
        F.coalesce(F.max(size), F.lit(0)).alias("max_size"),
        average.alias("avg_unique"),
    )


def deck_card_totals(cards: DataFrame, *keys: str) -> DataFrame:
    """Copies and entries per deck of flat cards; decks without cards are absent."""
    return cards.groupBy(*(keys or ("deck_id",))).agg(
        F.sum(F.col("quantity").cast("bigint")).alias("copies"), _count().alias("entries")
    )


def card_copies_per_deck(cards: DataFrame, markers: Sequence[str] = ENERGY_MARKERS) -> DataFrame:
    """Copies per (deck, card name) without energy cards: ``deck_id, card_name, copies, first_pos``.

    Grouping by both columns spreads even a deck that holds a large part of all cards.
    """
    kept = cards.where(is_key_card(F.col("card_name"), markers))
    return kept.groupBy("deck_id", "card_name").agg(
        F.sum(F.col("quantity").cast("bigint")).alias("copies"), F.min("pos").alias("first_pos")
    )


def deck_key_cards(cards: DataFrame, k: int = 3, markers: Sequence[str] = ENERGY_MARKERS) -> DataFrame:
    """The ``k`` cards with the most copies per deck, ties to the card seen first: ``deck_id, rank, card_name, copies``.

    Spark cuts each deck to ``k`` rows per partition before the shuffle on the deck.
    """
    order = Window.partitionBy("deck_id").orderBy(F.desc("copies"), "first_pos", "card_name")
    ranked = card_copies_per_deck(cards, markers).withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= k).select("deck_id", "rank", "card_name", "copies")


def deck_archetypes(cards: DataFrame, n: int | None = 20, markers: Sequence[str] = ENERGY_MARKERS) -> DataFrame:
    """The ``n`` key cards that lead the most decks: ``key_card, deck_count``."""
    key_cards = deck_key_cards(cards, 1, markers).select(F.col("card_name").alias("key_card"))
    return archetype_counts(key_cards, n)


def archetype_counts(key_cards: DataFrame, n: int | None = 20, count: Column | None = None) -> DataFrame:
    """Count decks by their ``key_card``; decks without one are absent. ``count`` as in :func:`events_by_date`."""
    counted = (_count() if count is None else count).alias("deck_count")
    counts = key_cards.where("key_card is not null").groupBy("key_card").agg(counted)
    return _first(counts, n, F.desc("deck_count"), "key_card")
