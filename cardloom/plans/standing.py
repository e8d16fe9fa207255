"""Standing reports: the summaries as a state per day, brought up to date from the days that changed and merged on read.

Counts, sums and maxima of a day can be merged, so a new day costs only its own rows. A state is a folder: each refresh adds
one folder per part with the rows of the days it worked out, and at last a line per day that says which refresh holds it. So
a refresh that is lost leaves rows that no line names, and the state stays as it was. One refresh of a source at a time.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cardloom.constants import ENERGY_MARKERS
from cardloom.operators import summaries
from cardloom.operators.decks import cards_of
from cardloom.operators.joins import hot_key_join
from cardloom.plans.ingest import stored
from cardloom.plans.summary import document_key_cards, document_totals
from cardloom.session import Stages
from cardloom.sources.landed import read_or_empty

#: The unit of a refresh, ``''`` for rows without a date. The date stays in the rows as it is besides.
DAY = "day"
_VERSIONS_DDL = f"{DAY} string, refresh bigint, token string, rows bigint, checksum decimal(38,0)"
_LATEST = "struct<event_date:string,event_id:string,pos:int,player_name:string,player_area:string>"

Part = Callable[[DataFrame, Sequence[str]], DataFrame]


def _hosts(events: DataFrame, markers: Sequence[str]) -> DataFrame:
    return events.groupBy(DAY, "event_date", "event_host").agg(
        F.count(F.lit(1)).alias("events"), F.sum(F.col("participants").cast("bigint")).alias("participants")
    )


def _players(results: DataFrame, markers: Sequence[str]) -> DataFrame:
    return results.where("player_id <> ''").groupBy(DAY, "player_id").agg(*summaries.player_measures())


def _appearances(results: DataFrame, markers: Sequence[str]) -> DataFrame:
    rows = results.where("player_id <> ''")
    return rows.select(DAY, "player_id", "event_date", "event_id", F.col("pos").cast("int").alias("pos"), "rank", "deck_id")


def _cards(decks: DataFrame, markers: Sequence[str]) -> DataFrame:
    return summaries.card_copies_by_key(cards_of(decks, DAY), DAY)


def _deck_totals(decks: DataFrame, markers: Sequence[str]) -> DataFrame:
    return document_totals(decks, DAY)


def _sizes(decks: DataFrame, markers: Sequence[str]) -> DataFrame:
    sizes = decks.select(DAY, F.expr(summaries.NESTED_CARDS).cast("bigint").alias("size"))
    return sizes.groupBy(DAY, "size").agg(F.count(F.lit(1)).alias("decks"))


def _archetypes(decks: DataFrame, markers: Sequence[str]) -> DataFrame:
    keyed = document_key_cards(decks, markers, DAY).where("key_card is not null")
    return keyed.groupBy(DAY, "key_card").agg(F.count(F.lit(1)).alias("decks"))


#: Of each source the columns that count and its parts: how the rows of days become state, and the state's columns.
SOURCES: dict[str, tuple[tuple[str, ...], dict[str, tuple[Part, str]]]] = {
    "events": (
        ("event_id", "event_date", "event_host", "participants"),
        {"hosts": (_hosts, "event_date string, event_host string, events bigint, participants bigint")},
    ),
    "results": (
        ("event_id", "event_date", "pos", "player_id", "player_name", "player_area", "rank", "deck_id"),
        {
            "players": (_players, f"player_id string, latest {_LATEST}, appearances bigint, first_places bigint"),
            "appearances": (
                _appearances,
                "player_id string, event_date string, event_id string, pos int, rank string, deck_id string",
            ),
        },
    ),
    "decks": (
        ("deck_id", "cards"),
        {
            "cards": (_cards, "card_key string, copies bigint"),
            "deck-totals": (_deck_totals, "deck_id string, copies bigint, entries bigint"),
            "sizes": (_sizes, "size bigint, decks bigint"),
            "archetypes": (_archetypes, "key_card string, decks bigint"),
        },
    ),
}


def versions(spark: SparkSession, state: str, source: str) -> DataFrame:
    """Which refresh holds each day of a source: ``day, refresh, token, rows, checksum``. One row per day."""
    lines = read_or_empty(spark, f"{state}/{source}-versions", _VERSIONS_DDL)
    last = F.max(F.struct("refresh", "token", "rows", "checksum")).alias("last")
    return lines.groupBy(DAY).agg(last).select(DAY, "last.*")


def refresh(
    documents: DataFrame,
    state: str,
    source: str,
    date: str = "event_date",
    whole: bool = True,
    markers: Sequence[str] = ENERGY_MARKERS,
) -> DataFrame:
    """Bring a source's state up to date; gives the days that were worked out anew with their ``rows``.

    ``source`` is ``events`` (rows with ``event_id, event_date, event_host, participants``), ``results`` (flat results with
    ``event_date``) or ``decks`` (deck documents with a ``date`` column). A day is due if number or checksum of its rows
    differ from the state's: new days, days with late or changed rows, and days whose rows are gone. The check is one
    scan and a small group-by; only rows of due days are worked out. With ``whole`` off, ``documents`` holds all rows of
    the days that occur in it, such as the folders of new days, and other days are left as they are. Rows without a date
    are a day of their own. Another list of ``markers`` needs a new state.
    """
    spark = documents.sparkSession
    columns, parts = SOURCES[source]
    keyed = documents.select(F.coalesce(F.col(date), F.lit("")).alias(DAY), *columns)
    checksum = F.sum(F.xxhash64(*columns).cast("decimal(20,0)")).cast("decimal(38,0)")
    now = keyed.groupBy(DAY).agg(F.count(F.lit(1)).alias("rows"), checksum.alias("checksum"))
    known = versions(spark, state, source)
    old = known.select(DAY, F.col("rows").alias("old_rows"), F.col("checksum").alias("old_checksum"))
    met = now.join(old, DAY, "full_outer" if whole else "left")
    rows = F.coalesce("rows", F.lit(0))
    differs = ~(rows.eqNullSafe(F.col("old_rows")) & F.col("checksum").eqNullSafe(F.col("old_checksum")))
    number = (known.agg(F.max("refresh")).first()[0] or 0) + 1
    token = uuid.uuid4().hex
    with Stages() as stages:
        due = stages.write(met.where(differs).select(DAY, rows.alias("rows"), "checksum"), "due-days")
        if not due.isEmpty():
            chosen = hot_key_join(keyed, due.select(DAY), DAY, "left_semi")
            for name, (part, _) in parts.items():
                part(chosen, markers).hint("rebalance").write.parquet(f"{state}/{name}/token={token}")
            line = due.select(DAY, F.lit(number).cast("bigint").alias("refresh"), F.lit(token).alias("token"), "rows", "checksum")
            line.coalesce(1).write.mode("append").parquet(f"{state}/{source}-versions")
    done = versions(spark, state, source)
    return done.where(F.col("token") == token).select(DAY, "rows")


def refresh_from_store(spark: SparkSession, store: str, state: str) -> dict[str, DataFrame]:
    """Bring all sources of a state up to date from an ingest store; gives the days worked out anew by source.

    Results and decks take the date of their event; those of no stored event are left out until it is stored. The join is
    one of the slim events, broadcast while Spark takes them for small.
    """
    events, results, decks = stored(spark, store)
    dates = events.groupBy("event_id").agg(F.min("event_date").alias("event_date"))
    people = events.withColumn("participants", F.coalesce("expected", F.lit(0)))
    sources = {
        "events": people,
        "results": hot_key_join(results, dates, "event_id"),
        "decks": hot_key_join(decks, dates, "event_id"),
    }
    return {source: refresh(table, state, source) for source, table in sources.items()}


def part_rows(spark: SparkSession, state: str, name: str) -> DataFrame:
    """The rows of a part that count: those of the refresh that holds their day."""
    ((source, ddl),) = ((s, parts[name][1]) for s, (_, parts) in SOURCES.items() if name in parts)
    rows = read_or_empty(spark, f"{state}/{name}", f"{DAY} string, {ddl}, token string")
    held = versions(spark, state, source).where("rows > 0").select(DAY, "token")
    return hot_key_join(rows, held, [DAY, "token"], "left_semi").drop("token")


def event_totals(hosts: DataFrame) -> DataFrame:
    people = F.coalesce(F.sum("participants"), F.lit(0)).alias("total_participants")
    return summaries.with_participants_per_event(hosts.agg(F.coalesce(F.sum("events"), F.lit(0)).alias("total_events"), people))


def player_stats(players: DataFrame) -> DataFrame:
    merged = players.groupBy("player_id").agg(
        F.max("latest").alias("latest"), F.sum("appearances").alias("appearances"), F.sum("first_places").alias("first_places")
    )
    return summaries.named_players(merged)


def deck_size_stats(sizes: DataFrame) -> DataFrame:
    mean = F.try_divide(F.sum(F.col("size") * F.col("decks")).cast("double"), F.sum("decks"))
    average = F.coalesce(F.round(mean, 1), F.lit(0.0))
    return sizes.agg(
        F.coalesce(F.sum("decks"), F.lit(0)).alias("total_decks"),
        average.alias("avg_size"),
        F.coalesce(F.min("size"), F.lit(0)).alias("min_size"),
        F.coalesce(F.max("size"), F.lit(0)).alias("max_size"),
        average.alias("avg_unique"),
    )


def reports(spark: SparkSession, state: str) -> dict[str, DataFrame]:
    """All reports of ``summary.summarize`` from the state; the same rows as over all documents."""
    hosts, cards = part_rows(spark, state, "hosts"), part_rows(spark, state, "cards")
    stats = player_stats(part_rows(spark, state, "players"))
    counted = F.count(F.lit(1))
    return {
        "event_totals": event_totals(hosts),
        "events_by_date": summaries.events_by_date(hosts, count=F.sum("events")),
        "top_hosts": summaries.top_hosts(hosts, count=F.sum("events")),
        "player_total": stats.agg(counted.alias("total_players")),
        "player_stats": stats,
        "player_appearances": part_rows(spark, state, "appearances").drop(DAY),
        "top_players": summaries.top_players(stats),
        "first_places": summaries.first_places(stats),
        "first_place_total": stats.where("first_places > 0").agg(counted.alias("total_first_place_players")),
        "card_usage": summaries.most_copies(cards),
        "deck_size_stats": deck_size_stats(part_rows(spark, state, "sizes")),
        "deck_card_totals": part_rows(spark, state, "deck-totals").drop(DAY),
        "deck_archetypes": summaries.archetype_counts(part_rows(spark, state, "archetypes"), count=F.sum("decks")),
    }
