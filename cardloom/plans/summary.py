"""Summary of event and deck documents: one DataFrame per report."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardloom.constants import ENERGY_MARKERS
from cardloom.functions.once import select_once
from cardloom.operators import summaries
from cardloom.operators.decks import cards_of, copies_in, entries_in, key_cards_in
from cardloom.operators.events import results_of


def document_key_cards(decks: DataFrame, markers: Sequence[str] = ENERGY_MARKERS, *keep: str) -> DataFrame:
    """Key card of every deck document, found inside its row without a shuffle: ``keep, deck_id, key_card``."""
    first = F.get(key_cards_in(F.col("cards"), 1, markers), F.lit(0))
    return select_once(decks, [*keep, "deck_id"], first["card_name"].alias("key_card"))


def document_totals(decks: DataFrame, *keep: str) -> DataFrame:
    """Copies and entries of every deck document, empty ones included: ``keep, deck_id, copies, entries``."""
    return decks.select(
        *keep,
        "deck_id",
        F.coalesce(copies_in(F.col("cards")), F.lit(0)).alias("copies"),
        entries_in(F.col("cards")).alias("entries"),
    )


def summarize_events(events: DataFrame) -> dict[str, DataFrame]:
    return {
        "event_totals": summaries.event_totals(events),
        "events_by_date": summaries.events_by_date(events),
        "top_hosts": summaries.top_hosts(events),
    }


def summarize_players(events: DataFrame) -> dict[str, DataFrame]:
    results = results_of(events)
    stats = summaries.player_stats(results)
    return {
        "player_total": summaries.player_total(results),
        "player_stats": stats,
        "player_appearances": summaries.player_appearances(results),
        "top_players": summaries.top_players(stats),
        "first_places": summaries.first_places(stats),
        "first_place_total": summaries.first_place_total(results),
    }


def summarize_decks(decks: DataFrame) -> dict[str, DataFrame]:
    return {
        "card_usage": summaries.card_usage(cards_of(decks)),
        "deck_size_stats": summaries.deck_size_stats(decks),
        "deck_card_totals": document_totals(decks),
    }


def summarize_deck_archetypes(decks: DataFrame, markers: Sequence[str] = ENERGY_MARKERS) -> DataFrame:
    return summaries.archetype_counts(document_key_cards(decks, markers))


def summarize(events: DataFrame, decks: DataFrame) -> dict[str, DataFrame]:
    """All reports by name. They are lazy and independent; persist the inputs to run many of them."""
    return {
        **summarize_events(events),
        **summarize_players(events),
        **summarize_decks(decks),
        "deck_archetypes": summarize_deck_archetypes(decks),
    }
