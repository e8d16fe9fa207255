"""Deck pages and deck documents. A deck is one row, so everything about one deck is computed inside its row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardloom.constants import (
    DECK_CODE_LABEL,
    DECK_CODE_OPEN_END,
    DECK_IMAGE_ENTRY,
    DECK_NAME_ENTRY,
    DECK_SCRIPT_MARK,
    ENERGY_MARKERS,
    JAPAN_BASE_URL,
)
from cardloom.functions import markup
from cardloom.functions.cards import card_code_of, card_name_of, is_key_card, number_of, set_of
from cardloom.functions.once import explode_once, let, select_once
from cardloom.functions.text import or_empty
from cardloom.functions.urls import deck_url
from cardloom.operators.joins import hot_key_join


def parse_deck_pages(pages: DataFrame) -> DataFrame:
    """Deck documents of landed deck pages (``deck_id, html``); other columns are kept. One projection, no shuffle.

    Names and images are page-local lists in which a later entry wins; a card without a name is dropped, a card
    without an image keeps ``''``. A quantity that is no integer ends the deck there.
    """
    bodies = markup.scripts_of(F.col("html"))
    scripts = F.array_join(F.filter(bodies, lambda script: F.contains(script, F.lit(DECK_SCRIPT_MARK))), "\n")
    cards = let(F.struct(packed_cards(F.col("html")).alias("listed"), scripts.alias("scripts")), _page_cards)
    others = [name for name in pages.columns if name not in ("deck_id", "html")]
    pages = select_once(pages, [*others, "deck_id"], markup.without_comments(F.col("html")).alias("html"))
    return pages.select(
        *others,
        deck_url(F.col("deck_id")).alias("deck_url"),
        "deck_id",
        _deck_code(F.col("html")).alias("deck_code"),
        cards.alias("cards"),
    )


def merge_deck_copies(decks: DataFrame) -> DataFrame:
    """One document per deck id where a page was landed more than once; copies are merged map-side."""
    fields = [name for name in decks.columns if name != "deck_id"]
    merged = decks.groupBy("deck_id").agg(F.max(F.struct(*fields)).alias("document"))
    return merged.select("deck_id", "document.*")


def _page_cards(page: Column) -> Column:
    # Reversed lists: the first hit is the last entry. Position 0 is no hit. Whole entries are looked for, once, and their
    # ids and values cut from them: neither the mark in front of an id nor an id holds what stands behind the id.
    entries = lambda pattern: F.reverse(F.regexp_extract_all(page["scripts"], F.lit(f"(?U){pattern}"), F.lit(0)))
    found = F.struct(
        page["listed"].alias("listed"), entries(DECK_NAME_ENTRY).alias("names"), entries(DECK_IMAGE_ENTRY).alias("images")
    )

    def lists(found: Column) -> Column:
        ids = lambda name: F.transform(
            found[name], lambda entry: F.substring_index(F.substring_index(entry, "]='", 1), "[", -1)
        )
        values = lambda name: F.transform(found[name], _entry_value)
        return F.struct(
            found["listed"].alias("listed"),
            ids("names").alias("name_ids"), values("names").alias("names"),
            ids("images").alias("image_ids"), values("images").alias("images"),
        )

    return let(let(found, lists), _named_cards)


def _entry_value(entry: Column) -> Column:
    """What an entry ``mark[id]='value'`` holds; a value has no quote inside."""
    return F.substring_index(F.substring_index(entry, "'", 2), "'", -1)


def _named_cards(lists: Column) -> Column:
    lookup = lambda values, keys, key: F.get(
        lists[values], (F.array_position(lists[keys], key) - 1).cast("int")
    )
    known = F.filter(lists["listed"], lambda card: F.array_contains(lists["name_ids"], card["card_id"]))
    looked_up = F.transform(
        known,
        lambda card: F.struct(
            card["card_id"].alias("card_id"),
            card["quantity"].alias("quantity"),
            lookup("names", "name_ids", card["card_id"]).alias("full_name"),
            lookup("images", "image_ids", card["card_id"]).alias("image"),
        ),
    )
    return F.transform(
        looked_up,
        lambda card: F.struct(
            card["card_id"].alias("card_id"),
            card_name_of(card["full_name"]).alias("card_name"),
            card_code_of(card["full_name"]).alias("card_code"),
            card["quantity"].alias("quantity"),
            or_empty(F.concat(F.lit(JAPAN_BASE_URL), card["image"])).alias("image_url"),
        ),
    )


def _deck_code(html: Column) -> Column:
    """What follows the label in the element whose own text holds it, up to the end of the line.

    The label may stand behind children of that element or void tags. Its element is the last one that is still open in
    front of it: closed elements are taken out from the inside, a level at a time, and of what is left the last tag counts.
    """
    return let(markup.visible(html), _code_in)


def _code_in(shown: Column) -> Column:
    there = F.contains(shown, F.lit(DECK_CODE_LABEL))  # NULL without a page, and so is the code
    front = F.when(there, F.substring_index(shown, DECK_CODE_LABEL, 1)).when(~there, "")
    before = F.regexp_replace(front, _VOID_TAG, "")
    for _ in range(_LEVELS):
        before = F.regexp_replace(before, r"<(\w+)(?=[\s>])[^>]*>[^<]*</\1\s*>", "")
    tag = F.regexp_extract(before, r"(?s)^.*<(\w+)", 1)
    behind = F.when(there, F.substring(shown, F.char_length(front) + 1, F.char_length(shown))).when(~there, "")

    def inside(parts: Column) -> Column:
        pieces = F.split(parts["behind"], F.concat(F.lit("(?i)(?=</?"), parts["tag"], F.lit("[\\s/>])")))
        return F.when(parts["tag"] == "", parts["behind"]).otherwise(markup.first_level(pieces))

    own = let(F.struct(behind.alias("behind"), tag.alias("tag")), inside)
    return F.regexp_extract(markup.stripped_text(own), rf"(?d){DECK_CODE_OPEN_END}(.+)", 1)


# Levels of closed elements in front of the label that are taken out.
_LEVELS = 6
_VOID_TAG = r"<(?i:area|base|br|col|embed|hr|img|input|link|meta|source|track|wbr)(?=[\s/>])[^>]*>|<[^>]*/>"


def packed_cards(html: Column) -> Column:
    """``array<struct<card_id, quantity>>`` of the packed inputs: entries joined by ``-``, parts by ``_``.

    Entries of fewer than two parts are skipped; the list ends before the first quantity that is no integer.
    """
    values = F.filter(
        F.transform(
            markup.tags_of(html, "input", markup.value_starts("id", "deck_")), lambda tag: markup.attribute(tag, "value")
        ),
        lambda value: value != "",
    )
    parts = F.filter(
        F.transform(F.flatten(F.transform(values, lambda value: F.split(value, "-"))), lambda e: F.split(e, "_")),
        lambda part: F.size(part) >= 2,
    )
    cards = F.transform(
        parts,
        lambda part: F.struct(
            F.get(part, F.lit(0)).alias("card_id"), F.get(part, F.lit(1)).try_cast("int").alias("quantity")
        ),
    )
    return let(cards, _until_broken)


def _until_broken(cards: Column) -> Column:
    broken_at = F.array_position(F.transform(cards, lambda card: card["quantity"].isNull()), F.lit(True)).cast("int")
    return let(broken_at, lambda at: F.when(at > 0, F.slice(cards, F.lit(1), at - 1)).otherwise(cards))


def cards_of(decks: DataFrame, *keep: str) -> DataFrame:
    """Flat cards of deck documents: the ``keep`` columns (``deck_id`` by default), ``pos`` and the card fields."""
    kept = keep or ("deck_id",)
    return explode_once(decks, kept, F.col("cards"), "pos", "card").select(*kept, "pos", "card.*")


def copies_in(cards: Column) -> Column:
    """Number of copies in a deck, the sum of its quantities."""
    return F.aggregate(cards, F.lit(0).cast("bigint"), lambda total, card: total + F.coalesce(card["quantity"], F.lit(0)))


def entries_in(cards: Column) -> Column:
    """Number of entries of a deck; a missing list counts as empty."""
    return F.coalesce(F.size(cards), F.lit(0)).cast("bigint")


def key_cards_in(cards: Column, k: int = 3, markers: Sequence[str] = ENERGY_MARKERS) -> Column:
    """The ``k`` card names with the most copies inside one deck, ties to the name seen first.

    Printings of a name are added up and energy cards left out. The array holds ``struct<copies, card_name>``.
    """
    kept = F.filter(cards, lambda card: is_key_card(card["card_name"], markers))
    return let(kept, lambda of_deck: _leading_names(of_deck, k))


def _leading_names(cards: Column, k: int) -> Column:
    names = F.array_distinct(F.transform(cards, lambda card: card["card_name"]))
    totals = F.transform(
        names,
        lambda name, seen: F.struct(
            (-copies_in(F.filter(cards, lambda card: card["card_name"] == name))).alias("minus_copies"),
            seen.alias("seen"),
            name.alias("card_name"),
        ),
    )
    return F.transform(
        F.slice(F.array_sort(totals), 1, k),
        lambda total: F.struct((-total["minus_copies"]).alias("copies"), total["card_name"].alias("card_name")),
    )


def flat_deck_cards(cards: DataFrame, *keys: str) -> DataFrame:
    """Flat card export: the key columns, name, count, and the code split into card number and set name."""
    return cards.select(
        *(keys or ("deck_id",)),
        "card_name",
        F.col("quantity").alias("card_count"),
        number_of(F.col("card_code")).alias("card_number"),
        set_of(F.col("card_code")).alias("set_name"),
    )


def flat_events(events: DataFrame) -> DataFrame:
    """Flat event export; there is no rule for the type, which stays empty."""
    return events.select(
        F.col("event_title").alias("event_name"), "event_date", "event_location", "event_url",
        F.lit("").alias("event_type"),
    )


def flat_deck_lists(events: DataFrame, decks: DataFrame) -> DataFrame:
    """Flat deck list export: results of event documents with the code of their deck; there is no rule for the type."""
    results = events.select("event_url", F.explode("results").alias("r")).select("event_url", "r.*")
    codes = decks.select("deck_id", "deck_code").where("deck_id <> ''").groupBy("deck_id").agg(
        F.max("deck_code").alias("deck_code")
    )
    return hot_key_join(results, codes, "deck_id", "left").select(
        "event_url", "player_name", F.col("rank").alias("player_rank"), F.lit("").alias("deck_type"), "deck_url",
        or_empty(F.col("deck_code")).alias("deck_code"),
    )
