"""Missing card codes: find them, look them up, put them back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardloom.constants import CARD_NUMBER_PATTERN
from cardloom.functions import markup
from cardloom.functions.once import explode_once, select_once
from cardloom.functions.text import NO_BREAK_SPACE, is_blank, select_decoded, strip
from cardloom.operators.joins import hot_key_join
from cardloom.session import OPEN_STAGES, Stages
from cardloom.operators.paging import number_rows


def cards_without_code(cards: DataFrame) -> DataFrame:
    """Card entries whose code is missing, empty or white space."""
    return cards.where(is_blank(F.col("card_code")))


def missing_codes(cards: DataFrame) -> DataFrame:
    """Per card id without a code: the name seen first and the number of entries: ``card_id, card_name, occurrences``.

    ``cards`` has ``deck_id, pos`` to say which entry is first. The deck files themselves are rows of
    :func:`missing_code_files`: a common card is missing in most decks, too many for one array.
    """
    first = F.min(F.struct("deck_id", "pos", "card_name"))
    return (
        cards_without_code(cards)
        .groupBy("card_id")
        .agg(first.alias("first"), F.count(F.lit(1)).alias("occurrences"))
        .select("card_id", "first.card_name", "occurrences")
    )


def missing_code_files(cards: DataFrame) -> DataFrame:
    """Deck files that lack a card's code, one row per entry (a deck can appear twice): ``card_id, deck_file``."""
    return cards_without_code(cards).select("card_id", "deck_file")


def missing_codes_preview(missing: DataFrame, n: int = 10) -> DataFrame:
    """The first ``n`` cards without a code, numbered, and on each row how many more there are: ``more``."""
    total = missing.agg(F.count(F.lit(1)).alias("total")).scalar()
    top = missing.orderBy("card_id").limit(n)
    return top.select(
        number_rows("card_id").alias("position"), "card_id", "card_name", "occurrences",
        F.greatest(total - n, F.lit(0)).alias("more"),
    )


def missing_ids(cards: DataFrame) -> DataFrame:
    """Distinct card ids without a code."""
    return cards_without_code(cards).select("card_id").distinct()


def cache_status(missing: DataFrame, cache: DataFrame) -> DataFrame:
    """How many of the missing ids the cache knows: ``total, cached, to_fetch``. ``cache`` has unique ids."""
    known = cache.select("card_id", F.lit(True).alias("known"))
    return missing.join(known, "card_id", "left").agg(
        F.count(F.lit(1)).alias("total"),
        F.count("known").alias("cached"),
        F.count_if(F.col("known").isNull()).alias("to_fetch"),
    )


def codes_to_fetch(missing: DataFrame, cache: DataFrame) -> DataFrame:
    """Missing ids the cache does not know."""
    return missing.join(cache, "card_id", "left_anti").select("card_id")


def extract_card_codes(pages: DataFrame) -> DataFrame:
    """Codes of landed card pages (``card_id, html``): ``card_id, card_code``, NULL where a part is missing."""
    image = markup.tag_of(F.col("html"), "img", markup.has_class("img-regulation"))
    fields = {"alt": markup.raw_attribute(image, "alt"), "text": markup.raw_element_text(F.col("html"))}
    number = F.regexp_extract("text", rf"(?U)({CARD_NUMBER_PATTERN})", 1)
    spaced = F.replace(number, F.lit(NO_BREAK_SPACE), F.lit(" "))
    parts = select_once(
        select_decoded(pages, ["card_id"], fields),
        ["card_id"],
        strip(F.col("alt")).alias("series"),
        strip(F.replace(spaced, F.lit(" / "), F.lit("/"))).alias("number"),
    )
    complete = (F.col("series") != "") & (F.col("number") != "")
    return parts.select("card_id", F.when(complete, F.concat_ws(" ", "series", "number")).alias("card_code"))


def fetched_codes(pages: DataFrame) -> DataFrame:
    """Codes found on landed card pages, one row per id; copies of a page are merged before any join."""
    return (
        extract_card_codes(pages)
        .where("card_code is not null")
        .groupBy("card_id")
        .agg(F.max("card_code").alias("card_code"))
    )


def upsert_cache(cache: DataFrame, codes: DataFrame) -> DataFrame:
    """The cache with the codes of new ids; known ids keep their code."""
    new = codes.join(cache.select("card_id"), "card_id", "left_anti")
    return cache.select("card_id", "card_code").unionByName(new.select("card_id", "card_code"))


def backfill_codes(cards: DataFrame, codes: DataFrame) -> DataFrame:
    """Cards with blank codes filled from ``codes`` (unique ids); all other codes and columns are unchanged.

    Adds ``filled``. Only blank entries are joined. Non-blank entries pass by, so a complete deck costs no shuffle; a
    card that is missing everywhere makes a hot key, which Spark splits as ``codes`` has one row for it.
    """
    blank = cards_without_code(cards)
    filled = hot_key_join(blank, codes.select("card_id", F.col("card_code").alias("new_code")), "card_id", "left")
    other = cards.where(~is_blank(F.col("card_code"))).withColumn("filled", F.lit(False))
    return (
        filled.withColumn("filled", F.coalesce(F.col("new_code"), F.lit("")) != "")
        .withColumn("card_code", F.when(F.col("filled"), F.col("new_code")).otherwise(F.col("card_code")))
        .select(*cards.columns, "filled")
        .unionByName(other)
    )


def backfill_report(cards: DataFrame, codes: DataFrame, file: str = "deck_file") -> DataFrame:
    """How many card ids are filled and in how many deck files: ``cards_updated, files_updated``; nothing is written."""
    blank = cards_without_code(cards).select("card_id", file)
    resolved = hot_key_join(blank, codes.where("card_code <> ''").select("card_id"), "card_id", "left_semi")
    return resolved.agg(
        F.count_distinct("card_id").alias("cards_updated"), F.count_distinct(file).alias("files_updated")
    )


def blank_ids(decks: DataFrame, *keys: str) -> DataFrame:
    """The ids of cards with a blank code, once per document: the key columns and ``card_id``."""
    blanks = F.array_distinct(
        F.transform(F.filter("cards", lambda card: is_blank(card["card_code"])), lambda card: card["card_id"])
    )
    return explode_once(decks, list(keys), blanks, "pos", "card_id").select(*keys, "card_id")


def backfill_documents(
    decks: DataFrame, codes: DataFrame, key: str = "deck_file", stages: Stages = OPEN_STAGES
) -> DataFrame:
    """The deck documents in which a code is filled, with all their cards; other documents are left out.

    ``key`` identifies a document. Documents with a blank code are staged, so that what they are made from is worked out
    once; complete ones go no further. Only the blank ids leave the staged documents: they meet the codes and come back
    as one small map per changed document, no larger than its card list, which is applied inside the row.
    """
    blank = F.exists("cards", lambda card: is_blank(card["card_code"]))
    # Bound first: the filter would else work out the cards once more, and with them the page they come from.
    others = [name for name in decks.columns if name != "cards"]
    bound = select_once(decks, others, F.col("cards").alias("cards")).select(*decks.columns)
    open_decks = stages.write(bound.where(blank), "decks-to-fill")
    found = (
        hot_key_join(blank_ids(open_decks, key), codes.where("card_code <> ''").select("card_id", "card_code"), "card_id")
        .groupBy(key)
        .agg(F.map_from_entries(F.collect_set(F.struct("card_id", "card_code"))).alias("found"))
    )
    refilled = F.transform(
        "cards",
        lambda card: card.withField(
            "card_code",
            F.when(is_blank(card["card_code"]), F.coalesce(F.try_element_at("found", card["card_id"]), card["card_code"]))
            .otherwise(card["card_code"]),
        ),
    )
    return hot_key_join(open_decks, found, key).withColumn("cards", refilled).select(*decks.columns)


def with_changes(decks: DataFrame, changed: DataFrame, key: str = "deck_file") -> DataFrame:
    """All documents, the changed ones in their new form. Write the outcome to a new path, not over what it reads."""
    same = hot_key_join(decks, changed.select(key).distinct(), key, "left_anti").select(*changed.columns)
    return same.unionByName(changed)
