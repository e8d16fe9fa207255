"""Back-fill of missing card codes in stored deck documents."""

from __future__ import annotations

import functools
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cardloom.operators.codes import (
    backfill_documents,
    backfill_report,
    blank_ids,
    cache_status,
    codes_to_fetch,
    fetched_codes,
    missing_codes,
    upsert_cache,
    with_changes,
)
from cardloom.operators.decks import cards_of
from cardloom.operators.joins import hot_key_join
from cardloom.schemas import DECK_DDL
from cardloom.session import OPEN_STAGES, Stages, let_go
from cardloom.sinks.documents import write_code_cache, write_documents
from cardloom.sources.documents import read_code_cache, read_document_lines
from cardloom.sources.landed import folder_sizes, read_or_none


@dataclass(frozen=True)
class BackfillPlan:
    """Tables of a back-fill. All are lazy; a dry run only looks at them."""

    missing: DataFrame
    status: DataFrame
    to_fetch: DataFrame
    cache: DataFrame
    report: DataFrame
    changed: DataFrame


def plan_backfill(decks: DataFrame, cache: DataFrame, code_pages: DataFrame) -> BackfillPlan:
    """Plan a back-fill of ``decks`` (deck documents with ``deck_file``) from a cache and landed card pages.

    Only pages of cards that are missing and not cached are used.
    """
    cards = cards_of(decks, "deck_id", "deck_file")
    missing = missing_codes(cards)
    to_fetch = codes_to_fetch(missing, cache)
    codes = fetched_codes(hot_key_join(code_pages, to_fetch, "card_id", "left_semi"))
    new_cache = upsert_cache(cache, codes)
    return BackfillPlan(
        missing=missing,
        status=cache_status(missing, cache),
        to_fetch=to_fetch,
        cache=new_cache,
        report=backfill_report(cards, new_cache),
        changed=backfill_documents(decks, new_cache),
    )


def blanks_path(store: str) -> str:
    """Where the index of a store of deck documents is: beside it, as all that is in its folder are documents."""
    return f"{store.rstrip('/')}-blanks"


def write_blanks(decks: DataFrame, store: str, partition: str, mode: str = "overwrite") -> None:
    """Index the documents' cards without a code: ``card_id, deck_file``, a folder per partition of the store.

    Each partition also has a row without a card, so that one in which nothing is missing any more is replaced as well.
    """
    folder = f"{partition}_folder"
    named = decks.withColumn(folder, F.coalesce(F.col(partition).cast("string"), F.lit("")))
    marks = named.select(folder).distinct().select(
        folder, F.lit(None).cast("string").alias("deck_file"), F.lit(None).cast("string").alias("card_id")
    )
    rows = blank_ids(named, folder, "deck_file").unionByName(marks)
    rows.hint("rebalance", folder).write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy(folder).parquet(
        blanks_path(store)
    )


def write_decks(decks: DataFrame, store: str, partition: str = "event_date", mode: str = "overwrite") -> None:
    """Deck documents as ``write_documents`` writes them, and before that their index, so that a back-fill need not look
    for missing codes in all documents. ``decks`` has ``deck_file``. A run that ends in between is to be repeated."""
    with Stages() as stages:
        whole = stages.write(decks, "decks-to-store")
        write_blanks(whole, store, partition, mode)
        let_go(whole.sparkSession)
        write_documents(whole, store, partition, mode)
    let_go(decks.sparkSession)


def run_backfill(
    spark: SparkSession, store: str, cache: DataFrame, code_pages: DataFrame, cache_path: str, partition: str
) -> DataFrame:
    """Write the new cache to a new path, then fill the deck documents of a store where they are; gives the report.

    ``store`` is a folder of JSON lines, one folder per ``partition`` value, as ``write_decks`` makes it. What is missing,
    and where, is read from its index; a store without one (of ``write_documents``) is indexed first, by one scan. Of the
    documents only partitions with a change are read and worked out anew, a bounded share of the store at a time, as a copy
    of it and its shuffles are on disk until it is replaced: their documents are staged as they are, to be
    parsed once, and again filled and unchanged, and then replace the partition, and after that its index. A run that ends in between leaves partitions in
    their old or their new form and an index that names no fewer blanks than there are, and running again fills the rest;
    on a full store it changes nothing. The cache is written first, as it is the costly part.
    """
    folder = f"{partition}_folder"
    decks, _ = read_document_lines(spark, store, f"{DECK_DDL}, deck_file string, {partition} string", folder)
    index_schema = f"deck_file string, card_id string, {folder} string"
    blanks = read_or_none(spark, blanks_path(store), index_schema)
    if blanks is None:
        write_blanks(decks, store, partition)
        blanks = spark.read.schema(index_schema).parquet(blanks_path(store))
    with Stages() as stages:
        missing = blanks.select("card_id").where("card_id is not null").distinct()
        pages = hot_key_join(code_pages, codes_to_fetch(missing, cache), "card_id", "left_semi")
        write_code_cache(upsert_cache(cache, fetched_codes(pages)), cache_path)
        saved = read_code_cache(spark, cache_path, layout="lines")
        known = saved.where("card_code <> ''").select("card_id")
        name = F.coalesce(folder, F.lit(""))
        touched = hot_key_join(blanks, known, "card_id", "left_semi").select(name.alias("name")).distinct()
        names = sorted(row["name"] for row in touched.collect())  # folders of the store
        filled = [spark.createDataFrame([], "deck_file string, card_id string")]
        for some in folders_at_once(names, folder_sizes(spark, store) if names else {}):
            with Stages() as ready:
                with Stages() as parts:
                    # Read several times below, so that its lines are parsed once.
                    few = parts.write(decks.where(name.isin(some)), "decks-of-folders")
                    filled.append(
                        stages.write(hot_key_join(blank_ids(few, "deck_file"), known, "card_id", "left_semi"), "filled-blanks")
                    )
                    changed = backfill_documents(few, saved, stages=parts)
                    whole = ready.write(with_changes(few, changed).drop(folder), "filled-decks")
                let_go(spark)
                write_documents(whole, store, partition)
                write_blanks(whole, store, partition)
            let_go(spark)
        updated = functools.reduce(DataFrame.unionByName, filled).agg(
            F.count_distinct("card_id").alias("cards_updated"), F.count_distinct("deck_file").alias("files_updated")
        )
        return OPEN_STAGES.write(updated, "backfill-report")


#: Partitions that are worked out in one go, at most; a filter on their names prunes the files that are read. So many bytes
#: of them, or this part of the store where that is more, unless a single one has more.
FOLDERS_AT_ONCE, BYTES_AT_ONCE, PART_AT_ONCE = 1000, 128 << 20, 1 / 8


def folders_at_once(names: list[str], sizes: dict[str, int]) -> list[list[str]]:
    """Names of folders in groups that are worked out in one go each, by the bytes of all folders of the store."""
    most = max(BYTES_AT_ONCE, PART_AT_ONCE * sum(sizes.values()))
    groups, held = [], 0
    for name in names:
        size = sizes.get(name, 0)
        if not groups or len(groups[-1]) == FOLDERS_AT_ONCE or held + size > most:
            groups.append([])
            held = 0
        groups[-1].append(name)
        held += size
    return groups
