"""Paged inputs: reading on until a terminal page, and ordered discovery of ids."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cardloom.constants import EVENT_LINK
from cardloom.functions import markup
from cardloom.functions.once import explode_once
from cardloom.functions.urls import event_id_of
from cardloom.operators.joins import hot_key_join
from cardloom.session import Stages

#: More links than a listing page can have.
PAGE_ROOM = 1 << 24


def one_of_each(pages: DataFrame, *keys: str) -> DataFrame:
    """Landed copies of a page merged, map-side first: of different copies the largest by its columns in order."""
    others = [name for name in pages.columns if name not in keys]
    merged = pages.groupBy(*keys).agg(F.max(F.struct(*others)).alias("copy"))
    return merged.select(*[F.col(name) if name in keys else F.col(f"copy.{name}") for name in pages.columns])


def merge_copies(landed: DataFrame, stages: Stages, merge: Callable[[DataFrame], DataFrame], *keys: str) -> DataFrame:
    """A staged table of pages with ``merge`` applied to the rows whose keys come again.

    Few pages have copies, and only the keys of all are grouped to find them: pages that stand alone are neither moved
    nor sorted. ``merge`` gives rows of the same columns.
    """
    again = stages.write(landed.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").drop("n"), "page-copies")
    if again.isEmpty():
        return landed
    again = again.select(*[F.col(name).alias(f"_{name}") for name in keys])
    same = reduce(lambda met, name: met & F.col(name).eqNullSafe(F.col(f"_{name}")), keys, F.lit(True))
    single, repeated = landed.join(again, same, "left_anti"), landed.join(again, same, "left_semi")
    return single.unionByName(merge(repeated).select(*landed.columns))


def reading_stops(pages: DataFrame, key: str, known_keys: Sequence[str] | None = None) -> DataFrame:
    """Where reading stops per ``key``: ``first_empty``, ``first_last`` and ``first_gap`` page.

    ``pages`` has ``page_no, is_empty, is_last``. A page that is not there ends its key as an empty one does; the first
    page is number 1. Aggregates with map-side combine and a join on (key, page), never a window over the key: a key may
    own a third of all pages.
    """
    if known_keys is not None:
        pages = pages.where(F.col(key).isin(list(known_keys)))
    marked = pages.select(
        key, "page_no", F.coalesce("is_empty", F.lit(True)).alias("is_empty"), F.coalesce("is_last", F.lit(True)).alias("is_last")
    )
    ends = marked.groupBy(key).agg(
        F.min(F.when(F.col("is_empty"), F.col("page_no"))).alias("first_empty"),
        F.min(F.when(F.col("is_last"), F.col("page_no"))).alias("first_last"),
    )
    numbers = marked.select(key, "page_no")
    following = numbers.select(key, (F.col("page_no") + 1).alias("page_no"))
    following = following.unionByName(ends.select(key, F.lit(1).alias("page_no")))
    gaps = following.join(numbers, [key, "page_no"], "left_anti").where("page_no >= 1")
    return ends.join(gaps.groupBy(key).agg(F.min("page_no").alias("first_gap")), key, "left")


def read_until(
    pages: DataFrame, stops: DataFrame, key: str, known_keys: Sequence[str] | None = None
) -> DataFrame:
    """Pages before the first empty or missing one and up to the first last one of their key.

    With ``known_keys`` (the configured sites) the stops have at most that many rows and are broadcast, so page text
    is never shuffled. Without it the number of keys is unbounded, and Spark chooses the join and splits hot keys;
    ``pages`` should then hold only what is needed.
    """
    if known_keys is not None:
        joined = pages.where(F.col(key).isin(list(known_keys))).join(F.broadcast(stops), key, "left")
    else:
        joined = hot_key_join(pages, stops, key, "left")
    before_empty = F.col("first_empty").isNull() | (F.col("page_no") < F.col("first_empty"))
    up_to_last = F.col("first_last").isNull() | (F.col("page_no") <= F.col("first_last"))
    before_gap = F.col("first_gap").isNull() | (F.col("page_no") < F.col("first_gap"))
    return joined.where(before_empty & up_to_last & before_gap).select(*pages.columns)


def event_links(listing: DataFrame) -> DataFrame:
    """Event ids linked from listing pages: ``page_no, pos, event_id``, one row per link."""
    hrefs = F.transform(
        markup.tags_of(markup.visible(F.col("html")), "a", markup.value_contains("href", EVENT_LINK)),
        lambda tag: event_id_of(markup.attribute(tag, "href")),
    )
    return explode_once(listing, ["page_no"], hrefs, "pos", "event_id").where("event_id <> ''")


def discover_event_ids(listing: DataFrame) -> DataFrame:
    """First occurrence of every event id, up to the first page that is missing or brings no new id:
    ``event_id, page_no, pos``. A listing starts at page 1."""
    first_seen = (
        event_links(listing)
        .groupBy("event_id")
        .agg(F.min(F.struct("page_no", "pos")).alias("first"))
        .select("event_id", "first.page_no", "first.pos")
    )
    # One row each: the first page, there or not, none of whose ids is seen there first; and where the listing starts.
    pages = listing.select("page_no")
    pages = pages.unionByName(pages.select((F.col("page_no") + 1).alias("page_no")))
    nothing_new = (
        pages.where("page_no >= 1")
        .join(first_seen.select("page_no").distinct(), "page_no", "left_anti")
        .agg(F.min("page_no").alias("page_no"))
    )
    starts = listing.agg(F.min("page_no")).scalar()
    stop = F.when(starts > 1, F.lit(1)).otherwise(nothing_new.scalar())
    return first_seen.where(stop.isNull() | (F.col("page_no") < stop))


def first_ids(discovered: DataFrame, max_events: int | None = None) -> DataFrame:
    """Discovered ids with their place in the listing: ``position, event_id``, all or the first ``max_events``.

    A limited list is numbered from 1. Without a limit the place orders the ids without a count over the whole table.
    """
    if max_events is None:
        return discovered.select((F.col("page_no").cast("bigint") * PAGE_ROOM + F.col("pos")).alias("position"), "event_id")
    top = discovered.orderBy("page_no", "pos").limit(max_events)
    return top.select(number_rows("page_no", "pos").alias("position"), "event_id")


def number_rows(*order: str | Column) -> Column:
    """Row number over an already limited set; the window has one partition, so never use it on a whole table."""
    return F.row_number().over(Window.orderBy(*order))
