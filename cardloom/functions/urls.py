"""Links and the codes inside them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from cardloom.constants import (
    DECK_LINK,
    EVENT_LINK,
    IMAGE_ENDINGS,
    IMAGE_FOLDER,
    JAPAN_BASE_URL,
    PLAYERS_BASE_URL,
)


def absolute_url(path: Column, base: str) -> Column:
    """Complete a link: empty stays empty, ``http…`` stays, everything else is appended to ``base``."""
    return (
        F.when(F.coalesce(path, F.lit("")) == "", F.lit(""))
        .when(F.startswith(path, F.lit("http")), path)
        .otherwise(F.concat(F.lit(base), path))
    )


def query_value(url: Column, name: str) -> Column:
    """Text after the first ``name=`` up to the next ``&``; ``''`` if the name is not there."""
    return F.regexp_extract(url, f"{name}=([^&]*)", 1)


def image_code(path: Column) -> Column:
    """Text after the last ``/images/`` without its ``.jpg`` and ``.png``; ``''`` if the folder is not there."""
    name = F.substring_index(path, IMAGE_FOLDER, -1)
    bare = reduce(lambda text, ending: F.replace(text, F.lit(ending), F.lit("")), IMAGE_ENDINGS, name)
    return F.when(F.contains(path, F.lit(IMAGE_FOLDER)), bare).otherwise(F.lit(""))


def event_url(event_id: Column) -> Column:
    return F.concat(F.lit(f"{PLAYERS_BASE_URL}{EVENT_LINK}"), event_id, F.lit("/result"))


def event_id_of(url: Column) -> Column:
    """Digits after ``/event/detail/``, ``''`` if there are none."""
    return F.regexp_extract(url, rf"(?U){EVENT_LINK}(\d+)", 1)


def deck_url(deck_id: Column) -> Column:
    return F.concat(F.lit(f"{JAPAN_BASE_URL}/deck/confirm.html/{DECK_LINK}/"), deck_id)


def deck_id_of(url: Column) -> Column:
    return F.regexp_extract(url, f"{DECK_LINK}/([^/]+)", 1)


def catalog_page_url(list_url: Column, page_no: Column) -> Column:
    """Address of a catalogue page; the first has no page parameter."""
    return F.when(page_no == 1, list_url).otherwise(F.concat(list_url, F.lit("?pageNo="), page_no.cast("string")))


def listing_page_url(page_no: Column, page_size: int = 20) -> Column:
    """Address of page 1, 2, … of the event listing, which counts by row offset."""
    offset = ((page_no - 1) * page_size).cast("string")
    return F.concat(F.lit(f"{PLAYERS_BASE_URL}/event/result/list?offset="), offset)
