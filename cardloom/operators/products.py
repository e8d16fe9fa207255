"""Product catalogue: API responses and catalogue pages to one product table."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardloom.constants import (
    EXPANSION_PARAMETER,
    HONG_KONG_BASE_URL,
    HONG_KONG_EN,
    HONG_KONG_ZH,
    JAPAN,
    JAPAN_BASE_URL,
    PRICE_LABEL,
    PRICE_UNIT,
    PRODUCT_COLUMNS,
)
from cardloom.functions import markup
from cardloom.functions.cards import joined_name
from cardloom.functions.dates import japanese_date, month_first_date, release_sort_key
from cardloom.functions.once import explode_once, select_once
from cardloom.functions.text import clean_lines, decode_references, or_empty, scalar_text, select_decoded
from cardloom.functions.urls import absolute_url, image_code, query_value
from cardloom.operators.joins import hot_key_join
from cardloom.operators.paging import merge_copies, one_of_each, read_until, reading_stops
from cardloom.schemas import API_RESPONSE_DDL
from cardloom.session import OPEN_STAGES, Stages

_CORRUPT = "corrupt_record"


@dataclass(frozen=True)
class Site:
    """A catalogue site: its key in the page table, its country label, the language of its price pages."""

    key: str
    country: str
    price_language: str
    base_url: str = HONG_KONG_BASE_URL


HONG_KONG_SITES = (Site("en", HONG_KONG_EN, "hk-en"), Site("zh", HONG_KONG_ZH, "hk"))


# ---- API responses ---------------------------------------------------------------------------------------------------


def readable_api_pages(pages: DataFrame, stages: Stages = OPEN_STAGES) -> DataFrame:
    """Responses that a page-by-page read reaches: pages 1 to ``maxPage`` of page 1, before the first one that is
    unreadable or not there.

    ``pages`` has ``page_no int, body string``. The result has ``page_no, response``, error responses left out. Bodies
    are parsed once into a staged table; a second parse is for those only that do not fit the declared fields. Copies
    of a page count once.
    """
    response = F.from_json("body", f"{API_RESPONSE_DDL}, {_CORRUPT} string", {"columnNameOfCorruptRecord": _CORRUPT})
    parsed = select_once(pages, ["page_no", "body"], response.alias("response"))
    suspect = F.col("response").isNull() | F.col(f"response.{_CORRUPT}").isNotNull()
    broken = ~F.startswith(F.ltrim("body"), F.lit("{")) | F.when(suspect, F.try_parse_json("body").isNull()).otherwise(False)
    kept = parsed.select(
        "page_no",
        F.coalesce(broken, F.lit(True)).alias("broken"),
        F.col("response").dropFields(_CORRUPT).alias("response"),
        F.xxhash64("body").alias("copy"),
    )
    landed = stages.write(kept.where("page_no is not null"), "api-responses")
    landed = merge_copies(landed, stages, _largest_copy, "page_no")
    last_page = landed.where("page_no = 1").agg(F.max(F.coalesce("response.maxPage", F.lit(1)))).scalar()
    numbers = landed.where("not broken").select("page_no").distinct()
    following = numbers.where("page_no >= 1").select((F.col("page_no") + 1).alias("page_no"))
    gap = following.join(numbers, "page_no", "left_anti").agg(F.min("page_no")).scalar()
    starts = numbers.where("page_no >= 1").agg(F.min("page_no")).scalar()
    reached = landed.where(~F.col("broken") & (F.col("page_no") <= last_page) & (F.col("page_no") < gap) & (starts == 1))
    return reached.where("response.result = 1").select("page_no", "response")


def _largest_copy(landed: DataFrame) -> DataFrame:
    first = landed.groupBy("page_no").agg(F.max("copy").alias("copy"))
    return landed.join(first, ["page_no", "copy"]).dropDuplicates(["page_no"])


def api_products(pages: DataFrame, stages: Stages = OPEN_STAGES) -> DataFrame:
    """Products of the landed API responses: ``page_no, pos`` and the product columns, named products only."""
    items = explode_once(readable_api_pages(pages, stages), ["page_no"], F.col("response.products"), "pos", "item")
    field = lambda name: or_empty(F.col(f"item.{name}"))
    link = lambda name: absolute_url(field(name), JAPAN_BASE_URL)
    title = field("productTitle")
    return items.where(title != "").select(
        "page_no",
        "pos",
        F.lit(JAPAN).alias("country"),
        joined_name(field("productType"), title, " ").alias("product_name"),
        field("priceTxt").alias("price"),
        japanese_date(field("releaseDate")).alias("release_date"),
        image_code(field("tumbsImg")).alias("code"),
        link("link_detailPage").alias("link"),
        link("tumbsImg").alias("image_url"),
        clean_lines(field("description")).alias("include"),
        F.lit("").alias("card_only"),
        field("productType").alias("product_type"),
        scalar_text(F.col("item.beginnerFlg")).alias("beginner_flag"),
        field("storesAvailable").alias("stores_available"),
        link("link_cardList").alias("link_card_list"),
        link("link_pokemonCenter").alias("link_pokemon_center"),
    )


# ---- catalogue pages -------------------------------------------------------------------------------------------------

_LIST = ("ul", markup.has_class("expansionList"))
_ITEM = ("li", markup.has_class("expansion"))


def catalog_pages(
    pages: DataFrame, sites: Sequence[Site] = HONG_KONG_SITES, stages: Stages = OPEN_STAGES
) -> DataFrame:
    """Catalogue pages that following the next-page links reaches: ``site, page_no, items``.

    ``pages`` has ``site, page_no, html``. Each page is read once: it becomes its marks and the insides of its items,
    which are staged. A page that is not there ends its site; copies of a page count once.
    """
    html = F.col("html")
    keys = [site.key for site in sites]
    chosen = pages.where(F.col("site").isin(keys))
    shown = select_once(chosen, ["site", "page_no"], markup.visible(html).alias("html"))
    next_item = markup.inner(
        markup.inner(html, "nav", markup.has_class("pagination")), "li", markup.has_class("paginationItem next")
    )
    parsed = select_once(
        shown,
        ["site", "page_no"],
        (~markup.found(next_item, markup.opening("a"))).alias("is_last"),
        markup.inners(markup.inner(html, *_LIST), *_ITEM).alias("items"),
    )
    parsed = parsed.select("site", "page_no", (F.size("items") == 0).alias("is_empty"), "is_last", "items")
    of_each = lambda copies: one_of_each(copies, "site", "page_no")
    slim = merge_copies(stages.write(parsed, "catalogue-pages"), stages, of_each, "site", "page_no")
    return read_until(slim, reading_stops(slim, "site", keys), "site", keys).select("site", "page_no", "items")


def catalog_items(pages: DataFrame, sites: Sequence[Site] = HONG_KONG_SITES) -> DataFrame:
    """Items of reached catalogue pages (``catalog_pages``): ``site, page_no, pos``, the nine product columns such a page
    has, and ``price_language``; the price is still empty. Items with neither a name nor a link are dropped."""
    item = F.col("item")
    series, time = ("span", markup.has_class("series")), ("time", markup.class_contains("date", ignore_case=True))
    link = markup.tag_of(item, "a", markup.has_class("expansionLink"), markup.has_attribute("href"))
    image = markup.tag_of(item, "img", markup.has_attribute("src"))
    fields = {
        "title": markup.raw_stripped_text(markup.inner(item, "h3", markup.has_class("expansionTitle"))),
        "series": markup.raw_stripped_text(markup.inner(item, *series)),
        "link": markup.raw_attribute(link, "href"),
        "image": markup.raw_attribute(image, "src"),
        "day": markup.raw_attribute(markup.tag_of(item, *time), "datetime"),
        "time": markup.raw_stripped_text(markup.inner(item, *time)),
    }
    there = [
        markup.found(item, markup.opening(*series)).alias("has_series"),
        (link != "").alias("has_link"),
        (image != "").alias("has_image"),
    ]
    items = explode_once(pages, ["site", "page_no"], F.col("items"), "pos", "item")
    texts = select_decoded(items, ["site", "page_no", "pos"], fields, there)
    name = (
        F.when(~F.col("has_series"), F.col("title"))
        .when(F.col("title") != "", F.concat("series", F.lit(" - "), "title"))
        .otherwise(F.col("series"))
    )
    parsed = texts.select(
        "site",
        "page_no",
        "pos",
        name.alias("product_name"),
        F.coalesce(F.nullif("day", F.lit("")), F.col("time")).alias("date_text"),
        _completed("has_link", "link", sites).alias("link"),
        _completed("has_image", "image", sites).alias("image_url"),
    )
    return parsed.where("product_name <> '' or link <> ''").select(
        "site",
        "page_no",
        "pos",
        _by_site(sites, "country").alias("country"),
        "product_name",
        F.lit("").alias("price"),
        month_first_date(F.col("date_text")).alias("release_date"),
        query_value(F.col("link"), EXPANSION_PARAMETER).alias("code"),
        "link",
        "image_url",
        F.lit("").alias("include"),
        F.lit("Yes").alias("card_only"),
        _by_site(sites, "price_language").alias("price_language"),
    )


def _by_site(sites: Sequence[Site], attribute: str) -> Column:
    return reduce(
        lambda chosen, site: F.when(F.col("site") == site.key, F.lit(getattr(site, attribute))).otherwise(chosen),
        sites,
        F.lit(None).cast("string"),
    )


def _completed(there: str, value: str, sites: Sequence[Site]) -> Column:
    # An attribute that is there but empty still gets the base address.
    return (
        F.when(~F.col(there), F.lit(""))
        .when(F.startswith(value, F.lit("http")), F.col(value))
        .otherwise(F.concat(_by_site(sites, "base_url"), value))
    )


# ---- prices ----------------------------------------------------------------------------------------------------------


def detail_prices(pages: DataFrame) -> DataFrame:
    """Prices of landed detail pages (``lang, code, html``): ``price_language, code_key, price``, one row per key.

    Copies of a page are merged by an aggregate with map-side combine before anything is joined to them. Pages
    without a price are left out, as a missing row and an empty price mean the same to :func:`with_prices`.
    """
    section = markup.inner(markup.visible(F.col("html")), "section", markup.has_class("section-product"))
    data_part = markup.inner(F.col("section"), "div", markup.has_class("data-product"))
    box_part = markup.inner(F.col("section"), "div", markup.has_class("box-red"))
    # Where a price is looked for, in this order.
    places = F.concat(F.array(data_part), markup.inners(box_part, "p"), F.array(F.col("section")))
    prices = F.transform("texts", lambda text: _price_in(decode_references(text)))
    price = F.get(F.filter(prices, lambda text: text != ""), F.lit(0))
    keys = [F.col("lang").alias("price_language"), F.lower("code").alias("code_key")]
    sections = select_once(pages, keys, section.alias("section")).where("section <> ''")
    texts = select_once(sections, ["price_language", "code_key"], F.transform(places, markup.raw_element_text).alias("texts"))
    return (
        select_once(texts, ["price_language", "code_key"], price.alias("amount"))
        .where("amount is not null")
        .groupBy("price_language", "code_key")
        .agg(F.concat(F.max("amount"), F.lit(PRICE_UNIT)).alias("price"))
    )


def _price_in(text: Column) -> Column:
    return F.regexp_extract(text, rf"(?U){PRICE_LABEL}\s*(\d+){PRICE_UNIT}", 1)


def with_prices(items: DataFrame, prices: DataFrame) -> DataFrame:
    """Catalogue items with their price by (language, lower-case code); ``''`` where there is none.

    ``prices`` has one row per key, so a hot code multiplies nothing; Spark broadcasts it when it is small and splits
    hot partitions otherwise.
    """
    keyed = items.drop("price").withColumn("code_key", F.lower("code"))
    joined = hot_key_join(keyed, prices, ["price_language", "code_key"], "left")
    return joined.withColumn("price", or_empty(F.col("price"))).drop("code_key")


# ---- union and order -------------------------------------------------------------------------------------------------

ORDER_COLUMNS = ("source_no", "site_no", "page_no", "pos")


def union_products(*sources: DataFrame) -> DataFrame:
    """Append product sources in the given order; columns a source lacks become ``''``.

    A source that holds several sites brings ``site_no``, the place of each site within it.
    """
    if not sources:
        raise ValueError("at least one product source is needed")
    numbered = []
    for number, source in enumerate(sources):
        within = F.col("site_no") if "site_no" in source.columns else F.lit(0)
        numbered.append(source.withColumn("source_no", F.lit(number)).withColumn("site_no", within))
    union = reduce(lambda left, right: left.unionByName(right, allowMissingColumns=True), numbered)
    filled = [
        (or_empty(F.col(name)) if name in union.columns else F.lit("")).alias(name) for name in PRODUCT_COLUMNS
    ]
    return union.select(*ORDER_COLUMNS, *filled)


def number_sites(items: DataFrame, sites: Sequence[Site] = HONG_KONG_SITES) -> DataFrame:
    """Add ``site_no``, so that items of all sites are worked out in one pass and still keep their site's place."""
    number = reduce(
        lambda chosen, numbered: F.when(F.col("site") == numbered[1].key, F.lit(numbered[0])).otherwise(chosen),
        enumerate(sites),
        F.lit(len(sites)),
    )
    return items.withColumn("site_no", number)


def sort_products(products: DataFrame, undated: str = "first") -> DataFrame:
    """Newest first, ties in source order; ``undated`` rows come ``'first'`` or ``'last'``.

    The whole order key takes part in the range partitioning, so many rows with one date still spread.
    """
    if undated not in ("first", "last"):
        raise ValueError("undated is 'first' or 'last'")
    key = release_sort_key(F.col("release_date"))
    keyed = products.withColumn("sort_key", key)
    order = [F.desc("sort_key"), *ORDER_COLUMNS]
    if undated == "last":
        order.insert(0, F.col("release_date") == "")
    return keyed.orderBy(*order).select("sort_key", *PRODUCT_COLUMNS)
