"""Registered queries: each operator over whole TESTDATA tables. ``oracles.py`` holds the expected outcomes as SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cardloom.functions import dates, markup, urls
from cardloom.functions.cards import card_code_of, card_name_of
from cardloom.functions.once import explode_once
from cardloom.functions.text import decode_references, select_decoded
from cardloom.operators import audit, codes, decks, events, paging, products, summaries
from cardloom.plans import backfill, ingest, standing, summary
from cardloom.plans.catalog import product_catalog
from cardloom.schemas import DECK_DDL, EVENT_DDL, STORED_EVENT_FIELDS
from cardloom.session import OPEN_STAGES, fresh_path, numbered
from cardloom.sinks import documents as sinks
from cardloom.sources import documents as sources
from cardloom.testbed import inputs
from cardloom.testbed.inputs import ENERGY_STAND_INS

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


# ---- events ----------------------------------------------------------------------------------------------------------


@query
def event_totals(spark, folder):
    return summaries.event_totals(inputs.events_with_counts(spark, folder), "participants")


@query
def events_by_date(spark, folder):
    return summaries.events_by_date(inputs.events(spark, folder))


@query
def events_in_range(spark, folder):
    return summaries.events_by_date(inputs.events(spark, folder), 10, "1996-01-01", "1998-12-31")


@query
def stored_events_in_range(spark, folder):
    """All dates of a range, from a store that three runs filled and whose files were merged; reads its months only."""
    store, events = fresh_path(spark, "store"), inputs.events(spark, folder)
    fields = [
        F.col(name) if name in events.columns else F.lit(None).cast(kind).alias(name)
        for name, kind in STORED_EVENT_FIELDS.items()
    ]
    first, second = "1997-06-10", "1997-06-20"
    date = F.col("event_date")
    for run in (date < first, date.between(first, second), date > second):
        ingest.append_events(events.where(run).select(*fields), store)
    ingest.merge_event_files(spark, store)
    found = ingest.stored_events_between(spark, store, "1996-01-01", "1998-12-31")
    return summaries.events_by_date(found, None)


@query
def event_counts_by_date(spark, folder):
    return summaries.events_by_date(inputs.events(spark, folder), None)


@query
def host_counts(spark, folder):
    return summaries.top_hosts(inputs.events(spark, folder), None, None)


@query
def top_hosts(spark, folder):
    # a prefix that merges customers, as the cut merges hosts
    return summaries.top_hosts(inputs.events(spark, folder), width=16)


# ---- players ---------------------------------------------------------------------------------------------------------


@query
def player_stats(spark, folder):
    return summaries.player_stats(inputs.results(spark, folder))


@query
def player_appearances(spark, folder):
    return summaries.player_appearances(inputs.results(spark, folder))


@query
def player_total(spark, folder):
    return summaries.player_total(inputs.results(spark, folder))


@query
def top_players(spark, folder):
    return summaries.top_players(summaries.player_stats(inputs.results(spark, folder)))


@query
def first_places(spark, folder):
    return summaries.first_places(summaries.player_stats(inputs.results(spark, folder)))


@query
def first_place_total(spark, folder):
    return summaries.first_place_total(inputs.results(spark, folder))


# ---- standing reports ------------------------------------------------------------------------------------------------


def _standing(spark, dated, source, first="1997-06-10"):
    """The state after a refresh with the days before ``first``, and one with all days.

    Each refresh scans its input for its days and once more per part, so the joins behind the input are worked out before.
    """
    state = fresh_path(spark, "state")
    dated = OPEN_STAGES.write(dated, f"dated-{source}")
    standing.refresh(dated.where(F.col("event_date") < first), state, source)
    standing.refresh(dated, state, source)
    return state


@query
def standing_host_counts(spark, folder):
    events = inputs.events(spark, folder).withColumn("participants", F.lit(0))
    hosts = standing.part_rows(spark, _standing(spark, events, "events"), "hosts")
    return summaries.top_hosts(hosts, None, None, F.sum("events"))


@query
def standing_player_stats(spark, folder):
    state = _standing(spark, inputs.results(spark, folder), "results")
    return standing.player_stats(standing.part_rows(spark, state, "players"))


@query
def standing_document_archetypes(spark, folder):
    dates = inputs.events(spark, folder).select(F.concat(F.lit("D"), "event_id").alias("deck_id"), "event_date")
    documents = decks.parse_deck_pages(inputs.deck_pages(spark, folder))
    state = _standing(spark, documents.join(dates, "deck_id"), "decks")
    return standing.reports(spark, state)["deck_archetypes"]


# ---- decks -----------------------------------------------------------------------------------------------------------


@query
def deck_archetypes(spark, folder):
    return summaries.deck_archetypes(inputs.cards(spark, folder), markers=ENERGY_STAND_INS)


@query
def deck_key_cards(spark, folder):
    return summaries.deck_key_cards(inputs.cards(spark, folder), 3, ENERGY_STAND_INS)


@query
def card_usage(spark, folder):
    return summaries.card_usage(inputs.cards(spark, folder))


@query
def card_copies(spark, folder):
    return summaries.card_usage(inputs.cards(spark, folder), None)


@query
def archetype_counts_all(spark, folder):
    return summaries.deck_archetypes(inputs.cards(spark, folder), None, ENERGY_STAND_INS)


def _deck_totals(spark, folder):
    totals = summaries.deck_card_totals(inputs.cards(spark, folder))
    return inputs.decks(spark, folder).join(totals, "deck_id", "left").fillna(0, ["copies", "entries"])


@query
def deck_size_stats(spark, folder):
    return summaries.deck_size_stats(_deck_totals(spark, folder), "entries")


@query
def deck_card_totals(spark, folder):
    return _deck_totals(spark, folder)


@query
def event_decks(spark, folder):
    # The deck of an event's results is the order here.
    results = inputs.results(spark, folder).where("deck_id <> ''").select(
        "event_id", "pos", "rank", F.substring_index("deck_id", "-", 1).alias("deck_id")
    )
    return audit.event_decks(results, _deck_totals(spark, folder)).select("event_id", "pos", "rank", "deck_id", "entries")


@query
def document_archetypes(spark, folder):
    return summary.summarize_deck_archetypes(decks.parse_deck_pages(inputs.deck_pages(spark, folder)))


@query
def document_totals(spark, folder):
    return summary.document_totals(decks.parse_deck_pages(inputs.deck_pages(spark, folder)))


# ---- scalar functions ------------------------------------------------------------------------------------------------


@query
def norm_dates(spark, folder):
    raw = inputs.table(spark, folder, "orders").select(
        "o_orderkey",
        F.expr(
            "case o_orderstatus when 'F' then date_format(o_orderdate, 'yyyy年 M月d日（金）') "
            "when 'O' then date_format(o_orderdate, 'yyyy年M月dd日') else '未定' end"
        ).alias("japanese"),
        F.expr(
            "case o_orderstatus when 'F' then date_format(o_orderdate, 'M-d-yyyy x') "
            "when 'O' then date_format(o_orderdate, 'MM-dd-yyyy') else date_format(o_orderdate, 'yyyy-MM-dd') end"
        ).alias("month_first"),
    )
    return raw.select(
        "o_orderkey",
        dates.japanese_date(F.col("japanese")).alias("jp_date"),
        dates.event_date(F.col("japanese")).alias("event_date"),
        dates.month_first_date(F.col("month_first")).alias("hk_date"),
    )


@query
def url_code(spark, folder):
    return inputs.spread_table(spark, folder, "pages").select("page_id", urls.query_value(F.col("url"), "page").alias("code"))


@query
def split_name_code(spark, folder):
    full_name = F.expr(
        "case p_size % 4 when 0 then p_name when 1 then concat(p_name, '(', p_brand, ')') "
        "when 2 then concat(p_name, ' (x)( ', p_brand, ' )') else concat(p_name, '()') end"
    )
    return inputs.table(spark, folder, "part").select(
        "p_partkey", card_name_of(full_name).alias("card_name"), card_code_of(full_name).alias("card_code")
    )


@query
def deck_file_names(spark, folder):
    return audit.deck_file_names(inputs.result_keys(spark, folder))


# ---- products --------------------------------------------------------------------------------------------------------


@query
def api_products(spark, folder):
    return products.api_products(inputs.api_pages(spark, folder))


@query
def catalog_pages_until_terminal(spark, folder):
    return products.catalog_pages(inputs.catalog_pages(spark, folder)).select("site", "page_no")


@query
def catalog_items(spark, folder):
    items = products.catalog_items(products.catalog_pages(inputs.catalog_pages(spark, folder)))
    return items.select(
        "site", "page_no", "pos", "country", "product_name", "release_date", "code", "link", "image_url", "card_only"
    )


@query
def price_enrich(spark, folder):
    items = products.catalog_items(products.catalog_pages(inputs.catalog_pages(spark, folder)))
    priced = products.with_prices(items, products.detail_prices(inputs.detail_pages(spark, folder)))
    return priced.select("page_no", "pos", "price_language", "code", "price")


def _catalog(spark, folder):
    return product_catalog(
        inputs.api_pages(spark, folder), inputs.catalog_pages(spark, folder), inputs.detail_pages(spark, folder)
    )


@query
def products_union_sorted(spark, folder):
    """The sorted products, each with its place in the order."""
    unsorted = OPEN_STAGES.write(_catalog(spark, folder), "products-unsorted")
    return numbered(OPEN_STAGES, products.sort_products(unsorted), "products")


# ---- card codes ------------------------------------------------------------------------------------------------------


@query
def missing_codes(spark, folder):
    return codes.missing_codes(inputs.cards(spark, folder))


@query
def missing_code_files(spark, folder):
    return codes.missing_code_files(inputs.cards(spark, folder))


@query
def missing_codes_preview(spark, folder):
    return codes.missing_codes_preview(codes.missing_codes(inputs.cards(spark, folder)))


@query
def cache_status(spark, folder):
    return codes.cache_status(codes.missing_ids(inputs.cards(spark, folder)), inputs.code_cache(spark, folder))


@query
def codes_to_fetch(spark, folder):
    return codes.codes_to_fetch(codes.missing_ids(inputs.cards(spark, folder)), inputs.code_cache(spark, folder))


@query
def card_code_extract(spark, folder):
    return codes.extract_card_codes(inputs.code_pages(spark, folder))


@query
def code_cache_upsert(spark, folder):
    return codes.upsert_cache(inputs.code_cache(spark, folder), codes.fetched_codes(inputs.code_pages(spark, folder)))


@query
def backfill_codes(spark, folder):
    filled = codes.backfill_codes(inputs.cards(spark, folder), code_cache_upsert(spark, folder))
    return filled.select("deck_id", "pos", "card_id", "card_code", "filled")


@query
def backfill_report(spark, folder):
    return codes.backfill_report(inputs.cards(spark, folder), code_cache_upsert(spark, folder))


@query
def backfill_documents(spark, folder):
    documents = decks.parse_deck_pages(inputs.deck_pages(spark, folder)).withColumn("deck_file", F.col("deck_id"))
    known = code_cache_upsert(spark, folder).select(
        (F.col("card_id").cast("bigint") + 40000).cast("string").alias("card_id"), "card_code"
    )
    changed = codes.backfill_documents(documents, known)
    return decks.cards_of(changed).select("deck_id", "pos", "card_id", "card_code")


@query
def backfill_run(spark, folder):
    """The store after a back-fill in place."""
    store, cache_path = fresh_path(spark, "decks"), fresh_path(spark, "cache")
    moved = lambda t: t.withColumn("card_id", (F.col("card_id").cast("bigint") + 40000).cast("string"))
    documents = decks.parse_deck_pages(inputs.deck_pages(spark, folder))
    documents = documents.withColumn("deck_file", F.col("deck_id")).withColumn("shard", F.substring("deck_id", 2, 1))
    backfill.write_decks(documents, store, "shard")
    backfill.run_backfill(
        spark, store, moved(inputs.code_cache(spark, folder)), moved(inputs.code_pages(spark, folder)), cache_path, "shard"
    )
    read, _ = sources.read_document_lines(spark, store, f"{DECK_DDL}, deck_file string", "shard_folder")
    return decks.cards_of(read).select("deck_id", "pos", "card_id", "card_code")


# ---- ingest ----------------------------------------------------------------------------------------------------------


@query
def discover_ids(spark, folder):
    return paging.first_ids(paging.discover_event_ids(inputs.listing_pages(spark, folder)), 100)


@query
def discover_all_ids(spark, folder):
    return paging.discover_event_ids(inputs.listing_pages(spark, folder))


def _audit(spark, folder, *columns):
    listed = inputs.table(spark, folder, "orders").selectExpr("cast(o_orderkey as string) as event_id", *columns)
    return audit.ingest_audit(listed, inputs.stored_events(spark, folder), inputs.stored_decks(spark, folder))


@query
def ingest_audit(spark, folder):
    return _audit(spark, folder)


@query
def ingest_candidates(spark, folder):
    landed = inputs.events_with_counts(spark, folder).selectExpr("event_id", "participants as landed")
    return audit.ingest_candidates(_audit(spark, folder, "o_orderkey as position"), landed, 50)


@query
def ingest_all_candidates(spark, folder):
    landed = inputs.events_with_counts(spark, folder).selectExpr("event_id", "participants as landed")
    return audit.ingest_candidates(_audit(spark, folder, "o_orderkey as position"), landed)


@query
def ingest_run(spark, folder):
    """The store after a run and a run again."""
    store = fresh_path(spark, "store")
    landed = (
        inputs.order_listing(spark, folder), inputs.landed_event_pages(spark, folder), inputs.order_deck_pages(spark, folder)
    )
    for _ in range(2):
        ingest.run_ingest(spark, *landed, store)
    events, results, decks = ingest.stored(spark, store)
    counts = lambda table, name: table.groupBy("event_id").agg(F.count("*").alias(name))
    joined = events.join(counts(results, "results"), "event_id", "left").join(counts(decks, "decks"), "event_id", "left")
    return joined.select("event_id", "event_date", "event_location", "expected", "expected_named", "results", "decks")


@query
def missing_decks(spark, folder):
    results = inputs.result_keys(spark, folder).drop("flag")
    return audit.missing_decks(results, inputs.stored_decks(spark, folder))


# ---- pages -----------------------------------------------------------------------------------------------------------


@query
def page_text(spark, folder):
    return inputs.spread_table(spark, folder, "pages").select("page_id", markup.stripped_text(F.col("html")).alias("text"))


@query
def page_header(spark, folder):
    html = F.col("html")
    fields = {
        "title": markup.raw_stripped_text(markup.inner(html, "title")),
        "h1": markup.raw_stripped_text(markup.inner(html, "h1")),
        "lang": markup.raw_attribute(markup.tag_of(html, "html"), "lang"),
    }
    return select_decoded(inputs.spread_table(spark, folder, "pages"), ["page_id"], fields)


@query
def page_links(spark, folder):
    links = F.transform(markup.tags_of(F.col("html"), "a"), lambda tag: markup.attribute(tag, "href"))
    return explode_once(inputs.spread_table(spark, folder, "pages"), ["page_id"], links, "pos", "href")


@query
def event_headers(spark, folder):
    return events.event_headers(inputs.event_pages(spark, folder))


@query
def event_result_rows(spark, folder):
    return events.event_results(inputs.event_pages(spark, folder))


@query
def deck_cards(spark, folder):
    parsed = decks.parse_deck_pages(inputs.deck_pages(spark, folder))
    return decks.cards_of(parsed, "deck_id", "deck_code")


@query
def flat_deck_cards(spark, folder):
    return decks.flat_deck_cards(decks.cards_of(decks.parse_deck_pages(inputs.deck_pages(spark, folder))))


@query
def flat_deck_lists(spark, folder):
    parsed = decks.parse_deck_pages(inputs.deck_pages(spark, folder))
    return decks.flat_deck_lists(inputs.event_documents(spark, folder), parsed)


@query
def flat_events(spark, folder):
    return decks.flat_events(inputs.event_documents(spark, folder))


@query
def decoded_references(spark, folder):
    pages = inputs.spread_table(spark, folder, "pages")
    raw = F.concat(F.lit("&eacute;&#12354;&#x3042;&hellip;&amp;lt;&none; "), F.col("url"))
    return pages.select("page_id", decode_references(raw).alias("text"))


# ---- file round trips ------------------------------------------------------------------------------------------------


def _one_file_each(table, key, path):
    """One text file per row, each in a folder of its own.

    The tasks are named, as adaptive execution would merge rows this short into one task, which wrote all files by itself.
    Tasks put their files in place themselves: else the driver moves one folder after the other. The path is new, so what
    a lost run leaves there is never read.
    """
    tasks = inputs.tasks_for(table)
    writer = table.repartition(tasks, key).write.option("mapreduce.fileoutputcommitter.algorithm.version", "2")
    writer.partitionBy(key).text(path)
    return path


@query
def event_scan_roundtrip(spark, folder):
    path = _one_file_each(inputs.supplier_event_documents(spark, folder), "event", fresh_path(spark, "events"))
    read = sources.read_event_documents(spark, path, "event=*/*.txt")
    place = F.regexp_extract("folder", "event=([^/]*)$", 1).alias("folder")
    return read.select("event_id", "event_date", "event_title", F.size("results").alias("results"), place)


@query
def deck_scan_roundtrip(spark, folder):
    whole = inputs.supplier_deck_documents(spark, folder).where("deck % 5 <> 0 and deck % 7 <> 0")
    path = _one_file_each(whole, "deck", fresh_path(spark, "decks"))
    read = sources.read_deck_documents(spark, path, "deck=*/*.txt", "deck=([^/]*)/[^/]*$")
    file = F.regexp_extract("deck_file", "(deck=[^/]*)/[^/]*$", 1).alias("deck_file")
    return read.select("deck_id", "event_id", file, F.explode("cards").alias("c")).select("deck_id", "event_id", "deck_file", "c.*")


@query
def deck_scan_tolerant(spark, folder):
    path = _one_file_each(inputs.supplier_deck_documents(spark, folder), "deck", fresh_path(spark, "decks"))
    good, bad = sources.read_deck_documents_tolerant(spark, path, "deck=*/*.txt", "deck=([^/]*)/[^/]*$")
    file = F.regexp_extract("deck_file", "(deck=[^/]*)/[^/]*$", 1).alias("deck_file")
    return good.select(file, F.lit("read").alias("state")).unionByName(bad.select(file, F.lit("rejected").alias("state")))


@query
def code_cache_scan(spark, folder):
    path = _one_file_each(inputs.supplier_code_objects(spark, folder), "part", fresh_path(spark, "cache"))
    return sources.read_code_cache(spark, f"{path}/part=*/*.txt", layout="object")


@query
def event_lines_roundtrip(spark, folder):
    path = fresh_path(spark, "events")
    sinks.write_documents(inputs.event_documents(spark, folder), path, "event_year")
    read, _ = sources.read_document_lines(spark, path, EVENT_DDL, "event_year_folder")
    return events.results_of(read)


@query
def deck_lines_roundtrip(spark, folder):
    path = fresh_path(spark, "decks")
    documents = decks.parse_deck_pages(inputs.deck_pages(spark, folder))
    prefix = F.left(F.regexp_extract("deck_id", r"(\d+)", 1), F.lit(1))
    sinks.write_documents(documents.withColumn("shard", prefix), path, "shard")
    read, _ = sources.read_document_lines(spark, path, DECK_DDL, "shard_folder")
    return decks.cards_of(read)


def _half_broken_lines(spark, folder) -> str:
    """Deck documents as lines, those whose id holds a 7 cut in the middle."""
    path = fresh_path(spark, "deck-lines")
    documents = decks.parse_deck_pages(inputs.deck_pages(spark, folder))
    line = F.to_json(F.struct(*documents.columns))
    broken = F.contains("deck_id", F.lit("7"))
    cut = F.when(broken, F.left(line, F.char_length(line) - 2)).otherwise(line)
    documents.select(cut.alias("value")).write.text(path)
    return path


@query
def deck_lines_tolerant(spark, folder):
    good, bad = sources.read_document_lines(spark, _half_broken_lines(spark, folder), DECK_DDL)
    return good.select("deck_id", F.lit("read").alias("state")).unionByName(
        bad.select(F.regexp_extract("text", '"deck_id":"([^"]*)"', 1).alias("deck_id"), F.lit("rejected").alias("state"))
    )


@query
def code_cache_lines(spark, folder):
    path = fresh_path(spark, "cache")
    sinks.write_code_cache(inputs.code_cache(spark, folder), path)
    return sources.read_code_cache(spark, path, layout="lines")


@query
def code_cache_appended(spark, folder):
    """A cache to which only the codes of new ids were added."""
    path = fresh_path(spark, "cache")
    sinks.append_code_cache(inputs.code_cache(spark, folder), path)
    sinks.append_code_cache(codes.fetched_codes(inputs.code_pages(spark, folder)), path)
    return sources.read_code_cache(spark, path, layout="lines")


@query
def products_csv_roundtrip(spark, folder):
    path = fresh_path(spark, "products")
    sinks.write_products(_catalog(spark, folder), path)
    return sinks.read_product_csv(spark, path)
