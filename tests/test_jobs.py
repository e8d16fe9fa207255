"""Composite jobs: golden rows, and running again changes nothing."""

import contextlib
import glob
import io
import os
import re

import pytest
from pyspark.sql import functions as F

from cardloom.operators import audit, codes, decks, summaries
from cardloom.operators.decks import merge_deck_copies, parse_deck_pages
from cardloom.operators.joins import likely_rows
from cardloom.plans import backfill, catalog, ingest, summary
from cardloom.schemas import DECK_DDL, EVENT_DDL, STORED_EVENT_FIELDS, STORED_RESULTS_DDL
from cardloom.session import shared_folder
from cardloom.sinks.documents import write_documents
from cardloom.sources.documents import read_code_cache, read_document_lines
from cardloom.sources.landed import folder_sizes

EVENTS = [
    ("u", "01", "t", "2025-01-01", "north", "", "", [
        ("1位", "9pt", "Ann", "1", "east", "", "d1"), ("2位", "5pt", "Bob", "2", "west", "", "d2"), ("3位", "1pt", "?", "", "", "", "")]),
    ("u", "02", "t", "2025-01-01", "south", "", "", []),
    ("u", "03", "t", "2025-01-03", "north", "", "", [
        ("1位", "9pt", "Bob B", "2", "west", "", "d3"), ("2位", "5pt", "Ann", "1", "south", "", "d1")]),
    ("u", "04", "t", "2025-01-02", "north", "", "", [("1位", "9pt", "Bobby", "2", "north", "", "d2")]),
]
DECKS = [
    ("u", "d1", "", [("1", "Fox", "X 001/002", 2, ""), ("2", "Owl", "", 3, ""), ("3", "Fox", "Y 001/002", 2, "")]),
    ("u", "d2", "", [("4", "基本エネルギー", "", 9, ""), ("2", "Owl", "", 1, ""), ("5", "Elk", "", 1, ""), ("6", "Fire Energy", "", 4, "")]),
    ("u", "d3", "", [("7", "", "", 4, ""), ("1", "Fox", "X 001/002", 1, "")]),
    ("u", "d4", "", []),
]


@pytest.fixture(scope="module")
def documents(spark):
    return spark.createDataFrame(EVENTS, EVENT_DDL).repartition(3), spark.createDataFrame(DECKS, DECK_DDL).repartition(3)


def rows(table):
    return [tuple(r) for r in table.collect()]


def plan_text(table):
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        table.explain("formatted")
    return text.getvalue()


def test_event_and_player_reports(documents):
    reports = summary.summarize(*documents)
    assert rows(reports["event_totals"]) == [(4, 6, 1.5)]
    assert rows(reports["events_by_date"]) == [("2025-01-03", 1), ("2025-01-02", 1), ("2025-01-01", 2)]
    assert rows(reports["top_hosts"]) == [("north", 3), ("south", 1)]
    assert sorted(rows(reports["player_stats"])) == [("1", "Ann", "south", 2, 1), ("2", "Bob B", "west", 3, 2)]
    assert sorted(rows(reports["player_appearances"])) == [
        ("1", "2025-01-01", "01", 0, "1位", "d1"), ("1", "2025-01-03", "03", 1, "2位", "d1"),
        ("2", "2025-01-01", "01", 1, "2位", "d2"), ("2", "2025-01-02", "04", 0, "1位", "d2"),
        ("2", "2025-01-03", "03", 0, "1位", "d3"),
    ]
    assert rows(reports["player_total"]) == [(2,)] and rows(reports["first_place_total"]) == [(2,)]
    assert rows(reports["first_places"]) == [(1, "2", "Bob B", "west", 2), (2, "1", "Ann", "south", 1)]
    assert rows(reports["top_players"]) == [(1, "2", "Bob B", "west", 3), (2, "1", "Ann", "south", 2)]


def test_deck_reports(documents):
    reports = summary.summarize(*documents)
    assert rows(reports["card_usage"]) == [
        ("基本エネルギー", 9), ("Fire Energy", 4), ("Owl", 4), ("Fox (X 001/002)", 3), ("Fox (Y 001/002)", 2), ("Elk", 1),
    ]
    assert rows(reports["deck_size_stats"]) == [(4, 2.3, 0, 4, 2.3)]
    assert sorted(rows(reports["deck_card_totals"])) == [("d1", 7, 3), ("d2", 15, 4), ("d3", 5, 2), ("d4", 0, 0)]


def test_key_cards_flat_and_in_documents(documents):
    _, table = documents
    assert sorted(rows(summaries.deck_key_cards(decks.cards_of(table)))) == [
        ("d1", 1, "Fox", 4), ("d1", 2, "Owl", 3), ("d2", 1, "Owl", 1), ("d2", 2, "Elk", 1), ("d3", 1, "Fox", 1),
    ]
    nested = table.select("deck_id", decks.key_cards_in(F.col("cards"), 3).alias("top")).collect()
    assert {r["deck_id"]: [(t["card_name"], t["copies"]) for t in r["top"]] for r in nested} == {
        "d1": [("Fox", 4), ("Owl", 3)], "d2": [("Owl", 1), ("Elk", 1)], "d3": [("Fox", 1)], "d4": [],
    }
    assert rows(summary.summarize_deck_archetypes(table)) == [("Fox", 2), ("Owl", 1)]
    assert rows(summaries.deck_archetypes(decks.cards_of(table))) == [("Fox", 2), ("Owl", 1)]


def test_limits_are_optional(documents):
    table, deck_table = documents
    assert sorted(rows(summaries.events_by_date(table, None))) == [("2025-01-01", 2), ("2025-01-02", 1), ("2025-01-03", 1)]
    assert rows(summaries.top_hosts(table, 1, 3)) == [("nor", 3)] and len(rows(summaries.top_hosts(table, None, None))) == 2
    assert len(rows(summaries.card_usage(decks.cards_of(deck_table), None))) == 6
    assert sorted(rows(summaries.deck_archetypes(decks.cards_of(deck_table), None))) == [("Fox", 2), ("Owl", 1)]


def test_empty_inputs(spark):
    reports = summary.summarize(spark.createDataFrame([], EVENT_DDL), spark.createDataFrame([], DECK_DDL))
    assert rows(reports["event_totals"]) == [(0, 0, None)]
    assert rows(reports["deck_size_stats"]) == [(0, 0.0, 0, 0, 0.0)]
    assert all(reports[name].count() == 0 for name in ("events_by_date", "top_players", "card_usage", "deck_archetypes"))


def test_missing_event_fields(spark):
    table = spark.createDataFrame([(None, None, None), ("", "", []), ("x" * 60, "2025-01-01", [])],
                                  "event_host string, event_date string, results array<struct<rank string>>")
    assert rows(summaries.events_by_date(table)) == [("Unknown", 1), ("2025-01-01", 1), ("", 1)]
    assert ("x" * 50, 1) in rows(summaries.top_hosts(table)) and ("Unknown", 1) in rows(summaries.top_hosts(table))
    assert rows(summaries.event_totals(table)) == [(3, 0, 0.0)]


# ---- back-fill -------------------------------------------------------------------------------------------------------

PAGE = '<img class="img-regulation" alt="{}"><p>{}</p>'


def deck_documents(spark):
    data = [
        ("u", "A", "", [("1", "a", "", 1, ""), ("2", "b", "OLD 001/002", 2, ""), ("3", "c", "　", 1, ""), ("1", "a2", None, 1, "")], "fa"),
        ("u", "B", "", [("2", "b", "OLD 001/002", 2, "")], "fb"),
        ("u", "C", "", [("4", "d", "", 1, ""), ("9", "z", "", 1, "")], "fc"),
        ("u", "D", "", [("9", "z", "", 1, "")], "fd"),
    ]
    return spark.createDataFrame(data, f"{DECK_DDL}, deck_file string").repartition(2)


def backfill_inputs(spark):
    cache = spark.createDataFrame([("1", "ONE 001/001"), ("7", "SEVEN 007/007")], "card_id string, card_code string")
    pages = spark.createDataFrame(
        [("3", PAGE.format("THREE", "003 / 003")), ("3", PAGE.format("THREE", "003 / 003")), ("4", PAGE.format("FOUR", "004/004")),
         ("1", PAGE.format("NEW", "111/111")), ("9", PAGE.format("", "009/009")), ("8", PAGE.format("EIGHT", "008/008"))],
        "card_id string, html string",
    )
    return cache, pages


def test_backfill_plan(spark):
    cache, pages = backfill_inputs(spark)
    plan = backfill.plan_backfill(deck_documents(spark), cache, pages)
    assert sorted(rows(plan.missing)) == [("1", "a", 2), ("3", "c", 1), ("4", "d", 1), ("9", "z", 2)]
    assert rows(plan.status) == [(4, 1, 3)]
    assert sorted(rows(plan.to_fetch)) == [("3",), ("4",), ("9",)]
    assert sorted(rows(plan.cache)) == [("1", "ONE 001/001"), ("3", "THREE 003/003"), ("4", "FOUR 004/004"), ("7", "SEVEN 007/007")]
    assert rows(plan.report) == [(3, 2)]
    changed = {r["deck_file"]: [c["card_code"] for c in r["cards"]] for r in plan.changed.collect()}
    assert changed == {"fa": ["ONE 001/001", "OLD 001/002", "THREE 003/003", "ONE 001/001"], "fc": ["FOUR 004/004", ""]}
    cards = decks.cards_of(deck_documents(spark), "deck_id", "deck_file")
    files = codes.missing_code_files(cards)
    assert sorted(rows(files)) == [("1", "fa"), ("1", "fa"), ("3", "fa"), ("4", "fc"), ("9", "fc"), ("9", "fd")]
    preview = rows(codes.missing_codes_preview(plan.missing, 3))
    assert [p[:2] for p in preview] == [(1, "1"), (2, "3"), (3, "4")] and {p[-1] for p in preview} == {1}
    filled = codes.backfill_codes(cards, plan.cache)
    assert filled.count() == cards.count() and filled.where("filled").count() == 4


def test_backfill_run_fills_the_store_and_again_nothing(spark, tmp_path):
    cache, pages = backfill_inputs(spark)
    store = f"{tmp_path}/decks"
    day = F.when(F.col("deck_id").isin("A", "B"), "").otherwise("2025-01-02")
    write_documents(deck_documents(spark).withColumn("event_date", day), store)
    untouched = {p: os.stat(p).st_mtime_ns for p in glob.glob(f"{store}/*/part-*")}
    report = backfill.run_backfill(spark, store, cache, pages, f"{tmp_path}/cache", "event_date")
    assert rows(report) == [(3, 2)]
    schema = f"{DECK_DDL}, deck_file string, event_date string"
    read = lambda: read_document_lines(spark, store, schema)[0]
    found = {r["deck_file"]: ([c["card_code"] for c in r["cards"]], r["event_date"]) for r in read().collect()}
    assert found == {
        "fa": (["ONE 001/001", "OLD 001/002", "THREE 003/003", "ONE 001/001"], ""), "fb": (["OLD 001/002"], ""),
        "fc": (["FOUR 004/004", ""], "2025-01-02"), "fd": ([""], "2025-01-02"),
    }
    assert not set(untouched) & set(glob.glob(f"{store}/*/part-*"))
    before = {p: os.stat(p).st_mtime_ns for p in glob.glob(f"{store}/*/part-*")}
    saved = read_code_cache(spark, f"{tmp_path}/cache", "lines")
    assert rows(backfill.run_backfill(spark, store, saved, pages, f"{tmp_path}/cache2", "event_date")) == [(0, 0)]
    assert {p: os.stat(p).st_mtime_ns for p in glob.glob(f"{store}/*/part-*")} == before


def test_backfill_reads_only_partitions_that_it_will_change(spark, tmp_path):
    cache, pages = backfill_inputs(spark)
    store, schema = f"{tmp_path}/decks", f"{DECK_DDL}, deck_file string, event_date string"
    table = deck_documents(spark)
    backfill.write_decks(table.withColumn("event_date", F.col("deck_id")), store)
    index = lambda: sorted(
        (r["event_date_folder"], r["deck_file"], r["card_id"]) for r in spark.read.parquet(f"{store}-blanks").collect() if r["card_id"]
    )
    assert index() == [("A", "fa", "1"), ("A", "fa", "3"), ("C", "fc", "4"), ("C", "fc", "9"), ("D", "fd", "9")]
    # A document that the index does not know: it stays blank and uncounted, as its partition is not read.
    unknown = table.where("deck_id = 'C'").withColumn("deck_file", F.lit("fx")).withColumn("event_date", F.lit("B"))
    write_documents(unknown, store, mode="append")
    assert rows(backfill.run_backfill(spark, store, cache, pages, f"{tmp_path}/cache", "event_date")) == [(3, 2)]
    read = {r["deck_file"]: [c["card_code"] for c in r["cards"]] for r in read_document_lines(spark, store, schema)[0].collect()}
    assert read["fx"] == ["", ""] and read["fc"] == ["FOUR 004/004", ""] and read["fa"][0] == "ONE 001/001"
    assert index() == [("C", "fc", "9"), ("D", "fd", "9")]

    # A run that was lost before the index: it names blanks that are filled, which costs a reading and changes nothing.
    saved = read_code_cache(spark, f"{tmp_path}/cache", "lines")
    backfill.write_blanks(table.withColumn("event_date", F.col("deck_id")), store, "event_date")
    assert rows(backfill.run_backfill(spark, store, saved, pages, f"{tmp_path}/cache2", "event_date")) == [(0, 0)]
    assert index() == [("C", "fc", "9"), ("D", "fd", "9")]
    # Replaced documents replace their index, also by nothing.
    whole = table.where("deck_id = 'B'").withColumn("event_date", F.lit("C"))
    backfill.write_decks(whole, store)
    assert index() == [("D", "fd", "9")]
    # A store without documents without a code.
    backfill.write_decks(whole, f"{tmp_path}/full")
    assert rows(backfill.run_backfill(spark, f"{tmp_path}/full", saved, pages, f"{tmp_path}/cache3", "event_date")) == [(0, 0)]


def test_backfill_works_out_a_bounded_part_of_the_store_at_a_time(spark, tmp_path, monkeypatch):
    cache, pages = backfill_inputs(spark)
    store, schema = f"{tmp_path}/decks", f"{DECK_DDL}, deck_file string, event_date string"
    place = F.when(F.col("deck_id") == "A", "").otherwise(F.concat("deck_id", F.lit("/=%")))
    backfill.write_decks(deck_documents(spark).withColumn("event_date", place), store)
    sizes = folder_sizes(spark, store)
    assert set(sizes) == {"", "B/=%", "C/=%", "D/=%"} and min(sizes.values()) > 50
    assert backfill.folders_at_once(["", "C/=%"], sizes) == [["", "C/=%"]]
    monkeypatch.setattr(backfill, "BYTES_AT_ONCE", 1)
    monkeypatch.setattr(backfill, "PART_AT_ONCE", 0)
    assert backfill.folders_at_once(["", "C/=%"], sizes) == [[""], ["C/=%"]]
    write, kept, before = backfill.write_documents, [], set(os.listdir(shared_folder(spark)))

    def counted(documents, path, partition):
        new = set(os.listdir(shared_folder(spark))) - before
        kept.append({name.rsplit("-", 1)[0] for name in new} & {"decks-of-folders", "decks-to-fill"})
        write(documents, path, partition)

    monkeypatch.setattr(backfill, "write_documents", counted)
    assert rows(backfill.run_backfill(spark, store, cache, pages, f"{tmp_path}/cache", "event_date")) == [(3, 2)]
    assert kept == [set(), set()]  # one folder after the other, and what it was made from is gone
    read = {r["deck_file"]: [c["card_code"] for c in r["cards"]] for r in read_document_lines(spark, store, schema)[0].collect()}
    assert read["fa"] == ["ONE 001/001", "OLD 001/002", "THREE 003/003", "ONE 001/001"] and read["fc"] == ["FOUR 004/004", ""]


def test_backfill_with_copies_of_a_document(spark):
    cache, pages = backfill_inputs(spark)
    documents = deck_documents(spark)
    changed = backfill.plan_backfill(documents.unionAll(documents), cache, pages).changed
    assert sorted(r["deck_file"] for r in changed.collect()) == ["fa", "fa", "fc", "fc"]


# ---- ingest ----------------------------------------------------------------------------------------------------------


def landed(spark, events=8):
    link = '<a href="/event/detail/{}/result">r</a>'
    listing = [(n, "".join(link.format(100 + 3 * n + k) for k in range(4))) for n in range(1, 4)]
    listing.append((4, link.format(103)))
    row = ('<tr><td>{r}位</td><td>1pt</td><td>pプレイヤーID：{r}エリア：a</td><td></td>'
           '<td><a href="/deck/confirm.html/deckID/D{e}-{r}">d</a></td></tr>')
    pages, deck_pages = [], []
    for e in range(103, 103 + events):
        body = "" if e == 104 else "".join(row.format(e=e, r=r) for r in (1, 2))
        pages.append((f"https://p/event/detail/{e}/result", 1,
                      f'<h1>E{e}</h1><div class="date-day">2025年1月{e - 100}日</div><table><tr></tr>{body}</table>'))
        for r in (1, 2):
            if (e, r) != (105, 2):
                deck_pages.append((f"D{e}-{r}", '<input id="deck_x" value="1_2_1">' "<script>PCGDECK.searchItemName[1]='n(C 001/002)';</script>"))
    return (
        spark.createDataFrame(listing, "page_no int, html string"),
        spark.createDataFrame(pages, "event_url string, page_no int, html string"),
        spark.createDataFrame(deck_pages, "deck_id string, html string"),
    )


def test_ingest_is_incremental(spark, tmp_path):
    listing, pages, deck_pages = landed(spark)
    store = f"{tmp_path}/store"
    first = ingest.run_ingest(spark, listing, pages, deck_pages, store, max_new=3)
    assert rows(first.orderBy("position").select("event_id", "status")) == [("103", "absent"), ("105", "absent"), ("106", "absent")]
    events, results, deck_table = ingest.stored(spark, store)
    assert sorted(rows(events.select("event_id", "event_title", "event_date", "expected"))) == [
        ("103", "E103", "2025-01-03", 2), ("105", "E105", "2025-01-05", 2), ("106", "E106", "2025-01-06", 2),
    ]
    assert results.count() == 6 and deck_table.count() == 5
    assert sorted(r["deck_file"] for r in deck_table.where("event_id = '103'").collect()) == ["deck_1st_D103-1.json", "deck_2nd_D103-2.json"]
    # the incomplete event is taken up again, complete ones do not count
    second = ingest.run_ingest(spark, listing, pages, deck_pages, store, max_new=3)
    assert rows(second.orderBy("position").select("event_id", "status")) == [("105", "partial"), ("107", "absent"), ("108", "absent")]
    ingest.run_ingest(spark, listing, pages, deck_pages, store, max_new=50)
    before = [sorted(rows(t)) for t in ingest.stored(spark, store)]
    last = ingest.run_ingest(spark, listing, pages, deck_pages, store, max_new=50)
    assert rows(last.select("event_id", "status")) == [("105", "partial")]
    assert [sorted(rows(t)) for t in ingest.stored(spark, store)] == before


def test_pages_are_neither_shuffled_nor_staged(spark):
    _, pages, deck_pages = landed(spark)
    ids = spark.createDataFrame([("103",)], "event_id string")
    rows_plan = plan_text(ingest.pages_to_rows(pages, ids))
    decks_plan = plan_text(merge_deck_copies(parse_deck_pages(likely_rows(deck_pages, "deck_id", ids.select(F.col("event_id").alias("deck_id"))))))
    for plan in (rows_plan, decks_plan):
        moved = re.findall(r"^\(\d+\) Exchange\nInput \[\d+\]: \[(.*)\]", plan, re.M)
        assert moved and not [columns for columns in moved if "html" in columns]
    assert ingest.page_rows(pages, headers=True).columns == [
        "event_url", "event_id", "page_no", "is_empty", "is_last", "results", "header",
    ]


def test_likely_rows_lose_none(spark):
    table = spark.range(5000).select(F.col("id").cast("string").alias("k"), F.lit("x").alias("html"))
    keys = spark.range(0, 5000, 7).select(F.col("id").cast("string").alias("k"))
    found = {r["k"] for r in likely_rows(table, "k", keys).collect()}
    assert {str(n) for n in range(0, 5000, 7)} <= found and len(found) < 730
    assert likely_rows(table, "k", keys.where("false")).count() == 0


def test_events_lie_in_few_files(spark, tmp_path):
    rows_ = [(f"u{n}", str(n), "t", "h", "a", "l", 1, 1, f"2024-{n % 3 + 1:02d}-{n % 28 + 1:02d}" if n % 10 else None) for n in range(600)]
    table = spark.createDataFrame(rows_, ", ".join(f"{k} {v}" for k, v in STORED_EVENT_FIELDS.items())).repartition(16)
    for _ in range(2):
        ingest.append_events(table, str(tmp_path))
    files = [f for f in glob.glob(f"{tmp_path}/events/*/*.parquet")]
    assert len(os.listdir(f"{tmp_path}/events")) >= 4 and len(files) == 2 * 4
    assert ingest.stored(spark, str(tmp_path))[0].count() == 1200


def stored_events(spark, store, dates):
    for run, date in enumerate(dates):
        fields = {"event_id": str(run), "event_date": date}
        columns = [F.lit(fields.get(name)).cast(kind).alias(name) for name, kind in STORED_EVENT_FIELDS.items()]
        ingest.append_events(spark.range(3).select(*columns), store)


def test_a_date_range_reads_only_its_months(spark, tmp_path):
    dates = ["2025-01-05", "2025-01-31", "2025-02-01", "2025-03-09", None, "", "odd date"]
    stored_events(spark, str(tmp_path), dates)
    everything = ingest.stored_events_between(spark, str(tmp_path), None, None)
    assert everything.count() == 3 * len(dates)
    for first in (None, "", "2025-01-06", "2025-01-31", "2025-04-01"):
        for last in (None, "2025-01-31", "2025-02-01", "zzz"):
            found = ingest.stored_events_between(spark, str(tmp_path), first, last)
            by_date = sorted(rows(summaries.events_by_date(found, None, first, last)))
            assert by_date == sorted(rows(summaries.events_by_date(everything, None, first, last)))
            assert found.count() == sum(n for _, n in by_date)
    few = ingest.stored_events_between(spark, str(tmp_path), "2025-01-06", "2025-02-28")
    assert re.search(r"PartitionFilters: \[.*event_month", plan_text(few))
    read = {r.path.split("event_month=")[1].split("/")[0] for r in few.select(F.col("_metadata.file_path").alias("path")).collect()}
    assert read == {"2025-01", "2025-02"}
    scanned = re.search(r"number of files read: (\d+)", few._jdf.queryExecution().toString())
    assert scanned is None or int(scanned[1]) == 3


def test_files_of_a_month_are_merged(spark, tmp_path):
    store = str(tmp_path)
    stored_events(spark, store, ["2025-01-05", "2025-01-31", "2025-01-07", "2025-02-01", None, "", None])
    count = lambda month: len(glob.glob(f"{store}/events/event_month={month}/*.parquet"))
    untouched = glob.glob(f"{store}/events/event_month=2025-02/*.parquet")
    before = sorted(rows(ingest.stored(spark, store)[0].fillna("none")))
    assert (count("2025-01"), count("__HIVE*")) == (3, 3)
    assert ingest.merge_event_files(spark, store) == ["", "2025-01"]
    assert (count("2025-01"), count("__HIVE*")) == (1, 1)
    assert glob.glob(f"{store}/events/event_month=2025-02/*.parquet") == untouched
    assert sorted(rows(ingest.stored(spark, store)[0].fillna("none"))) == before
    assert ingest.merge_event_files(spark, store) == []
    assert ingest.merge_event_files(spark, f"{store}/none") == []


def test_ingest_after_a_lost_run(spark, tmp_path):
    """Results are there, headers are not: the run ended in between. The event is taken up again, without copies."""
    listing, pages, deck_pages = landed(spark)
    whole, broken = f"{tmp_path}/whole", f"{tmp_path}/broken"
    ingest.run_ingest(spark, listing, pages, deck_pages, whole)
    spark.read.schema(STORED_RESULTS_DDL).parquet(f"{whole}/results").write.parquet(f"{broken}/results")
    ingest.run_ingest(spark, listing, pages, deck_pages, broken)
    assert [sorted(rows(t)) for t in ingest.stored(spark, broken)] == [sorted(rows(t)) for t in ingest.stored(spark, whole)]


def test_ingest_with_copies_and_blank_dates(spark, tmp_path):
    listing, pages, deck_pages = landed(spark)
    blank = pages.withColumn("html", F.regexp_replace("html", "2025年1月5日", ""))
    ingest.run_ingest(spark, listing.unionAll(listing), blank.unionAll(blank), deck_pages.unionAll(deck_pages), str(tmp_path))
    events, results, deck_table = ingest.stored(spark, str(tmp_path))
    assert dict(rows(events.where("event_id < '107'").select("event_id", "event_date"))) == {
        "103": "2025-01-03", "105": "", "106": "2025-01-06",
    }
    assert events.count() == 7 and results.count() == 14 and deck_table.count() == 13
    assert set(rows(events.select("expected", "expected_named"))) == {(2, 2)}


def test_blank_ids_need_not_count(spark, tmp_path):
    listing, pages, deck_pages = landed(spark)
    nameless = pages.withColumn("html", F.regexp_replace("html", "D103-2", ""))
    nameless = nameless.withColumn("html", F.regexp_replace("html", '<a href="/deck/confirm.html/deckID/">d</a>', ""))
    ingest.run_ingest(spark, listing, nameless, deck_pages, str(tmp_path))
    counted = ingest.run_ingest(spark, listing, nameless, deck_pages, str(tmp_path))
    assert sorted(r["event_id"] for r in counted.collect()) == ["103", "105"]
    named = ingest.run_ingest(spark, listing, nameless, deck_pages, str(tmp_path), count_blank_ids=False)
    assert [r["event_id"] for r in named.collect()] == ["105"]


def test_audit_statuses(spark):
    listed = spark.createDataFrame([(str(n),) for n in range(6)], "event_id string")
    stored = spark.createDataFrame([("0", 2), ("1", 2), ("2", 0), ("3", 0)], "event_id string, expected bigint")
    files = spark.createDataFrame([("0", "a"), ("0", "b"), ("1", "a"), ("3", "x"), ("4", "y")], "event_id string, deck_file string")
    found = {r["event_id"]: (r["expected"], r["actual"], r["status"]) for r in audit.ingest_audit(listed, stored, files).collect()}
    assert found == {
        "0": (2, 2, "complete"), "1": (2, 1, "partial"), "2": (0, 0, "partial"), "3": (0, 1, "complete"),
        "4": (0, 1, "no_info"), "5": (0, 0, "absent"),
    }
    results = spark.createDataFrame([("1", "a"), ("1", ""), ("2", "b")], "event_id string, deck_id string")
    assert sorted(rows(audit.expected_decks(results))) == [("1", 2), ("2", 1)]
    assert sorted(rows(audit.expected_decks(results, count_blank_ids=False))) == [("1", 1), ("2", 1)]


# ---- catalogue -------------------------------------------------------------------------------------------------------


def test_catalog_switches(spark):
    api = spark.createDataFrame([(1, '{"result":1,"products":[{"productTitle":"j"}]}')], "page_no int, body string")
    item = '<ul class="expansionList"><li class="expansion"><a class="expansionLink" href="/x?expansionCodes=M1">{}</a><h3 class="expansionTitle">{}</h3></li></ul>'
    pages = spark.createDataFrame([("zh", 1, item.format("", "z")), ("en", 1, item.format("", "e"))], "site string, page_no int, html string")
    price = '<section class="section-product"><div class="data-product">建議零售價：12元</div></section>'
    detail = spark.createDataFrame([("hk", "m1", price)], "lang string, code string, html string")
    names = lambda *a, **k: [(r["source_no"], r["site_no"], r["product_name"], r["price"]) for r in
                             catalog.product_catalog(*a, **k).orderBy("source_no", "site_no").collect()]
    assert names(api, pages, detail) == [(0, 0, "j", ""), (1, 0, "e", ""), (1, 1, "z", "12元")]
    assert names(api) == [(0, 0, "j", "")]
    assert names(None, pages, None) == [(0, 0, "e", ""), (0, 1, "z", "")]
    assert names(None, pages, detail, sites=catalog.HONG_KONG_SITES[1:]) == [(0, 0, "z", "12元")]
    with pytest.raises(ValueError):
        catalog.product_catalog()


def test_backfill_parses_a_page_once(spark):
    pages = spark.createDataFrame([("A", "<p>x</p>")], "deck_id string, html string")
    documents = decks.parse_deck_pages(pages).withColumn("deck_file", F.col("deck_id"))
    plans = []

    class Stages:
        def write(self, table, name):
            plans.append(table._jdf.queryExecution().optimizedPlan().toString())
            return table

    codes.backfill_documents(documents, spark.createDataFrame([("1", "c")], "card_id string, card_code string"), stages=Stages())
    assert plans[0].count("searchItemCardPict") == 1
