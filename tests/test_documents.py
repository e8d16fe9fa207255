"""Readers and writers in a temporary folder."""

import csv
import glob
import io
import json
import os

import pytest
from pyspark.sql import functions as F

from cardloom import session
from cardloom.constants import PRODUCT_COLUMNS
from cardloom.schemas import DECK_DDL
from cardloom.session import warehouse_is_shared
from cardloom.sinks import documents as sinks
from cardloom.sources import documents as sources
from cardloom.sources import landed
from cardloom.testbed import queries

CARD = {"card_id": "1", "card_name": "n", "card_code": "", "quantity": 2, "image_url": ""}


def deck(deck_id, *cards):
    return {"deck_url": "u", "deck_id": deck_id, "deck_code": deck_id, "cards": list(cards)}


def write(path, content):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(content if isinstance(content, str) else json.dumps(content, ensure_ascii=False, indent=2), "utf-8")


@pytest.fixture()
def folder(tmp_path):
    root = tmp_path / "event_data"
    event = {"event_url": "u", "event_id": "848638", "event_title": "シティ", "event_date": "2025-11-11", "event_host": "h",
             "event_address": "", "event_location": "", "results": [{"rank": "1位", "player_id": "7", "deck_id": "A"}]}
    write(root / "event_848638_2025-11-11" / "event_info.json", event)
    write(root / "event_848638_2025-11-11" / "deck_1st_A.json", deck("A", CARD, CARD))
    write(root / "event_848639_2025-11-12" / "deck_B.json", deck("B"))
    return root


def test_event_documents(spark, folder):
    (row,) = sources.read_event_documents(spark, str(folder)).collect()
    assert row["event_title"] == "シティ" and row["results"][0]["rank"] == "1位" and row["results"][0]["points"] is None
    assert row["folder"].endswith("/event_data/event_848638_2025-11-11")


def test_deck_documents(spark, folder):
    rows = sources.read_deck_documents(spark, str(folder)).orderBy("deck_id").collect()
    assert [(r["deck_id"], r["event_id"], len(r["cards"])) for r in rows] == [("A", "848638", 2), ("B", "848639", 0)]
    assert rows[0]["deck_file"].endswith("deck_1st_A.json")


def test_no_documents(spark, tmp_path):
    assert sources.read_event_documents(spark, str(tmp_path)).count() == 0
    assert sources.read_deck_documents(spark, str(tmp_path)).count() == 0
    good, bad = sources.read_deck_documents_tolerant(spark, str(tmp_path))
    assert (good.count(), bad.count()) == (0, 0)


def test_deeper_files_do_not_count(spark, folder):
    write(folder / "event_848638_2025-11-11" / "event_9_copy" / "deck_9th_Z.json", deck("Z"))
    write(folder / "event_848638_2025-11-11" / "event_9_copy" / "deck_9th_Y.json", "")
    assert sorted(r["deck_id"] for r in sources.read_deck_documents(spark, str(folder)).collect()) == ["A", "B"]
    good, bad = sources.read_deck_documents_tolerant(spark, str(folder))
    assert (good.count(), bad.count()) == (2, 0)


def test_folders_are_listed_by_tasks_of_the_session(spark, monkeypatch):
    seen = []

    class Reader:
        def option(self, name, value):
            seen.append((name, value))
            return self

        def load(self, pattern):
            seen.append((pattern, spark.conf.get(landed._LISTING_TASKS)))
            return spark.range(0).select(F.struct(F.lit("file:///x").alias("file_path")).alias("_metadata"))

    before = spark.conf.get(landed._LISTING_TASKS)
    landed.load_files(spark, Reader(), "/store/", "event_*/deck_*.json")
    assert seen[-1] == ("/store/event_*", "4") and ("pathGlobFilter", "deck_*.json") in seen
    assert spark.conf.get(landed._LISTING_TASKS) == before != "4"


def test_one_file_each_is_written_by_several_tasks(spark, tmp_path):
    table = spark.range(40).selectExpr("id as key", "'x' as value")
    path = queries._one_file_each(table, "key", str(tmp_path / "files"))
    files = glob.glob(f"{path}/key=*/*.txt")
    assert len(files) == 40 and len({os.path.basename(file)[:10] for file in files}) > 1


def test_broken_files(spark, folder):
    write(folder / "event_848638_2025-11-11" / "deck_2nd_C.json", '{"deck_id": "C", "cards": [')
    write(folder / "event_848639_2025-11-12" / "deck_D.json", "")
    with pytest.raises(Exception, match="MALFORMED|FAILFAST|FAILED_READ"):
        sources.read_deck_documents(spark, str(folder)).collect()
    good, bad = sources.read_deck_documents_tolerant(spark, str(folder))
    assert sorted((r["deck_id"], r["event_id"]) for r in good.collect()) == [("A", "848638"), ("B", "848639")]
    assert sorted(r["deck_file"].rsplit("/")[-1] for r in bad.collect()) == ["deck_2nd_C.json", "deck_D.json"]


def test_code_cache(spark, tmp_path):
    path = tmp_path / "cache.json"
    write(path, {"31": "ABC 001/050", "32": "XYZ 020/060"})
    cache = sources.read_code_cache(spark, str(path))
    assert dict(map(tuple, cache.collect())) == {"31": "ABC 001/050", "32": "XYZ 020/060"}
    sinks.write_code_cache(cache, str(tmp_path / "new"))
    again = sources.read_code_cache(spark, str(tmp_path / "new"), layout="lines")
    assert sorted(again.collect()) == sorted(cache.collect())
    write(tmp_path / "bad.json", "{broken")
    assert sources.read_code_cache(spark, str(tmp_path / "bad.json")).count() == 0
    assert sources.read_code_cache(spark, str(tmp_path / "none.json")).count() == 0


def product(**fields):
    return {name: fields.get(name, "") for name in PRODUCT_COLUMNS}


def test_product_file_has_the_csv_dialect(spark, tmp_path):
    rows = [
        product(country="Japan", product_name='a "b", c', release_date="2025-01-02", include="x  y"),
        product(country="Japan", product_name="日本\n語", release_date="2025-01-01", price=" 5 "),
    ]
    table = spark.createDataFrame([(0, 0, 1, n, *r.values()) for n, r in enumerate(rows)],
                                  ", ".join(["source_no int, site_no int, page_no int, pos int"] + [f"{n} string" for n in PRODUCT_COLUMNS]))
    path = str(tmp_path / "out")
    assert sinks.write_products(table.coalesce(1), path)
    expected = io.StringIO()
    writer = csv.DictWriter(expected, PRODUCT_COLUMNS, lineterminator="\n")
    writer.writeheader()
    writer.writerows(rows)
    parts = sorted(glob.glob(f"{path}/part-*.csv"))
    text = "".join(open(p, encoding="utf-8", newline="").read().removeprefix(",".join(PRODUCT_COLUMNS) + "\n") for p in parts)
    assert ",".join(PRODUCT_COLUMNS) + "\n" + text == expected.getvalue()
    back = sinks.read_product_csv(spark, path)
    assert sorted(tuple(r) for r in back.collect()) == sorted(tuple(r.values()) for r in rows)


def test_no_products_write_nothing(spark, tmp_path):
    table = spark.createDataFrame([], ", ".join(["source_no int, site_no int, page_no int, pos int"] + [f"{n} string" for n in PRODUCT_COLUMNS]))
    assert not sinks.write_products(table, str(tmp_path / "out"))
    assert not (tmp_path / "out").exists()


def test_documents_by_partition_replace_only_their_partitions(spark, tmp_path):
    path = str(tmp_path / "decks")
    rows = [("u", "A", "a", [tuple(CARD.values())], "e1", "2025-01-01"), ("u", "B", "b", [], "e2", "2025-01-02")]
    schema = f"{DECK_DDL}, event_id string, event_date string"
    sinks.write_documents(spark.createDataFrame(rows, schema), path)
    changed = spark.createDataFrame([("u", "C", "c", [], "e2", "2025-01-02")], schema)
    sinks.write_documents(changed, path)
    read, bad = sources.read_document_lines(spark, path, f"{DECK_DDL}, event_id string, event_date string")
    assert sorted((r["deck_id"], r["event_date"], len(r["cards"])) for r in read.collect()) == [
        ("A", "2025-01-01", 1), ("C", "2025-01-02", 0),
    ]
    assert bad.count() == 0


def test_landed_pages(spark, tmp_path):
    write(tmp_path / "site" / "en" / "2.html", "<p>2</p>\n")
    write(tmp_path / "api" / "page_3.json", '{"result":1}')
    write(tmp_path / "deck" / "AAA-B.html", "<p>d</p>")
    write(tmp_path / "price" / "hk-en" / "m1.html", "<p>p</p>")
    assert [tuple(r) for r in landed.read_catalog_pages(spark, f"{tmp_path}/site/*/*.html").collect()] == [("en", 2, "<p>2</p>\n")]
    assert [tuple(r) for r in landed.read_api_responses(spark, f"{tmp_path}/api/*.json").collect()] == [(3, '{"result":1}')]
    assert [tuple(r) for r in landed.read_keyed_pages(spark, f"{tmp_path}/deck/*.html", "deck_id").collect()] == [("AAA-B", "<p>d</p>")]
    assert [tuple(r) for r in landed.read_detail_pages(spark, f"{tmp_path}/price/*/*.html").collect()] == [("hk-en", "m1", "<p>p</p>")]
    assert [tuple(r) for r in landed.read_listing_pages(spark, f"{tmp_path}/site/en/*.html").collect()] == [(2, "<p>2</p>\n")]


def test_event_pages(spark, tmp_path):
    write(tmp_path / "events" / "77" / "2.html", "<p>e</p>")
    (row,) = landed.read_event_pages(spark, f"{tmp_path}/events/*/*.html").collect()
    assert (event_id(row["event_url"]), row["page_no"], row["html"]) == ("77", 2, "<p>e</p>")


def event_id(url):
    return url.split("/event/detail/")[1].split("/")[0]


def test_spread_has_one_plan_for_all_sizes(spark):
    for partitions in (1, 64):
        plan = landed.spread(spark.range(0, 100, 1, partitions))._jdf.queryExecution().toString()
        assert "RoundRobinPartitioning" in plan and "hashpartitioning" not in plan


def test_blank_and_missing_dates_survive_storage(spark, tmp_path):
    schema = f"{DECK_DDL}, event_date string"
    rows = [("u", name, "", [], date) for name, date in (("A", ""), ("B", None), ("C", "2025-01-01"))]
    sinks.write_documents(spark.createDataFrame(rows, schema), str(tmp_path / "d"))
    read, _ = sources.read_document_lines(spark, str(tmp_path / "d"), schema)
    assert sorted((r["deck_id"], r["event_date"]) for r in read.collect()) == [("A", ""), ("B", None), ("C", "2025-01-01")]


class FakeSession:
    """As much of a session as the shared folder needs."""

    def __init__(self, **conf):
        self.conf, self.sparkContext = conf, self

    def getCheckpointDir(self):
        return None


def test_shared_folder_comes_from_the_session(tmp_path):
    made = FakeSession(**{"spark.checkpoint.dir": str(tmp_path)})
    path = session.fresh_path(made, "x")
    assert path.startswith(str(tmp_path)) and path != session.fresh_path(made, "x")
    assert session.shared_folder(FakeSession(**{"spark.sql.warehouse.dir": "hdfs://w/"})) == "hdfs://w/cardloom-stages"


def test_stages_are_dropped(spark):
    with session.Stages() as stages:
        table = stages.write(spark.range(5), "five")
        path = table.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
        assert table.count() == 5 and os.path.exists(path)
    assert not os.path.exists(path)


def test_appended_codes_are_the_new_ones_only(spark, tmp_path):
    path, schema = str(tmp_path / "cache"), "card_id string, card_code string"
    lines = lambda: sorted(r["value"] for r in spark.read.text(path).collect())
    cached = lambda at: sorted(map(tuple, sources.read_code_cache(spark, at, layout="lines").collect()))
    first = spark.createDataFrame([("1", "A 001/002"), ("2", "B 001/002")], schema)
    assert sinks.append_code_cache(first, path) == 2
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "cache").glob("part-*")}
    more = spark.createDataFrame([("2", "NEW 001/002"), ("3", "C 001/002"), ("3", "C 001/002"), (None, "x")], schema)
    assert sinks.append_code_cache(more, path) == 1
    assert lines() == ['{"1":"A 001/002"}', '{"2":"B 001/002"}', '{"3":"C 001/002"}']
    assert all(p.stat().st_mtime_ns == at for p, at in before.items())
    files = set((tmp_path / "cache").glob("part-*"))
    assert sinks.append_code_cache(more, path) == 0 and set((tmp_path / "cache").glob("part-*")) == files
    assert cached(path) == [("1", "A 001/002"), ("2", "B 001/002"), ("3", "C 001/002")]
    sinks.merge_code_cache(spark, path, str(tmp_path / "merged"))
    assert cached(str(tmp_path / "merged")) == cached(path)


def test_a_local_warehouse_is_no_shared_folder_of_a_cluster():
    assert warehouse_is_shared("file:/x", "local[4]") and warehouse_is_shared("hdfs://n/x", "spark://h:1")
    assert not warehouse_is_shared("file:/x", "spark://h:1") and not warehouse_is_shared("/x", "local-cluster[2,1,1024]")
