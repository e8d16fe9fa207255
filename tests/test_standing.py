"""Standing reports: state and new days give what a run over all documents gives."""

import glob

import pytest
from pyspark.sql import functions as F

from cardloom.operators import summaries
from cardloom.operators.events import results_of
from cardloom.plans import ingest, standing, summary
from cardloom.schemas import DECK_DDL, EVENT_DDL
from cardloom.testbed import queries
from tests.test_jobs import DECKS, EVENTS, landed, rows

DATES = {"d1": "2025-01-01", "d2": "2025-01-02", "d3": "2025-01-03", "d4": None}
ODD = [
    ("u", "05", "t", None, None, "", "", [("1位", "", "Cy", "3", "", "", "")]),
    ("u", "06", "t", "", "south", "", "", None),
    ("u", "06", "t", "", "south", "", "", None),
]


def tables(spark, events, decks):
    nested = spark.createDataFrame(events, EVENT_DDL)
    dated = spark.createDataFrame([(*deck, DATES[deck[1]]) for deck in decks], f"{DECK_DDL}, event_date string")
    return nested, dated


def refresh_all(nested, dated, state, whole=True):
    people = nested.withColumn("participants", F.expr(summaries.NESTED_RESULTS))
    sources = {"events": people, "results": results_of(nested), "decks": dated}
    return {
        name: {row["day"]: row["rows"] for row in standing.refresh(table, state, name, whole=whole).collect()}
        for name, table in sources.items()
    }


def assert_as_whole_run(spark, state, nested, dated):
    expected = summary.summarize(nested, dated)
    found = standing.reports(spark, state)
    assert set(found) == set(expected)
    for name, table in expected.items():
        kinds = [(f.name, f.dataType) for f in table.schema]
        assert [(f.name, f.dataType) for f in found[name].schema] == kinds, name
        ordered = lambda t: sorted(map(tuple, t.collect()), key=str)
        assert ordered(found[name]) == ordered(table), name


@pytest.fixture()
def state(tmp_path):
    return str(tmp_path / "state")


def test_new_late_changed_and_removed_days(spark, state):
    first = tables(spark, EVENTS[:2], DECKS[:1])
    assert refresh_all(*first, state)["events"] == {"2025-01-01": 2}
    assert_as_whole_run(spark, state, *first)

    everything = tables(spark, EVENTS + ODD, DECKS)
    done = refresh_all(*everything, state)
    assert done["events"] == {"2025-01-02": 1, "2025-01-03": 1, "": 3}
    assert done["decks"] == {"2025-01-02": 1, "2025-01-03": 1, "": 1}
    assert_as_whole_run(spark, state, *everything)

    assert refresh_all(*everything, state) == {"events": {}, "results": {}, "decks": {}}

    late = ("u", "07", "t", "2025-01-02", "east", "", "", [("1位", "", "Ann", "1", "west", "", "d9")])
    coded = ("u", "d2", "", [("4", "Owl", "Z 001/002", 9, "")])  # as after a back-fill: as many rows, other content
    changed = tables(spark, [*EVENTS[:2], EVENTS[3], late, *ODD[:1]], [DECKS[0], coded])
    done = refresh_all(*changed, state)
    assert done["events"] == {"2025-01-02": 2, "2025-01-03": 0, "": 1}
    assert done["decks"] == {"2025-01-02": 1, "2025-01-03": 0, "": 0}
    assert_as_whole_run(spark, state, *changed)


def test_only_the_new_days_are_given(spark, state):
    refresh_all(*tables(spark, EVENTS[:2], DECKS[:1]), state)
    done = refresh_all(*tables(spark, EVENTS[2:], DECKS[1:]), state, whole=False)
    assert set(done["events"]) == {"2025-01-02", "2025-01-03"}
    assert_as_whole_run(spark, state, *tables(spark, EVENTS, DECKS))


def test_rows_of_a_lost_refresh_do_not_count(spark, state):
    whole = tables(spark, EVENTS, DECKS)
    refresh_all(*whole, state)
    for name in ("hosts", "players", "cards", "sizes", "archetypes"):
        spark.read.parquet(f"{state}/{name}").drop("token").write.parquet(f"{state}/{name}/token=lost")
    assert_as_whole_run(spark, state, *whole)


def test_a_refresh_writes_only_rows_of_due_days(spark, state):
    refresh_all(*tables(spark, EVENTS[:2], DECKS[:1]), state)
    before = set(glob.glob(f"{state}/hosts/token=*"))
    refresh_all(*tables(spark, EVENTS, DECKS), state)
    (new,) = set(glob.glob(f"{state}/hosts/token=*")) - before
    assert {row["day"] for row in spark.read.parquet(new).collect()} == {"2025-01-02", "2025-01-03"}


def test_an_empty_state_and_empty_tables(spark, state):
    nothing = tables(spark, [], [])
    assert_as_whole_run(spark, state, *nothing)
    assert refresh_all(*nothing, state) == {"events": {}, "results": {}, "decks": {}}
    assert_as_whole_run(spark, state, *nothing)


def test_a_store_that_grows(spark, tmp_path, state):
    store = str(tmp_path / "store")
    listing, event_pages, deck_pages = landed(spark)
    for most in (3, None):
        ingest.run_ingest(spark, listing, event_pages, deck_pages, store, max_new=most)
        done = standing.refresh_from_store(spark, store, state)
        events, results, decks = ingest.stored(spark, store)
        found = standing.reports(spark, state)
        assert rows(found["event_totals"]) == rows(summaries.event_totals(events, "expected"))
        dated = results.join(events.select("event_id", "event_date"), "event_id")
        assert sorted(rows(found["player_stats"])) == sorted(rows(summaries.player_stats(dated)))
        assert sorted(rows(found["deck_card_totals"])) == sorted(rows(summary.document_totals(decks)))
        assert rows(found["deck_size_stats"]) == rows(summaries.deck_size_stats(decks))
    assert events.count() > 3 and 0 < done["events"].count() < events.select("event_date").distinct().count()
    assert all(table.count() == 0 for table in standing.refresh_from_store(spark, store, state).values())


def test_input_of_the_query_is_worked_out_before_the_refreshes(spark, monkeypatch):
    plans = []
    monkeypatch.setattr(
        queries.standing, "refresh", lambda table, *_: plans.append(table._jdf.queryExecution().optimizedPlan().toString())
    )
    days = spark.sql("select * from values ('1997-06-01', 'a'), ('1997-07-01', 'b') as t(event_date, event_id)")
    queries._standing(spark, days.join(days.withColumnRenamed("event_date", "other"), "event_id"), "results")
    assert len(plans) == 2 and not any("Join" in plan for plan in plans)
