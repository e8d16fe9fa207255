"""Registered queries: equal rows to their SQL, and plans that hold at scale."""

import contextlib
import glob
import io
import os
import re

import duckdb
import pytest

import __spark_entry__ as entry_points
from cardloom.testbed.oracles import ORACLES
from cardloom.testbed.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
# Windows without a partition number the rows of an already limited top list, never a whole table.
TOP_LISTS = {"top_players", "first_places", "discover_ids", "ingest_candidates", "missing_codes_preview"}
WRITERS = {name for name in QUERIES if re.search("roundtrip|scan|_run$|lines|appended|products_union", name)}


@pytest.fixture(scope="module")
def oracle():
    connection = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return connection


def ordered(rows):
    return sorted(rows, key=lambda row: tuple((value is None, str(value)) for value in row))


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, oracle, name):
    table = QUERIES[name](spark, FOLDER)
    columns = sorted(table.columns)
    names = ", ".join(f'"{column}"' for column in columns)
    found = ordered(tuple(row) for row in table.select(*columns).collect())
    expected = ordered(oracle.execute(f"SELECT {names} FROM ({ORACLES[name]})").fetchall())
    assert found == expected and found


def plan_of(table):
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        table.explain("formatted")
    return text.getvalue()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - WRITERS))
def test_plan_holds_at_scale(spark, name):
    plan = plan_of(QUERIES[name](spark, FOLDER))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "Python" not in plan and "Pandas" not in plan
    single = re.findall(r"Arguments: SinglePartition", plan)
    if "Window" in plan and single and name not in TOP_LISTS:
        raise AssertionError("a window over a whole table in one partition")


def test_flagship_plan(spark):
    plan = plan_of(QUERIES["deck_archetypes"](spark, FOLDER))
    assert "WindowGroupLimit" in plan and "TakeOrderedAndProject" in plan and "SortAggregate" not in plan
    assert "ReadSchema: struct<l_orderkey:bigint,l_partkey:bigint,l_linenumber:int,l_quantity:double>" in plan
    assert "PushedFilters: [IsNotNull(p_name)" in plan or "IsNotNull(p_name)" in plan


def test_pages_are_not_shuffled_for_known_sites(spark):
    plan = plan_of(QUERIES["catalog_items"](spark, FOLDER))
    joins = re.findall(r"^\W*\(\d+\) (\w+Join)", plan, re.M)
    assert set(re.findall(r"(\w+Join) \(", plan)) | set(joins) <= {"BroadcastHashJoin"}


def test_entry(spark):
    table = entry_points.entry(spark)
    assert table.columns == ["key_card", "deck_count"] and table.count() == 20
