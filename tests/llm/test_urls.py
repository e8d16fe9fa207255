import duckdb
import pytest

from cardloom.llm import urls
from tests.llm.helpers import empty, frame

COUNTS = ("strict_hits", "soft_hits", "soft_weight")
CASES = [
    ("http://a.org/x", "a.org", "/x", "org/", "allow"),
    ("http://ORG", "org", "", None, "allow"),
    ("https://www.Example.ORG/es/1?q#f", "www.example.org", "/es/1", "example.org/es/", "block"),
    ("https://example.org/en/12", "example.org", "/en/12", "example.org/en/1", "block"),
    ("https://example.org/en/2", "example.org", "/en/2", "org/", "allow"),
    ("https://notexample.org/es/", "notexample.org", "/es/", "org/", "allow"),
    ("http://x.com/fr/casino", "x.com", "/fr/casino", "com/fr/", "allow"),
    ("http://x.com/de/a", "x.com", "/de/a", "com/de/", "block"),
    ("http://x.com/en/casino", "x.com", "/en/casino", None, "block"),
    ("http://x.com/en/casinos", "x.com", "/en/casinos", None, "allow"),
    ("http://free.x.com/win", "free.x.com", "/win", None, "block"),
    ("http://free.free.com/free", "free.free.com", "/free", None, "allow"),
    ("http://free.x.com/hot", "free.x.com", "/hot", None, "allow"),
    ("http://free.x.com/hot/vip", "free.x.com", "/hot/vip", None, "block"),
    ("http://hot.x.com/vip/deal?hot", "hot.x.com", "/vip/deal", None, "allow"),
    ("http://hot.x.com/vip/deal?promo", "hot.x.com", "/vip/deal", None, "block"),
    ("http://x.net?a=POKER", "x.net", "", None, "block"),
    ("x.org/a", "", "", None, "allow"),
    ("", "", "", None, "allow"),
    (None, "", "", None, "allow"),
    ("a://b://c/d", "b:", "//c/d", None, "allow"),
    ("http://évil.com/xxxé", "évil.com", "/xxxé", None, "block"),
]


def test_cases_and_sql(spark):
    rows = [(i, case[0]) for i, case in enumerate(CASES)] + [(None, "http://a.org/x"), (0, "http://a.org/x")]
    found = urls.judge_urls(frame(spark, rows, "page_id long, url string")).drop(*COUNTS).collect()
    by_id = {r.page_id: tuple(r)[1:] for r in found}
    assert len(found) == len(rows)
    for i, case in enumerate(CASES):
        assert by_id[i] == case[1:], case
    oracle = duckdb.connect()
    oracle.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR)")
    oracle.executemany("INSERT INTO pages VALUES (?, ?)", rows)
    wanted = oracle.execute(urls.judge_sql()).fetchall()
    assert sorted(map(str, map(tuple, found))) == sorted(map(str, wanted))


def test_empty(spark):
    assert urls.judge_urls(empty(spark, "page_id long, url string")).count() == 0


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.01"])
def test_table_equals_sql(spark, folder):
    path = f"/root/testdata/{folder}/pages.parquet"
    found = urls.judge_urls(spark.read.parquet(path)).drop(*COUNTS).collect()
    oracle = duckdb.connect()
    oracle.execute(f"CREATE VIEW pages AS SELECT * FROM '{path}'")
    assert sorted(map(str, map(tuple, found))) == sorted(map(str, oracle.execute(urls.judge_sql()).fetchall()))


def test_a_vocabulary_from_a_table(spark, monkeypatch):
    rows = [("Bad", 9), ("bad", 1), ("some", 2), ("more", 3), ("more", 3), ("", 5), (None, 5), ("none", 0), ("naught", None)]
    terms = frame(spark, rows, "term string, weight int")
    found = urls.vocabulary_of(terms, 5)
    assert found == urls.Vocabulary(("bad",), (("more", 3), ("some", 2)), 5)
    pages = frame(spark, [(1, "a://some/some"), (2, "a://some/more"), (3, "a://bad"), (4, "a://none")], "page_id long, url string")
    judged = {r.page_id: tuple(r)[4:] for r in urls.judge_urls(pages, (), found).collect()}
    assert judged == {1: ("allow", 0, 1, 2), 2: ("block", 0, 2, 5), 3: ("block", 1, 0, 0), 4: ("allow", 0, 0, 0)}
    monkeypatch.setattr(urls, "MOST_TERMS", 2)
    with pytest.raises(ValueError):
        urls.vocabulary_of(terms, 5)
    assert urls.vocabulary_of(empty(spark, "term string, weight int")) == urls.Vocabulary((), ())
    with pytest.raises(ValueError):
        urls.Vocabulary((), (("alone", 4),))
