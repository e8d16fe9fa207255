"""Golden rows of the scalar rules. Expected values are worked out by hand."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cardloom.functions import cards, dates, markup, text, urls

WIDE_SPACE = "　"
NO_BREAK = " "


def test_japanese_dates(apply):
    raw = ["2025年11月28日（金）", "2025年 9月26日（金）", f"2025年{WIDE_SPACE}9月26日（金）", "発売 2025年1月2日 予定", "未定", "", None]
    assert apply(dates.japanese_date, raw) == [
        "2025-11-28", "2025-09-26", "2025-09-26", "2025-01-02", "未定", "", None,
    ]


def test_event_dates_take_no_spaces(apply):
    assert apply(dates.event_date, ["2025年11月11日(火)", "2025年 9月26日", "x"]) == ["2025-11-11", "", ""]


def test_month_first_dates(apply):
    raw = ["11-14-2025", "1-4-2025 x", "2025-11-14", "on 1-4-2025", "99-99-2025"]
    assert apply(dates.month_first_date, raw) == ["2025-11-14", "2025-01-04", "2025-11-14", "on 1-4-2025", "2025-99-99"]


def test_release_sort_key(apply):
    raw = ["", None, "2025-11-28", "2025-11-28T00", "1-4-2025", "a-b", "未定", "123-1-2025x"]
    assert apply(dates.release_sort_key, raw) == [
        "9999-12-31", "9999-12-31", "2025-11-28", "2025-11-28", "2025-01-04", "a-b", "未定", "123-1-2025",
    ]


def test_absolute_url(apply):
    complete = lambda c: urls.absolute_url(c, "https://base.example")
    assert apply(complete, ["", None, "http://a/b", "/c"]) == ["", "", "http://a/b", "https://base.example/c"]


def test_codes_in_urls(apply):
    assert apply(urls.image_code, ["/products/2025/images/m2a.jpg", "/a/images/b/images/c.png", "/x/m2a.jpg", ""]) == [
        "m2a", "c", "", "",
    ]
    code = lambda c: urls.query_value(c, "expansionCodes")
    assert apply(code, ["/list/?expansionCodes=M1&x=1", "/list/?x=1&expansionCodes=SV10", "/list/"]) == ["M1", "SV10", ""]
    assert apply(urls.event_id_of, ["https://x/event/detail/848638/result", "/event/detail/x"]) == ["848638", ""]
    assert apply(urls.deck_id_of, ["/deck/confirm.html/deckID/AAA-BBB/", "/deck/"]) == ["AAA-BBB", ""]


def test_url_builders(spark):
    row = spark.range(1, 3).select(
        urls.catalog_page_url(F.lit("u/"), F.col("id")).alias("a"), urls.listing_page_url(F.col("id")).alias("b")
    ).orderBy("a").collect()
    assert [r["a"] for r in row] == ["u/", "u/?pageNo=2"]
    assert [r["b"].rsplit("=")[-1] for r in row] == ["0", "20"]


def test_name_and_code(apply):
    raw = ["X(SVOM 007/019)", "a(b)(c)", "a()", "plain", "(x)", " a ( b )"]
    assert apply(cards.card_name_of, raw) == ["X", "a(b)", "a()", "plain", "(x)", "a"]
    assert apply(cards.card_code_of, raw) == ["SVOM 007/019", "c", "", "", "", "b"]


def test_card_key(spark):
    rows = spark.createDataFrame([("n", "c"), ("n", ""), ("n", None), ("n", "  ")], "n string, c string")
    keys = [r[0] for r in rows.select(cards.card_key(F.col("n"), F.col("c"))).collect()]
    assert keys == ["n (c)", "n", "n", "n (  )"]


def test_rank_labels(apply):
    assert apply(cards.rank_label, ["1位", "2位", "3位", "4位", "21位", "", None]) == [
        "1st", "2nd", "3rd", "4th", "21th", "th", "th",
    ]


def test_energy_cards_are_no_key_cards(apply):
    assert apply(cards.is_key_card, ["ピカチュウ", "基本エネルギー", "Fire Energy", "energy", "", None]) == [
        True, False, False, True, False, False,
    ]


def test_code_parts(apply):
    raw = ["SVOM 007/019", "Brand#2", "", "A B 1/2"]
    assert apply(cards.number_of, raw) == ["007/019", "", "", "1/2"]
    assert apply(cards.set_of, raw) == ["SVOM", "Brand#2", "", "A B"]


def test_blank(apply):
    assert apply(text.is_blank, [None, "", " ", WIDE_SPACE, NO_BREAK, "\x1c", "x"]) == [True] * 6 + [False]


def test_truncate_counts_code_points(apply):
    assert apply(lambda c: text.truncate(c, 2), ["日本語", "🎴🎴🎴", "a"]) == ["日本", "🎴🎴", "a"]


def test_clean_lines(apply):
    assert apply(text.clean_lines, ["\n a\nb  c \n", f"{WIDE_SPACE}x{WIDE_SPACE}"]) == ["a b  c", "x"]


@settings(max_examples=20, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet=" \t\n\x1f  　ab日", max_size=12), min_size=1, max_size=20))
def test_strip_equals_python(apply, values):
    assert apply(text.strip, values) == [value.strip() for value in values]


def test_references_decode_once(apply):
    assert apply(text.decode_references, ["a &amp;lt; b", "&lt;&gt;&quot;&middot;&copy;", "x&nbsp;y"]) == [
        "a &lt; b", '<>"·©', f"x{NO_BREAK}y",
    ]


def test_scalar_text(spark):
    raw = ['{"f":null}', '{"f":0}', "{}", '{"f":true}', '{"f":"x"}']
    rows = spark.createDataFrame([(n, r) for n, r in enumerate(raw)], "n int, j string")
    value = F.from_json("j", "f variant")["f"]
    assert [r[0] for r in rows.orderBy("n").select(text.scalar_text(value)).collect()] == ["None", "0", "", "True", "x"]


def test_text_of_elements(apply):
    page = (
        "<!DOCTYPE html><p> a <b> b\n</b>&nbsp;<i>c &amp; d</i></p><!-- <p>no</p> --> e<SCRIPT>var x='</p>';</SCRIPT>"
        "<style>p{}</style>  f <section>g</section><s>h</s>"
    )
    assert apply(markup.stripped_text, [page]) == ["abc & defgh"]
    assert apply(markup.element_text, ["<p> a <b>b</b>\n<!-- x -->c</p>"]) == [" a b\nc"]


def test_text_keeps_inner_space(apply):
    assert apply(markup.stripped_text, [" a  b <br> c\td ", "", "x", None]) == ["a  bc\td", "", "x", None]


def test_elements_by_class(apply):
    page = """<div class='x'>no</div><DIV id="a" class="big date-day red">yes</DIV><div class="date-days">no</div>"""
    assert apply(lambda c: markup.inner(c, "div", markup.has_class("date-day")), [page, "", None]) == ["yes", "", None]
    exact = lambda c: markup.found(c, markup.opening("li", markup.has_class("paginationItem next")))
    assert apply(exact, ['<li class="paginationItem next">', '<li class="next paginationItem">', '<link class="paginationItem next">']) == [
        True, False, False,
    ]


def test_attributes(apply):
    tag = ["""<a data-href="no" href='/x?a=1&amp;b="2"' class=c>""", "<a>", '<a HREF="">']
    assert apply(lambda c: markup.attribute(c, "href"), tag) == ['/x?a=1&b="2"', "", ""]
    assert apply(lambda c: markup.found(c, markup.opening("a", markup.has_attribute("href"))), tag) == [True, False, True]
    disabled = ['<button class="next" disabled>', '<button disabled="" class="next">', '<button data-disabled class="next">']
    pattern = markup.opening("button", markup.has_class("next"), markup.has_attribute("disabled"))
    assert apply(lambda c: markup.found(c, pattern), disabled) == [True, True, False]


def test_long_white_space_runs_are_linear(apply):
    # quadratic patterns would need hours for this
    long = "a" + " " * 400_000 + "b" + " " * 400_000 + "<b>c</b>"
    assert len(apply(markup.stripped_text, [long])[0]) == 400_003


def test_elements_in_one_match_equal_elements_by_pieces(apply):
    pages = [
        "", "<td></td>", "<td>a</td><td>b</td>", "<td>a<td>b</td></td>", "<td a='<'>x</td><td>y</td>", "<td/><td>x</td>",
        "<TD>a</TD><td>b</td >", "<td>a", "</td><td>a</td>b</td>", "<td>a<tdx>b</tdx></td>", "<td>a<", "<td", "<td>a</td", "x<td \n>\n<b>a</b></td>",
        None,
    ]
    assert apply(lambda html: markup.inners(html, "td"), pages) == apply(lambda html: markup._inners_by_pieces(html, "td"), pages)
    general = lambda html: markup.upto_end(F.regexp_extract(html, rf"(?s){markup.opening('td')}(.*)", 1), "td")
    assert apply(lambda html: markup.inner(html, "td"), pages) == apply(general, pages)
