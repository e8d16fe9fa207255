"""Extraction from real-shaped pages, expected values by hand."""

import re

from pyspark.sql import functions as F

from cardloom.constants import HONG_KONG_BASE_URL, JAPAN_BASE_URL
from cardloom.functions import markup
from cardloom.functions.text import decode_references
from cardloom.operators import codes, decks, events, paging, products
from cardloom.session import Stages

ITEM = (
    '<li class="expansion"><a class="expansionLink" href="/hk/card-search/list/?expansionCodes=M1&amp;x=1">'
    '<img src="/img/m1.png"><span class="series"> S </span><h3 class="expansionTitle">超級 <b>進化</b></h3>'
    '<time class="Date" datetime="11-14-2025">soon</time></a></li>'
)
NEXT = '<nav class="pagination"><ul><li class="paginationItem next"><a href="?pageNo=2"></a></li></ul></nav>'
LAST = '<nav class="pagination"><ul><li class="paginationItem next"></li></ul></nav>'


def page(items, navigation):
    return f'<html><ul class="expansionList">{items}</ul>{navigation}</html>'


def catalog(spark, rows):
    return spark.createDataFrame(rows, "site string, page_no int, html string")


def test_catalog_reads_until_terminal_page(spark):
    full = page(ITEM, NEXT)
    rows = [("en", n, full) for n in (1, 2)] + [("en", 3, page(ITEM, LAST)), ("en", 4, full)]
    rows += [("zh", 1, full), ("zh", 2, page("", NEXT)), ("zh", 3, full), ("other", 1, full)]
    kept = products.catalog_pages(catalog(spark, rows)).select("site", "page_no").collect()
    assert sorted(map(tuple, kept)) == [("en", 1), ("en", 2), ("en", 3), ("zh", 1)]
    single = products.catalog_pages(catalog(spark, [("en", 1, page(ITEM, "")), ("en", 2, full), ("zh", 1, None)]))
    assert [tuple(r) for r in single.select("site", "page_no").collect()] == [("en", 1)]


def test_catalog_item_fields(spark):
    odd = (
        '<li class="expansion"><h3 class="expansionTitle">only title</h3><time class="date">1-4-2025 x</time></li>'
        '<li class="expansion"><a class="expansionLink" href=""></a><img src="https://i/x.png"></li>'
        '<li class="expansion"><span class="series">only series</span></li><li class="expansion"><p>x</p></li>'
    )
    found = products.catalog_items(products.catalog_pages(catalog(spark, [("zh", 1, page(ITEM + odd, ""))]))).orderBy("pos").collect()
    first = found[0].asDict()
    assert first["product_name"] == "S - 超級進化" and first["release_date"] == "2025-11-14" and first["code"] == "M1"
    assert first["link"] == f"{HONG_KONG_BASE_URL}/hk/card-search/list/?expansionCodes=M1&x=1"
    assert first["image_url"] == f"{HONG_KONG_BASE_URL}/img/m1.png"
    assert first["country"] == "Hong Kong (ZH)" and first["card_only"] == "Yes" and first["price_language"] == "hk"
    assert [r["product_name"] for r in found] == ["S - 超級進化", "only title", "", "only series"]
    assert [r["link"] for r in found][1:] == ["", HONG_KONG_BASE_URL, ""]
    assert found[1]["release_date"] == "2025-01-04" and found[2]["image_url"] == "https://i/x.png"


def test_detail_prices(spark):
    section = '<section class="section-product">{}</section>'
    rows = [
        ("hk", "M1", section.format('<div class="box-red"><p>建議零售價：9元</p></div><div class="data-product">建議零售價： 12元</div>')),
        ("hk", "SV10", section.format('<div class="box-red"><p>x</p><p>建議零售價:<b>18</b>元</p></div>')),
        ("hk", "m3", section.format("<span>建議零售價：20元</span>")),
        ("hk", "m4", section.format("none") + "建議零售價：1元"),
        ("hk-en", "m5", "<p>建議零售價：1元</p>"),
        ("hk", "m1", section.format('<div class="data-product">建議零售價： 12元</div>')),
    ]
    found = products.detail_prices(spark.createDataFrame(rows, "lang string, code string, html string")).collect()
    assert sorted(map(tuple, found)) == [("hk", "m1", "12元"), ("hk", "m3", "20元"), ("hk", "sv10", "18元")]


def api(spark, *bodies):
    return spark.createDataFrame([(n, b) for n, b in enumerate(bodies, 1)], "page_no int, body string")


def test_api_stops_at_max_page_and_at_unreadable_page(spark):
    item = '{"productTitle":"t%d"}'
    body = lambda n, m=5: '{"result":1,"maxPage":%d,"products":[%s]}' % (m, item % n)
    names = lambda *pages: [r[0] for r in products.api_products(api(spark, *pages)).orderBy("page_no").select("product_name").collect()]
    assert names(body(1, 2), body(2), body(3)) == ["t1", "t2"]
    assert names(body(1), '{"result":0,"errMsg":"x"}', body(3)) == ["t1", "t3"]
    assert names(body(1), "<html>", body(3)) == ["t1"]
    assert names('{"result":1,"products":[%s]}' % (item % 1), body(2)) == ["t1"]
    assert names("[]", body(2)) == []


def test_api_product_fields(spark):
    body = (
        '{"result":1,"maxPage":1,"products":[{"productType":"拡張パック","productTitle":"M2a","priceTxt":"550円","releaseDate":'
        '"2025年11月28日（金）","tumbsImg":"/products/2025/images/m2a.jpg","link_detailPage":"/ex/m2a/","description":"a\\nb ",'
        '"beginnerFlg":null,"storesAvailable":"s","link_cardList":"","link_pokemonCenter":"http://pc/"},'
        '{"productType":"x"},{"productTitle":"only","productType":null,"priceTxt":null,"beginnerFlg":1}]}'
    )
    first, second = products.api_products(api(spark, body)).orderBy("pos").collect()
    assert tuple(first)[2:] == (
        "Japan", "拡張パック M2a", "550円", "2025-11-28", "m2a", f"{JAPAN_BASE_URL}/ex/m2a/",
        f"{JAPAN_BASE_URL}/products/2025/images/m2a.jpg", "a b", "", "拡張パック", "None", "s", "", "http://pc/",
    )
    assert second["product_name"] == "only" and second["price"] == "" and second["beginner_flag"] == "1"


def test_products_sort_undated_first_and_ties_in_source_order(spark):
    rows = [("a", "2025-01-01"), ("b", ""), ("c", "2025-11-28"), ("d", "2025-11-28")]
    source = spark.createDataFrame([(1, n, *row) for n, row in enumerate(rows)], "page_no int, pos int, product_name string, release_date string")
    union = products.union_products(source, source.withColumn("price", F.lit("1")))
    names = [r["product_name"] for r in products.sort_products(union).collect()]
    assert names == ["b", "b", "c", "d", "c", "d", "a", "a"]
    assert [r["price"] for r in products.sort_products(union).collect()][:2] == ["", "1"]
    assert [r["product_name"] for r in products.sort_products(union, "last").collect()][-2:] == ["b", "b"]


HEADER = (
    '<h2>x</h2><h1 class="c eventName1"> シティ<br>リーグ </h1><div class="date-day">2025年11月11日(火)</div>'
    "<div>主催者： 店 A </div>\n<div>〒123-4567 兵庫県1-2 ビルイベント結果 x</div>\n{}"
)


def headers(spark, html):
    rows = [("https://p/event/detail/848638/result", 1, html), ("https://p/event/detail/848638/result", 2, "<h1>no</h1>")]
    return events.event_headers(spark.createDataFrame(rows, "event_url string, page_no int, html string")).collect()


def test_event_header(spark):
    (row,) = headers(spark, HEADER.format('<span class="location">L</span><div class="Store-x"> S </div>'))
    assert row.asDict() == {
        "event_url": "https://p/event/detail/848638/result", "event_id": "848638", "event_title": "シティリーグ",
        "event_date": "2025-11-11", "event_host": "店 A", "event_address": "〒123-4567 兵庫県1-2 ビル", "event_location": "S",
    }


def test_event_location_falls_back_to_store_name(spark):
    (row,) = headers(spark, HEADER.format('<div class="venue"> </div><p>会場 カードラボ秋葉原 まで</p>'))
    assert row["event_location"] == "カードラボ秋葉原"
    (row,) = headers(spark, "<p>x</p><h2>Two</h2><h1>One</h1>")
    assert (row["event_title"], row["event_date"], row["event_host"], row["event_address"], row["event_location"]) == ("Two", "", "", "", "")


def results_page(rows, button):
    return f"<table><tr><th>h</th></tr>{rows}</table>{button}"


ROW = (
    '<tr><td>{}位</td><td>100pt</td><td>nama <span>プレイヤーID：123</span>エリア：兵庫県</td><td>x</td>'
    '<td><a href="/x">x</a><a href="https://d/deck/confirm.html/deckID/AAA-BBB/">d</a></td></tr>'
)
OPEN, CLOSED = '<button class="btn next">', '<button class="next" disabled="">'


def test_event_results_follow_the_next_button(spark):
    url = "https://p/event/detail/{}/result"
    rows = [
        (url.format(1), 1, results_page(ROW.format(1), OPEN)), (url.format(1), 2, results_page(ROW.format(2), CLOSED)),
        (url.format(1), 3, results_page(ROW.format(3), OPEN)), (url.format(2), 1, results_page(ROW.format(1), "")),
        (url.format(2), 2, results_page(ROW.format(2), OPEN)), (url.format(3), 1, "<p>none</p>" + OPEN),
        (url.format(3), 2, results_page(ROW.format(9), OPEN)),
    ]
    found = events.event_results(spark.createDataFrame(rows, "event_url string, page_no int, html string"))
    assert sorted((r["event_id"], r["page_no"], r["rank"]) for r in found.collect()) == [("1", 1, "1位"), ("1", 2, "2位"), ("2", 1, "1位")]


def test_event_result_fields(spark):
    odd = "<tr><td>1</td><td>2</td><td>3</td><td>4</td></tr><tr><td>2位</td><td></td><td>プリン</td><td></td><td>no</td></tr>"
    html = results_page(ROW.format(1) + odd, "")
    found = events.event_results(spark.createDataFrame([("/event/detail/5", 1, html)], "event_url string, page_no int, html string"))
    first, second = found.orderBy("pos").collect()
    assert tuple(first) == ("5", 1, 0, "1位", "100pt", "nama", "123", "兵庫県", "https://d/deck/confirm.html/deckID/AAA-BBB/", "AAA-BBB")
    assert tuple(second) == ("5", 1, 1, "2位", "", "", "", "", "", "")


def deck_page(*inputs, names="", code="<p>【デッキコード】AAA-BBB</p>"):
    fields = "".join(f'<input value="{value}" id="deck_{n}">' for n, value in enumerate(inputs))
    return f"{code}{fields}<script>{names}</script><script>x.searchItemName[1]='no';</script>"


def name_entry(card_id, name, image=None):
    picture = f"PCGDECK.searchItemCardPict[{card_id}]='{image}';" if image else ""
    return f"PCGDECK.searchItemName[{card_id}]='{name}';{picture}"


def parsed(spark, html):
    row = decks.parse_deck_pages(spark.createDataFrame([("AAA-BBB", html)], "deck_id string, html string")).collect()[0]
    return row["deck_code"], [(c["card_id"], c["quantity"]) for c in row["cards"]], row


def test_deck_page(spark):
    names = name_entry(47259, "old", "/o.jpg") + name_entry(47258, "b") + name_entry(47259, "マリィex(SVOM 007/019)", "/n.jpg")
    code, cards, row = parsed(spark, deck_page("47259_2_1-47258_3_1", "", "9_1_1", names=names))
    assert code == "AAA-BBB" and cards == [("47259", 2), ("47258", 3)]
    assert row["cards"][0].asDict() == {
        "card_id": "47259", "card_name": "マリィex", "card_code": "SVOM 007/019", "quantity": 2,
        "image_url": f"{JAPAN_BASE_URL}/n.jpg",
    }
    assert row["cards"][1]["card_code"] == "" and row["cards"][1]["image_url"] == ""
    assert row["deck_url"] == f"{JAPAN_BASE_URL}/deck/confirm.html/deckID/AAA-BBB"


def test_packed_lists(spark):
    names = "".join(name_entry(n, f"n{n}") for n in (1, 3, 4))
    assert parsed(spark, deck_page("1_2-x-3_4", names=names))[1] == [("1", 2), ("3", 4)]
    assert parsed(spark, deck_page("1_2-3_z-4_1", "4_1", names=names))[1] == [("1", 2)]
    # a broken quantity ends the deck even for an unknown card
    assert parsed(spark, deck_page("1_2-8_z-4_1", names=names))[1] == [("1", 2)]
    assert parsed(spark, deck_page(names=names, code=""))[:2] == ("", [])


def test_card_code_pages(spark):
    image = '<img src="x" class="a img-regulation" alt=" {} ">'
    rows = [
        ("1", image.format("SVN") + "<p>023&nbsp;/&nbsp;045</p>"), ("2", image.format("SVN") + "023/ 045 and 111/222"),
        ("3", "023 / 045"), ("4", image.format("SVN") + "23/45"), ("5", image.format(" ") + "023/045"),
        ("6", '<img class="img-regulation">023/045'), ("7", image.format("A") + "023 / 045"),
    ]
    found = codes.extract_card_codes(spark.createDataFrame(rows, "card_id string, html string")).collect()
    assert dict(map(tuple, found)) == {
        "1": "SVN 023/045", "2": "SVN 023/ 045", "3": None, "4": None, "5": None, "6": None, "7": "A 023/045",
    }


def test_discovery_against_brute_force(spark):
    import random

    random.seed(3)
    pages = [[str(random.randint(1, 12 + n)) for _ in range(4)] for n in range(12)]
    link = '<li><a class="x" href="https://p/event/detail/{}/result">r</a><a href="/other">o</a></li>'
    rows = [(n, "".join(link.format(i) for i in ids)) for n, ids in enumerate(pages, 1)]
    listing = spark.createDataFrame(rows, "page_no int, html string").repartition(4)
    for limit in (3, 10, 100):
        expected = []
        for ids in pages:
            new = [i for i in dict.fromkeys(ids) if i not in expected]
            expected += new[: limit - len(expected)]
            if not new or len(expected) >= limit:
                break
        found = paging.first_ids(paging.discover_event_ids(listing), limit).orderBy("position").collect()
        assert [r["event_id"] for r in found] == expected
        assert [r["position"] for r in found] == list(range(1, len(expected) + 1))


def test_discovery_counts_pages_without_links(spark):
    rows = [(1, '<a href="/event/detail/1">'), (2, "<p>none</p>"), (3, '<a href="/event/detail/2">')]
    found = paging.discover_event_ids(spark.createDataFrame(rows, "page_no int, html string"))
    assert [r["event_id"] for r in found.collect()] == ["1"]


# ---- whole elements, comments, references ----------------------------------------------------------------------------


def one(spark, html, column):
    return spark.createDataFrame([(html,)], "html string").select(column.alias("out")).first()["out"]


def event_page(spark, *bodies, url="https://p/event/detail/5/result"):
    return spark.createDataFrame([(url, n, body) for n, body in bodies], "event_url string, page_no int, html string")


def test_element_ends_where_its_depth_does(spark):
    html = F.col("html")
    page = "<div class='a'><div>1<div>2</div></div><div/>3<br></div><div>4</div>"
    assert one(spark, page, markup.inner(html, "div", markup.has_class("a"))) == "<div>1<div>2</div></div><div/>3<br>"
    assert one(spark, "<DIV class='a'>x<p>y", markup.inner(html, "div", markup.has_class("a"))) == "x<p>y"
    assert one(spark, "<p>x</p>", markup.inner(html, "div")) == ""
    items = "<ul><li class='e'>1<ul><li>2</li></ul>3</li><li>4</li><li class='e'>5</li></ul>"
    assert one(spark, items, markup.inners(html, "li", markup.has_class("e"))) == ["1<ul><li>2</li></ul>3", "5"]
    deep = "<div>" * 3000 + "x" + "</div>" * 3000
    assert one(spark, deep, markup.inner(html, "div")) == deep[5:-6]


def test_hidden_markup_is_no_page(spark):
    html = F.col("html")
    page = "a<!-- <p>x</p> --><script>'<p>y</p>'</script><STYLE>p{}</STYLE><p>z</p>"
    assert one(spark, page, markup.visible(html)) == "a<p>z</p>"
    assert one(spark, "<script>/*<!--*/</script>1<!--2-->3", markup.without_comments(html)) == "<script>/*<!--*/</script>13"


def test_character_references(spark):
    import html as standard

    texts = ["Pok&eacute;mon &#12354; &#x3042;&hellip;", "&amp;lt; &amp;amp; &lt;", "&none; & &; &#; &#x; &#0; &#x110000; &#xD800;",
             "&copy 1 &copyx &notit; &Aacute&aacute;", "&#128;&#150;&#128512;&NotEqualTilde;", "", "no reference"]
    table = spark.createDataFrame([(n, t) for n, t in enumerate(texts)], "n int, t string")
    found = table.orderBy("n").select(decode_references(F.col("t")).alias("out")).collect()
    assert [r["out"] for r in found] == [standard.unescape(t) for t in texts]


def test_venue_with_children(spark):
    body = '<div class="shop-info"><div>A</div><div>B</div></div>'
    assert events.event_headers(event_page(spark, (1, body))).first()["event_location"] == "AB"


def test_price_of_the_product_with_children(spark):
    html = ('<section class="section-product"><p>建議零售價：9元</p><div class="data-product"><div>x</div>建議零售價：5元</div>'
            "</section>")
    pages = spark.createDataFrame([("hk", "c", html)], "lang string, code string, html string")
    assert products.detail_prices(pages).first()["price"] == "5元"


RESULT = '<tr><td>1位</td><td>1pt</td><td>pプレイヤーID：1</td><td></td><td></td></tr>'


def test_commented_table_and_copies_and_gaps(spark):
    table = f"<!-- <table><tr></tr></table> --><table><tr></tr>{RESULT}</table>"
    more = table + '<button class="next">n</button>'
    assert events.event_results(event_page(spark, (1, table))).count() == 1
    assert events.event_results(event_page(spark, (1, more), (1, more), (2, table), (2, table))).count() == 2
    assert events.event_results(event_page(spark, (1, more), (3, table))).count() == 1
    assert events.event_results(event_page(spark, (2, more), (3, table))).count() == 0
    assert events.event_headers(event_page(spark, (1, more), (1, more))).count() == 1


def test_pages_are_read_once(spark, tmp_path):
    """What is scanned are the pages once, then slim rows."""
    pages = event_page(spark, (1, f"<table><tr></tr>{RESULT}</table>"))
    pages.write.parquet(f"{tmp_path}/pages")
    stages = Stages()
    found = events.event_results(spark.read.parquet(f"{tmp_path}/pages"), stages)
    plan = found._jdf.queryExecution().toString()
    assert f"{tmp_path}/pages" not in plan and "html" not in plan and found.count() == 1
    stages.drop()


def test_deck_code_behind_children(spark):
    for html, code in (
        ("<p>foo<br>【デッキコード】ABC</p><p>x</p>", "ABC"),
        ("<p><b>foo</b>【デッキコード】ABC</p>", "ABC"),
        ("<div><p>【デッキコード】<b>A<i>B</i></b>C</p>z</div>", "ABC"),
        ("<!-- 【デッキコード】NO --><div><p><i>a</i><img>【デッキコード】AB</p>z</div>", "AB"),
        ("<p>none</p>", ""),
    ):
        pages = spark.createDataFrame([("D", html)], "deck_id string, html string")
        assert decks.parse_deck_pages(pages).first()["deck_code"] == code, html


def test_api_gap_and_copies(spark):
    body = '{"result":1,"maxPage":4,"products":[{"productTitle":"j"}]}'
    pages = lambda *numbers: spark.createDataFrame([(n, body) for n in numbers], "page_no int, body string")
    assert products.api_products(pages(1, 2, 2, 3)).count() == 3
    assert products.api_products(pages(1, 2, 4)).count() == 2
    assert products.api_products(pages(2, 3)).count() == 0


def test_only_pages_with_copies_are_merged(spark):
    """Without copies no page is moved or sorted, with some the others stay where they are and the largest copy counts."""
    full, other = page(ITEM, NEXT), page(ITEM * 2, NEXT)
    alone = products.catalog_pages(catalog(spark, [("en", 1, full), ("en", 2, full), ("zh", 1, full), ("zh", None, full)]))
    plan = alone._jdf.queryExecution().toString()
    assert "max(struct(" not in plan and "items" in plan and alone.count() == 3
    rows = [("en", 1, full), ("en", 2, full), ("en", 2, other), ("en", 2, full), ("en", None, full), ("en", None, other), ("en", 3, full)]
    some = products.catalog_pages(catalog(spark, rows))
    assert sorted((r["page_no"], len(r["items"])) for r in some.collect()) == [(1, 1), (2, 2), (3, 1)]
    body = '{"result":1,"maxPage":3,"products":[{"productTitle":"j"}]}'
    bodies = [(1, body), (2, body), (3, body), (None, body)]
    api = products.api_products(spark.createDataFrame(bodies, "page_no int, body string"))
    assert "first(response" not in api._jdf.queryExecution().toString() and api.count() == 3
    api = products.api_products(spark.createDataFrame([*bodies, (2, body), (None, body)], "page_no int, body string"))
    assert sorted(r["page_no"] for r in api.collect()) == [1, 2, 3]


def test_listing_gap(spark):
    link = '<a href="/event/detail/{}/result">r</a>'
    listing = lambda *numbers: spark.createDataFrame([(n, link.format(n)) for n in numbers], "page_no int, html string")
    ids = lambda table: sorted(r["event_id"] for r in paging.discover_event_ids(table).collect())
    assert ids(listing(1, 2, 4)) == ["1", "2"] and ids(listing(2, 3)) == [] and ids(listing(1, 1, 2)) == ["1", "2"]


def test_elements_inside_elements_of_their_kind(spark):
    inside = lambda page, *of: one(spark, page, markup.inners(F.col("html"), *of))
    nested = '<li class="e">1<ul><li class="e">2</li><li>3</li></ul>4<a></a></li><li class="e">5</li>'
    assert inside(nested, "li", markup.has_class("e")) == ['1<ul><li class="e">2</li><li>3</li></ul>4<a></a>', "2", "5"]
    assert inside(nested, "li") == ['1<ul><li class="e">2</li><li>3</li></ul>4<a></a>', "2", "3", "5"]
    assert inside("<p>1<p>2<p/>3", "p") == ["1<p>2<p/>3", "2<p/>3", ""]
    assert inside("</p>0</p><P>1<p>2</P></p>3</p><p>4", "p") == ["1<p>2</P>", "2", "4"]
    assert inside("<pre>x</pre><p>1</p>", "p") == ["1"] and inside("none", "p") == [] and inside(None, "p") is None
    deep = "<b>" * 60 + "x" + "</b>" * 60
    assert [len(x) for x in inside(deep, "b")] == [1 + 7 * n for n in range(59, -1, -1)]


def test_item_inside_an_item_keeps_the_outer_link(spark):
    inner = '<ul><li class="expansion"><h3 class="expansionTitle">I</h3></li></ul>'
    item = f'<li class="expansion"><h3 class="expansionTitle">T</h3>{inner}<a class="expansionLink" href="/x?expansionCodes=Q"></a></li>'
    found = products.catalog_items(products.catalog_pages(catalog(spark, [("en", 1, page(item, ""))]))).orderBy("pos").collect()
    # as the series-less outer item is searched as a whole, its first title counts
    assert [(r["product_name"], r["code"]) for r in found] == [("T", "Q"), ("I", "")]


def test_table_inside_a_cell_keeps_the_result_row(spark):
    cell = "<table><tr><td>a</td></tr></table>"
    html = f"<table><tr><th>h</th></tr><tr><td>1{cell}</td><td>2pt</td><td>3</td><td>4</td><td>5</td></tr></table>"
    rows = spark.createDataFrame([("https://x/event/detail/7/result", 1, html)], "event_url string, page_no int, html string")
    found = events.event_results(rows, Stages()).collect()
    # cells of the table inside count as well, in the order in which they are opened
    assert [(r["rank"], r["points"], r["player_name"]) for r in found] == [("1a", "a", "2pt")]


def test_names_of_references_are_in_a_plan_once(spark):
    rows = spark.createDataFrame([("u", 1, "<p>x</p>")], "event_url string, page_no int, html string")
    plan = events.event_headers(rows)._jdf.queryExecution().optimizedPlan().toString()
    assert len(plan) < 100_000 and plan.count("CounterClockwiseContourIntegral") == 1


def test_hidden_parts_as_by_plain_patterns(apply):
    pages = [
        "a<!-- x --><script>1<!-- y --></script >b", "<SCRIPT a='1'>if (a < b) '</p>' </script\n>c<!--->-->d", "<script>never",
        "<style>x</style><scripted>s</scripted><!-- open <script>z</script>", "<!-- <script> --><script>é</SCRIPT>あ</script>", "",
        "<script/>1</script><style >2<script>3</style>4</script>",
    ]
    hidden = r"(?is)<(?:!--.*?-->|script(?=[\s/>]).*?</script\s*>|style(?=[\s/>]).*?</style\s*>)"
    comment = r"(?is)(<(script|style)(?=[\s/>]).*?</\2\s*>)|<!--.*?-->"
    assert apply(markup.visible, pages) == [re.sub(hidden, "", page) for page in pages]
    assert apply(markup.without_comments, pages) == [re.sub(comment, r"\1", page) for page in pages]
    bodies = [re.findall(r"(?is)<script(?=[\s/>])[^>]*>(.*?)</script\s*>", page) for page in pages]
    assert apply(markup.scripts_of, pages) == bodies
    assert apply(markup.visible, [None]) == apply(markup.without_comments, [None]) == [None]


def test_long_scripts_take_linear_time(apply):
    body = "x < y; " * 60_000
    (text,) = apply(markup.without_comments, [f"<!-- c --><script>{body}</script>"])
    assert text == f"<script>{body}</script>"
    assert apply(markup.scripts_of, [text]) == [[body]]


def test_no_deck_page_has_no_code(spark):
    rows = spark.createDataFrame([("A", None), ("B", "<p>x</p>"), ("C", "<p>デッキコード】c</p>")], "deck_id string, html string")
    codes = {row["deck_id"]: row["deck_code"] for row in decks.parse_deck_pages(rows).collect()}
    assert codes == {"A": None, "B": "", "C": "c"}
