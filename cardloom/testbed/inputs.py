"""Inputs of the operators derived from the TESTDATA tables by Spark.

Flat inputs come from joins. Pages, responses and documents are built inside the row they come from, so no group is
ever collected to make one, and their number grows with the tables. Every rule is repeated in ``oracles.py`` as SQL,
which states the expected outcome straight from the tables and builds no page.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cardloom.functions.cards import deck_file_name
from cardloom.functions.once import select_once
from cardloom.sources.landed import spread, tasks_for

ENERGY_STAND_INS = ("ring", "anvil")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table with much work per row behind it, its rows dealt out evenly."""
    return spread(table(spark, folder, name))


# ---- flat inputs -----------------------------------------------------------------------------------------------------


def results(spark: SparkSession, folder: str) -> DataFrame:
    """One result per lineitem; suppliers in debt have no player id, seventh places no deck.

    Joined rows are dealt out, not those before: what groups them sorts a task's rows, which a join leaves in as many tasks
    as the session has shuffle partitions, however many rows there are.
    """
    lineitem = table(spark, folder, "lineitem")
    joined = (
        lineitem.join(table(spark, folder, "orders"), F.expr("l_orderkey = o_orderkey"))
        .join(table(spark, folder, "supplier"), F.expr("l_suppkey = s_suppkey"))
        .join(table(spark, folder, "nation"), F.expr("s_nationkey = n_nationkey"))
    )
    return joined.selectExpr(
        "cast(l_orderkey as string) as event_id",
        "date_format(o_orderdate, 'yyyy-MM-dd') as event_date",
        "l_linenumber as pos",
        "concat(l_linenumber, '位') as rank",
        "concat(cast(l_quantity as int), 'pt') as points",
        "if(s_acctbal < 0, '', cast(l_suppkey as string)) as player_id",
        "concat(s_name, '/', l_returnflag) as player_name",
        "n_name as player_area",
        "if(l_linenumber = 7, '', concat(l_orderkey, '-', l_partkey)) as deck_id",
    ).repartition(tasks_for(lineitem), "event_id", "pos")


def result_keys(spark: SparkSession, folder: str) -> DataFrame:
    """The part of :func:`results` that needs no join: event, rank, deck."""
    return spread_table(spark, folder, "lineitem").selectExpr(
        "cast(l_orderkey as string) as event_id",
        "concat(l_linenumber, '位') as rank",
        "if(l_linenumber = 7, '', concat(l_orderkey, '-', l_partkey)) as deck_id",
        "l_returnflag as flag",
    )


def events(spark: SparkSession, folder: str) -> DataFrame:
    joined = table(spark, folder, "orders").join(table(spark, folder, "customer"), F.expr("o_custkey = c_custkey"))
    return joined.selectExpr(
        "cast(o_orderkey as string) as event_id",
        "date_format(o_orderdate, 'yyyy-MM-dd') as event_date",
        "c_name as event_host",
    )


def events_with_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Events with their number of results; orders without lineitems have none."""
    counts = spread_table(spark, folder, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("results"))
    orders = table(spark, folder, "orders")
    return orders.join(counts, F.expr("o_orderkey = l_orderkey"), "left").selectExpr(
        "cast(o_orderkey as string) as event_id", "o_orderkey as position", "o_orderstatus as state",
        "coalesce(results, 0) as participants",
    )


def cards(spark: SparkSession, folder: str) -> DataFrame:
    """One card entry per lineitem; small parts have a blank code, the smallest one of only spaces."""
    joined = spread_table(spark, folder, "lineitem").join(table(spark, folder, "part"), F.expr("l_partkey = p_partkey"))
    return joined.selectExpr(
        "cast(l_orderkey as string) as deck_id",
        "concat('deck_', l_orderkey, '.json') as deck_file",
        "l_linenumber as pos",
        "cast(l_partkey as string) as card_id",
        "p_name as card_name",
        "case when p_size <= 5 then '  ' when p_size <= 15 then '' else p_brand end as card_code",
        "cast(l_quantity as int) as quantity",
    )


def decks(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").selectExpr("cast(o_orderkey as string) as deck_id")


def code_cache(spark: SparkSession, folder: str) -> DataFrame:
    """Cached codes of the cards of two part types."""
    return table(spark, folder, "part").where("p_type in ('ECONOMY', 'LARGE')").selectExpr(
        "cast(p_partkey as string) as card_id",
        "concat(p_brand, ' ', lpad(p_partkey % 1000, 3, '0'), '/100') as card_code",
    )


def stored_events(spark: SparkSession, folder: str) -> DataFrame:
    """Events whose information is stored: those of finished or open orders."""
    return events_with_counts(spark, folder).where("state <> 'P'").selectExpr("event_id", "participants as expected")


def stored_decks(spark: SparkSession, folder: str) -> DataFrame:
    """Stored deck files: those of lineitems that were not returned."""
    keys = result_keys(spark, folder).where("flag <> 'R' and deck_id <> ''")
    return keys.select("event_id", deck_file_name(F.col("rank"), F.col("deck_id")).alias("deck_file"))


# ---- API responses ---------------------------------------------------------------------------------------------------


def api_pages(spark: SparkSession, folder: str) -> DataFrame:
    """One response per part with up to four products; the last part lies beyond ``maxPage``."""
    part = spread_table(spark, folder, "part")
    last = table(spark, folder, "part").agg(F.max("p_partkey")).scalar()
    day = "date_add(date'2020-01-01', cast(p_partkey % 3000 as int))"
    product = f"""concat(
        '{{"productType":"', if(i = 2, '', p_type), '"',
        ',"productTitle":"', if(i = 1 and p_size % 7 = 0, '', concat(p_name, ' ', i)), '"',
        ',"priceTxt":', if(i = 0 and p_size = 20, 'null', concat('"', cast(p_retailprice as int), '円"')),
        case i when 0 then concat(',"releaseDate":"', date_format({day}, 'yyyy年M月d日'), '（金）"')
               when 1 then concat(',"releaseDate":"', date_format({day}, 'yyyy年 M月d日'), '"')
               when 2 then '' else ',"releaseDate":"未定"' end,
        case i when 0 then concat(',"tumbsImg":"/products/images/p', p_partkey, '.jpg"')
               when 1 then concat(',"tumbsImg":"https://img.example/x/images/p', p_partkey, '.png"')
               when 2 then ',"tumbsImg":"/other/p.jpg"' else '' end,
        ',"link_detailPage":"', if(i % 2 = 0, '/ex/', 'https://shop.example/'), p_partkey, '"',
        ',"description":" line ', i, '\\\\n box "',
        case i when 0 then '' when 1 then ',"beginnerFlg":null' when 2 then ',"beginnerFlg":0'
               else ',"beginnerFlg":"1"' end,
        ',"storesAvailable":"', p_brand, '"',
        if(i = 0, concat(',"link_cardList":"/list/', p_partkey, '"'), ',"link_cardList":""'),
        if(i = 1, concat(',"link_pokemonCenter":"https://pc.example/', p_partkey, '"'), ''),
        '}}')"""
    body = f"""concat('{{"result":', if(p_size = 13, 0, 1), ',"errMsg":"","maxPage":', last_page, ',"products":[',
        array_join(transform(sequence(0, p_size % 4), i -> {product}), ','), ']}}')"""
    return select_once(
        part.withColumn("last_page", last), [F.expr("cast(p_partkey + 1 as int) as page_no")], F.expr(body).alias("body")
    )


# ---- catalogue pages -------------------------------------------------------------------------------------------------


def catalog_pages(spark: SparkSession, folder: str) -> DataFrame:
    """One catalogue page per part on one of two sites, numbered without a gap. The last tenth of the pages of the first site lies behind a
    page without a next link, the last twentieth of the second site behind pages without a list."""
    part = spread_table(spark, folder, "part")
    last = table(spark, folder, "part").agg(F.max("p_partkey")).scalar()
    day = "date_add(date'2020-01-01', cast(p_partkey % 3000 as int))"
    item = f"""concat('<li class="expansion new">',
        case i when 0 then concat('<a href="/hk/card-search/list/?expansionCodes=P', p_partkey,
                                  '&amp;x=1" class="expansionLink">')
               when 1 then concat('<a class="expansionLink" href="https://x.example/list?expansionCodes=Q', p_partkey, '">')
               when 2 then '<a class="expansionLink" href="/hk/none">' else '<a>' end,
        if(i < 2, concat('<img alt="x" src="', if(i = 0, '/img/', 'https://img.example/'), p_partkey, '.png">'), ''),
        if(i in (0, 2), concat('<span class="series">\\n ', p_type, ' </span>'), ''),
        if(i = p_size % 4, '<ul><li class="expansion">inner</li></ul>', '<ul><li>inner</li></ul>'), if(i < 2, concat('<h3 class="expansionTitle"> ', p_name, ' &amp; <b>', i, '</b> </h3>'), ''),
        case i when 0 then concat('<time class="Release-Date" datetime="', date_format({day}, 'M-d-yyyy'), '">soon</time>')
               when 1 then concat('<time class="date"> ', date_format({day}, 'M-d-yyyy'), ' (Fri)</time>')
               else '' end,
        '</a></li>')"""
    html = f"""concat('<html><body><!-- <ul class="expansionList"><li class="expansion"></li></ul> -->',
        if(site = 'zh' and p_partkey >= last_page - last_page div 20, '<p>none</p>',
           concat('<ul class="expansionList wide">', array_join(transform(sequence(0, p_size % 4), i -> {item}), '\\n'),
                  '</ul>')),
        '<nav class="pagination"><ul><li class="paginationItem prev"><a href="?p"></a></li>',
        if(site = 'en' and p_partkey >= last_page - last_page div 10, '',
           '<li class="paginationItem next"><a href="?n"></a></li>'),
        '</ul></nav></body></html>')"""
    sited = part.withColumn("last_page", last).withColumn("site", F.expr("if(p_partkey % 2 = 0, 'en', 'zh')"))
    return select_once(sited, ["site", F.expr("cast(p_partkey div 2 + 1 as int) as page_no")], F.expr(html).alias("html"))


def detail_pages(spark: SparkSession, folder: str) -> DataFrame:
    """One price page per part, with the price in one of three places or missing."""
    html = """concat('<section class="section-product"><p>建議零售價</p>',
        case p_size % 8 div 2
             when 0 then concat('<p>建議零售價：5元</p><div class="data-product"><div>x</div><p>建議零售價： ', p_size, '元</p></div>',
                                '<div class="box-red"><p>建議零售價：1元</p></div>')
             when 1 then concat('<div class="box-red"><p>x</p><p>建議零售價:', p_size, '元</p></div>')
             when 2 then concat('<span>建議零售價：<b>', p_size, '</b>元</span>')
             else '' end,
        '</section><p>建議零售價：2元</p>')"""
    keys = [F.expr("if(p_partkey % 2 = 0, 'hk-en', 'hk') as lang"), F.expr("concat('p', p_partkey) as code")]
    return select_once(spread_table(spark, folder, "part"), keys, F.expr(html).alias("html"))


# ---- listing, event, deck and card pages -----------------------------------------------------------------------------


def listing_pages(spark: SparkSession, folder: str) -> DataFrame:
    """One listing page per event row: a link of its own and one to a busy id. The last tenth has only the latter."""
    rows = spread_table(spark, folder, "events")
    last = table(spark, folder, "events").agg(F.max("event_id")).scalar()
    html = """concat('<ul>',
        if(event_id < last_event - last_event div 10,
           concat('<li><a class="ev" href="/event/detail/', event_id + 1000000, '/result">e</a></li>'), ''),
        '<li><a href="/other/1">o</a></li><li><a href="/event/detail/x">x</a></li>',
        '<li><a href="https://players.example/event/detail/', user_id, '/result">u</a></li></ul>')"""
    return select_once(
        rows.withColumn("last_event", last), [F.expr("cast(event_id + 1 as int) as page_no")], F.expr(html).alias("html")
    )


def event_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Result pages of one event per order: one to three pages, and behind the last one a page nobody reaches."""
    orders = spread_table(spark, folder, "orders")
    row = """concat('<tr><td>', (page_no - 1) * 3 + j, '位</td><td> ', o_custkey % 100, 'pt</td><td><b>nama', j,
        '</b>プレイヤーID：', o_custkey * 10 + j, '<br>エリア：', o_orderpriority, ' </td><td>x</td><td>',
        if(j = 3, '', concat('<a href="https://deck.example/deck/confirm.html/deckID/D', o_orderkey, '-', page_no, '-', j,
                             '/x">deck</a>')), if(o_orderkey % 32 = 0, '<table><tr><td>inner</td></tr></table>', ''), '</td></tr>')"""
    html = f"""concat('<html><head><title>t</title></head><body>',
        '<!-- <table><tr></tr><tr><td>0</td><td>0</td><td>0</td><td>0</td><td>0</td></tr></table> -->',
        if(o_orderstatus = 'F', concat('<h2>Top</h2><h1>', o_orderpriority, '</h1>'),
           concat('<h2>Top</h2><h1 class="big eventName-x"> Cup <i>', o_orderpriority, '</i></h1>')),
        '<div class="date-day">', date_format(o_orderdate, 'yyyy年M月d日'), '(火)</div>',
        '<p>主催者： Host ', o_custkey, '\\n〒123-4567 City ', o_custkey, 'イベント結果</p>',
        case o_orderstatus when 'F' then '<div class="Shop-name"><div>Caf&eacute;</div> <div>&#12354;</div></div>' when 'O' then '<span class="location">L </span>'
             else '' end,
        '<p>カードラボ', o_custkey, ' x</p>',
        '<table><tr><th>h</th><td>1</td><td>2</td><td>3</td><td>4</td><td>5</td></tr>',
        array_join(transform(sequence(1, 3), j -> {row}), '\\n'), '<tr><td>1</td><td>2</td><td>3</td><td>4</td></tr></table>',
        if(page_no < pages, '<button class="btn next">n</button>',
           if(o_orderstatus = 'F', '', '<button class="next" disabled>n</button>')), '</body></html>')"""
    paged = orders.withColumn("pages", F.expr("cast(1 + o_custkey % 3 as int)")).withColumn(
        "page_no", F.expr("explode(sequence(1, pages + 1))")
    )
    url = F.expr("concat('https://players.example/event/detail/', o_orderkey, '/result') as event_url")
    return select_once(paged, [url, "page_no"], F.expr(html).alias("html"))


def deck_pages(spark: SparkSession, folder: str) -> DataFrame:
    """One deck page per order with up to six cards in two packed inputs.

    Card 1 is an energy card, card 2 has no code, card 4 no name; the first name comes twice, the later one counts.
    Orders in progress have a broken quantity at card 3.
    """
    orders = spread_table(spark, folder, "orders")
    card_id = "(40000 + (o_custkey * 7 + i * 13) % 900)"
    entry = f"""concat({card_id}, '_', if(i = 3 and o_orderstatus = 'P', 'x', cast(1 + (o_orderkey + i) % 4 as string)), '_1')"""
    name = f"""case i when 1 then '基本エネルギー' when 2 then concat('plain ', {card_id} % 64)
        else concat('card ', {card_id} % 64, '(SET ', lpad({card_id} % 1000, 3, '0'), '/100)') end"""
    image = f"concat('/img/', {card_id}, '.jpg')"
    named = f"concat('PCGDECK.searchItemName[', {card_id}, ']=\\'', {name}, '\\';')"
    pictured = f"concat('PCGDECK.searchItemCardPict[', {card_id}, ']=\\'', {image}, '\\';')"
    html = f"""concat(if(o_orderkey % 2 = 0, '<p><b>deck</b><br>【デッキコード】C', '<p>【デッキコード】<b>C'), o_orderkey,
        if(o_orderkey % 2 = 0, '</p>', '</b></p>'), '<!-- <input id="deck_old" value="9_9_1"> -->',
        '<input type="hidden" id="deck_pke" value="', array_join(transform(slice(ids, 1, 3), i -> {entry}), '-'), '">',
        '<input id="other" value="1_1_1"><input id="deck_ene" value="">',
        '<input value="', array_join(transform(slice(ids, 4, 9), i -> {entry}), '-'), '" id="deck_tr">',
        '<script>PCGDECK.searchItemName[', 40000 + (o_custkey * 7) % 900, ']=\\'old\\';</script>',
        '<script>', array_join(transform(filter(ids, i -> i <> 4), i -> {named}), '\\n'),
        array_join(transform(filter(ids, i -> i % 2 = 0), i -> {pictured}), ''), '</script>',
        '<script>other[1]=\\'no\\';</script>')"""
    listed = orders.withColumn("ids", F.expr("sequence(0, cast(o_custkey % 6 as int))"))
    return select_once(listed, [F.expr("concat('D', o_orderkey) as deck_id")], F.expr(html).alias("html"))


def code_pages(spark: SparkSession, folder: str) -> DataFrame:
    """One card page per part; parts of size 19 have no series, of size 20 no number."""
    html = """concat('<h1>card</h1>',
        if(p_size = 19, '', concat('<img class="x img-regulation" src="r.png" alt=" ', p_brand, ' ">')), '<p>',
        if(p_size = 20, 'none', concat(lpad(p_partkey % 1000, 3, '0'),
            case p_size % 3 when 0 then '&nbsp;/&nbsp;' when 1 then ' / ' else '/ ' end, '100')), '</p>')"""
    keys = [F.expr("cast(p_partkey as string) as card_id")]
    return select_once(spread_table(spark, folder, "part"), keys, F.expr(html).alias("html"))


# ---- documents -------------------------------------------------------------------------------------------------------


def event_documents(spark: SparkSession, folder: str) -> DataFrame:
    """One nested event document per order with up to five results."""
    result = """named_struct('rank', concat(i, '位'), 'points', cast(null as string),
        'player_name', concat('p"', i, '\\n'), 'player_id', if(i = 2, '', cast(o_custkey % 50 + i as string)),
        'player_area', o_orderpriority, 'deck_url', '', 'deck_id', concat('D', o_orderkey))"""
    results_sql = f"if(o_custkey % 6 = 0, array(), transform(sequence(1, cast(o_custkey % 6 as int)), i -> {result}))"
    return spread_table(spark, folder, "orders").selectExpr(
        "concat('u/', o_orderkey) as event_url", "cast(o_orderkey as string) as event_id", "o_orderpriority as event_title",
        "date_format(o_orderdate, 'yyyy-MM-dd') as event_date", "concat('Host ', o_custkey % 20) as event_host",
        "'' as event_address", "o_orderstatus as event_location",
        f"{results_sql} as results",
        "date_format(o_orderdate, 'yyyy') as event_year",
    )


def supplier_event_documents(spark: SparkSession, folder: str) -> DataFrame:
    """One event document per supplier as ``event, value``, of zero to three results."""
    result = """named_struct('rank', concat(i, '位'), 'points', '', 'player_name', s_name, 'player_id', cast(i as string),
        'player_area', '', 'deck_url', '', 'deck_id', concat('S', s_suppkey, '-', i))"""
    document = f"""named_struct('event_url', concat('u/', s_suppkey), 'event_id', cast(s_suppkey as string),
        'event_title', s_name, 'event_date', if(s_suppkey % 3 = 0, '', '2025-01-02'), 'event_host', '', 'event_address', '',
        'event_location', '', 'results', slice(transform(sequence(1, 3), i -> {result}), 1, cast(s_suppkey % 4 as int)))"""
    return table(spark, folder, "supplier").selectExpr("s_suppkey as event", f"to_json({document}) as value")


def supplier_deck_documents(spark: SparkSession, folder: str) -> DataFrame:
    """One deck document per supplier as ``deck, value``; every fifth is cut off in the middle, every seventh blank."""
    document = """to_json(named_struct('deck_url', '', 'deck_id', concat('S', s_suppkey), 'deck_code', s_name,
        'cards', array(named_struct('card_id', cast(s_suppkey as string), 'card_name', s_name, 'card_code', '',
                                    'quantity', s_nationkey, 'image_url', ''))))"""
    value = f"""case when s_suppkey % 7 = 0 then '' when s_suppkey % 5 = 0 then left({document}, 30) else {document} end"""
    return table(spark, folder, "supplier").selectExpr("s_suppkey as deck", f"{value} as value")


def supplier_code_objects(spark: SparkSession, folder: str) -> DataFrame:
    """One JSON object of two codes per supplier as ``part, value``."""
    pairs = "map(cast(s_suppkey as string), s_name, concat('n', s_nationkey), concat('N ', s_nationkey))"
    return table(spark, folder, "supplier").selectExpr("s_suppkey as part", f"to_json({pairs}) as value")


def order_listing(spark: SparkSession, folder: str) -> DataFrame:
    """One listing page per order; every ninth was landed twice."""
    link = "concat('<a href=\"/event/detail/', o_orderkey, '/result\">e</a>') as html"
    pages = spread_table(spark, folder, "orders").selectExpr("cast(o_orderkey + 1 as int) as page_no", link)
    return pages.unionByName(pages.where("page_no % 9 = 0"))


def landed_event_pages(spark: SparkSession, folder: str) -> DataFrame:
    """:func:`event_pages`, some landed twice, some events without a date."""
    dated = event_pages(spark, folder).withColumn(
        "html",
        F.when(F.endswith("event_url", F.lit("7/result")), F.regexp_replace("html", '(class="date-day">)[^<]*', "$1")).otherwise(
            F.col("html")
        ),
    )
    return dated.unionByName(dated.where(F.rlike("event_url", F.lit("[05]/result$"))))


def order_deck_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Deck pages of the results of :func:`event_pages`; every tenth event lacks those of its second places."""
    paged = spread_table(spark, folder, "orders").selectExpr("o_orderkey", "explode(sequence(1, cast(1 + o_custkey % 3 as int))) as p")
    decks_of = paged.selectExpr("o_orderkey", "p", "explode(array(1, 2)) as j").where("o_orderkey % 10 <> 3 or j = 1")
    html = """'<input id="deck_a" value="1_2_1"><script>PCGDECK.searchItemName[1]=\\'n(C 001/002)\\';</script>' as html"""
    return decks_of.selectExpr("concat('D', o_orderkey, '-', p, '-', j) as deck_id", html)
