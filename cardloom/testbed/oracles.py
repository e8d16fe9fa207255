"""Expected outcome of every registered query as DuckDB SQL over the TESTDATA tables.

The SQL states what must come out straight from the tables. Where the Spark query parses pages or documents, the SQL
builds none: it repeats only the rule the page was made by.
"""

from __future__ import annotations

from cardloom.constants import HONG_KONG_BASE_URL, JAPAN_BASE_URL, PLAYERS_BASE_URL

RESULTS = """results AS (
    SELECT CAST(l_orderkey AS VARCHAR) AS event_id, strftime(o_orderdate, '%Y-%m-%d') AS event_date,
           l_linenumber AS pos, l_linenumber || '位' AS rank,
           CASE WHEN s_acctbal < 0 THEN '' ELSE CAST(l_suppkey AS VARCHAR) END AS player_id,
           s_name || '/' || l_returnflag AS player_name, n_name AS player_area,
           CASE WHEN l_linenumber = 7 THEN '' ELSE l_orderkey || '-' || l_partkey END AS deck_id
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey
         JOIN nation ON s_nationkey = n_nationkey)"""

STATS = f"""{RESULTS}, ranked AS (
    SELECT *, row_number() OVER (PARTITION BY player_id
              ORDER BY event_date DESC, event_id DESC, pos DESC, player_name DESC, player_area DESC) AS latest
    FROM results WHERE player_id <> ''),
stats AS (
    SELECT player_id, max(player_name) FILTER (latest = 1) AS player_name,
           max(player_area) FILTER (latest = 1) AS player_area, count(*) AS appearances,
           count(*) FILTER (rank = '1位') AS first_places
    FROM ranked GROUP BY player_id)"""

CARDS = """cards AS (
    SELECT CAST(l_orderkey AS VARCHAR) AS deck_id, l_linenumber AS pos, CAST(l_partkey AS VARCHAR) AS card_id,
           p_name AS card_name, CAST(l_quantity AS BIGINT) AS quantity,
           CASE WHEN p_size <= 5 THEN '  ' WHEN p_size <= 15 THEN '' ELSE p_brand END AS card_code
    FROM lineitem JOIN part ON l_partkey = p_partkey)"""

KEY_CARDS = f"""{CARDS}, per_name AS (
    SELECT deck_id, card_name, sum(quantity) AS copies, min(pos) AS first_pos FROM cards
    WHERE card_name NOT LIKE '%ring%' AND card_name NOT LIKE '%anvil%' GROUP BY deck_id, card_name),
key_cards AS (
    SELECT deck_id, card_name, CAST(copies AS BIGINT) AS copies, CAST(row_number() OVER (
               PARTITION BY deck_id ORDER BY copies DESC, first_pos, card_name) AS INTEGER) AS rank
    FROM per_name)"""

DECK_TOTALS = f"""{CARDS}, totals AS (
    SELECT deck_id, CAST(sum(quantity) AS BIGINT) AS copies, count(*) AS entries FROM cards GROUP BY deck_id),
decks AS (
    SELECT CAST(o_orderkey AS VARCHAR) AS deck_id, coalesce(copies, 0) AS copies, coalesce(entries, 0) AS entries
    FROM orders LEFT JOIN totals ON CAST(o_orderkey AS VARCHAR) = deck_id)"""

COUNTS = """counts AS (
    SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS event_id, o_orderstatus, count(l_orderkey) AS participants
    FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL)"""

# A card code is missing for parts of size 15 or less, white space codes included.
MISSING = f"{CARDS}, missing AS (SELECT * FROM cards WHERE trim(card_code) = '')"

CACHE = """cache AS (
    SELECT CAST(p_partkey AS VARCHAR) AS card_id, p_brand || ' ' || lpad(CAST(p_partkey % 1000 AS VARCHAR), 3, '0') || '/100'
           AS card_code FROM part WHERE p_type IN ('ECONOMY', 'LARGE'))"""

PAGE_CODES = """page_codes AS (
    SELECT CAST(p_partkey AS VARCHAR) AS card_id, CASE WHEN p_size NOT IN (19, 20) THEN p_brand || ' '
           || lpad(CAST(p_partkey % 1000 AS VARCHAR), 3, '0') || CASE WHEN p_size % 3 = 2 THEN '/ 100' ELSE '/100' END END
           AS card_code FROM part)"""

CODES = f"""{CACHE}, {PAGE_CODES}, codes AS (
    SELECT * FROM cache UNION ALL
    SELECT * FROM page_codes WHERE card_code IS NOT NULL AND card_id NOT IN (SELECT card_id FROM cache))"""

# Stored deck files: lineitems that were not returned; stored information: orders not in progress.
AUDIT = f"""{COUNTS}, stored AS (
    SELECT l_orderkey, count(*) AS actual FROM lineitem WHERE l_returnflag <> 'R' AND l_linenumber <> 7
    GROUP BY l_orderkey),
audit AS (
    SELECT o_orderkey, event_id, participants,
           CASE WHEN o_orderstatus <> 'P' THEN participants ELSE 0 END AS expected, coalesce(actual, 0) AS actual,
           CASE WHEN o_orderstatus = 'P' THEN CASE WHEN actual > 0 THEN 'no_info' ELSE 'absent' END
                WHEN actual >= participants AND actual > 0 THEN 'complete' ELSE 'partial' END AS status
    FROM counts LEFT JOIN stored ON o_orderkey = l_orderkey)"""

DAY = "(DATE '2020-01-01' + CAST(p_partkey % 3000 AS INTEGER))"

API = f"""api AS (
    SELECT CAST(p_partkey + 1 AS INTEGER) AS page_no, CAST(i AS INTEGER) AS pos, 'Japan' AS country,
           CASE WHEN i = 2 THEN '' ELSE p_type || ' ' END || p_name || ' ' || i AS product_name,
           CASE WHEN i = 0 AND p_size = 20 THEN '' ELSE floor(p_retailprice)::INTEGER || '円' END AS price,
           CASE i WHEN 2 THEN '' WHEN 3 THEN '未定' ELSE strftime({DAY}, '%Y-%m-%d') END AS release_date,
           CASE WHEN i < 2 THEN 'p' || p_partkey ELSE '' END AS code,
           CASE WHEN i % 2 = 0 THEN '{JAPAN_BASE_URL}/ex/' ELSE 'https://shop.example/' END || p_partkey AS link,
           CASE i WHEN 0 THEN '{JAPAN_BASE_URL}/products/images/p' || p_partkey || '.jpg'
                  WHEN 1 THEN 'https://img.example/x/images/p' || p_partkey || '.png'
                  WHEN 2 THEN '{JAPAN_BASE_URL}/other/p.jpg' ELSE '' END AS image_url,
           'line ' || i || '  box' AS include, '' AS card_only,
           CASE WHEN i = 2 THEN '' ELSE p_type END AS product_type,
           CASE i WHEN 0 THEN '' WHEN 1 THEN 'None' WHEN 2 THEN '0' ELSE '1' END AS beginner_flag,
           p_brand AS stores_available,
           CASE WHEN i = 0 THEN '{JAPAN_BASE_URL}/list/' || p_partkey ELSE '' END AS link_card_list,
           CASE WHEN i = 1 THEN 'https://pc.example/' || p_partkey ELSE '' END AS link_pokemon_center
    FROM part, range(4) AS r(i)
    WHERE i <= p_size % 4 AND p_size <> 13 AND NOT (i = 1 AND p_size % 7 = 0)
      AND p_partkey < (SELECT max(p_partkey) FROM part))"""

SITES = """bounds AS (SELECT max(p_partkey) AS m FROM part), reached AS (
    SELECT part.*, CASE WHEN p_partkey % 2 = 0 THEN 'en' ELSE 'zh' END AS site,
           CAST(p_partkey // 2 + 1 AS INTEGER) AS page_no
    FROM part, bounds
    WHERE CASE WHEN p_partkey % 2 = 0
               THEN p_partkey <= (SELECT min(p_partkey) FROM part WHERE p_partkey % 2 = 0 AND p_partkey >= m - m // 10)
               ELSE p_partkey < m - m // 20 END)"""

ITEMS = f"""{SITES}, items AS (
    SELECT site, page_no, CAST(i AS INTEGER) AS pos, p_size, p_partkey,
           CASE site WHEN 'en' THEN 'Hong Kong (EN)' ELSE 'Hong Kong (ZH)' END AS country,
           CASE i WHEN 0 THEN p_type || ' - ' || p_name || ' &' || i WHEN 1 THEN p_name || ' &' || i
                  ELSE p_type END AS product_name,
           CASE WHEN i < 2 THEN strftime({DAY}, '%Y-%m-%d') ELSE '' END AS release_date,
           CASE i WHEN 0 THEN 'P' || p_partkey WHEN 1 THEN 'Q' || p_partkey ELSE '' END AS code,
           CASE i WHEN 0 THEN '{HONG_KONG_BASE_URL}/hk/card-search/list/?expansionCodes=P' || p_partkey || '&x=1'
                  WHEN 1 THEN 'https://x.example/list?expansionCodes=Q' || p_partkey
                  ELSE '{HONG_KONG_BASE_URL}/hk/none' END AS link,
           CASE i WHEN 0 THEN '{HONG_KONG_BASE_URL}/img/' || p_partkey || '.png'
                  WHEN 1 THEN 'https://img.example/' || p_partkey || '.png' ELSE '' END AS image_url,
           'Yes' AS card_only,
           CASE site WHEN 'en' THEN 'hk-en' ELSE 'hk' END AS price_language,
           CASE WHEN i = 0 AND p_size % 8 < 6 THEN p_size || '元' ELSE '' END AS price
    FROM reached, range(3) AS r(i) WHERE i <= p_size % 4)"""

PRODUCTS = f"""{API}, {ITEMS}, products AS (
    SELECT 0 AS source_no, 0 AS site_no, * FROM api
    UNION ALL BY NAME
    SELECT 1 AS source_no, CASE site WHEN 'en' THEN 0 ELSE 1 END AS site_no, page_no, pos, country, product_name, price, release_date, code, link, image_url, '' AS include, card_only,
           '' AS product_type, '' AS beginner_flag, '' AS stores_available, '' AS link_card_list,
           '' AS link_pokemon_center FROM items)"""

LISTING = """links AS (
    SELECT event_id + 1 AS page_no, 0 AS pos, CAST(event_id + 1000000 AS VARCHAR) AS id FROM events
    WHERE event_id < (SELECT max(event_id) - max(event_id) // 10 FROM events)
    UNION ALL
    SELECT event_id + 1, CASE WHEN event_id < (SELECT max(event_id) - max(event_id) // 10 FROM events) THEN 2 ELSE 1 END,
           CAST(user_id AS VARCHAR) FROM events),
numbered AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY page_no, pos) AS n FROM links),
firsts AS (SELECT id AS event_id, CAST(page_no AS INTEGER) AS page_no, CAST(pos AS INTEGER) AS pos FROM numbered WHERE n = 1),
stop AS (SELECT min(event_id + 1) AS page FROM events WHERE event_id + 1 NOT IN (SELECT page_no FROM firsts)),
found AS (SELECT firsts.* FROM firsts, stop WHERE page IS NULL OR page_no < page)"""

EVENT_ROWS = """event_rows AS (
    SELECT *, CAST(1 + o_custkey % 3 AS INTEGER) AS pages, CAST(p AS INTEGER) AS page_no, CAST(j AS INTEGER) AS j
    FROM orders, range(1, 4) AS a(p), range(1, 4) AS b(j) WHERE p <= 1 + o_custkey % 3)"""

PLACE = "CASE o_orderstatus WHEN 'O' THEN 'L' WHEN 'F' THEN 'Caféあ' ELSE 'カードラボ' || o_custkey END"

CARD_ID = "(40000 + (o_custkey * 7 + i * 13) % 900)"

# Cards of the deck pages: card 4 has no name, and a broken quantity at card 3 ends the deck of an order in progress.
DECK_CARDS = f"""page_cards AS (
    SELECT 'D' || o_orderkey AS deck_id, 'C' || o_orderkey AS deck_code,
           CAST(i - CASE WHEN i > 4 THEN 1 ELSE 0 END AS INTEGER) AS pos, CAST({CARD_ID} AS VARCHAR) AS card_id,
           CASE i WHEN 1 THEN '基本エネルギー' WHEN 2 THEN 'plain ' || {CARD_ID} % 64 ELSE 'card ' || {CARD_ID} % 64 END AS card_name,
           CASE WHEN i IN (1, 2) THEN '' ELSE 'SET ' || lpad(CAST({CARD_ID} % 1000 AS VARCHAR), 3, '0') || '/100' END AS card_code,
           CAST(1 + (o_orderkey + i) % 4 AS INTEGER) AS quantity,
           CASE WHEN i % 2 = 0 THEN '{JAPAN_BASE_URL}/img/' || {CARD_ID} || '.jpg' ELSE '' END AS image_url
    FROM orders, range(6) AS r(i)
    WHERE i <= o_custkey % 6 AND i <> 4 AND NOT (o_orderstatus = 'P' AND i >= 3))"""

EVENT_DOCUMENTS = """document_results AS (
    SELECT CAST(o_orderkey AS VARCHAR) AS event_id, strftime(o_orderdate, '%Y-%m-%d') AS event_date,
           CAST(i - 1 AS INTEGER) AS pos, i || '位' AS rank, CAST(NULL AS VARCHAR) AS points,
           'p"' || i || chr(10) AS player_name, CASE WHEN i = 2 THEN '' ELSE CAST(o_custkey % 50 + i AS VARCHAR) END AS player_id,
           o_orderpriority AS player_area, '' AS deck_url, 'D' || o_orderkey AS deck_id, 'u/' || o_orderkey AS event_url
    FROM orders, range(1, 6) AS r(i) WHERE i <= o_custkey % 6)"""

TAG_TEXT = r"""replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace({0},
    '\s*(?:<!--(?s:.*?)-->|<script(?s:.*?)</script>|<style(?s:.*?)</style>|<[^>]+>)\s*', '', 'g'),
    '^\s+|\s+$', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', chr(34)), '&middot;', '·'), '&copy;', '©'), '&amp;', '&')"""

ORACLES: dict[str, str] = {
    "event_totals": f"""WITH {COUNTS} SELECT count(*) AS total_events, CAST(sum(participants) AS BIGINT) AS total_participants,
        round(sum(participants) / count(*), 1) AS avg_participants FROM counts""",
    "events_by_date": """SELECT strftime(o_orderdate, '%Y-%m-%d') AS event_date, count(*) AS event_count FROM orders
        JOIN customer ON o_custkey = c_custkey GROUP BY 1 ORDER BY 1 DESC LIMIT 10""",
    "events_in_range": """SELECT strftime(o_orderdate, '%Y-%m-%d') AS event_date, count(*) AS event_count FROM orders
        JOIN customer ON o_custkey = c_custkey WHERE o_orderdate >= DATE '1996-01-01' AND o_orderdate < DATE '1999-01-01'
        GROUP BY 1 ORDER BY 1 DESC LIMIT 10""",
    "stored_events_in_range": """SELECT strftime(o_orderdate, '%Y-%m-%d') AS event_date, count(*) AS event_count FROM orders
        JOIN customer ON o_custkey = c_custkey WHERE o_orderdate >= DATE '1996-01-01' AND o_orderdate < DATE '1999-01-01'
        GROUP BY 1""",
    "top_hosts": """SELECT left(c_name, 16) AS host, count(*) AS event_count FROM orders
        JOIN customer ON o_custkey = c_custkey GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""",
    "player_stats": f"WITH {STATS} SELECT * FROM stats",
    "player_appearances": f"""WITH {RESULTS} SELECT player_id, event_date, event_id, pos, rank, deck_id FROM results
        WHERE player_id <> ''""",
    "player_total": "SELECT count(DISTINCT l_suppkey) AS total_players FROM lineitem JOIN supplier ON l_suppkey = s_suppkey "
    "WHERE s_acctbal >= 0",
    "top_players": f"""WITH {STATS} SELECT CAST(row_number() OVER (ORDER BY appearances DESC, player_id) AS INTEGER) AS rank,
        player_id, player_name, player_area, appearances FROM stats ORDER BY appearances DESC, player_id LIMIT 20""",
    "first_places": f"""WITH {STATS} SELECT CAST(row_number() OVER (ORDER BY first_places DESC, player_id) AS INTEGER) AS rank,
        player_id, player_name, player_area, first_places FROM stats WHERE first_places > 0
        ORDER BY first_places DESC, player_id LIMIT 20""",
    "first_place_total": """SELECT count(DISTINCT l_suppkey) AS total_first_place_players FROM lineitem
        JOIN supplier ON l_suppkey = s_suppkey WHERE s_acctbal >= 0 AND l_linenumber = 1""",
    "deck_archetypes": f"""WITH {KEY_CARDS} SELECT card_name AS key_card, count(*) AS deck_count FROM key_cards WHERE rank = 1
        GROUP BY card_name ORDER BY 2 DESC, 1 LIMIT 20""",
    "deck_key_cards": f"WITH {KEY_CARDS} SELECT deck_id, rank, card_name, copies FROM key_cards WHERE rank <= 3",
    "card_usage": f"""WITH {CARDS} SELECT CASE WHEN card_code <> '' THEN card_name || ' (' || card_code || ')'
        ELSE card_name END AS card_key, CAST(sum(quantity) AS BIGINT) AS copies FROM cards
        GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 30""",
    "deck_size_stats": f"""WITH {DECK_TOTALS} SELECT count(*) AS total_decks, round(avg(entries), 1) AS avg_size,
        min(entries) AS min_size, max(entries) AS max_size, round(avg(entries), 1) AS avg_unique FROM decks""",
    "deck_card_totals": f"WITH {DECK_TOTALS} SELECT * FROM decks",
    "event_decks": f"""WITH {RESULTS}, per_order AS (
        SELECT CAST(l_orderkey AS VARCHAR) AS deck_id, count(*) AS entries FROM lineitem JOIN part ON l_partkey = p_partkey
        GROUP BY 1)
        SELECT r.event_id, r.pos, r.rank, d.deck_id, d.entries FROM results r JOIN per_order d ON r.event_id = d.deck_id
        WHERE r.deck_id <> ''""",
    "document_archetypes": f"""WITH {DECK_CARDS}, ranked AS (
        SELECT deck_id, card_name, row_number() OVER (PARTITION BY deck_id ORDER BY sum(quantity) DESC, min(pos)) AS n
        FROM page_cards WHERE card_name NOT LIKE '%エネルギー%' GROUP BY deck_id, card_name)
        SELECT card_name AS key_card, count(*) AS deck_count FROM ranked WHERE n = 1 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20""",
    "document_totals": f"""WITH {DECK_CARDS} SELECT 'D' || o_orderkey AS deck_id, CAST(coalesce(sum(quantity), 0) AS BIGINT)
        AS copies, count(card_id) AS entries FROM orders LEFT JOIN page_cards ON deck_id = 'D' || o_orderkey GROUP BY 1""",
    "norm_dates": """SELECT o_orderkey,
        CASE WHEN o_orderstatus = 'P' THEN '未定' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS jp_date,
        CASE WHEN o_orderstatus = 'O' THEN strftime(o_orderdate, '%Y-%m-%d') ELSE '' END AS event_date,
        strftime(o_orderdate, '%Y-%m-%d') AS hk_date FROM orders""",
    "url_code": "SELECT page_id, regexp_extract(url, 'page=([^&]*)', 1) AS code FROM pages",
    "split_name_code": """SELECT p_partkey, p_name || CASE p_size % 4 WHEN 2 THEN ' (x)' WHEN 3 THEN '()' ELSE '' END
        AS card_name, CASE WHEN p_size % 4 IN (1, 2) THEN p_brand ELSE '' END AS card_code FROM part""",
    "deck_file_names": f"""SELECT CAST(l_orderkey AS VARCHAR) AS event_id, l_orderkey || '-' || l_partkey AS deck_id,
        'deck_' || l_linenumber || CASE l_linenumber WHEN 1 THEN 'st' WHEN 2 THEN 'nd' WHEN 3 THEN 'rd' ELSE 'th' END || '_'
        || l_orderkey || '-' || l_partkey || '.json' AS deck_file,
        '{PLAYERS_BASE_URL}/event/detail/' || l_orderkey || '/result' AS event_url,
        '{JAPAN_BASE_URL}/deck/confirm.html/deckID/' || l_orderkey || '-' || l_partkey AS deck_url
        FROM lineitem WHERE l_linenumber <> 7""",
    "api_products": f"WITH {API} SELECT * FROM api",
    "catalog_pages_until_terminal": f"WITH {SITES} SELECT site, page_no FROM reached",
    "catalog_items": f"""WITH {ITEMS} SELECT site, page_no, pos, country, product_name, release_date, code, link, image_url,
        card_only FROM items""",
    "price_enrich": f"WITH {ITEMS} SELECT page_no, pos, price_language, code, price FROM items",
    "products_union_sorted": f"""WITH {PRODUCTS}, keyed AS (
        SELECT CASE release_date WHEN '' THEN '9999-12-31' ELSE release_date END AS sort_key, * FROM products)
        SELECT * EXCLUDE (source_no, site_no, page_no, pos),
        row_number() OVER (ORDER BY sort_key DESC, source_no, site_no, page_no, pos) AS position FROM keyed""",
    "missing_codes": f"""WITH {MISSING} SELECT card_id, max(card_name) AS card_name, count(*) AS occurrences FROM missing
        GROUP BY card_id""",
    "missing_code_files": f"WITH {MISSING} SELECT card_id, 'deck_' || deck_id || '.json' AS deck_file FROM missing",
    "missing_codes_preview": f"""WITH {MISSING}, per_card AS (
        SELECT card_id, max(card_name) AS card_name, count(*) AS occurrences FROM missing GROUP BY card_id)
        SELECT CAST(row_number() OVER (ORDER BY card_id) AS INTEGER) AS position, *,
        greatest((SELECT count(*) FROM per_card) - 10, 0) AS more FROM per_card ORDER BY card_id LIMIT 10""",
    "cache_status": f"""WITH {MISSING}, {CACHE}, ids AS (SELECT DISTINCT card_id FROM missing)
        SELECT count(*) AS total, count(cache.card_id) AS cached, count(*) - count(cache.card_id) AS to_fetch
        FROM ids LEFT JOIN cache ON ids.card_id = cache.card_id""",
    "codes_to_fetch": f"""WITH {MISSING}, {CACHE} SELECT DISTINCT card_id FROM missing
        WHERE card_id NOT IN (SELECT card_id FROM cache)""",
    "card_code_extract": f"WITH {PAGE_CODES} SELECT * FROM page_codes",
    "code_cache_upsert": f"WITH {CODES} SELECT * FROM codes",
    "backfill_codes": f"""WITH {CARDS}, {CODES} SELECT deck_id, pos, cards.card_id,
        CASE WHEN trim(cards.card_code) = '' THEN coalesce(codes.card_code, cards.card_code) ELSE cards.card_code END AS card_code,
        trim(cards.card_code) = '' AND codes.card_code IS NOT NULL AS filled
        FROM cards LEFT JOIN codes ON cards.card_id = codes.card_id""",
    "backfill_report": f"""WITH {MISSING}, {CODES} SELECT count(DISTINCT missing.card_id) AS cards_updated,
        count(DISTINCT deck_id) AS files_updated FROM missing JOIN codes ON missing.card_id = codes.card_id""",
    "backfill_documents": f"""WITH {DECK_CARDS}, {CODES}, known AS MATERIALIZED (
        SELECT CAST(CAST(card_id AS BIGINT) + 40000 AS VARCHAR) AS card_id, card_code AS new_code FROM codes),
        joined AS MATERIALIZED (SELECT page_cards.*, new_code FROM page_cards LEFT JOIN known ON page_cards.card_id = known.card_id)
        SELECT deck_id, pos, card_id, CASE WHEN card_code = '' THEN coalesce(new_code, '') ELSE card_code END AS card_code
        FROM joined WHERE deck_id IN (SELECT deck_id FROM joined WHERE card_code = '' AND new_code IS NOT NULL)""",
    "discover_ids": f"""WITH {LISTING} SELECT CAST(row_number() OVER (ORDER BY page_no, pos) AS INTEGER) AS position, event_id
        FROM found ORDER BY page_no, pos LIMIT 100""",
    "discover_all_ids": f"WITH {LISTING} SELECT event_id, page_no, pos FROM found",
    "ingest_audit": f"WITH {AUDIT} SELECT event_id, expected, actual, status FROM audit",
    "ingest_candidates": f"""WITH {AUDIT} SELECT CAST(row_number() OVER (ORDER BY o_orderkey) AS INTEGER) AS position, event_id,
        status FROM audit WHERE status <> 'complete' AND (status = 'partial' OR participants > 0)
        ORDER BY o_orderkey LIMIT 50""",
    "missing_decks": """SELECT CAST(l_orderkey AS VARCHAR) AS event_id, l_linenumber || '位' AS rank,
        l_orderkey || '-' || l_partkey AS deck_id FROM lineitem l WHERE l_linenumber <> 7 AND NOT EXISTS (
        SELECT 1 FROM lineitem s WHERE s.l_returnflag <> 'R' AND s.l_orderkey = l.l_orderkey
        AND s.l_linenumber = l.l_linenumber AND s.l_partkey = l.l_partkey)""",
    "page_text": f"SELECT page_id, {TAG_TEXT.format('html')} AS text FROM pages",
    "page_header": f"""SELECT page_id,
        {TAG_TEXT.format("regexp_extract(html, '<title>((?s:.*?))</title>', 1)")} AS title,
        {TAG_TEXT.format("regexp_extract(html, '<h1>((?s:.*?))</h1>', 1)")} AS h1,
        regexp_extract(html, '<html lang="([^"]*)"', 1) AS lang FROM pages""",
    "page_links": """WITH tags AS (SELECT page_id, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS hrefs FROM pages)
        SELECT page_id, CAST(unnest(range(len(hrefs))) AS INTEGER) AS pos, replace(unnest(hrefs), '&amp;', '&') AS href
        FROM tags""",
    "event_headers": f"""SELECT 'https://players.example/event/detail/' || o_orderkey || '/result' AS event_url,
        CAST(o_orderkey AS VARCHAR) AS event_id,
        CASE WHEN o_orderstatus = 'F' THEN 'Top' ELSE 'Cup' || o_orderpriority END AS event_title,
        strftime(o_orderdate, '%Y-%m-%d') AS event_date, 'Host ' || o_custkey AS event_host,
        '〒123-4567 City ' || o_custkey AS event_address,
        {PLACE} AS event_location FROM orders""",
    "event_result_rows": f"""WITH {EVENT_ROWS} SELECT CAST(o_orderkey AS VARCHAR) AS event_id, page_no,
        CAST(j - 1 AS INTEGER) AS pos, ((page_no - 1) * 3 + j) || '位' AS rank, (o_custkey % 100) || 'pt' AS points,
        'nama' || j AS player_name, CAST(o_custkey * 10 + j AS VARCHAR) AS player_id, o_orderpriority AS player_area,
        CASE WHEN j = 3 THEN '' ELSE 'https://deck.example/deck/confirm.html/deckID/D' || o_orderkey || '-' || page_no || '-'
             || j || '/x' END AS deck_url,
        CASE WHEN j = 3 THEN '' ELSE 'D' || o_orderkey || '-' || page_no || '-' || j END AS deck_id FROM event_rows""",
    "deck_cards": f"WITH {DECK_CARDS} SELECT * FROM page_cards",
    "flat_deck_cards": f"""WITH {DECK_CARDS} SELECT deck_id, card_name, quantity AS card_count,
        CASE WHEN card_code = '' THEN '' ELSE split_part(card_code, ' ', 2) END AS card_number,
        split_part(card_code, ' ', 1) AS set_name FROM page_cards""",
    "flat_deck_lists": f"""WITH {EVENT_DOCUMENTS} SELECT event_url, player_name, rank AS player_rank, '' AS deck_type, deck_url,
        'C' || event_id AS deck_code FROM document_results""",
    "flat_events": """SELECT o_orderpriority AS event_name, strftime(o_orderdate, '%Y-%m-%d') AS event_date,
        o_orderstatus AS event_location, 'u/' || o_orderkey AS event_url, '' AS event_type FROM orders""",
    "event_scan_roundtrip": """SELECT CAST(s_suppkey AS VARCHAR) AS event_id,
        CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE '2025-01-02' END AS event_date, s_name AS event_title,
        CAST(s_suppkey % 4 AS INTEGER) AS results, CAST(s_suppkey AS VARCHAR) AS folder FROM supplier""",
    "deck_scan_roundtrip": """SELECT 'S' || s_suppkey AS deck_id, CAST(s_suppkey AS VARCHAR) AS event_id,
        'deck=' || s_suppkey AS deck_file, CAST(s_suppkey AS VARCHAR) AS card_id, s_name AS card_name, '' AS card_code,
        CAST(s_nationkey AS INTEGER) AS quantity, '' AS image_url FROM supplier WHERE s_suppkey % 5 <> 0 AND s_suppkey % 7 <> 0""",
    "deck_scan_tolerant": """SELECT 'deck=' || s_suppkey AS deck_file,
        CASE WHEN s_suppkey % 5 = 0 OR s_suppkey % 7 = 0 THEN 'rejected' ELSE 'read' END AS state FROM supplier""",
    "code_cache_scan": """SELECT CAST(s_suppkey AS VARCHAR) AS card_id, s_name AS card_code FROM supplier
        UNION SELECT 'n' || s_nationkey, 'N ' || s_nationkey FROM supplier""",
    "products_csv_roundtrip": f"WITH {PRODUCTS} SELECT * EXCLUDE (source_no, site_no, page_no, pos) FROM products",
    "event_counts_by_date": """SELECT strftime(o_orderdate, '%Y-%m-%d') AS event_date, count(*) AS event_count FROM orders
        JOIN customer ON o_custkey = c_custkey GROUP BY 1""",
    "host_counts": """SELECT c_name AS host, count(*) AS event_count FROM orders JOIN customer ON o_custkey = c_custkey
        GROUP BY 1""",
    "card_copies": f"""WITH {CARDS} SELECT CASE WHEN card_code <> '' THEN card_name || ' (' || card_code || ')'
        ELSE card_name END AS card_key, CAST(sum(quantity) AS BIGINT) AS copies FROM cards GROUP BY 1""",
    "archetype_counts_all": f"""WITH {KEY_CARDS} SELECT card_name AS key_card, count(*) AS deck_count FROM key_cards
        WHERE rank = 1 GROUP BY card_name""",
    "ingest_all_candidates": f"""WITH {AUDIT} SELECT o_orderkey AS position, event_id, status FROM audit
        WHERE status <> 'complete' AND (status = 'partial' OR participants > 0)""",
    "ingest_run": f"""SELECT CAST(o_orderkey AS VARCHAR) AS event_id,
        CASE WHEN o_orderkey % 10 = 7 THEN '' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS event_date,
        {PLACE} AS event_location,
        3 * (1 + o_custkey % 3) AS expected, 2 * (1 + o_custkey % 3) AS expected_named, 3 * (1 + o_custkey % 3) AS results,
        CASE WHEN o_orderkey % 10 = 3 THEN 1 ELSE 2 END * (1 + o_custkey % 3) AS decks FROM orders""",
    "backfill_run": f"""WITH {DECK_CARDS}, {CODES}, known AS MATERIALIZED (
        SELECT CAST(CAST(card_id AS BIGINT) + 40000 AS VARCHAR) AS card_id, card_code AS new_code FROM codes)
        SELECT deck_id, pos, page_cards.card_id,
        CASE WHEN card_code = '' THEN coalesce(new_code, '') ELSE card_code END AS card_code
        FROM page_cards LEFT JOIN known ON page_cards.card_id = known.card_id""",
    "decoded_references": """SELECT page_id, 'éああ…&lt;&none; ' || replace(url, '&amp;', '&') AS text FROM pages""",
    "event_lines_roundtrip": f"WITH {EVENT_DOCUMENTS} SELECT * EXCLUDE (event_url) FROM document_results",
    "deck_lines_roundtrip": f"WITH {DECK_CARDS} SELECT * EXCLUDE (deck_code) FROM page_cards",
    "deck_lines_tolerant": """SELECT 'D' || o_orderkey AS deck_id,
        CASE WHEN contains(CAST(o_orderkey AS VARCHAR), '7') THEN 'rejected' ELSE 'read' END AS state FROM orders""",
    "code_cache_lines": f"WITH {CACHE} SELECT * FROM cache",
}
ORACLES["code_cache_appended"] = ORACLES["code_cache_upsert"]
# A state that is kept up to date gives what the whole run gives.
for _report in ("host_counts", "player_stats", "document_archetypes"):
    ORACLES[f"standing_{_report}"] = ORACLES[_report]
