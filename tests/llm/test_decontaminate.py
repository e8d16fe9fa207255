import hashlib
import random
import re

import pytest

from cardloom.llm import decontaminate
from tests.llm.helpers import empty, frame, lowered, odd_rows, prose, vocabulary

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ITEM = "item_id long, text string"


def expected(rows, items):
    windows = {}
    for item, text in items:
        words = WORD.findall(lowered(text))
        size = min(13, len(words))
        for i in range(len(words) - size + 1 if size else 0):
            windows.setdefault(tuple(words[i : i + size]), set()).add(item)
    out = []
    for doc, text in rows:
        words, hit, met = WORD.findall(lowered(text)), set(), set()
        for size in {len(w) for w in windows}:
            for i in range(len(words) - size + 1):
                if tuple(words[i : i + size]) in windows:
                    hit |= set(range(i, i + size))
                    met |= windows[tuple(words[i : i + size])]
        names = ",".join(sorted(str(x) for x in met if x is not None))
        sha = hashlib.sha256(names.encode()).hexdigest()
        n = len(met - {None})
        out.append((doc, len(words), len(hit), n, sha, len(hit) > 0 and 20 * len(hit) >= len(words)))
    return sorted(map(str, out))


def corpus():
    draw, words = random.Random(7), vocabulary(7)
    items = [(i, prose(draw, words, n)) for i, n in enumerate((60, 13, 14, 12, 5, 2, 1, 40))]
    items += [(20, items[0][1]), (21, None), (22, "..."), (None, items[7][1]), (1, items[2][1])]
    rows = odd_rows()
    for i in range(60):
        item = items[draw.randrange(8)][1].split()
        cut = draw.randrange(len(item))
        part = " ".join(item[cut : cut + draw.choice((5, 12, 13, 20, 60))])
        rows.append((100 + i, f"{prose(draw, words, draw.randint(0, 300))}-{part.upper()}; {prose(draw, words, draw.randint(0, 40))}"))
    return rows, items


@pytest.mark.parametrize("sent", [decontaminate.SENT, 0])
def test_against_brute_force(spark, sent):
    rows, items = corpus()
    found = decontaminate.contamination(frame(spark, rows), frame(spark, items, ITEM), sent).drop("text_key").collect()
    assert sorted(map(str, map(tuple, found))) == expected(rows, items)


def test_clean_rows_stay_with_all_columns(spark):
    rows, items = corpus()
    table = frame(spark, rows)
    kept = decontaminate.decontaminated(table, frame(spark, items, ITEM))
    clean = [eval(x)[0] for x in expected(rows, items) if x.endswith("False)")]
    assert kept.columns == table.columns and sorted(str(r.doc_id) for r in kept.collect()) == sorted(map(str, clean))


def test_empty_tables(spark):
    rows, items = corpus()
    found = decontaminate.contamination(frame(spark, rows), empty(spark, ITEM)).collect()
    assert len(found) == len(rows) and not any(r.n_hit for r in found)
    assert decontaminate.contamination(empty(spark), frame(spark, items, ITEM)).count() == 0
