import random
import re
from collections import Counter

import duckdb
import pyarrow as pa
import pytest

from cardloom.llm import divergence
from tests.llm.helpers import ODD_TEXTS, empty, frame, lowered, prose, vocabulary

SCHEMA = "doc_id long, text string, lang string, source string"
COLUMNS = ["lang", "source", "part", "item", "value", "rank"]


def brute(rows, least=10, top=10):
    texts = [(lang or "", source or "", Counter(re.findall(divergence.TERM, lowered(text)))) for _, text, lang, source in rows]
    out = []
    for lang in {t[0] for t in texts}:
        own = [t for t in texts if t[0] == lang]
        holding = Counter(term for _, _, c in own for term in c)
        kept = {term for term, n in holding.items() if n >= least}
        groups = {}
        for _, source, counts in own:
            groups.setdefault(source, Counter()).update({t: n for t, n in counts.items() if t in kept})
        everything = sum(groups.values(), Counter())
        share = lambda c, t: 1 + 10**9 * (c[t] + 2) // (sum(c.values()) + 2 * len(kept))
        apart = lambda p, q: (p - q) ** 2 // (p + q)
        for source, counts in groups.items():
            pairs = [(sum(apart(share(counts, t), share(c, t)) for t in kept), o) for o, c in groups.items() if o != source]
            terms = [(apart(share(counts, t), share(everything, t)), t) for t in kept if counts[t] and share(counts, t) > share(everything, t)]
            for part, items, limit in (("pair", pairs, None), ("term", terms, top)):
                items = sorted(items, key=lambda x: (-x[0], x[1].encode()))[:limit]
                out += [(lang, source, part, item, value, rank) for rank, (value, item) in enumerate(items, 1)]
    return sorted(map(str, out))


def check(spark, rows, **sizes):
    found = divergence.divergence_audit(frame(spark, rows, SCHEMA), **sizes).select(COLUMNS).collect()
    wanted = brute(rows)
    assert sorted(str(tuple(r)) for r in found) == wanted and wanted
    oracle = duckdb.connect()
    oracle.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR)")
    oracle.executemany("INSERT INTO documents VALUES (?, ?, ?, ?)", rows)
    assert sorted(map(str, oracle.execute(f"SELECT {', '.join(COLUMNS)} FROM ({divergence.AUDIT_SQL})").fetchall())) == wanted


def corpus(seed):
    draw, words = random.Random(seed), vocabulary(seed, 60)
    rows = []
    for i in range(250):
        source = "big" if i % 3 else draw.choice(["a", "Z", "é", None, ""])
        text = prose(draw, words[: 30 if source == "big" else 60], draw.randint(0, 25))
        # one term in several chunks of the same document and of others
        text = "".join(draw.choice(("", ", ", " '", "-")) + w.title() * draw.randint(0, 1) + f" {w}." for w in text.split())
        rows.append((i, text, draw.choice(["xx", "xx", "yy", None]), source))
    return rows


@pytest.mark.parametrize("block", [50, 1 << 20])
def test_equals_brute_force_and_sql(spark, block):
    check(spark, corpus(block), block=block)


def test_documents_at_the_threshold(spark):
    # nine and ten documents, the term in chunks of which each is in few of them, and in two chunks of one document
    rows = [(i, f"nine{i} <nine> ten.{i} ten,", "xx", f"s{i % 2}") for i in range(9)]
    rows += [(10, "ten", "xx", "s0"), (11, "a-a b", "yy", "s0"), (11, "a-a b", "yy", "s0"), (None, None, "yy", None)]
    check(spark, rows)


def test_odd_rows(spark):
    rows = [(i, t, "xx", s) for i in range(12) for t in ODD_TEXTS for s in (None, "s")] + [(None, "word", None, None), (None, "word", None, None)]
    check(spark, rows)
    assert divergence.divergence_audit(empty(spark, SCHEMA)).count() == 0


def test_long_text_is_counted_whole():
    words = pa.array([[f"w{i % 1000}" for i in range(400_000)]])
    rows = pa.Table.from_batches(divergence.block_counts(pa.array(["xx"]), pa.array(["s"]), words, 7, 10))
    assert rows.num_rows == 1000 and set(rows["ns"].combine_chunks().flatten().to_pylist()) == {400}
    assert set(rows["ids"].combine_chunks().flatten().to_pylist()) == {7}
