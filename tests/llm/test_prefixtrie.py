import hashlib
import random
import zlib

import pytest

from cardloom.llm import prefixtrie
from tests.llm.helpers import ODD_TEXTS, SPACED, empty, frame, prose, vocabulary

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    """Every node by going through all beginnings of all rebuilt conversations."""
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn is not None, turn or 0, (role or "").encode(), (text or "").encode()))
    own = {c: [x[2:] for x in sorted(t)] for c, t in own.items()}
    made = {}
    for conv, turns in own.items():
        h = zlib.crc32(str(conv).encode()) % 4
        first = conv - (abs(conv) % 20) * (1 if conv >= 0 else -1)
        made[conv] = tuple(own.get(first, [])[:h]) + tuple(turns[h:])
    members, children = {}, {}
    for conv, turns in made.items():
        for d in range(len(turns) + 1):
            members.setdefault(turns[:d], []).append(conv)
            if d:
                children.setdefault(turns[: d - 1], set()).add(turns[:d])

    def below(node):
        words = len(SPACED.findall(node[-1][1].decode())) if node else 0
        leaves, saved = int(node not in children), (len(members[node]) - 1) * words
        for child in children.get(node, ()):
            more, words = below(child)
            leaves, saved = leaves + more, saved + words
        return leaves, saved

    out = []
    for node, convs in members.items():
        leaves, saved = below(node)
        ends = ",".join(str(c) for c in sorted(convs) if made[c] == node)
        parent = min(members[node[:-1]]) if node else None
        out.append((min(convs), len(node), parent, len(convs), len(children.get(node, ())), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(map(str, out))


def check(spark, rows, **sizes):
    found = prefixtrie.conversation_trie(frame(spark, rows, SCHEMA), **sizes).collect()
    assert sorted(str(tuple(r)) for r in found) == brute(rows)


def corpus(seed, conversations, words=3):
    draw, known = random.Random(seed), vocabulary(seed, 40)[:words]
    rows = []
    for conv in range(conversations):
        for turn in range(draw.choice((1, 2, 3, 5, 9))):
            rows.append((conv, turn, draw.choice(("user", "assistant")) if turn > 1 else "user", prose(draw, known, draw.choice((1, 1, 1, 2)))))
    return rows


@pytest.mark.parametrize("first, growth", [(1000, 2), (3, 3)])
def test_equals_brute_force(spark, first, growth):
    check(spark, corpus(first, 120), first=first, growth=growth)


def test_batches_cut_edges_at_several_places(spark):
    long = [(100, t, "user", f"word{t} x") for t in range(40)]
    parts = [(101 + n, t, "user", f"word{t} x") for n in range(30) for t in range(4 + n)]
    check(spark, long + parts, first=2, growth=2)


def test_odd_rows_and_copies(spark):
    rows = [(None, 1, "user", "no conversation"), (None, None, None, None), (5, None, None, None), (5, None, None, None)]
    rows += [(i, i % 3 if i % 4 else None, None if i % 2 else "user", t) for i in (0, 7, 20, 21, 22, -5, -40) for t in ODD_TEXTS]
    rows += [(c, t, "user", f"the same {t}") for c in range(1000, 1300) for t in range(5)]
    check(spark, rows, first=4, growth=2)


def test_ids_in_many_pieces(spark):
    rows = [(c * 20, 0, "user", "hello") for c in range(9500)]
    found = {r.depth: r for r in prefixtrie.conversation_trie(frame(spark, rows, SCHEMA)).collect()}
    ids = ",".join(str(c * 20) for c in range(9500))
    assert found[1].ends_sha256 == hashlib.sha256(ids.encode()).hexdigest() and found[1].n_convs == 9500 and len(found) == 2


def test_empty(spark):
    assert prefixtrie.conversation_trie(empty(spark, SCHEMA)).count() == 0
    assert prefixtrie.conversation_trie(frame(spark, [(None, 1, "user", "x")], SCHEMA)).count() == 0


def test_fattest(spark):
    pairs = [(a, b) for a in range(0, 40) for b in range(a + 1, 41)]
    table = spark.createDataFrame(pairs, "a int, b int")
    for a, b, f in table.select("a", "b", prefixtrie.fattest(table.a, table.b)).collect():
        assert f == max(range(a + 1, b + 1), key=lambda x: x & -x)
