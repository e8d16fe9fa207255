import hashlib
import random

import pytest

from cardloom.llm import substrings
from tests.llm.helpers import empty, frame, odd_rows, prose, vocabulary


def expected(rows):
    """Rows in the order of the operator: id, null first; equal rows are one document."""
    seen, out = {}, {}
    for doc, text in sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0)):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - 99):
            if seen.setdefault(data[i : i + 100], (doc, i)) != (doc, i):
                gone[i : i + 100] = b"\1" * 100
        left = bytes(b for b, g in zip(data, gone, strict=True) if not g)
        spans = sum(g and not before for g, before in zip(gone, b"\0" + bytes(gone), strict=False))
        out[doc, text] = (len(data), sum(gone), spans, hashlib.sha256(left).hexdigest())
    return out


def corpus():
    draw, words = random.Random(8), vocabulary(8)
    passage = prose(draw, words, 60)
    rows = [(0, passage), (1, passage), (1, passage), (2, "ab" * 150), (3, "é" * 130), (4, "x" * 99), (5, "x" * 100), (None, passage)]
    for i in range(40):
        low = draw.randrange(len(passage))
        cut = passage[low : low + draw.choice((50, 99, 100, 101, 130, 400))]
        rows.append((10 + i, prose(draw, words, draw.randint(0, 60)) + cut + prose(draw, words, draw.randint(0, 30)) + cut))
    return rows


@pytest.mark.parametrize("batches,together", [(4, 10_000), (1, 0), (7, 3)])
def test_against_brute_force(spark, batches, together):
    rows = corpus()
    found = substrings.substring_report(frame(spark, rows), batches, together).collect()
    wanted = expected(rows)
    assert sorted(map(str, map(tuple, found))) == sorted(str((doc, *wanted[doc, text])) for doc, text in rows)


def test_odd_rows_and_what_is_left(spark):
    rows = odd_rows()
    found = {r.doc_id: bytes(r.kept) for r in substrings.without_repeats(frame(spark, rows)).collect() if r.doc_id in range(6)}
    assert found[5] == "é ü 漢字 🎉".encode() and found[0] == found[1] == b""
    assert substrings.substring_report(empty(spark)).count() == 0


def test_long_text_in_pieces(monkeypatch):
    draw = random.Random(9)
    text = prose(draw, vocabulary(9), 800).encode()
    data = text + b"!" + text
    whole = substrings.anchors(data)
    monkeypatch.setattr(substrings, "_PIECE", 300)
    pieces = substrings.anchors(data)
    assert sum(pieces[3]) >= sum(whole[3]) and len(pieces[0]) >= len(whole[0])


def test_levels_merge_geometrically(spark):
    index = substrings.SuffixIndex()
    schema = "gram long, stretch long, key long, part long, place long"
    for i in range(7):
        index.add(spark.createDataFrame([(i % 3, i % 3, i, 0, 5), (i, i + 100, i, 0, 9)], schema))
    assert [size for size, _ in index.levels] == [4, 2, 1]
    found = {(r.gram, r.stretch): r.key for r in index.suffixes().collect()}
    assert found == {**{(i, i): i for i in range(3)}, **{(i, i + 100): i for i in range(7)}}
