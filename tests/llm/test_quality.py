import random
import re

import numpy as np

from cardloom.llm import quality
from tests.llm.helpers import SPACED, empty, frame, odd_rows, prose, vocabulary


def expected(text):
    text = text or ""
    words = SPACED.findall(text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    inside = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(5)}
    lines, seen, again = text.split("\n"), set(), 0
    for line in lines:
        if SPACED.search(line):
            again += line in seen
            seen.add(line)
    failed = len(words) < 10 or 100 * len(inside) > 20 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), again, len(inside), failed


def texts():
    draw, words = random.Random(3), vocabulary(3, 30)
    out = [prose(draw, words, n) for n in (0, 9, 10, 40, 80)]
    out += ["one two three four five six\n" * 3 + prose(draw, words, 30), "# * $ | <a> & %é " * 5]
    phrase = prose(draw, words, 12)
    return out + [phrase + " " + prose(draw, words, 12) + " " + phrase, prose(draw, words, 60) + "\n" + phrase]


def test_counts_equal_brute_force(spark):
    rows = [*odd_rows(), *((100 + i, text) for i, text in enumerate(texts()))]
    found = quality.repetition_report(frame(spark, rows)).collect()
    assert len(found) == len(rows)
    wanted = sorted((str(i), *expected(text)) for i, text in rows)
    assert sorted((str(r[0]), *r[1:7]) for r in found) == wanted
    assert not any(r.kept and r.base_failed for r in found)


def test_method_rejects_what_the_base_lets_pass():
    draw, words = random.Random(5), vocabulary(5)
    clean = prose(draw, words, 200)
    line = "extraordinarily longwinded repetition everywhere throughout"
    lines = "\n".join(prose(draw, ["a", "b", "of"], 7) if i % 5 else line for i in range(40))
    limits = quality.RepetitionLimits()
    assert quality.measure(clean.encode(), limits).kept
    found = quality.measure(lines.encode(), limits)
    assert found.dup_line_chars > limits.line_chars and not found.kept


def test_each_length_rejects_by_itself():
    from dataclasses import replace

    limits = quality.RepetitionLimits()
    assert list(limits.gram_chars.values()) == sorted(limits.gram_chars.values(), reverse=True)
    loose = replace(limits, gram_chars={}, top_chars={})
    for size in (2, 3, 4):  # half of the characters in one phrase among differing words
        text = " ".join(" ".join([f"buy{k}" for k in range(size)] + [f"w{i}x{k}" for k in range(size)]) for i in range(20))
        alone = replace(loose, top_chars={size: limits.top_chars[size]})
        found = quality.measure(text.encode(), limits)
        assert not found.base_failed and found.n_repeat_words == 0 and not found.kept
        assert not quality.measure(text.encode(), alone).kept and quality.measure(text.encode(), loose).kept
    for size in range(5, 11):  # one phrase of so many words twice, its share just above the limit of its length
        n = int(2 * size / (limits.gram_chars[size] + 0.005))
        phrase = " ".join(f"p{k:03}" for k in range(size))
        text = f"{phrase} {' '.join(f'q{i:03}' for i in range(n - 2 * size))} {phrase}"
        alone = replace(loose, gram_chars={size: limits.gram_chars[size]})
        assert not quality.measure(text.encode(), alone).kept and quality.measure(text.encode(), loose).kept
        assert not quality.measure(text.encode(), limits).kept
        others = {k: v for k, v in limits.gram_chars.items() if k != size}
        assert quality.measure(text.encode(), replace(loose, gram_chars=others)).kept
    assert quality._top_chars(*_grams("a a a a b", 2), 2, np.ones(5, dtype=int)) == 4


def _grams(text, size):
    from cardloom.llm import words as W

    grams = W.gram_hashes(W.word_hashes(text.encode()), size)
    return grams, W.seen_again(grams)


def test_long_text_in_pieces(monkeypatch):
    from cardloom.llm import words as W

    text = prose(random.Random(1), vocabulary(1), 5000).encode()
    whole = W.word_hashes(text)
    monkeypatch.setattr(W, "_PIECE", 100)
    assert (W.word_hashes(text) == whole).all() and len(whole) == 5000


def test_keep_good_has_all_columns(spark):
    draw = random.Random(2)
    rows = [(1, prose(draw, vocabulary(), 50)), (2, "short"), (None, prose(draw, vocabulary(), 50)), (4, None)]
    table = frame(spark, rows)
    kept = quality.keep_good(table)
    assert kept.columns == table.columns
    assert {r.doc_id for r in kept.collect()} == {1, None}
    assert quality.keep_good(empty(spark)).count() == quality.repetition_report(empty(spark)).count() == 0
