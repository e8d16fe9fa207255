import random
import zlib

import duckdb
import numpy as np

from cardloom.llm import crossparse
from tests.llm.helpers import ODD_TEXTS, empty, frame, prose, vocabulary

SCHEMA = "doc_id long, text string, lang string"


def greedy(text, known):
    """Phrases of the longest matches with any substring of the labelled text, one letter at least."""
    count = at = 0
    while at < len(text):
        end = at + 1
        while end < len(text) and text[at : end + 1] in known:
            end += 1
        count, at = count + 1, end
    return count


def plain(text):
    return "".join(chr(p) if p else " " for p in crossparse.letters_and_gaps(text)[0])


def test_phrases_equal_brute_force():
    draw = random.Random(5)
    sample = {"a": ["abracadabra abba", "cab"], "b": ["the theory of thieves", "é漢 ß"], "c": ["x"]}
    symbol = crossparse.alphabet_of(sample)
    parser = crossparse.CrossParser(symbol, {k: crossparse.language_tables(v, symbol) for k, v in sample.items()})
    texts = ["".join(draw.choice("abcrdthe ofié漢zß") for _ in range(draw.randint(0, 60))) for _ in range(200)] + ["abracadabra abba"]
    got = parser.phrases([symbol[crossparse.letters_and_gaps(t)[0]] for t in texts])
    for row, name in enumerate(parser.names):
        known = "".join(plain(t) + " " for t in sample[name])
        assert got[row].tolist() == [greedy(plain(t), known) for t in texts]


def test_packed_automaton_keeps_every_move():
    draw = np.random.default_rng(3)
    moves = crossparse.suffix_automaton(draw.integers(1, 30, 3000).tolist())
    base, table = crossparse.packed(moves)
    for state, to in enumerate(moves[1:], 1):
        for symbol in range(1, 31):
            cell = int(table[base[state] + symbol]) if base[state] + symbol < len(table) else 0
            assert (cell & 0xFFFFFFFF if cell >> 32 == state else None) == to.get(symbol)


def test_long_text_is_parsed_to_its_end():
    sample = {"a": ["aaaaab bbbbba"], "b": ["cccccd ddddc"]}
    symbol = crossparse.alphabet_of(sample)
    parser = crossparse.CrossParser(symbol, {k: crossparse.language_tables(v, symbol) for k, v in sample.items()})
    begin = "aaaaab " * 2000
    assert next(parser.predict([begin]))[0] == "a" and next(parser.predict([begin + "cccccd " * 6000]))[0] == "b"


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    rows = {r.doc_id: r for r in crossparse.languages_of(spark.read.parquet(f"{folder}/documents.parquet")).collect()}
    truth = duckdb.sql(f"SELECT doc_id, lang FROM '{folder}/documents.parquet'").fetchall()
    assert len(rows) == len(truth) and all(rows[d].held_out == (zlib.crc32(str(d).encode()) % 4 == 2) for d, _ in truth)
    judged = [rows[d].lang_pred == lang for d, lang in truth if rows[d].held_out]
    assert sum(judged) / len(judged) > 0.97 and all(0 <= r.score <= 1 for r in rows.values())


def test_labels_of_held_out_rows_and_other_columns_do_not_matter(spark):
    draw, words = random.Random(9), {lang: vocabulary(n) for n, lang in enumerate(("aa", "bb"))}
    rows = [(i, prose(draw, words[lang], 40), lang) for i in range(120) for lang in [draw.choice(("aa", "bb"))]]
    turned = [(d, t, "bb" if zlib.crc32(str(d).encode()) % 4 == 2 else lang) for d, t, lang in rows]
    first, second = (sorted(map(tuple, crossparse.languages_of(frame(spark, r, SCHEMA)).collect())) for r in (rows, turned))
    assert first == second and {f[2] for f in first} == {"aa", "bb"}


def test_odd_rows(spark):
    rows = [(i, t, "xx") for i, t in enumerate(ODD_TEXTS)] + [(None, "word word", None), (None, "12 34 !?", "yy"), (3, "word", "xx"), (3, "word", "xx")]
    rows += [(50, "mot" * 50_000, "yy"), (51, "mot mot", None)]
    found = crossparse.languages_of(frame(spark, rows, SCHEMA)).collect()
    assert len(found) == len(rows)
    by = {r.doc_id: r for r in found}
    assert all((by[i].lang_pred, by[i].score) == ("und", 0.0) for i in (0, 1, 2)) and by[51].lang_pred == "yy"
    nothing = crossparse.languages_of(frame(spark, [(1, "word", None), (2, None, "xx")], SCHEMA)).collect()
    assert {r.lang_pred for r in nothing} == {"und"}
    assert crossparse.languages_of(empty(spark, SCHEMA)).count() == 0
