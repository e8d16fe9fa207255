"""Language of a text by cross-parsing: the fewest phrases that a language's labelled text needs to say it.

A suffix automaton of labelled text knows all its substrings. A text is parsed greedily into longest matches with each
language's automaton; text of the same language falls into few long phrases, other text into many short ones.
"""

from __future__ import annotations

import math
import unicodedata
from collections.abc import Iterator, Sequence
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Documents whose excerpts a language is learned from, code points of an excerpt, languages (those of most documents).
SAMPLE, EXCERPT, LANGUAGES = 64, 512, 100
#: Bits that a phrase costs beside the choice of its place in the labelled text: its length, or a letter not seen there.
LENGTH_BITS = 8.0
#: How fast a language's share in the score falls with the bits it needs beyond the best one's.
SHARPNESS = 16.0
#: Code points that are parsed together: a text in pieces of this length, each started anew.
PIECE, BATCH = 1024, 1 << 21
#: Places tried for a state's transitions before they go to the end of the table.
TRIES = 64
UNKNOWN = "und"
_SPACE, _STRANGE, _FIRST = 0, 1, 2


@cache
def _kinds() -> np.ndarray:
    """2 for letters, 1 for marks that stand with letters, 0 for all other code points."""
    kinds = np.zeros(0x110000, dtype=np.uint8)
    for point in range(0x110000):
        category = unicodedata.category(chr(point))[0]
        kinds[point] = 2 if category == "L" else category == "M"
    return kinds


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le", "replace"), dtype=np.uint32)


def letters_and_gaps(text: str) -> tuple[np.ndarray, bool]:
    """Lower-case code points of a text, each run of other than letters as one 0, and whether there is a letter."""
    points = _points(text)
    kinds = _kinds()[points]
    points = np.where(kinds > 0, points, 0)
    return points[(points > 0) | (np.diff(points, prepend=1) != 0)], bool((kinds == 2).any())


def suffix_automaton(symbols: Sequence[int]) -> list[dict[int, int]]:
    """Transitions of each state of the automaton of all substrings; state 0 is the start."""
    moves, link, length, last = [{}], [-1], [0], 0
    for symbol in symbols:
        state = len(moves)
        moves.append({})
        length.append(length[last] + 1)
        link.append(0)
        at, last = last, state
        while at >= 0 and symbol not in moves[at]:
            moves[at][symbol] = state
            at = link[at]
        if at < 0:
            continue
        to = moves[at][symbol]
        if length[to] == length[at] + 1:
            link[state] = to
            continue
        copy = len(moves)
        moves.append(dict(moves[to]))
        length.append(length[at] + 1)
        link.append(link[to])
        link[to] = link[state] = copy
        while at >= 0 and moves[at].get(symbol) == to:
            moves[at][symbol] = copy
            at = link[at]
    return moves


def packed(moves: list[dict[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """The transitions in one array: that of a state by a symbol stands at the state's base plus the symbol.

    A cell holds its state and the next one, so a cell of another state is told apart. The start has none: a match that
    ends there begins a new phrase.
    """
    top = max((max(m) for m in moves if m), default=0) + 1
    several = sorted((s for s in range(1, len(moves)) if len(moves[s]) > 1), key=lambda s: -len(moves[s]))
    single = np.array([(s, *next(iter(moves[s].items()))) for s in range(1, len(moves)) if len(moves[s]) == 1], dtype=np.int64)
    room = top + sum(len(m) for m in moves) + (TRIES + 1) * top
    base, table, hole, end = np.zeros(len(moves), dtype=np.int64), np.zeros(room, dtype=np.int64), 0, 0
    taken = bytearray(room)
    for state in several:
        symbols = sorted(moves[state])
        least, others = symbols[0], [x - symbols[0] for x in symbols[1:]]
        hole = taken.find(0, hole)
        at = taken.find(0, max(hole, least))
        for _ in range(TRIES):
            if not any(taken[at + x] for x in others):
                break
            at = taken.find(0, at + 1)
        else:
            at = max(end + 1, least)
        if at + top >= room - top:
            taken.extend(bytes(room))
            table = np.concatenate([table, np.zeros(room, dtype=np.int64)])
            room *= 2
        base[state] = at - least
        for x in symbols:
            taken[base[state] + x] = 1
            table[base[state] + x] = (state << 32) | moves[state][x]
        end = max(end, at - least + symbols[-1])
    if len(single):
        free = np.flatnonzero(np.frombuffer(taken, dtype=np.uint8) == 0)
        free = free[free >= top]
        free = np.concatenate([free, np.arange(room, room + max(0, len(single) - len(free)))])[: len(single)]
        table = np.concatenate([table, np.zeros(max(0, int(free[-1]) + 1 - len(table)), dtype=np.int64)])
        base[single[:, 0]] = free - single[:, 1]
        table[free] = (single[:, 0] << 32) | single[:, 2]
        end = max(end, int(free[-1]))
    return base, table[: max(end + 1, int(base.max(initial=0)) + top + 1)]


def alphabet_of(sample: dict[str, list[str]]) -> np.ndarray:
    """The symbol of every code point: the gap, the stranger that no sample holds, and those that occur."""
    known = np.unique(np.concatenate([np.zeros(1, dtype=np.int64), *[letters_and_gaps(t)[0] for x in sample.values() for t in x]]))
    symbol = np.full(0x110000, _STRANGE, dtype=np.int32)
    symbol[known] = np.arange(len(known)) + _FIRST - 1
    symbol[0] = _SPACE
    return symbol


def language_tables(parts: Sequence[str], symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """A language's automaton as arrays, the first move by each symbol (0: none), and the length of its sample."""
    text = np.concatenate([np.append(letters_and_gaps(t)[0], 0) for t in parts])
    moves = suffix_automaton(symbol[text].tolist())
    first = np.zeros(int(symbol.max(initial=0)) + _FIRST, dtype=np.int64)
    first[list(moves[0])] = list(moves[0].values())
    return *packed(moves), first, len(text)


class CrossParser:
    """Automata of several languages, side by side in one table."""

    def __init__(self, symbol: np.ndarray, tables: dict[str, tuple[np.ndarray, np.ndarray, np.ndarray, int]]) -> None:
        self.symbol, self.names = symbol, sorted(tables)
        bases, cells, firsts, shift, place = [], [], [], 0, 0
        self.starts, self.cost = [], []
        for name in self.names:
            base, table, first, length = tables[name]
            bases.append(base + place)
            cells.append(np.where(table > 0, table + ((shift << 32) | shift), -1))
            firsts.append(first + shift)
            self.starts.append(shift)
            self.cost.append(math.log2(length + 1) + LENGTH_BITS)
            shift, place = shift + len(base), place + len(table)
        width = int(symbol.max(initial=0)) + _FIRST
        room = np.full(width, -1, dtype=np.int64)
        self.base, self.table = np.concatenate([*bases, []]).astype(np.int64), np.concatenate([*cells, room])
        self.first = np.array(firsts, dtype=np.int64).reshape(len(self.names), width)

    def phrases(self, pieces: list[np.ndarray]) -> np.ndarray:
        """Phrases of each piece of symbols in each language: all pieces and languages go on one symbol at a time."""
        order = sorted(range(len(pieces)), key=lambda i: -len(pieces[i]))
        lengths = np.array([len(pieces[i]) for i in order])
        grid = np.zeros((int(lengths.max(initial=0)), len(order)), dtype=np.int64)
        for column, i in enumerate(order):
            grid[: len(pieces[i]), column] = pieces[i]
        state = np.repeat(np.array(self.starts, dtype=np.int64)[:, None], len(order), axis=1)
        count = np.zeros((len(self.names), len(order)), dtype=np.int64)
        going = np.searchsorted(-lengths, -np.arange(len(grid)), side="left")
        for step, symbols in enumerate(grid):
            n = going[step]
            symbols, now = symbols[:n], state[:, :n]
            cell = self.table[self.base[now] + symbols]
            ends = (cell >> 32) != now
            count[:, :n] += ends
            state[:, :n] = np.where(ends, self.first[:, symbols], cell & 0xFFFFFFFF)
        back = np.empty_like(count)
        back[:, order] = count
        return back

    def predict(self, texts: Sequence[str | None]) -> Iterator[tuple[str, float]]:
        """Language and score of each text, worked out for as many texts at a time as a batch has room for."""
        held, size = [], 0
        for text in texts:
            points, has_letter = letters_and_gaps(text or "")
            held.append(self.symbol[points] if has_letter else None)
            size += len(points)
            if size >= BATCH:
                yield from self._judged(held)
                held, size = [], 0
        yield from self._judged(held)

    def _judged(self, texts: list[np.ndarray | None]) -> Iterator[tuple[str, float]]:
        pieces, ends = [], [0]
        for symbols in texts:
            if symbols is not None and self.names:
                pieces += [symbols[at : at + PIECE] for at in range(0, len(symbols), PIECE)]
            ends.append(len(pieces))
        sums = np.zeros((len(self.names), len(pieces) + 1), dtype=np.int64)
        for at in range(0, len(pieces), BATCH // PIECE):
            some = pieces[at : at + BATCH // PIECE]
            sums[:, at + 1 : at + 1 + len(some)] = self.phrases(some)
        sums = sums.cumsum(axis=1)
        bits = (sums[:, ends[1:]] - sums[:, ends[:-1]]) * np.array(self.cost).reshape(len(self.cost), 1)
        for i, symbols in enumerate(texts):
            if symbols is None or not self.names:
                yield UNKNOWN, 0.0
                continue
            best = int(bits[:, i].argmin())
            yield self.names[best], float(1.0 / np.exp2(-SHARPNESS * (bits[:, i] / bits[best, i] - 1.0)).sum())


def held_out(doc_id: Column, folds: int = 4, fold: int = 2) -> Column:
    """Is this document none to learn from?"""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % folds == fold


def labelled_sample(docs: DataFrame, sample: int = SAMPLE, excerpt: int = EXCERPT, languages: int = LANGUAGES) -> DataFrame:
    """``lang``, ``excerpt``: of each language the excerpts of ``sample`` different texts, those of the smallest hashes.

    An excerpt starts at a place that the hash tells, not at the beginning. First the hashes are chosen, by an aggregate
    and a limited rank that runs before its shuffle, then the texts of at most ``sample * languages`` hashes are read.
    """
    chosen = docs.where("lang is not null and text is not null").where(~held_out(F.col("doc_id")))
    slim = chosen.select(F.col("lang").alias("lang"), "text", F.xxhash64("text").alias("hash"), F.char_length("text").alias("length"))
    of_lang = slim.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(languages).select("lang")
    hashes = slim.where("length > 0").groupBy("lang", "hash").agg(F.lit(1).alias("one")).join(F.broadcast(of_lang), "lang")
    ranked = hashes.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("hash"))).where(F.col("rank") <= sample)
    start = F.greatest(F.pmod("hash", F.greatest(F.col("length") - excerpt + 1, F.lit(1))) + 1, F.lit(1)).cast("int")
    found = slim.join(F.broadcast(ranked.select("lang", "hash")), ["lang", "hash"])
    found = found.select("lang", "hash", F.substring(F.col("text"), start, F.lit(excerpt)).alias("excerpt"))
    return found.groupBy("lang", "hash").agg(F.min("excerpt").alias("excerpt")).select("lang", "excerpt")


def _builder(symbol: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, parts in zip(batch.column("lang").to_pylist(), batch.column("parts").to_pylist()):
                *arrays, length = language_tables(parts, symbol)
                columns = [pa.array([lang]), pa.array([length], pa.int64()), *[pa.array([a.astype("<i8").tobytes()]) for a in arrays]]
                yield pa.RecordBatch.from_arrays(columns, names=["lang", "length", "base", "cells", "first"])

    return run


def learn(sample: DataFrame) -> tuple[np.ndarray, dict]:
    """Alphabet and tables of the languages of a bounded sample; each language's automaton is built in a task of its own."""
    learned: dict[str, list[str]] = {}
    for row in sample.orderBy("lang", "excerpt").collect():
        learned.setdefault(row["lang"], []).append(row["excerpt"])
    symbol = alphabet_of(learned)
    if not learned:
        return symbol, {}
    spark = sample.sparkSession
    rows = spark.createDataFrame(list(learned.items()), "lang string, parts array<string>").repartition(len(learned))
    built = rows.mapInArrow(_builder(symbol), "lang string, length long, base binary, cells binary, first binary").collect()
    array = lambda data: np.frombuffer(data, dtype="<i8")
    return symbol, {r["lang"]: (array(r["base"]), array(r["cells"]), array(r["first"]), r["length"]) for r in built}


def _predictor(model):
    built = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not built:
            built.append(CrossParser(*model.value))
        for batch in batches:
            # Spark's texts may hold what is no UTF-8
            texts = ((v.as_py() or b"").decode("utf-8", "replace") for v in batch.column("text").cast(pa.binary()))
            judged = list(built[0].predict(texts))
            columns = [batch.column("doc_id"), batch.column("held_out")]
            columns += [pa.array([j[0] for j in judged], pa.string()), pa.array([j[1] for j in judged], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "lang_pred", "score"])

    return run


def languages_of(docs: DataFrame, sample: int = SAMPLE, excerpt: int = EXCERPT, languages: int = LANGUAGES) -> DataFrame:
    """``doc_id``, ``held_out``, ``lang_pred``, ``score`` of every row of ``docs`` (``doc_id``, ``text``, ``lang``).

    Languages are learned from labelled rows that are not held out; a prediction reads nothing but the text. The sample
    is bounded by ``sample``, ``excerpt`` and ``languages``, whatever the input's size, so its automata go to every task;
    every whole text is parsed. A phrase costs the bits to say which of the labelled text's places it is copied from, so
    languages with less labelled text are not preferred. Ties go to the first name.

    ``und`` with score 0 stands for a text that is null or has no letter, and for all texts if there is nothing to learn
    from. Rows that repeat are predicted each; a null id counts as the empty text; other columns are not read. An empty
    table gives no rows.
    """
    model = docs.sparkSession.sparkContext.broadcast(learn(labelled_sample(docs, sample, excerpt, languages)))
    doc_id = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows.mapInArrow(_predictor(model), f"doc_id {doc_id}, held_out boolean, lang_pred string, score double")
