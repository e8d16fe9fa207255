"""Quality rules by repetition coverage."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from cardloom.llm import words as W

SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, dup_line_chars double, dup_gram_chars double"
)
_SYMBOLS = np.zeros(256, dtype=np.int64)
_SYMBOLS[list(b"#*$%&|<>")] = 1


@dataclass(frozen=True)
class RepetitionLimits:
    """Largest shares that a kept text may have.

    ``gram_chars``: by n-gram length, the share of a text's word characters inside n-grams that occur twice or more;
    overlaps count once. What repeats in longer n-grams repeats in shorter ones too, so the limits fall with the length.
    ``top_chars``: by length, the share inside the one n-gram that covers most, if it occurs twice or more. ``line_chars``: the share in lines equal to an earlier line. The base limits: fewest words, and
    percent of words in repeated ``base_gram``-word windows.
    """

    gram_chars: dict[int, float] = field(default_factory=lambda: {n: (20 - n) / 100 for n in range(5, 11)})
    top_chars: dict[int, float] = field(default_factory=lambda: {2: 0.20, 3: 0.18, 4: 0.16})
    line_chars: float = 0.25
    base_words: int = 10
    base_gram: int = 5
    base_percent: int = 20


@dataclass(frozen=True)
class Measured:
    n_words: int
    word_chars: int
    n_symbols: int
    n_dup_lines: int
    n_repeat_words: int
    base_failed: bool
    kept: bool
    dup_line_chars: float
    dup_gram_chars: float


def measure(data: bytes, limits: RepetitionLimits) -> Measured:
    """Counts, shares and the verdict of one UTF-8 text."""
    octets = np.frombuffer(data, dtype=np.uint8)
    symbols = int(np.bincount(octets, minlength=256) @ _SYMBOLS)
    starts, ends = W.word_spans(data)
    n = len(starts)
    letters = np.zeros(len(octets) + 1, dtype=np.int64)
    np.cumsum((octets & 0xC0) != 0x80, out=letters[1:])
    lengths = letters[ends] - letters[starts]
    chars = int(lengths.sum())
    dup_lines, dup_line_chars = _repeated_lines(data)

    hashes = W.word_hashes(data, codes=W.CODES)
    repeated, worst, failed = 0, 0.0, False
    for size in sorted({limits.base_gram, *limits.gram_chars, *limits.top_chars}):
        grams = W.gram_hashes(hashes, size)
        again = W.seen_again(grams)
        if not again.any():
            break  # a longer repeated window would hold a repeated window of this size
        if size in limits.top_chars:
            failed |= _top_chars(grams, again, size, lengths) > limits.top_chars[size] * chars
        inside = W.covered(np.flatnonzero(again), size, n)
        if size == limits.base_gram:
            repeated = int(inside.sum())
        share = float(lengths[inside].sum()) / chars
        if size in limits.gram_chars:
            worst = max(worst, share)
            failed |= share > limits.gram_chars[size]
    line_share = dup_line_chars / chars if chars else 0.0
    base = n < limits.base_words or 100 * repeated > limits.base_percent * n
    kept = not (base or failed or line_share > limits.line_chars)
    return Measured(n, chars, symbols, dup_lines, repeated, base, kept, line_share, worst)


def _top_chars(grams: np.ndarray, again: np.ndarray, size: int, lengths: np.ndarray) -> int:
    """Characters of the words inside the n-gram, of those that occur again, that covers most; overlaps count once."""
    at = np.flatnonzero(again)
    at = at[np.argsort(grams[at], kind="stable")]
    same = np.zeros(len(at), dtype=bool)
    same[1:] = grams[at[1:]] == grams[at[:-1]]
    new = np.full(len(at), size)
    new[1:][same[1:]] = np.minimum(size, np.diff(at)[same[1:]])
    sums = np.concatenate(([0], np.cumsum(lengths)))
    covers = sums[at + size] - sums[at + size - new]
    return int(np.add.reduceat(covers, np.flatnonzero(~same)).max())


def _repeated_lines(data: bytes) -> tuple[int, int]:
    """Lines with a word that equal an earlier line: how many, and the characters of their words."""
    seen: set[bytes] = set()
    count = chars = 0
    for line in data.split(b"\n"):
        if not line.strip():
            continue
        if line in seen:
            count += 1
            chars += sum(len(word.decode("utf-8", "replace")) for word in line.split())
        seen.add(line)
    return count, chars


def _judge(limits: RepetitionLimits) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [measure(data, limits) for data in W.utf8(batch.column("text"))]
            columns = {"doc_id": batch.column("doc_id").cast(pa.int64())}
            for name, kind in _TYPES.items():
                columns[name] = pa.array([getattr(x, name) for x in found], kind)
            yield pa.RecordBatch.from_pydict(columns)

    return run


_TYPES = {
    "n_words": pa.int64(),
    "word_chars": pa.int64(),
    "n_symbols": pa.int64(),
    "n_dup_lines": pa.int64(),
    "n_repeat_words": pa.int64(),
    "base_failed": pa.bool_(),
    "kept": pa.bool_(),
    "dup_line_chars": pa.float64(),
    "dup_gram_chars": pa.float64(),
}


def repetition_report(docs: DataFrame, limits: RepetitionLimits | None = None) -> DataFrame:
    """One row per row of ``docs`` (``doc_id``, ``text``): its counts, its repetition shares and the verdict ``kept``.

    Rolling hashes of words give each n-gram's hash, sorting finds those that occur twice, and marks over the words
    measure the characters inside them. A row needs no other row, so nothing is shuffled.

    A null or empty text has no words and fails the base rule. Repeated rows are judged each for themselves; a null
    ``doc_id`` stays null. Other columns are not read, whatever their names. An empty table gives none.
    """
    return docs.select("doc_id", "text").mapInArrow(_judge(limits or RepetitionLimits()), SCHEMA)


def keep_good(docs: DataFrame, limits: RepetitionLimits | None = None) -> DataFrame:
    """The rows of ``docs`` that ``repetition_report`` keeps, with all their columns."""
    chosen = limits or RepetitionLimits()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mask = [measure(data, chosen).kept for data in W.utf8(batch.column("text"))]
            yield batch.filter(pa.array(mask, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
