"""Exact substring duplicates by a logarithmic family of sparse suffix indexes.

A suffix is kept only where it starts at an *anchor*: of all the 24-byte grams in a 100-byte string, the one with the
smallest hash. Whatever holds the string chooses the same gram, so equal strings always meet at equal anchors. An anchor
owns a stretch of neighbouring 100-byte strings; its suffix is cut at the end of the stretch and known by two hashes, that
of its gram (``gram``) and that of the stretch (``stretch``). Ordered by them, suffixes with equal beginnings are
neighbours, as in a suffix array, at about one suffix for 35 bytes.

Documents come in batches in order of their ids. A batch's suffixes are sorted, merged against every level of the index
so that only new ones remain, and become a level; levels of equal size are merged, so n batches make log(n) levels.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardloom.llm import words as W
from cardloom.llm.staging import drop_stage, in_order, staged

#: Bytes of a duplicate string, and of an anchor's gram.
LENGTH, GRAM = 100, 24
#: Batches that a whole table is indexed in.
BATCHES = 4
#: Different stretches of one anchor that are compared inside a task; those of an anchor with more are compared as rows.
TOGETHER = 10_000

_PIECE = 1 << 20
_PLACE = np.uint64((1 << 24) - 1)
_STEP = 128  # more strings than an anchor can own
_KEY = ["key", "part"]


def anchors(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``gram``, ``stretch``, first string and number of strings of each anchor; of equal stretches only the first.

    Long texts go through piece by piece. A stretch that a piece ends is cut there, which costs a comparison, no match.
    """
    found = []
    for at in range(0, len(data) - LENGTH + 1, _PIECE):
        octets = np.frombuffer(data, dtype=np.uint8, count=min(_PIECE + LENGTH - 1, len(data) - at), offset=at)
        sums = W.prefixes(W.CODES[octets])
        place = np.arange(len(octets) - GRAM + 1)
        grams = W.between(sums, place, place + GRAM)
        least = W.sliding_min((grams & ~_PLACE) | place.astype(np.uint64), LENGTH - GRAM + 1)
        chosen = (least & _PLACE).astype(np.int64)
        first = np.flatnonzero(np.diff(chosen, prepend=-1))
        count = np.diff(first, append=len(chosen))
        stretch = W.between(sums, first, first + count - 1 + LENGTH)
        found.append((grams[chosen[first]], stretch, first + at, count))
    if not found:
        none = np.zeros(0, dtype=np.int64)
        return none.view(np.uint64), none.view(np.uint64), none, none
    gram, stretch, first, count = map(np.concatenate, zip(*found, strict=True))
    _, once = np.unique(np.stack([gram, stretch]), axis=1, return_index=True)
    once.sort()
    return gram[once], stretch[once], first[once], count[once]


def _suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys, parts = (batch.column(name).to_numpy(zero_copy_only=False) for name in _KEY)
        kept, rows, held = [], [], 0
        for i, data in enumerate(W.utf8(batch.column("text"))):
            one = anchors(data)
            kept.append((one[0].view(np.int64), one[1].view(np.int64), one[2] * _STEP + one[3]))
            rows.append(np.full(len(one[0]), i))
            held += len(one[0])
            if held > 1 << 18 or i == batch.num_rows - 1:
                gram, stretch, place = map(np.concatenate, zip(*kept, strict=True))
                of = np.concatenate(rows)
                columns = [gram, stretch, keys[of], parts[of], place]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["gram", "stretch", *_KEY, "place"])
                kept, rows, held = [], [], 0


class SuffixIndex:
    """The levels of the index. Each is a table of the distinct suffixes of its batches with their first place.

    ``add`` takes batches in the order of their keys. A suffix that an earlier level has is not new, and where several of
    a batch are equal the first stands, so over all levels a suffix is there once, with the first place it starts at.
    """

    def __init__(self) -> None:
        self.levels: list[tuple[int, DataFrame]] = []

    def add(self, suffixes: DataFrame) -> None:
        place = F.struct(*_KEY, "place")
        new = suffixes.groupBy("gram", "stretch").agg(F.min(place).alias("at"))
        for _, level in self.levels:
            new = new.join(level.hint("merge"), ["gram", "stretch"], "left_anti")
        array = new.select("gram", "stretch", "at.*").sortWithinPartitions("gram", "stretch")
        self.levels.append((1, staged(array, "suffix-level")))
        while len(self.levels) > 1 and self.levels[-1][0] == self.levels[-2][0]:
            (size, left), (_, right) = self.levels.pop(), self.levels.pop()
            merged = left.unionByName(right).repartition("gram").sortWithinPartitions("gram", "stretch")
            self.levels.append((2 * size, staged(merged, "suffix-level")))
            drop_stage(left)
            drop_stage(right)

    def suffixes(self) -> DataFrame:
        return reduce(DataFrame.unionByName, [level for _, level in self.levels])


def _contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of each stretch to be compared."""
    for batch in batches:
        keys, parts, shared = (batch.column(name) for name in (*_KEY, "shared"))
        rows: dict[str, list] = {name: [] for name in ("gram", "n", *_KEY, "first", "content")}
        held = 0
        for i, data in enumerate(W.utf8(batch.column("text"))):
            for one in shared[i].as_py():
                first, count = divmod(one["place"], _STEP)
                content = data[first : first + count - 1 + LENGTH]
                for name, value in zip(rows, (one["gram"], one["n"], keys[i].as_py(), parts[i].as_py(), first, content), strict=True):
                    rows[name].append(value)
                held += len(content)
            if held > 1 << 24 or i == batch.num_rows - 1:
                yield pa.RecordBatch.from_pydict({k: pa.array(v, pa.binary() if k == "content" else pa.int64()) for k, v in rows.items()})
                rows, held = {name: [] for name in rows}, 0


def _strings(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of every 100-byte string of the rows' contents (with the row's gram), its row, and its start in the row."""
    sizes = np.array([len(v.as_py()) for v in batch.column("content")], dtype=np.int64)
    joined = b"".join(v.as_py() for v in batch.column("content"))
    ends = np.cumsum(sizes)
    counts = sizes - LENGTH + 1
    row = np.repeat(np.arange(len(sizes)), counts)
    inside = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
    start = (ends - sizes)[row] + inside
    hashes = W.between(W.prefixes(W.CODES[np.frombuffer(joined, dtype=np.uint8)]), start, start + LENGTH)
    gram = batch.column("gram").to_numpy(zero_copy_only=False).view(np.uint64)
    return hashes ^ W.mixed(gram)[row], row, inside


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of strings that start earlier in another row of their gram. Rows come by gram, and by place in a gram."""

    def runs(table: pa.RecordBatch) -> pa.RecordBatch:
        hashes, row, inside = _strings(table)
        _, once = np.unique(hashes, return_index=True)
        again = np.ones(len(hashes), dtype=bool)
        again[once] = False
        at = np.flatnonzero(again)
        new = np.ones(len(at), dtype=bool)
        new[1:] = (np.diff(at) != 1) | (np.diff(row[at]) != 0)
        heads = np.flatnonzero(new)
        count = np.diff(heads, append=len(at))
        of = row[at[heads]]
        first = table.column("first").to_numpy(zero_copy_only=False)[of] + inside[at[heads]]
        keys = [table.column(name).take(pa.array(of)) for name in _KEY]
        return pa.RecordBatch.from_arrays([*keys, pa.array(first), pa.array(count)], names=[*_KEY, "first", "count"])

    yield from map(runs, W.whole_groups(batches, ["gram"]))


def _as_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 2000):
            part = batch.slice(at, 2000)
            hashes, row, inside = _strings(part)
            first = part.column("first").to_numpy(zero_copy_only=False)[row] + inside
            keys = [part.column(name).take(pa.array(row)) for name in _KEY]
            yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), *keys, pa.array(first)], names=["string", *_KEY, "first"])


def _earlier_strings(contents: DataFrame, together: int) -> DataFrame:
    """``key``, ``part``, ``first``, ``count``: runs of strings that another stretch of their anchor holds earlier."""
    runs = "key long, part long, first long, count long"
    few = contents.where(F.col("n") <= together).repartition("gram").sortWithinPartitions("gram", *_KEY, "first")
    compared = few.drop("n").mapInArrow(_compared, runs)
    rows = contents.where(F.col("n") > together).drop("n").mapInArrow(_as_rows, "string long, key long, part long, first long")
    place = F.struct(*_KEY, "first")
    firsts = rows.groupBy("string").agg(F.min(place).alias("at")).withColumn("_hash", F.xxhash64("string"))
    later = rows.withColumn("_hash", F.xxhash64("string")).join(firsts, ["string", "_hash"]).where(place != F.col("at"))
    return compared.unionByName(later.select(*_KEY, "first", F.lit(1).cast("long").alias("count")))


def removed_runs(data: bytes, firsts: list[int], later: list[dict]) -> list[tuple[int, int]]:
    """Runs [start, end) of bytes to remove. All strings are later ones, but for those of ``firsts`` not in ``later``."""
    again = np.zeros(max(0, len(data) - LENGTH + 1) + 2, dtype=np.int8)
    again[1:-1] = 1
    for packed in firsts:
        first, count = divmod(packed, _STEP)
        again[first + 1 : first + count + 1] = 0
    for run in later:
        again[run["first"] + 1 : run["first"] + run["count"] + 1] = 1
    edges = np.flatnonzero(np.diff(again))
    gone = np.zeros(len(data) + 2, dtype=np.int8)
    gone[1:-1] = W.covered(edges[::2], edges[1::2] - edges[::2] + LENGTH - 1, len(data))
    edges = np.flatnonzero(np.diff(gone))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


def _kept(data: bytes, runs: list[tuple[int, int]]) -> bytes:
    ends = [0, *(end for _, end in runs)]
    starts = [*(start for start, _ in runs), len(data)]
    return b"".join(data[a:b] for a, b in zip(ends, starts, strict=True))


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for i, data in enumerate(W.utf8(batch.column("text"))):
            runs = removed_runs(data, batch.column("firsts")[i].as_py() or [], batch.column("later")[i].as_py() or [])
            gone = sum(end - start for start, end in runs)
            rows.append((len(data), gone, len(runs), hashlib.sha256(_kept(data, runs)).hexdigest()))
        n_bytes, n_removed, n_spans, sha = zip(*rows, strict=True) if rows else ((),) * 4
        yield pa.RecordBatch.from_pydict(
            {
                "doc_id": batch.column("doc_id").cast(pa.int64()),
                "n_bytes": pa.array(n_bytes, pa.int64()),
                "n_removed": pa.array(n_removed, pa.int64()),
                "n_spans": pa.array(n_spans, pa.int64()),
                "kept_sha256": pa.array(sha, pa.string()),
            }
        )


def _cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = []
        for i, data in enumerate(W.utf8(batch.column("text"))):
            runs = removed_runs(data, batch.column("firsts")[i].as_py() or [], batch.column("later")[i].as_py() or [])
            texts.append(_kept(data, runs))
        yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id").cast(pa.int64()), "kept": pa.array(texts, pa.binary())})


def _with_matches(docs: DataFrame, batches: int, together: int) -> DataFrame:
    """``docs`` with ``firsts`` and ``later``, what ``removed_runs`` needs."""
    keyed = in_order(docs)
    edges = keyed.approxQuantile("key", [i / batches for i in range(1, batches)], 0.01) if batches > 1 else []
    bounds = [None, *sorted({int(edge) for edge in edges}), None]
    index = SuffixIndex()
    for low, high in zip(bounds, bounds[1:], strict=False):
        batch = keyed.where(F.lit(True) if low is None else F.col("key") > low)
        batch = batch.where(F.lit(True) if high is None else F.col("key") <= high)
        suffixes = batch.select("text", *_KEY).mapInArrow(_suffixes, "gram long, stretch long, key long, part long, place long")
        index.add(suffixes)

    suffixes = index.suffixes()
    several = suffixes.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1").withColumn("_hash", F.xxhash64("gram"))
    met = suffixes.withColumn("_hash", F.xxhash64("gram")).join(several, ["gram", "_hash"], "left")
    shared = F.when(F.col("n").isNotNull(), F.struct("place", "gram", "n"))
    lists = met.groupBy(*_KEY).agg(F.collect_list("place").alias("firsts"), F.collect_list(shared).alias("shared"))
    lists = staged(lists, "suffix-lists")
    for _, level in index.levels:
        drop_stage(level)

    asked = keyed.select("text", *_KEY).join(lists.where("size(shared) > 0").select(*_KEY, "shared"), _KEY)
    contents = asked.mapInArrow(_contents, "gram long, n long, key long, part long, first long, content binary")
    contents = staged(contents, "suffix-contents")
    later = _earlier_strings(contents, together).groupBy(*_KEY).agg(F.collect_list(F.struct("first", "count")).alias("later"))
    found = lists.select(*_KEY, "firsts").join(later, _KEY, "left")
    return keyed.join(found, _KEY, "left").select("doc_id", "text", "firsts", "later")


def _mapped(docs: DataFrame, task: Callable, schema: str, batches: int, together: int) -> DataFrame:
    return _with_matches(docs, batches, together).mapInArrow(task, schema)


def substring_report(docs: DataFrame, batches: int = BATCHES, together: int = TOGETHER) -> DataFrame:
    """One row per row of ``docs`` (``doc_id``, ``text``): bytes, removed bytes and runs, and the hash of what is left.

    A byte goes if a 100-byte string that covers it also starts earlier: in a document of smaller id, or earlier in its
    own. Null and empty texts have no bytes. A null ``doc_id`` is the smallest; rows of one ``doc_id`` with different
    texts are ordered by the texts' hashes, and equal rows are one document, so neither removes the other. Other columns
    are not read. An empty table gives none.
    """
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    return _mapped(docs, _digest, schema, batches, together)


def without_repeats(docs: DataFrame, batches: int = BATCHES, together: int = TOGETHER) -> DataFrame:
    """``doc_id`` and ``kept``, the bytes that ``substring_report`` leaves of each text."""
    return _mapped(docs, _cleaned, "doc_id long, kept binary", batches, together)
