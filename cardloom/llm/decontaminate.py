"""Benchmark decontamination by winnowed fingerprints."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardloom.llm import words as W
from cardloom.llm.staging import staged

#: Words of a window, and of the k-grams whose smallest hash is a window's fingerprint.
WINDOW, GRAM = 13, 5
#: A document is contaminated if at least one word in this many is hit.
SHARE = 20
#: Benchmark fingerprints that are sent to every task (8 bytes each); above this, documents meet them in a join alone.
SENT = 1_000_000

_RUNS = "array<struct<length:int,fp:bigint,start:int,windows:array<bigint>>>"


def _windows(hashes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprint and hash of each window of ``length`` words.

    The fingerprint is the smallest hash of the window's k-grams: whoever shares the window shares it. Windows that are
    shorter than the common length are their own fingerprint.
    """
    whole = W.gram_hashes(hashes, length)
    if length < WINDOW or not len(whole):
        return whole, whole
    return W.sliding_min(W.gram_hashes(hashes, GRAM), length - GRAM + 1), whole


def _item_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for item, data in zip(batch.column("item_id"), W.utf8(batch.column("text")), strict=True):
            hashes = W.word_hashes(data, W.ALNUM)
            length = min(WINDOW, len(hashes))
            if not length:
                continue
            prints, whole = _windows(hashes, length)
            n = len(whole)
            columns = {
                "item_id": pa.array([item.as_py()] * n, pa.int64()),
                "length": pa.array(np.full(n, length), pa.int32()),
                "fp": pa.array(prints.view(np.int64)),
                "window": pa.array(whole.view(np.int64)),
            }
            yield pa.RecordBatch.from_pydict(columns)


def _candidates(lengths: list[int], sent) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows of documents with the runs of windows under one fingerprint; with ``sent``, only of benchmark fingerprints."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, found = [], []
            for data in W.utf8(batch.column("text")):
                hashes = W.word_hashes(data, W.ALNUM)
                sizes.append(len(hashes))
                found.append([part for length in lengths for part in runs(hashes, length)])
            columns = {
                "doc_id": batch.column("doc_id").cast(pa.int64()),
                "text_key": batch.column("text_key"),
                "n_words": pa.array(sizes, pa.int64()),
                "runs": pa.array(found, _RUN_TYPE),
            }
            yield pa.RecordBatch.from_pydict(columns)

    def runs(hashes: np.ndarray, length: int) -> Iterator[dict]:
        prints, whole = _windows(hashes, length)
        if not len(prints):
            return
        keep = np.ones(len(prints), dtype=bool)
        if sent is not None:
            known = sent.value[length]
            keep = known[np.minimum(np.searchsorted(known, prints), len(known) - 1)] == prints
        new = np.ones(len(prints), dtype=bool)
        new[1:] = prints[1:] != prints[:-1]
        starts = np.flatnonzero(new)
        ends = np.append(starts[1:], len(prints))
        for a, b in zip(starts[keep[starts]].tolist(), ends[keep[starts]].tolist(), strict=True):
            yield {"length": length, "fp": int(prints[a : a + 1].view(np.int64)[0]), "start": a, "windows": whole[a:b].view(np.int64)}

    return run


_RUN_TYPE = pa.list_(
    pa.struct([("length", pa.int32()), ("fp", pa.int64()), ("start", pa.int32()), ("windows", pa.list_(pa.int64()))])
)


def _union_length(spans: Column) -> Column:
    """Words covered by sorted (start, end) spans."""
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("upto"))

    def add(state: Column, span: Column) -> Column:
        more = F.greatest(F.lit(0), span["end"] - F.greatest(span["start"], state["upto"]))
        return F.struct((state["n"] + more).alias("n"), F.greatest(state["upto"], span["end"]).alias("upto"))

    return F.aggregate(spans, zero, add)["n"]


def contamination(docs: DataFrame, benchmark: DataFrame, sent_limit: int = SENT) -> DataFrame:
    """One row per row of ``docs`` (``doc_id``, ``text``): hit words and items, against ``benchmark`` (``item_id``, ``text``).

    A window is 13 words of an item, or all words of a shorter one; a document word in any occurrence of it is hit.
    Both sides keep the smallest k-gram hash of each window, so a shared window always has a shared fingerprint. Where
    the benchmark's fingerprints are counted to be few, tasks get them to leave all others out at once; in any case
    documents and benchmark are joined by fingerprint, and hits extend over the windows that are equal in full.

    Null texts have no words and hit nothing, null items hold no window. A null ``item_id`` is left out of the list of
    items. Repeated rows, and rows of one ``doc_id``, are judged each for themselves. Other columns are not read. With an
    empty benchmark nothing is hit; an empty table gives none.
    """
    items = benchmark.select("item_id", "text").mapInArrow(_item_windows, "item_id long, length int, fp long, window long")
    items = staged(items, "benchmark-windows")
    prints = items.select("length", "fp").distinct()
    sizes = {row["length"]: row["n"] for row in prints.groupBy("length").agg(F.count("*").alias("n")).collect()}
    sent = None
    if sum(sizes.values()) <= sent_limit:
        known = {length: [] for length in sizes}
        for row in prints.collect():
            known[row["length"]].append(row["fp"] % (1 << 64))
        sent = docs.sparkSession.sparkContext.broadcast({k: np.sort(np.array(v, dtype=np.uint64)) for k, v in known.items()})

    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("text_key"))
    found = keyed.mapInArrow(
        _candidates(sorted(sizes), sent), f"doc_id long, text_key long, n_words long, runs {_RUNS}"
    )
    found = staged(found, "document-windows")
    runs = found.select("doc_id", "text_key", F.inline("runs"))
    joined = runs.join(prints, ["length", "fp"])
    windows = joined.select(
        "doc_id", "text_key", "length", "fp", F.col("start").alias("first"), F.posexplode("windows").alias("i", "window")
    )
    owners = items.groupBy("length", "fp", "window").agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    hits = windows.join(owners, ["length", "fp", "window"])
    start = F.col("first") + F.col("i")
    span = F.struct(start.alias("start"), (start + F.col("length")).alias("end"))
    by_document = hits.groupBy("doc_id", "text_key").agg(
        F.sort_array(F.collect_set(span)).alias("spans"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items")
    )
    by_document = by_document.select(
        F.col("doc_id").alias("_doc"), F.col("text_key").alias("_key"), _union_length(F.col("spans")).alias("n_hit"), "items"
    )
    same = F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("text_key") == F.col("_key"))
    all_rows = found.select("doc_id", "text_key", "n_words").join(by_document, same, "left")
    names = F.sort_array(F.transform(F.coalesce("items", F.array().cast("array<bigint>")), lambda x: x.cast("string")))
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return all_rows.select(
        "doc_id",
        "text_key",
        "n_words",
        n_hit.alias("n_hit"),
        F.size(names).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", names), 256).alias("items_sha256"),
        ((n_hit > 0) & (SHARE * n_hit >= F.col("n_words"))).alias("contaminated"),
    )


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with all their columns."""
    hit = contamination(docs, benchmark).where("contaminated")
    hit = hit.select(F.col("doc_id").alias("_doc"), F.col("text_key").alias("_key"))
    same = F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.xxhash64("text") == F.col("_key"))
    return docs.join(hit, same, "left_anti")
