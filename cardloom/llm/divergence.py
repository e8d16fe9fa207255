"""How the words of each source differ from its language's: counts by chunk factorization, exact integer divergences.

Most occurrences of a term come in few different chunks (runs without white space). So chunks are counted per document
and block of documents, each globally distinct chunk is cut into terms once, and its terms are joined back to the counts.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cardloom.llm.staging import drop_stage, staged

#: A term is kept in a language if at least so many of its documents hold it.
LEAST = 10
#: Terms that are listed for each group.
TOP = 10
#: Scale of the smoothed shares.
UNIT = 1_000_000_000
TERM = "[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
#: Bytes of text that are counted together in a task; documents taken up and rows sent on at a time.
BLOCK, SLICE, ROWS = 20 << 20, 1000, 1 << 16
_COUNTS = "lang string, chunk string, docs long, ids array<long>, sources array<string>, ns array<int>"
_TERMS = "lang string, source string, term string, n long, ids array<long>"


def _run_starts(ordered: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.diff(ordered, prepend=ordered[0] - 1 if len(ordered) else 0))


def block_counts(langs: pa.Array, sources: pa.Array, words: pa.ListArray, first: int, least: int) -> Iterator[pa.RecordBatch]:
    """The chunks of some documents as a row per language and chunk: documents that hold it (and which ones, if they are
    fewer than ``least``), and the occurrences in each source."""
    chunks = words.flatten().dictionary_encode()
    doc = np.repeat(np.arange(len(words), dtype=np.int64), words.value_lengths().to_numpy())
    size = len(chunks.dictionary)
    kept = chunks.indices.to_numpy().astype(np.int64)
    held = pc.not_equal(chunks.dictionary, "").to_numpy(zero_copy_only=False)[kept] if size else np.zeros(0, dtype=bool)
    pairs, n = np.unique(doc[held] * size + kept[held], return_counts=True)
    if not len(pairs):
        return
    doc, chunk = pairs // size, pairs % size
    langs, sources = langs.dictionary_encode(), sources.dictionary_encode()
    lang, source = (x.indices.to_numpy().astype(np.int64) for x in (langs, sources))
    key = (lang[doc] * size + chunk) * len(sources.dictionary) + source[doc]
    order = np.argsort(key, kind="stable")
    key, doc, n = key[order], doc[order], n[order]
    parts = _run_starts(key)
    row_key = key // len(sources.dictionary)
    rows = _run_starts(row_key)
    docs = np.diff(np.append(rows, len(key)))
    few = np.repeat(docs < least, docs)
    ids = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.where(docs < least, docs, 0))]), pa.int32()), pa.array(doc[few] + first))
    upto = pa.array(np.append(np.searchsorted(parts, rows), len(parts)), pa.int32())
    names = pa.ListArray.from_arrays(upto, sources.dictionary.take(pa.array(key[parts] % len(sources.dictionary))))
    sums = pa.ListArray.from_arrays(upto, pa.array(np.add.reduceat(n, parts), pa.int32()))
    columns = [
        langs.dictionary.take(pa.array(row_key[rows] // size)), chunks.dictionary.take(pa.array(row_key[rows] % size)),
        pa.array(docs, pa.int64()), ids, names, sums,
    ]
    batch = pa.RecordBatch.from_arrays(columns, names=["lang", "chunk", "docs", "ids", "sources", "ns"])
    for at in range(0, batch.num_rows, ROWS):
        yield batch.slice(at, ROWS)


def _counter(least: int, block: int):
    """Documents to the counts of their chunks, block by block. A document's number is its place in its partition, the
    same when a lost task runs again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, held, size = TaskContext.get().partitionId() << 40, [], 0

        def counted():
            table = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            return block_counts(table.column("lang"), table.column("source"), table.column("words"), first, least)

        for batch in (b.slice(at, SLICE) for b in batches for at in range(0, b.num_rows, SLICE)):
            words = pc.ascii_split_whitespace(pc.ascii_lower(batch.column("text")))
            columns = [batch.column("lang"), batch.column("source"), words]
            held.append(pa.RecordBatch.from_arrays(columns, names=["lang", "source", "words"]))
            size += batch.column("text").nbytes
            if size >= block:
                yield from counted()
                first, held, size = first + sum(b.num_rows for b in held), [], 0
        if sum(b.num_rows for b in held):
            yield from counted()

    return run


class _Merged:
    """Counts of a run of chunks: documents of each language, occurrences in each source, and documents' numbers."""

    def __init__(self, docs: pa.Table, ns: pa.Table, ids: pa.Table, least: int) -> None:
        self.docs = docs.group_by(["chunk", "lang"]).aggregate([("docs", "sum")]).rename_columns(["chunk", "lang", "docs"])
        self.ns = ns.group_by(["chunk", "lang", "source"]).aggregate([("n", "sum")]).rename_columns(["chunk", "lang", "source", "n"])
        self.ids, self.least = ids, least

    @classmethod
    def of(cls, batch: pa.RecordBatch, least: int) -> _Merged:
        def flat(name, **lists):
            row = pc.list_parent_indices(batch.column(name))
            return pa.table({"chunk": batch.column("chunk").take(row), "lang": batch.column("lang").take(row)} | {k: batch.column(c).flatten() for k, c in lists.items()})

        return cls(pa.table({k: batch.column(k) for k in ("chunk", "lang", "docs")}), flat("sources", source="sources", n="ns"), flat("ids", id="ids"), least)

    def plus(self, other: _Merged) -> _Merged:
        return _Merged(*(pa.concat_tables(x) for x in ((self.docs, other.docs), (self.ns, other.ns), (self.ids, other.ids))), self.least)

    def split(self, chunk: str) -> tuple[_Merged, _Merged]:
        """What is of other chunks, and what is of this one, whose documents are dropped where they are too many to matter."""
        tables = self.docs, self.ns, self.ids
        rest = [t.filter(pc.not_equal(t["chunk"], chunk)) for t in tables]
        own = [t.filter(pc.equal(t["chunk"], chunk)) for t in tables]
        many = own[0].filter(pc.greater_equal(own[0]["docs"], self.least))["lang"]
        own[2] = own[2].filter(pc.invert(pc.is_in(own[2]["lang"], many.combine_chunks())))
        return _Merged(*rest, self.least), _Merged(*own, self.least)

    def term_rows(self) -> Iterator[pa.RecordBatch]:
        """Rows of the terms of these chunks, each of which is tokenized here, once: for each source its occurrences, and
        with a null source the documents that hold the chunk, and which ones if they are fewer than ``least``."""
        if not self.docs.num_rows:
            return
        chunks = pc.unique(self.docs["chunk"])
        terms, counts = [], np.zeros(len(chunks), dtype=np.int64)
        for i, chunk in enumerate(chunks.to_pylist()):
            found = _TERM.findall(chunk)
            counts[i] = len(found)
            terms += found
        terms = pa.array(terms, pa.string())
        starts = np.cumsum(counts) - counts

        def expanded(table):
            at = pc.index_in(table["chunk"].combine_chunks(), chunks).to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(at)), counts[at])
            inside = np.arange(len(row)) - np.repeat(np.cumsum(counts[at]) - counts[at], counts[at])
            return at, row, terms.take(pa.array(np.repeat(starts[at], counts[at]) + inside))

        _, row, term = expanded(self.ns)
        own = self.ns.take(pa.array(row))
        none = pa.nulls(len(row), pa.list_(pa.int64()))
        yield from self._sent(own["lang"], own["source"], term, own["n"], none)

        langs = pc.unique(self.docs["lang"])
        at, row, term = expanded(self.docs)
        key = lambda table, at: at * len(langs) + pc.index_in(table["lang"].combine_chunks(), langs).to_numpy(zero_copy_only=False)
        own_key = key(self.docs, at)
        id_key = key(self.ids, pc.index_in(self.ids["chunk"].combine_chunks(), chunks).to_numpy(zero_copy_only=False))
        order = np.argsort(id_key, kind="stable")
        begin, end = (np.searchsorted(id_key[order], own_key, side=side) for side in ("left", "right"))
        docs = self.docs["docs"].to_numpy()
        few = docs[row] < self.least
        lengths = np.where(few, (end - begin)[row], 0)
        place = np.repeat(begin[row], lengths) + np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        numbers = self.ids["id"].to_numpy()[order][place]
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32()), pa.array(numbers, pa.int64()))
        yield from self._sent(self.docs["lang"].take(pa.array(row)), pa.nulls(len(row), pa.string()), term, pa.array(docs[row]), lists)

    @staticmethod
    def _sent(*columns) -> Iterator[pa.RecordBatch]:
        table = pa.table(list(columns), names=["lang", "source", "term", "n", "ids"]).combine_chunks()
        for batch in table.to_batches(max_chunksize=ROWS):
            yield batch


_TERM = re.compile(TERM)


def _merger(least: int):
    """Counts in the order of their chunks to the rows of their terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            if batch.num_rows:
                now = _Merged.of(batch, least)
                done, rest = (rest.plus(now) if rest else now).split(batch.column("chunk")[-1].as_py())
                yield from done.term_rows()
        if rest:
            yield from rest.term_rows()

    return run


def _read(docs: DataFrame) -> DataFrame:
    return docs.select(*[F.coalesce(F.col(name).cast("string"), F.lit("")).alias(name) for name in ("lang", "source", "text")])


def term_rows(docs: DataFrame, least: int = LEAST, block: int = BLOCK) -> DataFrame:
    """``lang``, ``source``, ``term``, ``n`` and ``ids`` of each chunk: a row per source with ``n`` occurrences of the term,
    and one with a null source, where ``n`` documents of the language hold the chunk, ``ids`` if they are fewer than ``least``.

    One shuffle by chunk brings its counts together, a row per block of documents and never one per document. They are
    merged there in order, so a frequent chunk's rows pass through a task, but are never held; each globally distinct
    chunk is tokenized once, and its terms are joined back to its counts in place.
    """
    counts = _read(docs).mapInArrow(_counter(least, block), _COUNTS)
    return counts.repartition("chunk").sortWithinPartitions("chunk").mapInArrow(_merger(least), _TERMS)


def term_counts(docs: DataFrame, least: int = LEAST, block: int = BLOCK) -> DataFrame:
    """``lang``, ``source``, ``term``, ``n``: occurrences of each term in each group, for the terms that at least ``least``
    documents of the language hold.

    How many documents hold a term lies between its most frequent chunk's documents and the sum of all its chunks'. Only
    where ``least`` is between the two are the documents themselves counted, and there every chunk has less than ``least``
    of them. Each row of ``docs`` is a document.
    """
    rows = staged(term_rows(docs, least, block), "chunk-terms")
    held = rows.where("source is null")
    bounds = held.groupBy("lang", "term").agg(F.sum("n").alias("most"), F.max("n").alias("fewest"))
    bounds = staged(bounds.where(F.col("most") >= least), "term-bounds")
    sure = bounds.where(F.col("fewest") >= least).select("lang", "term")
    between = bounds.where(F.col("fewest") < least).select("lang", "term")
    each = held.where(F.size("ids") > 0).join(between, ["lang", "term"]).select("lang", "term", F.explode("ids").alias("id"))
    exact = each.distinct().groupBy("lang", "term").agg(F.count("*").alias("docs")).where(F.col("docs") >= least)
    kept = rows.where("source is not null").join(sure.unionByName(exact.select("lang", "term")), ["lang", "term"])
    kept = staged(kept.groupBy("lang", "source", "term").agg(F.sum("n").alias("n")), "kept-terms")
    drop_stage(rows)
    drop_stage(bounds)
    return kept


def _share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(UNIT * (count + 2) / (total + 2 * terms)), in decimals as the product may pass 64 bits."""
    above = F.lit(UNIT).cast("decimal(10,0)") * (count + 2).cast("decimal(20,0)")
    return 1 + F.call_function("div", above, (total + 2 * terms).cast("decimal(20,0)"))


def _apart(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def divergence_audit(docs: DataFrame, least: int = LEAST, top: int = TOP, block: int = BLOCK) -> DataFrame:
    """Divergence of each group (``lang``, ``source``) from the other sources of its language, and its leading terms.

    Rows: ``lang, source, part, item, value, rank``. ``part`` is ``pair`` (item is the other source, value the sum over all
    kept terms) or ``term`` (item is a kept term that the group uses more than the language, only the ``top`` first).
    All arithmetic is in integers. Null text, lang and source count as the empty string; every row of ``docs`` is a
    document, also one that repeats another or has a null id. Ties in value go by the item's bytes. A group without kept
    terms has pairs, a language without kept terms has pairs of value 0; an empty table gives no rows. Other columns are
    not read.

    Pairs meet only in the terms that both use: a term that one of them lacks has its lacking count's constant share, so
    those sums come from a histogram of counts per group.
    """
    groups = staged(_read(docs).select("lang", "source").distinct(), "groups")
    kept = term_counts(docs, least, block)
    sizes = kept.groupBy("lang").agg(F.countDistinct("term").alias("v"), F.sum("n").alias("all_n"))
    used = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    known = groups.join(used, ["lang", "source"], "left").join(sizes, "lang", "left").na.fill(0, ["total", "v", "all_n"])
    known = known.withColumn("none", F.when(F.col("v") > 0, _share(F.lit(0), F.col("total"), F.col("v"))))
    known = staged(known, "group-sizes")

    shares = kept.join(known.where("v > 0"), ["lang", "source"])
    shares = shares.select("lang", "source", "term", "n", _share(F.col("n"), F.col("total"), F.col("v")).alias("p"), "none", "v", "all_n")
    shares = staged(shares, "term-shares")
    of_lang = kept.groupBy("lang", "term").agg(F.sum("n").alias("in_lang"))
    ahead = shares.join(of_lang, ["lang", "term"]).withColumn("q", _share(F.col("in_lang"), F.col("all_n"), F.col("v")))
    ahead = ahead.where("p > q").select(
        "lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _apart(F.col("p"), F.col("q")).alias("value")
    )

    one, two = shares.alias("a"), shares.alias("b")
    met = one.join(two, (F.col("a.lang") == F.col("b.lang")) & (F.col("a.term") == F.col("b.term")) & (F.col("a.source") < F.col("b.source")))
    pa_, pb, a0, b0 = (F.col(x) for x in ("a.p", "b.p", "a.none", "b.none"))
    both = met.groupBy(F.col("a.lang").alias("lang"), F.col("a.source").alias("source"), F.col("b.source").alias("item")).agg(
        F.sum(_apart(pa_, pb) - _apart(pa_, b0) - _apart(a0, pb) + _apart(a0, b0)).alias("value")
    )
    both = both.unionByName(both.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))
    others = known.select("lang", F.col("source").alias("item"), F.col("none").alias("other_none"))
    alike = shares.groupBy("lang", "source", "p", "none").agg(F.count("*").alias("terms"))
    single = alike.join(others, "lang").where("source <> item")
    single = single.groupBy("lang", "source", "item").agg(
        F.sum(F.col("terms") * (_apart(F.col("p"), F.col("other_none")) - _apart(F.col("none"), F.col("other_none")))).alias("value")
    )
    single = single.unionByName(single.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))
    base = known.join(others, "lang").where("source <> item")
    empty = F.coalesce(F.col("v") * _apart(F.col("none"), F.col("other_none")), F.lit(0)).cast("long")
    parts = both.unionByName(single).unionByName(base.select("lang", "source", "item", empty.alias("value")))
    pairs = parts.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value")

    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    leading = ahead.withColumn("rank", rank).where(F.col("rank") <= top)
    return pairs.withColumn("rank", rank).unionByName(leading)


AUDIT_SQL = f"""
WITH docs AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
words AS (SELECT id, lang, source, unnest(regexp_extract_all(text, '{TERM}')) AS term FROM docs),
kept AS (SELECT lang, term, count(*)::HUGEINT AS in_lang FROM words GROUP BY lang, term HAVING count(DISTINCT id) >= {LEAST}),
langs AS (SELECT lang, count(*)::HUGEINT AS v, sum(in_lang)::HUGEINT AS all_n FROM kept GROUP BY lang),
groups AS (SELECT DISTINCT lang, source FROM docs),
counts AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM words SEMI JOIN kept USING (lang, term) GROUP BY ALL),
totals AS (SELECT lang, source, sum(n)::HUGEINT AS total FROM counts GROUP BY ALL),
shares AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
    1 + {UNIT}::HUGEINT * (coalesce(c.n, 0) + 2) // (coalesce(t.total, 0) + 2 * l.v) AS p,
    1 + {UNIT}::HUGEINT * (k.in_lang + 2) // (l.all_n + 2 * l.v) AS q
  FROM groups g JOIN kept k ON g.lang = k.lang JOIN langs l ON g.lang = l.lang
  LEFT JOIN totals t ON g.lang = t.lang AND g.source = t.source
  LEFT JOIN counts c ON g.lang = c.lang AND g.source = c.source AND k.term = c.term),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(s.value, 0)::BIGINT AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (
    SELECT x.lang, x.source, y.source AS item, sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)) AS value
    FROM shares x JOIN shares y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL) s
  ON a.lang = s.lang AND a.source = s.source AND b.source = s.item),
terms AS (
  SELECT lang, source, term AS item, ((p - q) * (p - q) // (p + q))::BIGINT AS value FROM shares WHERE n > 0 AND p > q)
SELECT lang, source, 'pair' AS part, item, value,
  row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INT AS rank FROM pairs
UNION ALL
SELECT * FROM (
  SELECT lang, source, 'term' AS part, item, value,
    row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INT AS rank FROM terms)
WHERE rank <= {TOP}
"""
