"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cardloom.llm.staging import staged

WEIGHTS = (5, 2, 1)
#: No document is repeated more often.
REPEATS = 3
#: Words in a block.
BLOCK = 64
#: Points of the golden-ratio sequence are multiples of 1 / POINTS; the multiplier is the odd number next to POINTS / phi.
POINTS, GOLDEN = 1 << 31, 1327217885
#: The unit interval in equal cells, which slots and sources are joined by.
CELLS = 4096
#: Slots whose ranks are counted together.
CHUNK = 1 << 16


def word_count(text: Column) -> Column:
    """Number of runs without space and the characters 9 to 13; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """``sid`` (rank by code point, null last), ``source``, ``source_size`` and ``target`` words of each source.

    Weights repeat over the sources. All targets together are all words; a target stops at ``repeats`` times its source,
    and the excess is shared again by weight. Sources are filled in order of the level at which they stop, so running
    sums tell where that ends. One row per source comes together in one task: the list of sources, never their rows.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = totals.select(
        "source",
        "source_size",
        (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1).alias("sid"),
    )
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("sid") % len(weights) + 1).cast("int")).cast("long")
    ranked = ranked.select("*", weight.alias("weight"))
    everything, stop = Window.partitionBy(), (repeats * F.col("source_size"))
    by_level = Window.orderBy(stop / F.col("weight"), "sid").rowsBetween(Window.unboundedPreceding, -1)
    level = ranked.select(
        "*",
        (F.sum("source_size").over(everything) - F.coalesce(F.sum(stop).over(by_level), F.lit(0))).alias("left"),
        (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(by_level), F.lit(0))).alias("heft"),
    )
    wide = "decimal(38,0)"
    above = F.col("weight").cast(wide) * F.col("left") > stop.cast(wide) * F.col("heft")
    level = level.select("*", above.alias("full"))
    rest = [F.max(F.when(~F.col("full"), F.struct("heft", "left"))).over(everything)[x] for x in ("left", "heft")]
    target = F.when(F.col("full"), stop.cast("double")).otherwise((F.col("weight") * rest[0]).cast("double") / rest[1])
    return level.select(F.col("sid").cast("long").alias("sid"), "source", "source_size", target.alias("target"))


def schedule(targets: DataFrame, block: int = BLOCK) -> DataFrame:
    """Slots of the mix in order: ``slot``, ``sid``, and ``rank``, which of its source's blocks the slot takes.

    The golden-ratio points fall on the sources in proportion to their targets, in every stretch of the schedule alike.
    Each point meets its source by an equi-join on its cell of the unit interval. Ranks are counted in two levels, over
    chunks of slots and inside a chunk, so that a source with most of the slots is no single task. Behind the slots that
    the words fill, each source gets those that the points have left it short of, so that its blocks cover its target
    however small it is, also where it is too small for a point of its own.
    """
    upto = Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, 0)
    whole = targets.select("sid", F.floor("target").alias("words")).select(
        "sid", "words", F.sum("words").over(upto).alias("end"), F.sum("words").over(Window.partitionBy()).alias("all")
    )
    edge = lambda x: F.floor(x / F.col("all") * POINTS)
    bands = whole.where("words > 0").select(
        "sid", edge(F.col("end") - F.col("words")).alias("low"), edge(F.col("end")).alias("high")
    )
    bands = bands.where("low < high")
    width = POINTS // CELLS
    cells = bands.select(
        "sid",
        "low",
        "high",
        F.explode(F.sequence(F.floor(F.col("low") / width), F.floor((F.col("high") - 1) / width))).alias("cell"),
    )
    slots_wanted = F.ceil(F.sum("words") / block)
    chunks = targets.select(F.floor("target").alias("words")).agg(slots_wanted.alias("n"))
    chunks = chunks.where("n > 0").select(
        "n", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / CHUNK))).alias("chunk")
    )
    numbers = F.sequence(F.col("chunk") * CHUNK, F.least((F.col("chunk") + 1) * CHUNK, F.col("n")) - 1)
    slots = chunks.repartition("chunk").select("chunk", F.explode(numbers).alias("slot"))
    slots = slots.select("chunk", "slot", ((F.col("slot") % POINTS) * GOLDEN % POINTS).alias("point"))
    slots = slots.select("*", F.floor(F.col("point") / width).alias("cell"))
    drawn = slots.join(cells, "cell").where("low <= point and point < high").select("chunk", "slot", "sid")
    drawn = staged(drawn, "mix-slots")

    counts = drawn.groupBy("sid", "chunk").agg(F.count("*").alias("n"))
    before = Window.partitionBy("sid").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select("sid", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    inside = F.row_number().over(Window.partitionBy("sid", "chunk").orderBy("slot")) - 1
    ranked = drawn.select("*", inside.alias("inside")).join(firsts, ["sid", "chunk"])
    ranked = ranked.select("slot", "sid", (F.col("first") + F.col("inside")).cast("long").alias("rank"))

    each = counts.groupBy("sid").agg(F.sum("n").alias("n"))
    short = targets.join(each, "sid", "left").select("sid", F.coalesce("n", F.lit(0)).alias("n"), (F.ceil(_quota() / block) - F.coalesce("n", F.lit(0))).alias("short"))
    sources_before = Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, -1)
    short = short.where("short > 0").withColumn("before", F.coalesce(F.sum("short").over(sources_before), F.lit(0)))
    last = drawn.agg(F.coalesce(F.max("slot"), F.lit(-1))).scalar()
    more = short.select("sid", "n", "before", F.explode(F.sequence(F.lit(0).cast("long"), F.col("short") - 1)).alias("i"))
    more = more.select((last + 1 + F.col("before") + F.col("i")).alias("slot"), "sid", (F.col("n") + F.col("i")).cast("long").alias("rank"))
    return ranked.unionByName(more)


def _quota(repeats: int = REPEATS) -> Column:
    """Words that the mix takes of a source: its target in whole words, never above its limit."""
    return F.least(F.round("target"), F.lit(repeats) * F.col("source_size")).cast("long")


def shuffled_line(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """Each row with its place on its source's line of words: ``start`` and ``number``, in the order of ``order_key``.

    Running sums in two levels: over the first three digits of the key, then inside such a group.
    """
    keyed = rows.join(targets, F.col("_source").eqNullSafe(F.col("source"))).drop("source")
    keyed = keyed.select("*", F.left("order_key", F.lit(3)).alias("_group"))
    groups = keyed.groupBy("sid", "_group").agg(F.sum("_size").alias("words"), F.count("*").alias("n"))
    before = Window.partitionBy("sid").orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)
    firsts = groups.select(
        "sid",
        "_group",
        F.coalesce(F.sum("words").over(before), F.lit(0)).alias("first_word"),
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first_row"),
    )
    own = Window.partitionBy("sid", "_group").orderBy("order_key", "doc_id", "_size")
    running = F.sum("_size").over(own.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_size")
    placed = keyed.select("*", running.alias("_words"), F.row_number().over(own).alias("_row"))
    placed = placed.join(firsts, ["sid", "_group"])
    return placed.withColumns(
        {"start": F.col("first_word") + F.col("_words"), "number": F.col("first_row") + F.col("_row")}
    ).drop("_group", "first_word", "first_row", "_words", "_row")


def taken_words(line: DataFrame, slots: DataFrame, block: int = BLOCK, repeats: int = REPEATS) -> DataFrame:
    """``sid``, ``number`` and ``taken``: the words that the scheduled blocks take of each row they meet.

    A source's line is laid out ``repeats`` times end to end and cut into blocks of equal words. A slot takes the block
    of its rank, up to the target. A row is joined to the blocks it lies in, and to nothing else.
    """
    quota = _quota(repeats)
    wanted = line.where("_size > 0").select("sid", "number", "_size", "start", "source_size", quota.alias("quota"))
    turns = wanted.select("*", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("turn"))
    turns = turns.select(
        "sid", "number", "quota", (F.col("start") + F.col("turn") * F.col("source_size")).alias("low"), "_size"
    )
    turns = turns.select("*", F.least(F.col("low") + F.col("_size"), F.col("quota")).alias("high")).where("low < high")
    first, last = F.floor(F.col("low") / block), F.floor((F.col("high") - 1) / block)
    pieces = turns.select("sid", "number", "low", "high", F.explode(F.sequence(first, last)).alias("rank"))
    met = pieces.join(slots.select("sid", "rank"), ["sid", "rank"])
    words = F.least("high", (F.col("rank") + 1) * block) - F.greatest("low", F.col("rank") * block)
    return met.groupBy("sid", "number").agg(F.sum(words).alias("taken"))


def mixed(docs: DataFrame, block: int = BLOCK, columns: Sequence[str] = ()) -> DataFrame:
    """Each row of ``docs`` (``doc_id``, ``text``, ``source``) with ``size``, ``source_size``, ``target``, ``start`` and ``taken``."""
    key = F.md5(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(F.coalesce("text", F.lit("")))))
    rows = docs.select(
        "doc_id", *columns, F.col("source").alias("_source"), word_count(F.col("text")).alias("_size"), key.alias("order_key")
    )
    rows = staged(rows, "mix-rows")
    targets = staged(source_targets(rows.select(F.col("_source").alias("source"), F.col("_size").alias("size"))), "mix-targets")
    line = staged(shuffled_line(rows, targets), "mix-line")
    taken = taken_words(line, schedule(targets, block), block)
    return line.join(taken, ["sid", "number"], "left").withColumn("taken", F.coalesce("taken", F.lit(0)))


def mix_digest(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per row of ``docs``: its size in words, its source's size and target, and the words the mix takes of it.

    No row is taken more than three times over. Sources of no words, and rows of no words, are taken 0 words of. A null
    text has none, a null source is a source and comes last, a null ``doc_id`` is shuffled as the empty text. The order is
    that of a hash of ``doc_id`` and text; rows that are equal in both are interchangeable. What is taken of a source is its
    target in whole words, however small it is. Other columns are not read. An empty
    table gives none. Reruns agree, as the order is that of a hash.
    """
    return mixed(docs, block).select(
        "doc_id", F.col("_size").alias("size"), "source_size", "target", F.col("taken").cast("long").alias("taken")
    )


def mix_documents(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """The mix as whole documents: a row of ``docs`` with all its columns, as often as the mix takes its words, rounded.

    So a row comes up to three times, a row of no words never, and only the row at the end of a source's target is rounded.
    """
    others = [c for c in docs.columns if c != "doc_id"]
    packed = docs.select("doc_id", "text", "source", F.struct(*[F.col(c).alias(f"_{i}") for i, c in enumerate(others)]).alias("_row_"))
    rows = mixed(packed, block, ["_row_"])
    copies = F.when(F.col("_size") > 0, F.round(F.col("taken") / F.col("_size"))).otherwise(0).cast("int")
    repeated = rows.where(copies > 0).select("doc_id", "_row_", F.explode(F.sequence(F.lit(1), copies)))
    return repeated.select(*[F.col("doc_id") if c == "doc_id" else F.col(f"_row_._{others.index(c)}").alias(c) for c in docs.columns])


MIX_SQL = f"""
WITH rows AS (
  SELECT row_number() OVER () AS rid, doc_id, source, md5(coalesce(doc_id::VARCHAR, '') || '|' || md5(coalesce(text, ''))) AS k,
    len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size
  FROM documents),
totals AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS sid
  FROM rows GROUP BY source),
ranked AS (SELECT *, [{", ".join(map(str, WEIGHTS))}][sid % {len(WEIGHTS)} + 1]::BIGINT AS weight FROM totals),
levels AS (
  SELECT *, {REPEATS} * source_size AS cap,
    (sum(source_size) OVER () - coalesce(sum({REPEATS} * source_size) OVER ({{by}}), 0))::HUGEINT AS rest,
    (sum(weight) OVER () - coalesce(sum(weight) OVER ({{by}}), 0))::HUGEINT AS heft
  FROM ranked),
filled AS (SELECT *, weight * rest > cap * heft AS is_full FROM levels),
common AS (
  SELECT arg_max(rest, heft) FILTER (NOT is_full) AS rest, max(heft) FILTER (NOT is_full) AS heft FROM filled),
targets AS (
  SELECT sid, source, source_size, least(round(target), cap)::BIGINT AS quota, target
  FROM (SELECT f.*, CASE WHEN is_full THEN cap::DOUBLE ELSE (weight * c.rest)::DOUBLE / c.heft END AS target
        FROM filled f CROSS JOIN common c)),
line AS (
  SELECT r.rid, r.doc_id, r.size, t.sid, t.source_size, t.target, t.quota,
    sum(r.size) OVER (PARTITION BY t.sid ORDER BY r.k, r.doc_id, r.size, r.rid) - r.size AS start
  FROM rows r JOIN targets t ON r.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  (SELECT sum(greatest(0, least(quota - start - e * source_size, size))) FROM (VALUES (0), (1), (2)) AS turns(e))::BIGINT AS taken
FROM line
""".replace("{by}", f"ORDER BY ({REPEATS} * source_size) / weight, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING")
