"""Sharding on a consistent-hash ring with virtual nodes and bounded loads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cardloom.llm.staging import staged

#: Places on the ring. A place with its splits is what loads are added up by, so their number bounds the small tables.
RING = 1 << 16
#: Splits of a place by the hash of ``doc_id``, so that many copies of one text are many groups of rows.
SPLITS = 256


def _ring(spark: SparkSession, shards: int, virtual: int) -> DataFrame:
    """Each place of the ring with the virtual node that follows it clockwise (``arc``, by ring order) and its shard."""
    nodes = spark.range(shards * virtual).select(
        F.floor(F.col("id") / virtual).cast("int").alias("shard"),
        F.xxhash64(F.lit("node"), F.floor(F.col("id") / virtual), F.col("id") % virtual).bitwiseAND(RING - 1).alias("place"),
    )
    nodes = nodes.groupBy("place").agg(F.min("shard").alias("shard"))  # of nodes at one place the first shard stands
    in_order = Window.orderBy("place")  # the ring has a fixed number of nodes
    ordered = nodes.select(
        "shard",
        (F.row_number().over(in_order) - 1).cast("long").alias("arc"),
        F.coalesce(F.lag("place").over(in_order) + 1, F.lit(0)).alias("first"),
        "place",
        F.lead("place").over(in_order).isNull().alias("last"),
        F.first("shard").over(in_order).alias("shard_0"),
    )
    places = ordered.select("arc", "shard", F.explode(F.sequence("first", "place")).alias("place"))
    beyond = ordered.where(F.col("last") & (F.col("place") < RING - 1)).select(
        F.lit(0).cast("long").alias("arc"),
        F.col("shard_0").alias("shard"),
        F.explode(F.sequence(F.col("place") + 1, F.lit(RING - 1).cast("long"))).alias("place"),
    )
    return places.unionByName(beyond)


def _flow(arcs: DataFrame, shards: int, capacity: Column) -> DataFrame:
    """Which stretch [low, high) of each arc's bytes goes to which shard.

    An arc's own shard takes its bytes up to the shard's capacity, in ring order. What is over queues clockwise: at each
    further node the front of the queue fills the free room of that node's shard. Two turns empty the queue, as all
    capacities together are at least the sum. One row per virtual node, so the work has a fixed size.
    """
    own = Window.partitionBy("shard").orderBy("arc").rowsBetween(Window.unboundedPreceding, -1)
    queue = Window.orderBy("arc").rowsBetween(Window.unboundedPreceding, 0)
    home = arcs.select("*", capacity.alias("capacity"))
    before = F.coalesce(F.sum("load").over(own), F.lit(0))
    home = home.select("*", F.greatest(F.lit(0), F.least(F.col("load"), F.col("capacity") - before)).alias("kept"))
    home = home.select("*", F.sum(F.col("load") - F.col("kept")).over(queue).alias("queued"))

    node = F.struct("arc", "shard", "load", "kept", "queued", "capacity")
    ring = home.agg(F.sort_array(F.collect_list(node)).alias("ring"))
    free = F.transform(
        F.sequence(F.lit(0), F.lit(shards - 1)),
        lambda s: F.aggregate(
            F.filter("ring", lambda n: n["shard"] == s),
            F.element_at("ring", 1)["capacity"],
            lambda room, n: room - n["kept"],
        ),
    )
    ring = ring.select("ring", free.alias("free"), F.size("ring").alias("n"))
    taken = "array<struct<shard:int,low:bigint,high:bigint>>"
    start = F.struct(F.lit(0).cast("long").alias("at"), F.col("free"), F.array().cast(taken).alias("taken"))

    def visit(state: Column, step: Column) -> Column:
        here = F.element_at("ring", (step % F.col("n") + 1).cast("int"))
        ready = F.when(step < F.col("n"), here["queued"]).otherwise(F.element_at("ring", -1)["queued"])
        room = F.element_at(state["free"], here["shard"] + 1)
        take = F.greatest(F.lit(0).cast("long"), F.least(room, ready - state["at"]))
        left = F.transform(state["free"], lambda f, s: F.when(s == here["shard"], f - take).otherwise(f))
        entry = F.struct(here["shard"].alias("shard"), state["at"].alias("low"), (state["at"] + take).alias("high"))
        grown = F.when(take > 0, F.concat(state["taken"], F.array(entry))).otherwise(state["taken"])
        return F.struct((state["at"] + take).alias("at"), left.alias("free"), grown.cast(taken).alias("taken"))

    walked = ring.select("ring", F.aggregate(F.sequence(F.lit(0), 2 * F.col("n") - 1), start, visit)["taken"].alias("taken"))
    nodes = walked.select("taken", F.explode("ring").alias("node")).select("taken", "node.*")
    head = F.col("queued") - (F.col("load") - F.col("kept"))  # the queue before this arc's part
    moved = F.transform(
        F.filter("taken", lambda t: (t["low"] < F.col("queued")) & (t["high"] > head)),
        lambda t: F.struct(
            t["shard"].alias("shard"),
            (F.col("kept") + F.greatest(t["low"], head) - head).alias("low"),
            (F.col("kept") + F.least(t["high"], F.col("queued")) - head).alias("high"),
        ),
    )
    home_part = F.struct(F.col("shard").alias("shard"), F.lit(0).cast("long").alias("low"), F.col("kept").alias("high"))
    parts = F.filter(F.concat(F.array(home_part).cast(taken), moved.cast(taken)), lambda p: p["low"] < p["high"])
    parts = F.when(F.col("kept") < F.col("load"), parts).otherwise(F.array(home_part).cast(taken))
    return nodes.select("arc", F.inline(parts))


def shard_documents(
    docs: DataFrame, shards: int = 8, virtual: int = 64, slack_permille: int = 1, columns: list[str] | None = None
) -> DataFrame:
    """One row per row of ``docs`` (``doc_id``, ``text``): ``shard`` from 0, and ``slot``, gapless from 0 in each shard.

    A text's hash is its place on the ring, and the next virtual node clockwise its home, so equal texts share a home.
    No shard takes more than ``1 + slack_permille / 1000`` times its even share of bytes (UTF-8 bytes plus one each), but
    for part of one row; what a full shard can't take continues clockwise. A group of copies that is larger than a shard
    is spread over as many shards as it needs, by the hash of ``doc_id``.

    Row offsets and slots are running sums in two levels: sums of small groups of rows first, then rows inside a group;
    a place's rows are split by ``doc_id``, so no window holds one hot text. Rows that are equal in ``doc_id`` and text
    are interchangeable, which is all that ties can be; a rerun gives the same shard sizes and set of slots.

    Null texts count as empty with a hash of their own; a null ``doc_id`` stays null. ``columns`` are passed through;
    names used here may clash with none of them, others are not read. An empty table gives none.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    size = F.octet_length(text).cast("long") + 1
    rows = docs.select(
        "doc_id",
        *(columns or []),
        size.alias("_size"),
        F.crc32(text).alias("_crc"),
        F.xxhash64("text").bitwiseAND(RING - 1).alias("_place"),
        F.pmod(F.xxhash64(F.lit("split"), "doc_id"), F.lit(SPLITS)).cast("int").alias("_split"),
    )
    rows = staged(rows, "shard-rows")
    ring = F.broadcast(_ring(docs.sparkSession, shards, virtual))  # RING rows

    group = ["_arc", "_place", "_split"]
    places = ring.select(F.col("place").alias("_place"), F.col("arc").alias("_arc"), F.col("shard").alias("_home"))
    groups = rows.groupBy("_place", "_split").agg(F.sum("_size").alias("bytes")).join(places, "_place")
    earlier = Window.partitionBy("_arc").orderBy("_place", "_split").rowsBetween(Window.unboundedPreceding, -1)
    starts = groups.select(*group, F.coalesce(F.sum("bytes").over(earlier), F.lit(0)).alias("_start"))

    arcs = (
        groups.groupBy("_arc")
        .agg(F.sum("bytes").alias("bytes"))
        .join(ring.groupBy("arc", "shard").agg(F.lit(1).alias("one")), F.col("_arc") == F.col("arc"), "right")
        .select("arc", "shard", F.coalesce("bytes", F.lit(0)).alias("load"))
    )
    total = F.sum("load").over(Window.partitionBy())
    share = F.floor(total * (1000 + slack_permille) / F.lit(1000 * shards)) + 1
    flow = _flow(arcs, shards, share)

    own = Window.partitionBy(*group).orderBy("doc_id", "_crc", "_size")
    inside = F.sum("_size").over(own.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_size")
    placed = rows.join(places.drop("_home"), "_place").select("*", inside.alias("_inside"))
    placed = placed.join(starts, group)
    middle = 2 * (F.col("_start") + F.col("_inside")) + F.col("_size")
    parts = F.broadcast(flow.select(F.col("arc").alias("_arc"), F.col("shard").alias("_shard"), "low", "high"))
    fits = (2 * F.col("low") <= middle) & (middle < 2 * F.col("high"))
    sharded = staged(placed.join(parts, "_arc").where(fits).drop("low", "high", "_start"), "shard-groups")

    counts = sharded.groupBy("_shard", *group).agg(F.count("*").alias("rows"))
    ahead = Window.partitionBy("_shard").orderBy(*group).rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select("_shard", *group, F.coalesce(F.sum("rows").over(ahead), F.lit(0)).alias("_first"))
    number = F.row_number().over(Window.partitionBy("_shard", *group).orderBy("_inside")) - 1
    numbered = sharded.select("*", number.alias("_number")).join(firsts, ["_shard", *group])
    return numbered.select(
        "doc_id",
        *(columns or []),
        F.col("_size").alias("size"),
        F.col("_crc").alias("text_crc32"),
        F.lit("bytes").alias("law"),
        F.col("_shard").cast("int").alias("shard"),
        (F.col("_first") + F.col("_number")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
