"""A z-fast trie of conversations: which beginnings they share.

A conversation is the sequence of its turns; its beginnings are known by 128-bit hashes. Nodes where paths part or end are
compacted: a node stands for the run of depths (``lo``, ``hi``] below its parent. It is found by its handle, the hash of
the beginning at the depth of that run that is divisible by the highest power of two. So the node at which a conversation
leaves the trie is found by a binary search over depths, with as many joins as a depth has binary digits, instead of one
for every turn.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from cardloom.llm.staging import drop_stage, staged
from cardloom.llm.words import mixed

#: Sequences of the first batch, about, and how much larger each batch is than all before it.
FIRST, GROWTH = 8192, 16
#: Conversations in a row share the first turns of one of them, up to three.
SHARING, HEADS = 20, 4
#: Ids in a piece of the text that a hash of member ids is worked out over.
IDS = 4096
_WORDS = "[^\\x20\\x09-\\x0D]+"
_EDGE = "lo int, p1 long, p2 long, h1 array<long>, h2 array<long>, words array<long>"
_LONGS = pa.list_(pa.int64())
_ARROW_EDGE = pa.schema([("lo", pa.int32()), ("p1", pa.int64()), ("p2", pa.int64()), ("h1", _LONGS), ("h2", _LONGS), ("words", _LONGS)])


# ---- conversations as sequences --------------------------------------------------------------------------------------


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """``conv_id``, ``pos`` from 0, two hashes of role and text, and the text's ``words``. Rows without a conversation id
    belong to none; turns of one number are ordered by role and text; rows that repeat are turns of their own."""
    text, role = (F.coalesce(F.col(name).cast("string"), F.lit("")) for name in ("text", "role"))
    turns = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("turn"), role.alias("role"), text.alias("text")
    )
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    return turns.select(
        "conv_id",
        (F.row_number().over(order) - 1).alias("pos"),
        F.xxhash64(F.lit(1), "role", "text").alias("t1"),
        F.xxhash64(F.lit(2), "role", "text").alias("t2"),
        F.regexp_count("text", F.lit(_WORDS)).cast("long").alias("words"),
    )


def rebuilt_turns(turns: DataFrame, sharing: int = SHARING, heads: int = HEADS) -> DataFrame:
    """Turns (``conv_id``, ``own``, ``pos`` …) of conversations that begin as the first of their ``sharing`` neighbours does.

    A conversation takes so many first turns from there as its id's checksum says, and keeps its own turns after as many.
    """
    taken = F.crc32(F.col("conv_id").cast("string")) % heads
    own = turns.where(F.col("pos") >= taken).withColumn("own", F.lit(1))
    ids = turns.select("conv_id").distinct().select("conv_id", (F.col("conv_id") - F.col("conv_id") % sharing).alias("first"), taken.alias("taken"))
    begin = turns.where(F.col("pos") < heads - 1).withColumnRenamed("conv_id", "first")
    lent = ids.where("taken > 0").join(begin, "first").where("pos < taken").withColumn("own", F.lit(0))
    columns = ["conv_id", "own", "pos", "t1", "t2", "words"]
    none = ids.select("conv_id", *[F.lit(None).cast(kind).alias(c) for c, kind in zip(columns[1:], ("int", "int", "long", "long", "long"))])
    return own.select(columns).unionByName(lent.select(columns)).unionByName(none)


def _with_prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        turns = batch.column("turns")
        flat, offsets = turns.flatten(), turns.offsets.to_numpy() - turns.offsets[0].as_py()
        place = (np.arange(len(flat)) - np.repeat(offsets[:-1], np.diff(offsets))).astype(np.uint64)
        columns = [batch.column("conv_id"), pa.array(np.diff(offsets).astype(np.int32))]
        for salt, name in ((1, "t1"), (2, "t2")):
            hashes = flat.field(name).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            sums = np.cumsum(mixed(hashes ^ mixed(place * np.uint64(2) + np.uint64(salt))), dtype=np.uint64)
            before = np.concatenate([np.zeros(1, dtype=np.uint64), sums])[offsets[:-1]]
            sums = mixed(sums - np.repeat(before, np.diff(offsets))).view(np.int64)
            columns.append(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(sums)))
        columns.append(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat.field("words").cast(pa.int64())))
        yield pa.RecordBatch.from_arrays(columns, names=["conv_id", "n", "h1", "h2", "words"])


def paths(turns: DataFrame) -> DataFrame:
    """A row per conversation: ``n`` turns, the hashes ``h1`` and ``h2`` of its beginnings of 1 to n turns, ``words`` of each."""
    turn = F.when(F.col("pos").isNotNull(), F.struct("own", "pos", "t1", "t2", "words"))
    gathered = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    return gathered.mapInArrow(_with_prefixes, "conv_id long, n int, h1 array<long>, h2 array<long>, words array<long>")


def _at(array: str, depth: Column) -> Column:
    """The hash of the beginning of a depth; 0 for the empty one, null beyond the end."""
    return F.when(depth == 0, F.lit(0).cast("long")).otherwise(F.get(array, depth - 1))


def sequences(of_conversations: DataFrame) -> DataFrame:
    """Conversations of the same turns as one row: their smallest id as ``conv_id``, and how many, ``members``."""
    keyed = of_conversations.select("*", _at("h1", F.col("n")).alias("e1"), _at("h2", F.col("n")).alias("e2"))
    path = F.struct("h1", "h2", "words")
    merged = keyed.groupBy("n", "e1", "e2").agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("members"), F.min_by(path, "conv_id").alias("path")
    )
    return merged.select("conv_id", "members", "n", "e1", "e2", "path.*")


# ---- the trie --------------------------------------------------------------------------------------------------------


def fattest(low: Column, high: Column) -> Column:
    """The number in (low, high] that the highest power of two divides."""
    digits = F.length(F.bin(low.bitwiseXOR(high)))
    return high.bitwiseAND(F.call_function("shiftleft", F.lit(-1), digits - 1))


def _trie(edges: DataFrame) -> DataFrame:
    """Nodes from their edges: depths, own hash ``e``, handle ``f`` with its hash, and the hash ``c`` of the edge's first turn."""
    hi = F.col("lo") + F.size("h1")
    nodes = edges.select("*", hi.alias("hi"), fattest(F.col("lo"), hi).alias("f"))
    inside = lambda array, depth: F.get(array, depth - F.col("lo") - 1)
    made = {f"{name}{i}": inside(f"h{i}", depth) for name, depth in (("e", F.col("hi")), ("f", F.col("f")), ("c", F.col("lo") + 1)) for i in (1, 2)}
    return nodes.withColumns(made)


def exit_points(batch: DataFrame, trie: DataFrame, longest: int) -> DataFrame:
    """``batch`` with the depth ``l`` up to which each sequence is in the trie and, where it ends inside the edge of a node,
    that node's edge as ``x_lo``, ``x1``, ``x2`` (depth of its parent, hash of its first turn).

    Each round probes one depth of every sequence that is still open: if a handle is there, the search goes on below its
    node, else above the depth. What is closed meets nothing, under its own id, so that it does not come together.
    """
    handles = trie.select("f", F.col("f1").alias("k1"), F.col("f2").alias("k2"), F.col("lo").alias("_lo"), F.col("hi").alias("_hi"),
                          F.col("e1").alias("_e1"), F.col("e2").alias("_e2"))
    zero = F.lit(0).cast("long")
    found = batch.select("*", F.lit(0).alias("low"), F.col("n").alias("high"), F.lit(0).alias("v_lo"), F.lit(0).alias("v_hi"),
                         zero.alias("v1"), zero.alias("v2"))
    for _ in range(longest.bit_length()):
        is_open = F.col("low") < F.col("high")
        probe = found.withColumn("f", F.when(is_open, fattest(F.col("low"), F.col("high"))).otherwise(-1))
        probe = probe.withColumns({f"k{i}": F.when(F.col("f") > 0, _at(f"h{i}", F.col("f"))).otherwise(F.col("conv_id")) for i in (1, 2)})
        probe = probe.join(handles, ["f", "k1", "k2"], "left")
        hit = F.col("_hi").isNotNull()
        # the search goes on below the node it has met
        found = probe.withColumns({
            "low": F.when(hit, F.col("_hi")).otherwise(F.col("low")),
            "high": F.when(~hit & (F.col("f") > 0), F.col("f") - 1).otherwise(F.col("high")),
            "v_lo": F.when(hit, F.col("_lo")).otherwise(F.col("v_lo")),
            "v_hi": F.when(hit, F.col("_hi")).otherwise(F.col("v_hi")),
            "v1": F.when(hit, F.col("_e1")).otherwise(F.col("v1")),
            "v2": F.when(hit, F.col("_e2")).otherwise(F.col("v2")),
        }).drop("f", "k1", "k2", "_lo", "_hi", "_e1", "_e2")
    passed = F.coalesce((_at("h1", F.col("v_hi")) == F.col("v1")) & (_at("h2", F.col("v_hi")) == F.col("v2")), F.lit(False))
    below = F.when(passed & (F.col("n") > F.col("v_hi")), F.col("v_hi") + 1).when(passed, F.lit(-1)).otherwise(F.col("v_lo") + 1)
    ask = found.withColumn("c", below)
    ask = ask.withColumns({f"k{i}": F.when(F.col("c") > 0, _at(f"h{i}", F.col("c"))).otherwise(F.col("conv_id")) for i in (1, 2)})
    edges = trie.select((F.col("lo") + 1).alias("c"), F.col("c1").alias("k1"), F.col("c2").alias("k2"), F.col("h1").alias("_h1"), F.col("h2").alias("_h2"))
    met = ask.join(edges, ["c", "k1", "k2"], "left")
    same = F.lit(0)
    own = [F.slice(f"h{i}", F.greatest(F.col("c"), F.lit(1)), F.greatest(F.size(f"_h{i}"), F.lit(0))) for i in (1, 2)]
    equal = [F.zip_with(own[i], F.col(f"_h{i + 1}"), lambda a, b: F.coalesce(a == b, F.lit(False))) for i in (0, 1)]
    same = F.size(F.filter(F.zip_with(*equal, lambda a, b: a & b), lambda x: x))
    inside = F.col("_h1").isNotNull()
    return met.select(
        "conv_id", "n", "h1", "h2", "words",
        F.when(inside, F.col("c") - 1 + same).otherwise(F.col("v_hi")).alias("l"),
        F.when(inside, F.col("c") - 1).alias("x_lo"),
        F.when(inside, F.col("k1")).alias("x1"),
        F.when(inside, F.col("k2")).alias("x2"),
    )


def _grown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of the compacted trees of sequences, which come in the order of their hashes, tree by tree.

    Only the latest sequence and the depths of its nodes are held, so a tree may be of any size.
    """
    key, low, last, depths, made = None, 0, None, [], []

    def close(down_to: int) -> None:
        while depths and depths[-1] > down_to:
            depth = depths.pop()
            top = max(depths[-1] if depths else low, down_to)
            before = (int(last[0][top - 1]), int(last[1][top - 1])) if top else (0, 0)
            made.append((top, *before, *(array[top:depth] for array in last)))

    def sent() -> pa.RecordBatch:
        columns = [pa.array([m[i] for m in made], f.type) for i, f in enumerate(_ARROW_EDGE)]
        made.clear()
        return pa.RecordBatch.from_arrays(columns, schema=_ARROW_EDGE)

    for batch in batches:
        lows, firsts = batch.column("l").to_pylist(), [batch.column(name).to_pylist() for name in ("g1", "g2")]
        arrays = [batch.column(name) for name in ("h1", "h2", "words")]
        for row, own in enumerate(zip(lows, *firsts)):
            now = [a[row].values.to_numpy(zero_copy_only=False) for a in arrays]
            if own != key:
                close(-1)
                key, low, depths = own, own[0], []
            else:
                n = min(len(last[0]), len(now[0]))
                differs = np.flatnonzero((last[0][:n] != now[0][:n]) | (last[1][:n] != now[1][:n]))
                common = int(differs[0]) if len(differs) else n
                close(common)
                if (depths[-1] if depths else low) < common:
                    depths.append(common)
            last = now
            depths.append(len(now[0]))
            if len(made) >= 10_000:
                yield sent()
    close(-1)
    if made:
        yield sent()


def inserted(trie: DataFrame | None, batch: DataFrame, longest: int) -> DataFrame:
    """The trie with a batch of different sequences: edges are cut where a sequence leaves or ends inside them, and what
    goes on from one point with one turn becomes a tree of its own below that point."""
    if trie is None:
        none = [F.lit(None).cast(kind) for kind in ("int", "long", "long")]
        at = batch.select("conv_id", "n", "h1", "h2", "words", F.lit(0).alias("l"), *[c.alias(x) for c, x in zip(none, ("x_lo", "x1", "x2"))])
    else:
        at = staged(exit_points(batch, trie, longest), "exit-points")
    new = at.where("n > l").select(
        "l", _at("h1", F.col("l") + 1).alias("g1"), _at("h2", F.col("l") + 1).alias("g2"), "h1", "h2", "words"
    )
    grown = new.repartition("l", "g1", "g2").sortWithinPartitions("l", "g1", "g2", "h1", "h2").mapInArrow(_grown, _EDGE)
    if trie is None:
        return staged(_trie(grown), "trie")
    cuts = at.where("x_lo is not null").groupBy("x_lo", "x1", "x2").agg(F.collect_set("l").alias("cuts"))
    cuts = cuts.select(F.col("x_lo").alias("lo"), F.col("x1").alias("c1"), F.col("x2").alias("c2"), "cuts")
    old = trie.join(cuts, ["lo", "c1", "c2"], "left")
    stops = F.array_sort(F.array_union(F.coalesce("cuts", F.array().cast("array<int>")), F.array("lo", "hi")))
    old = old.withColumn("stops", stops).select("*", F.posexplode(F.slice("stops", F.lit(1), F.size("stops") - 1)).alias("k", "start"))
    length = F.get("stops", F.col("k") + 1) - F.col("start")
    part = lambda array: F.slice(array, F.col("start") - F.col("lo") + 1, length)
    before = lambda i: F.when(F.col("k") == 0, F.col(f"p{i}")).otherwise(F.get(f"h{i}", F.col("start") - F.col("lo") - 1))
    pieces = old.select(F.col("start").alias("lo"), before(1).alias("p1"), before(2).alias("p2"), *[part(a).alias(a) for a in ("h1", "h2", "words")])
    larger = staged(_trie(pieces.unionByName(grown)), "trie")
    drop_stage(at)
    drop_stage(trie)
    return larger


def z_fast_trie(of_sequences: DataFrame, first: int = FIRST, growth: int = GROWTH) -> DataFrame | None:
    """The compacted nodes of different sequences, below the root; ``None`` if no sequence has a turn.

    Batches are chosen by hash and grow: what a batch adds below one point are sequences that share a beginning that no
    earlier batch has, which are few whatever the input's size. This is why the trees that grow in one place stay small.
    """
    some = of_sequences.where("n > 0")
    size = some.agg(F.count("*").alias("n"), F.max("n").alias("longest")).first()
    trie, low = None, 0
    draw = F.pmod(F.xxhash64(F.lit(3), "e1", "e2"), F.lit(1 << 30))
    upto = first
    while size["n"] and low < 1 << 30:
        high = min(1 << 30, -(-upto * (1 << 30) // size["n"])) if upto < size["n"] else 1 << 30
        batch = some.where((draw >= low) & (draw < high)).select("conv_id", "n", "h1", "h2", "words")
        if trie is not None or not batch.isEmpty():
            trie = inserted(trie, batch, size["longest"])
        low, upto = high, upto * growth
    return trie


# ---- what the nodes hold ---------------------------------------------------------------------------------------------


def _joined_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    key, held, names = None, [], ["n", "e1", "e2", "first", "ids"]

    def sent() -> pa.RecordBatch:
        row = [*key, held[0], ",".join(map(str, held))]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, (pa.int32(), *[pa.int64()] * 3, pa.string()))], names=names)

    ready = []
    for batch in batches:
        for *own, conv in zip(*(batch.column(name).to_pylist() for name in ("n", "e1", "e2", "conv_id"))):
            if held and (own != key or len(held) >= IDS):
                ready.append(sent())
                held = []
            key = own
            held.append(conv)
            if len(ready) >= 1000:
                yield pa.Table.from_batches(ready).combine_chunks().to_batches()[0]
                ready = []
    if held:
        ready.append(sent())
    if ready:
        yield pa.Table.from_batches(ready).combine_chunks().to_batches()[0]


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    key, digest, ready = None, None, []

    def sent() -> pa.RecordBatch:
        columns = [pa.array([r[i] for r in ready], t) for i, t in enumerate((pa.int32(), pa.int64(), pa.int64(), pa.string()))]
        ready.clear()
        return pa.RecordBatch.from_arrays(columns, names=["n", "e1", "e2", "ends_sha256"])

    for batch in batches:
        for *own, ids in zip(*(batch.column(name).to_pylist() for name in ("n", "e1", "e2", "ids"))):
            if own != key:
                if key:
                    ready.append((*key, digest.hexdigest()))
                key, digest = own, hashlib.sha256(ids.encode())
            else:
                digest.update(b"," + ids.encode())
        if ready:
            yield sent()
    if key:
        ready.append((*key, digest.hexdigest()))
        yield sent()


def end_digests(of_conversations: DataFrame) -> DataFrame:
    """SHA-256 of the ascending ids of the conversations that end at a node (``n``, ``e1``, ``e2``).

    Ids are put in order and joined to pieces in partitions by range, so that a node of very many members is dealt out;
    what comes together for one node are the pieces, one after another.
    """
    ends = of_conversations.select("n", _at("h1", F.col("n")).alias("e1"), _at("h2", F.col("n")).alias("e2"), "conv_id")
    order = ["n", "e1", "e2", "conv_id"]
    pieces = ends.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(
        _joined_ids, "n int, e1 long, e2 long, first long, ids string")
    keys = ["n", "e1", "e2"]
    return pieces.repartition(*keys).sortWithinPartitions(*keys, "first").mapInArrow(_digests, "n int, e1 long, e2 long, ends_sha256 string")


def conversation_trie(conversations: DataFrame, first: int = FIRST, growth: int = GROWTH) -> DataFrame:
    """A row per different beginning of the rebuilt conversations: ``conv_id`` (its smallest member), ``depth``,
    ``parent_conv_id``, ``n_convs``, ``n_children``, ``n_leaves``, ``saved_tokens``, ``ends_sha256``.

    Nodes come from the z-fast trie; its edges are expanded to a row per depth. Members, leaves and words are summed over
    the compacted nodes on the path of each different conversation. Words saved below a node are those of all members less
    those of all different beginnings, and each edge's words are counted by the conversation of the smallest id on it.

    Null role and text count as empty, a null turn comes first, turns of one number are ordered by role and text, rows that
    repeat are turns of their own, and rows without a conversation id are left out. Other columns are not read. An empty
    table gives no rows, not even the root.
    """
    of_conversations = staged(paths(rebuilt_turns(staged(ordered_turns(conversations), "turns"))), "paths")
    of_sequences = staged(sequences(of_conversations), "sequences")
    trie = z_fast_trie(of_sequences, first, growth)
    spark = conversations.sparkSession
    if trie is None:
        trie = _trie(spark.createDataFrame([], _EDGE))
    key = ["d", "k1", "k2"]
    named = lambda table, *names: table.select(*[F.col(n).alias(k) for n, k in zip(names, key)], *table.columns)

    inner = trie.select(F.col("lo").alias("n"), F.col("p1").alias("e1"), F.col("p2").alias("e2")).groupBy("n", "e1", "e2").agg(F.count("*").alias("n_children"))
    leafy = of_sequences.join(inner, ["n", "e1", "e2"], "left").withColumn("leaf", F.col("n_children").isNull().cast("long"))
    total = F.aggregate("words", F.lit(0).cast("long"), lambda s, w: s + w)
    steps = leafy.select("conv_id", "members", "leaf", "n", "h1", "h2", "words", total.alias("total"), F.explode(F.sequence(F.lit(0), "n")).alias("d"))
    upto = F.aggregate(F.slice("words", F.lit(1), F.col("d")), F.lit(0).cast("long"), lambda s, w: s + w)
    steps = steps.select("conv_id", "members", "leaf", "d", _at("h1", F.col("d")).alias("k1"), _at("h2", F.col("d")).alias("k2"), (F.col("total") - upto).alias("below"))
    root = spark.range(1).select(F.lit(0).alias("d"), F.lit(0).cast("long").alias("k1"), F.lit(0).cast("long").alias("k2"), F.lit(0).cast("long").alias("edge_words"))
    edges = named(trie.withColumn("edge_words", total), "hi", "e1", "e2").select(*key, "edge_words").unionByName(root)
    on_path = staged(steps.join(edges, key), "on-path")
    counts = on_path.groupBy(key).agg(
        F.min("conv_id").alias("least"), F.sum("members").alias("n_convs"), F.sum("leaf").alias("n_leaves"),
        F.sum(F.col("members") * F.col("below")).alias("all_below"),
    )
    counts = staged(counts, "node-counts")
    owned = on_path.join(counts.select(*key, "least"), key)
    mine = F.when(F.col("least") == F.col("conv_id"), F.col("edge_words")).otherwise(0)
    deeper = Window.partitionBy("conv_id").orderBy(F.desc("d")).rowsBetween(Window.unboundedPreceding, -1)
    different = owned.select(*key, F.coalesce(F.sum(mine).over(deeper), F.lit(0)).alias("words")).groupBy(key).agg(F.sum("words").alias("once"))
    children = named(inner, "n", "e1", "e2").select(*key, "n_children")
    ends = named(end_digests(of_conversations), "n", "e1", "e2").select(*key, "ends_sha256")
    nodes = counts.join(different, key).join(children, key, "left").join(ends, key, "left")
    nodes = nodes.withColumn("below", F.col("all_below") - F.col("once")).drop("all_below", "once")

    nobody = F.sha2(F.lit(""), 256)
    here = [F.coalesce("n_children", F.lit(0)).cast("long"), F.coalesce("ends_sha256", nobody)]
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    top = nodes.where("d = 0").select(*[c.alias(n) for c, n in zip(
        (F.col("least"), F.lit(0).cast("long"), F.lit(None).cast("long"), F.col("n_convs"), here[0], F.col("n_leaves"), F.col("below"), here[1]), names)])
    above = counts.select(F.col("d").alias("lo"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("least").alias("parent"))
    edges = named(trie.select("lo", "p1", "p2", "hi", "e1", "e2", "words"), "hi", "e1", "e2").drop("hi", "e1", "e2")
    edges = edges.join(nodes, key).join(above, ["lo", "p1", "p2"])
    rest = F.aggregate(F.slice("words", F.col("k") + 1, F.size("words")), F.lit(0).cast("long"), lambda s, w: s + w)
    runs = edges.select("*", F.posexplode("words").alias("k", "_w"))
    is_end = F.col("k") + 1 == F.size("words")
    below = runs.select(*[c.alias(n) for c, n in zip(
        (F.col("least"), (F.col("lo") + F.col("k") + 1).cast("long"), F.when(F.col("k") == 0, F.col("parent")).otherwise(F.col("least")), F.col("n_convs"),
         F.when(is_end, here[0]).otherwise(F.lit(1)).cast("long"), F.col("n_leaves"), F.col("below") + (F.col("n_convs") - 1) * rest,
         F.when(is_end, here[1]).otherwise(nobody)), names)])
    return top.unionByName(below)
