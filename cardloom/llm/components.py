"""Connected components of a graph of links, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardloom.llm.staging import staged

_HASH = "_hash"


def _star(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """Each pair (u, v) as (v, smallest neighbour of u). ``pairs`` holds v by u and may have very many rows of one u.

    The hash as a further key changes no match, but has Spark shuffle both sides, so that a hot u can be split.
    """
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    least = least.select("u", F.least("u", "m").alias("m"), F.xxhash64("u").alias(_HASH))
    joined = pairs.withColumn(_HASH, F.xxhash64("u")).join(least, ["u", _HASH])
    return joined.select(F.col("v").alias("u"), F.col("m").alias("v"))


def components(links: DataFrame, rounds: int = 100) -> DataFrame:
    """``node`` and ``root`` (the component's smallest node) of every node in ``links`` (``a``, ``b``, both long).

    Large stars hang every larger neighbour of a node on its smallest neighbour, small stars do so with the smaller
    neighbours; in turns they end in one star per component after about log(n) rounds. Each round is written to the
    shared folder. Loops and repeated links do no harm; nulls are no nodes. No links give no rows.
    """
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges, before = staged(edges, "links"), None
    for _ in range(rounds):
        state = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if state == before or not state["n"]:
            break
        before = state
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both, both.where("v > u")).where("u <> v").distinct()
        small = large.where("v < u")
        own = small.select("u").distinct().select("u", F.col("u").alias("v"))
        edges = staged(_star(small, small.unionByName(own)).where("u <> v").distinct(), "links")
    else:
        raise RuntimeError(f"components have not settled after {rounds} rounds")
    roots = edges.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("root"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
