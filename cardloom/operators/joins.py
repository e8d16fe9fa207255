"""Joins whose hot keys stay splittable."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_HASH = "_key_hash"


def hot_key_join(left: DataFrame, right: DataFrame, keys: str | Sequence[str], how: str = "inner") -> DataFrame:
    """Join ``left``, which may hold very many rows of one key, to ``right``, which has few per key.

    Adaptive execution splits a hot partition of ``left`` only if both sides are shuffled for the join. A ``right``
    that was just grouped by the keys is already in place and would not be, which leaves the hot key to one task. The
    hash of the keys as a further join key changes no match, but makes Spark shuffle both sides; the additional
    shuffle is that of the smaller side. A ``right`` that is small by Spark's measure is broadcast as ever.
    """
    names = [keys] if isinstance(keys, str) else list(keys)
    hashed = F.xxhash64(*names)
    joined = left.withColumn(_HASH, hashed).join(right.withColumn(_HASH, hashed), [*names, _HASH], how)
    return joined.drop(_HASH)


#: Places of the table that :func:`likely_rows` broadcasts: 8 MB at most, however many keys there are.
BITS = 1 << 26


def likely_rows(table: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """The rows whose ``key`` is among that of ``keys``, and few others, without a shuffle of ``table``.

    For wide rows such as pages: choose them so, make slim rows of them, and join those exactly. The keys are marked in a
    table of bits by their hash, which is of bounded size; with very many keys more other rows get through, never fewer
    of the wanted ones.
    """
    place = F.pmod(F.xxhash64(key), F.lit(BITS)) + 1
    marks = keys.select(place.alias("_place")).groupBy(F.bitmap_bucket_number("_place").alias("_bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("_place")).alias("_bits")
    )
    placed = table.select("*", place.alias("_place"))
    placed = placed.select("*", F.bitmap_bucket_number("_place").alias("_bucket"), F.bitmap_bit_position("_place").alias("_bit"))
    met = placed.join(F.broadcast(marks), "_bucket")
    byte = F.conv(F.hex(F.substring(F.col("_bits"), F.floor(F.col("_bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    marked = F.call_function("shiftright", byte, (F.col("_bit") % 8).cast("int")).bitwiseAND(1) == 1
    return met.where(marked).select(*table.columns)
