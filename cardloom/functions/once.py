"""Work done once.

The optimizer merges projections and pushes filters below them by copying expressions, and a lambda evaluates what it
refers to once per element. That is right for cheap expressions and ruinous for regular expressions over whole pages.
These helpers bind a costly value first: to a lambda variable inside an expression, or by a generator between two
projections, through which nothing is merged or pushed.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, with ``value`` evaluated once however often ``body`` uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def select_once(table: DataFrame, keep: Sequence[str | Column], *computed: Column) -> DataFrame:
    """The ``keep`` columns and the computed ones (aliased), each evaluated once per row.

    Later filters run on the outcome. All computed columns are evaluated, so leave out what is not needed.
    """
    return table.select(*keep, F.inline(F.array(F.struct(*computed))))


def explode_once(table: DataFrame, keep: Sequence[str | Column], array: Column, position: str, value: str) -> DataFrame:
    """The ``keep`` columns with position and value of every array element; the array is evaluated once per row.

    The outer form keeps Spark from inferring a filter on the array size, which would evaluate the array twice.
    """
    return table.select(*keep, F.posexplode_outer(array).alias(position, value)).where(F.col(position).isNotNull())
