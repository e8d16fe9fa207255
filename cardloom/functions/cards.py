"""Names, codes and ranks of cards and decks."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from cardloom.constants import ENERGY_MARKERS, NAME_AND_CODE, OTHER_RANK_SUFFIX, RANK_SUFFIXES, RANK_UNIT
from cardloom.functions.text import strip

_NAME_AND_CODE = f"(?d){NAME_AND_CODE}"  # only a line feed ends a line


def card_name_of(full_name: Column) -> Column:
    """``X`` of ``X(CODE)``, split at the last bracket; the whole text if there is no code."""
    return F.when(
        F.rlike(full_name, F.lit(_NAME_AND_CODE)), strip(F.regexp_extract(full_name, _NAME_AND_CODE, 1))
    ).otherwise(full_name)


def card_code_of(full_name: Column) -> Column:
    """``CODE`` of ``X(CODE)``, ``''`` if there is no code."""
    return strip(F.regexp_extract(full_name, _NAME_AND_CODE, 2))


def card_key(name: Column, code: Column) -> Column:
    """``name (code)``, or only the name where the code is missing or empty (white space is a code here)."""
    return F.when(F.coalesce(code, F.lit("")) != "", F.concat(name, F.lit(" ("), code, F.lit(")"))).otherwise(name)


def joined_name(prefix: Column, name: Column, separator: str) -> Column:
    """``prefix + separator + name`` if both are there, else the name."""
    both = (F.coalesce(prefix, F.lit("")) != "") & (F.coalesce(name, F.lit("")) != "")
    return F.when(both, F.concat(prefix, F.lit(separator), name)).otherwise(F.coalesce(name, F.lit("")))


def is_key_card(name: Column, markers: Sequence[str] = ENERGY_MARKERS) -> Column:
    """A named card that is no energy card (case-sensitive)."""
    return reduce(
        lambda kept, marker: kept & ~F.contains(name, F.lit(marker)), markers, F.coalesce(name, F.lit("")) != ""
    )


def rank_label(rank: Column) -> Column:
    """``1位`` becomes ``1st``. Only 1, 2 and 3 have a suffix of their own, so 21 gives ``21th`` and blank ``th``."""
    number = F.replace(F.coalesce(rank, F.lit("")), F.lit(RANK_UNIT), F.lit(""))
    suffix = F.lit(OTHER_RANK_SUFFIX)
    for value, text in RANK_SUFFIXES.items():
        suffix = F.when(number == value, F.lit(text)).otherwise(suffix)
    return F.concat(number, suffix)


def deck_file_name(rank: Column, deck_id: Column) -> Column:
    """File name of a stored deck with its rank label."""
    return F.concat(F.lit("deck_"), rank_label(rank), F.lit("_"), deck_id, F.lit(".json"))


def number_of(code: Column) -> Column:
    """Card number of a code, the part after its last space."""
    return F.when(F.contains(code, F.lit(" ")), F.substring_index(code, " ", -1)).otherwise(F.lit(""))


def set_of(code: Column) -> Column:
    """Set name of a code, the part before its last space; the whole code if there is no space."""
    return F.regexp_replace(F.coalesce(code, F.lit("")), r"(?s) [^ ]*$", "")
