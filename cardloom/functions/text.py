"""Text rules: trimming, blank tests, truncation, character references."""

from __future__ import annotations

import zlib
from collections.abc import Sequence
from html.entities import html5

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardloom.functions.once import let, select_once

NO_BREAK_SPACE = "\u00a0"

# --- fixed values: characters that count as white space ---------------------------------------------------------------
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def strip(text: Column) -> Column:
    """Remove white space at both ends, ideographic and no-break spaces included (``trim`` removes U+0020 only)."""
    return F.btrim(text, F.lit(WHITE_SPACE))


def is_blank(text: Column) -> Column:
    """Missing, empty or only white space."""
    return F.coalesce(strip(text), F.lit("")) == ""


def or_empty(text: Column) -> Column:
    """NULL becomes the empty string."""
    return F.coalesce(text, F.lit(""))


def truncate(text: Column, width: int) -> Column:
    """The first ``width`` code points."""
    return F.left(text, F.lit(width))


def clean_lines(text: Column) -> Column:
    """Line feeds become spaces, ends are stripped, inner runs stay."""
    return strip(F.replace(text, F.lit("\n"), F.lit(" ")))


def decode_references(text: Column) -> Column:
    """Decode all named and numeric character references, each once; what is no reference stays.

    The text is cut in front of every ``&``; each piece then starts with at most one reference, is decoded by itself and
    joined again, so nothing decodes twice. Texts without ``&`` are left alone.
    """

    def decode(bound: Column) -> Column:
        pieces = F.transform(F.split(bound, "(?=&)"), _decoded)
        return F.when(F.contains(bound, F.lit("&")), F.array_join(pieces, "")).otherwise(bound)

    return let(text, decode)


def select_decoded(
    table: DataFrame, keep: Sequence[str | Column], texts: dict[str, Column], also: Sequence[Column] = ()
) -> DataFrame:
    """The ``keep`` columns, the ``also`` ones (aliased), and ``texts`` by name with their references decoded.

    The texts of a row are gathered in one array and decoded in one place, so the table of names is in the plan once,
    however many fields a page has.
    """
    raw = select_once(table, keep, *also, F.array(*texts.values()).alias("_raw"))
    kept = [name for name in raw.columns if name != "_raw"]
    decoded = select_once(raw, kept, F.transform("_raw", decode_references).alias("_texts"))
    return decoded.select(*kept, *[F.get("_texts", F.lit(i)).alias(name) for i, name in enumerate(texts)])


# A reference by name or number. Names without a semicolon are the few old ones that browsers know that way.
_REFERENCE = r"^&(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});"
_OLD_REFERENCE = rf"^&({'|'.join(sorted((n for n in html5 if not n.endswith(';')), key=len, reverse=True))})"


def _decoded(piece: Column) -> Column:
    parts = F.struct(
        piece.alias("piece"),
        F.regexp_extract(piece, _REFERENCE, 1).alias("whole"),
        F.regexp_extract(piece, _OLD_REFERENCE, 1).alias("old"),
    )
    # The commonest by far needs no search of the tables.
    ampersand = F.concat(F.lit("&"), F.substring(piece, 6, F.char_length(piece)))
    return (
        F.when(~F.startswith(piece, F.lit("&")), piece)
        .when(F.startswith(piece, F.lit("&amp;")), ampersand)
        .otherwise(let(parts, _character_and_rest))
    )


def _character_and_rest(parts: Column) -> Column:
    piece, whole, old = parts["piece"], parts["whole"], parts["old"]
    after = lambda name, more: F.substring(piece, F.char_length(name) + 1 + more, F.char_length(piece))
    number = F.when(F.rlike(whole, F.lit("^#[xX]")), F.conv(F.substring(whole, 3, 8), 16, 10)).otherwise(
        F.substring(whole, 2, 8)
    )
    # Both readings of a name go through one lookup, so that its table stands in the plan once.
    readings = F.array(
        F.struct(F.concat(whole, F.lit(";")).alias("name"), after(whole, 2).alias("rest")),
        F.struct(F.nullif(old, F.lit("")).alias("name"), after(old, 1).alias("rest")),
    )
    named = F.transform(readings, lambda reading: F.struct(_named(reading["name"]).alias("text"), reading["rest"].alias("rest")))
    known = F.transform(F.filter(named, lambda it: it["text"] != ""), lambda it: F.concat(it["text"], it["rest"]))
    return F.coalesce(
        F.when(F.startswith(whole, F.lit("#")), F.concat(_character(number.try_cast("int")), after(whole, 2))),
        F.get(known, F.lit(0)),
        piece,
    )


# The standard library's table of named references as lines of name and characters, dealt into short texts by the
# checksum of the name: a search in a literal text costs less than building a map for each row.
_BUCKETS, _LINE, _IS = 16, "\x01", "\x02"


def _dealt() -> list[str]:
    dealt = [_LINE] * _BUCKETS
    for key, character in html5.items():
        dealt[zlib.crc32(key.encode()) % _BUCKETS] += f"{key}{_IS}{character}{_LINE}"
    return dealt


_NAMES = _dealt()


def _named(name: Column) -> Column:
    lines = F.get(F.array(*map(F.lit, _NAMES)), (F.crc32(name) % _BUCKETS).cast("int"))
    start = F.concat(F.lit(_LINE), name, F.lit(_IS))
    # Lines begin with their mark, so where the name is not found the part in front of the first mark is empty.
    return F.substring_index(F.call_function("substring_index", lines, start, F.lit(-1)), _LINE, 1)


def _character(number: Column) -> Column:
    """The character of a code point, U+FFFD for those that are none; 128 to 159 count as Windows-1252."""
    odd = F.when(number.between(128, 159), F.substring(F.lit(_WINDOWS), number - 127, F.lit(1)))
    high = F.hex(
        F.when(number < 0x80, number)
        .when(number < 0x800, 0xC080 + F.shiftright(number, 6) * 256 + number.bitwiseAND(63))
        .when(
            number < 0x10000,
            0xE08080 + F.shiftright(number, 12) * 65536 + F.shiftright(number, 6).bitwiseAND(63) * 256 + number.bitwiseAND(63),
        )
        .otherwise(
            F.lit(0xF0808080)
            + F.shiftright(number, 18).cast("bigint") * 16777216
            + F.shiftright(number, 12).bitwiseAND(63) * 65536
            + F.shiftright(number, 6).bitwiseAND(63) * 256
            + number.bitwiseAND(63)
        )
        .cast("bigint")
    )
    none = (number == 0) | (number > 0x10FFFF) | number.between(0xD800, 0xDFFF)
    return F.when(none, F.lit("\ufffd")).otherwise(F.coalesce(odd, F.decode(F.unhex(high), "UTF-8")))


_WINDOWS = "".join(bytes([n]).decode("cp1252", "ignore") or chr(n) for n in range(128, 160))


def decode_no_break_space(text: Column) -> Column:
    """Decode only the no-break space, which takes part in white space rules before the markup is removed."""
    return F.regexp_replace(text, "&(?:nbsp|#160|#[xX][aA]0);", NO_BREAK_SPACE)


def scalar_text(value: Column) -> Column:
    """Text of a JSON scalar held as VARIANT: absent gives ``''``, null ``'None'``, booleans ``'True'``/``'False'``."""
    text = value.cast("string")
    return (
        F.when(value.isNull(), F.lit(""))
        .when(F.is_variant_null(value), F.lit("None"))
        .when(F.schema_of_variant(value) == "BOOLEAN", F.initcap(text))
        .otherwise(text)
    )
