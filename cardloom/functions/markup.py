"""Elements, attributes and text of web pages as string expressions.

What has several fields takes them ``raw`` and has them decoded together (``text.select_decoded``).

Pages are machine-made: attribute values are quoted and ``>`` does not occur inside them. Elements may hold elements of
the same tag: the text behind an opening tag is cut at each further tag of that name, and a running depth tells where
the element ends, as a tree search would. Comments, and scripts where they are not looked for, are to be taken out first
(``visible``, ``without_comments``). All this is linear in the page length and stays inside the JVM. Tag and attribute
names match in any case, values exactly.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from cardloom.functions.once import let
from cardloom.functions.text import decode_no_break_space, decode_references, strip

# A match can start only at "<" (or at white space), which lets the scan skip everything else quickly; ordinary tags
# are told apart by their second character and need no further try.
_MARKUP = (
    r"<(?:[^>!sS][^>]*+>"
    r"|!--.*?-->"
    r"|(?i:script)(?=[\s/>]).*?</(?i:script)\s*>"
    r"|(?i:style)(?=[\s/>]).*?</(?i:style)\s*>"
    r"|[^>]+>)"
)
# White space next to markup belongs to the text nodes and is stripped with it. The look-behind lets a run of white
# space be tried once, at its start, so that long runs cost linear time.
_MARKUP_AND_SPACE = rf"(?sU)(?:\s(?<!\s\s)\s*+)?{_MARKUP}\s*+"


def raw_element_text(html: Column) -> Column:
    """Text nodes joined as they are, references not decoded; comments, scripts and styles are not text."""
    return F.regexp_replace(html, f"(?s){_MARKUP}", "")


def element_text(html: Column) -> Column:
    """:func:`raw_element_text`, decoded."""
    return decode_references(raw_element_text(html))


def raw_stripped_text(html: Column) -> Column:
    """Text nodes stripped one by one and joined with nothing in between, references not decoded."""

    def stripped(text: Column) -> Column:
        # Both patterns need one certain character, and most texts of a page have neither.
        spaced = F.when(F.contains(text, F.lit("&")), decode_no_break_space(text)).otherwise(text)
        return F.when(F.contains(text, F.lit("<")), F.regexp_replace(spaced, _MARKUP_AND_SPACE, "")).otherwise(spaced)

    return strip(let(html, stripped))


def stripped_text(html: Column) -> Column:
    """:func:`raw_stripped_text`, decoded."""
    return decode_references(raw_stripped_text(html))


def has_class(token: str) -> str:
    """Attribute condition: ``token`` is one of the classes (or, with a space inside, the whole class value)."""
    value = re.escape(token)
    if " " in token:
        return rf"\s(?i:class)\s*=\s*(?:\"{value}\"|'{value}')"
    return (
        rf"\s(?i:class)\s*=\s*(?:\"(?:[^\">]*\s)?{value}(?:\s[^\">]*)?\"|'(?:[^'>]*\s)?{value}(?:\s[^'>]*)?')"
    )


def class_contains(part: str, ignore_case: bool = False) -> str:
    """Attribute condition: ``part`` occurs in the class value."""
    value = f"(?i:{re.escape(part)})" if ignore_case else re.escape(part)
    return rf"\s(?i:class)\s*=\s*(?:\"[^\">]*{value}[^\">]*\"|'[^'>]*{value}[^'>]*')"


def has_attribute(name: str) -> str:
    """Attribute condition: the attribute is there, with or without a value."""
    return rf"\s(?i:{re.escape(name)})(?=[\s=/>])"


def value_contains(name: str, part: str) -> str:
    """Attribute condition: ``part`` occurs in the value of the attribute."""
    value = re.escape(part)
    return rf"\s(?i:{re.escape(name)})\s*=\s*(?:\"[^\">]*{value}|'[^'>]*{value})"


def value_starts(name: str, prefix: str) -> str:
    """Attribute condition: the value of the attribute starts with ``prefix``."""
    return rf"\s(?i:{re.escape(name)})\s*=\s*[\"']{re.escape(prefix)}"


def opening(tag: str, *conditions: str) -> str:
    """Pattern of an opening tag that meets all conditions, in whatever order its attributes stand."""
    ahead = "".join(f"(?=[^>]*?{condition})" for condition in conditions)
    return rf"<(?i:{tag})(?=[\s/>]){ahead}[^>]*>"


def _whole(tag: str) -> str:
    """Pattern of an element whose inside holds no markup, from behind its ``<`` to its closing tag.

    Runs without ``<`` are passed in one go; trying the closing tag at each character of a script took most of the time.
    """
    return rf"(?i:{tag})(?=[\s/>]){_no_close(tag)}</(?i:{tag})\s*+>"


def _no_close(tag: str) -> str:
    """Pattern of all text up to the next closing tag of that name."""
    return rf"(?:[^<]++|<(?!/(?i:{tag})\s*+>))*+"


# As above, a match can start only at "<".
_HIDDEN = rf"<(?:!--(?s:.*?)-->|{_whole('script')}|{_whole('style')})"
# The look-ahead lets the scan skip all else: without it each character would be tried for both readings.
_COMMENT = rf"(?=<)(?:<!--(?s:.*?)-->|(<{_whole('script')}|<{_whole('style')}))"


def visible(html: Column) -> Column:
    """The page without comments, scripts and styles, which may hold what looks like elements."""
    return F.regexp_replace(html, _HIDDEN, "")


def without_comments(html: Column) -> Column:
    """The page without comments; what looks like one inside a script stays."""
    return F.regexp_replace(html, _COMMENT, "$1")


def scripts_of(html: Column) -> Column:
    """Insides of all scripts, in page order."""
    pattern = rf"<(?i:script)(?=[\s/>])[^>]*+>({_no_close('script')})</(?i:script)\s*+>"
    return F.regexp_extract_all(html, F.lit(pattern), F.lit(1))


def found(html: Column, pattern: str) -> Column:
    """Does the page hold a match?"""
    return F.rlike(html, F.lit(pattern))


def upto_end(behind: Column, tag: str) -> Column:
    """The inside of an element, from the text behind its opening tag; all of it if the element is never closed."""
    # The blank in front is the first piece's, so that the text behind it is never taken for it.
    return F.substring(first_level(F.split(F.concat(F.lit(" "), behind), rf"(?i)(?=</?{tag}[\s/>])")), 2, 1 << 30)


def first_level(pieces: Column) -> Column:
    """Pieces, cut in front of each tag of one name, joined up to the tag that closes what the first one is inside of."""
    start = F.struct(F.lit(1).alias("depth"), F.lit(1).alias("n"))

    def step(state: Column, piece: Column) -> Column:
        depth = state["depth"] + F.when(F.startswith(piece, F.lit("</")), -1).when(
            F.rlike(piece, F.lit("^<[^>]*/>")), 0
        ).otherwise(1)
        inside = F.struct(depth.alias("depth"), (state["n"] + F.when(depth > 0, 1).otherwise(0)).alias("n"))
        return F.when(state["depth"] > 0, inside).otherwise(state)

    def cut(parts: Column) -> Column:
        counted = F.aggregate(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), start, step)["n"]
        return F.array_join(F.slice(parts, F.lit(1), counted), "")

    return let(pieces, cut)


def inner(html: Column, tag: str, *conditions: str) -> Column:
    """Inside of the first such element, ``''`` if there is none.

    Where the next tag of that name closes the element, one match gives its inside. All else, empty elements too, gives
    nothing there and takes the way over the pieces.
    """
    first = opening(tag, *conditions)
    # Without a closing tag next the match goes on to the end, so that no later element is taken for the first.
    simple = F.regexp_extract(html, rf"(?s){first}(?:({_no_tag(tag)})</(?i:{tag})[\s/>]|.*)", 1)
    general = upto_end(F.regexp_extract(html, rf"(?s){first}(.*)", 1), tag)
    return let(simple, lambda inside: F.when(inside != "", inside).otherwise(general))


def _no_tag(tag: str) -> str:
    """Pattern of all text up to the next tag of that name, in linear time and without recursion."""
    return rf"(?:[^<]++|<(?!/?(?i:{tag})[\s/>]))*+"


def inners(html: Column, tag: str, *conditions: str) -> Column:
    """Insides of all such elements in page order, also of those that stand inside each other.

    Without conditions, and where the next tag of that name closes each element, one match an element gives its inside.
    Else the page is cut in front of each tag of that name. Where no two openings follow each other, an element is its piece;
    else a stack over the outline, a text of one letter per tag, finds where each one ends. An element that is never
    closed ends with the page, a closing tag without an opening one counts for nothing.
    """
    if conditions:
        return _inners_by_pieces(html, tag, *conditions)
    close = f"</{tag}>"
    # Every opening tag matches, but only one with a plain end and its closing tag next has a group.
    simple = F.regexp_extract_all(
        html, F.lit(rf"<(?i:{tag})(?=[\s/>])(?:[^<>]*+(?<!/)>({_no_tag(tag)}{close}))?"), F.lit(1)
    )

    def chosen(insides: Column) -> Column:
        cut = F.transform(insides, lambda inside: F.left(inside, F.char_length(inside) - len(close)))
        plain = F.forall(insides, lambda inside: inside != "")
        return F.when(plain, cut).otherwise(_inners_by_pieces(html, tag))

    return let(simple, chosen)


def _inners_by_pieces(html: Column, tag: str, *conditions: str) -> Column:
    pattern = opening(tag, *conditions)
    content = rf"(?s)^{pattern[:-1]}(?<!/)>(.*)"  # none of an element that its own tag closes

    def chosen(piece: Column) -> Column:
        if conditions:
            return F.rlike(piece, F.lit(f"^{pattern}"))
        return F.startswith(piece, F.lit("<")) & ~F.startswith(piece, F.lit("</"))

    def found_in(pieces: Column) -> Column:
        first = lambda piece: F.regexp_extract(piece, content, 1)
        flat = F.transform(F.filter(pieces, chosen), first)
        spans = F.filter(_spans(_outline(pieces)), lambda span: chosen(F.get(pieces, span["at"])))
        nested = F.transform(
            spans,
            lambda span: F.concat(
                first(F.get(pieces, span["at"])),
                F.array_join(F.slice(pieces, span["at"] + 2, F.greatest(span["upto"] - span["at"] - 1, F.lit(0))), ""),
            ),
        )
        begins = F.lower(F.array_join(F.transform(pieces, lambda piece: F.left(piece, F.lit(2))), ""))
        return F.when(F.contains(begins, F.lit(f"<{tag[0]}" * 2)), nested).otherwise(flat)

    # The blank in front is the first piece's, so that it is never taken for an element.
    return let(F.split(F.concat(F.lit(" "), html), rf"(?i)(?=</?{tag}[\s/>])"), found_in)


# Letters of an outline.
_OPENS, _CLOSES, _EMPTY, _OTHER = "o", "c", "e", "-"


def _outline(pieces: Column) -> Column:
    def kind(piece: Column) -> Column:
        return (
            F.when(F.startswith(piece, F.lit("</")), F.lit(_CLOSES))
            .when(~F.startswith(piece, F.lit("<")), F.lit(_OTHER))
            .when(F.rlike(piece, F.lit("^<[^>]*/>")), F.lit(_EMPTY))
            .otherwise(F.lit(_OPENS))
        )

    return F.array_join(F.transform(pieces, kind), "")


def _spans(outline: Column) -> Column:
    """``array<struct<at, upto>>``: the piece each element starts with and the one that ends it, in order."""
    span = "array<struct<at:int,upto:int>>"
    start = F.struct(F.array().cast("array<int>").alias("open"), F.array().cast(span).alias("done"))
    marks = F.transform(F.split(outline, ""), lambda mark, at: F.struct(mark.alias("mark"), at.alias("at")))

    def step(state: Column, mark: Column) -> Column:
        latest = F.struct(F.get(state["open"], F.lit(0)).alias("at"), mark["at"].alias("upto"))
        alone = F.struct(mark["at"].alias("at"), (mark["at"] + 1).alias("upto"))
        pushed = F.struct(F.concat(F.array(mark["at"]), state["open"]).alias("open"), state["done"].alias("done"))
        popped = F.struct(
            F.slice(state["open"], F.lit(2), F.greatest(F.size(state["open"]) - 1, F.lit(0))).alias("open"),
            F.concat(state["done"], F.array(latest)).alias("done"),
        )
        closed = F.struct(state["open"].alias("open"), F.concat(state["done"], F.array(alone)).alias("done"))
        return (
            F.when(mark["mark"] == _OPENS, pushed)
            .when((mark["mark"] == _CLOSES) & (F.size(state["open"]) > 0), popped)
            .when(mark["mark"] == _EMPTY, closed)
            .otherwise(state)
        )

    def finish(state: Column) -> Column:
        never = F.transform(state["open"], lambda at: F.struct(at.alias("at"), F.size(marks).alias("upto")))
        return F.array_sort(F.concat(state["done"], never))

    return F.aggregate(marks, start, step, finish)


def tag_of(html: Column, tag: str, *conditions: str) -> Column:
    """The first opening tag that meets the conditions, ``''`` if there is none."""
    return F.regexp_extract(html, opening(tag, *conditions), 0)


def tags_of(html: Column, tag: str, *conditions: str) -> Column:
    """All opening tags that meet the conditions, in page order."""
    return F.regexp_extract_all(html, F.lit(opening(tag, *conditions)), F.lit(0))


def raw_attribute(opening_tag: Column, name: str) -> Column:
    """Value of an attribute of an opening tag, references not decoded, ``''`` if it is not there."""
    return F.regexp_extract(opening_tag, rf"\s(?i:{re.escape(name)})\s*=\s*([\"'])((?s:.*?))\1", 2)


def attribute(opening_tag: Column, name: str) -> Column:
    """:func:`raw_attribute`, decoded."""
    return decode_references(raw_attribute(opening_tag, name))
