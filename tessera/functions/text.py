"""Text semantics shared by all operators, as column expressions.

Lengths and slices count code points, which equals UTF-16 units for text of the basic plane;
``utf16_length`` counts the units. White space is the wide class, word edges are ASCII.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as JavaScript has it, and as rendered bodies have it (with U+200B).
WS = r"[\t-\r    -     　﻿]"
WS_CHARS = "\t\n\x0b\x0c\r \xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
RENDER_WS = r"[\t-\r    -​    　﻿]"
#: White space of rendered bodies within a line.
BLANK = "[" + r"\t\x0b-\r" + RENDER_WS.removeprefix(r"[\t-\r")
#: Fixed value: the box-drawing characters of visual separators.
BOX = "┌┐└┘├┤┬┴┼─│┏┓┗┛┣┫┳┻╋━┃╭╮╰╯╔╗╚╝╠╣╦╩╬═║╞╡╤╧╪╟╢╥╨╫╒╕╘╛╓╖╙╜┄┅┈┉┆┇┊┋╎╏"


def word(alternatives: str) -> str:
    """A pattern for whole ASCII words."""
    return f"(?<![A-Za-z0-9_])(?:{alternatives})(?![A-Za-z0-9_])"


def lit(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def bound(x: Column, use: Callable[[Column], Column]) -> Column:
    """use(x), with x worked out once however often it is used."""
    return F.element_at(F.transform(F.array(x), use), 1)


def utf16_length(x: Column) -> Column:
    return (F.octet_length(F.encode(x, "UTF-16BE")) / 2).cast("long")


def compact(x: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.coalesce(x, F.lit("")), f"{WS}+", " "), "^ | $", "")


def trim_ws(x: Column) -> Column:
    return F.btrim(x, F.lit(WS_CHARS))


def sha256(x: Column) -> Column:
    return F.sha2(x, 256)


def byte_length(x: Column) -> Column:
    return F.octet_length(x)


def tokens(chars: Column) -> Column:
    """A token for each four characters, rounded up."""
    return F.ceil(chars / 4).cast("long")


def or_else(x: Column, other: Column) -> Column:
    """other where x is null or empty."""
    return F.coalesce(F.nullif(x, F.lit("")), other)


def half_up(x: Column, digits: int = 0) -> Column:
    """Rounding with halves towards plus infinity."""
    scale = 10**digits
    return F.floor(x * scale + 0.5) / scale


def drop_newline_start(x: Column) -> Column:
    return F.regexp_replace(x, r"\A\n", "")


def drop_newline_end(x: Column) -> Column:
    return F.regexp_replace(x, r"\n\z", "")


def xml_escape(x: Column) -> Column:
    for a, b in (("&", "&amp;"), ('"', "&quot;"), ("<", "&lt;"), (">", "&gt;")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def xml_unescape(x: Column) -> Column:
    for a, b in (("&gt;", ">"), ("&lt;", "<"), ("&quot;", '"'), ("&amp;", "&")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def xml_attributes(x: Column) -> Column:
    """name="value" pairs as a map; of repeated names the last counts."""
    names, values = (F.regexp_extract_all(x, F.lit(r'([A-Za-z_][A-Za-z0-9_-]*)="([^"]*)"'), F.lit(i)) for i in (1, 2))
    last = F.map_from_entries(F.transform(F.array_distinct(names), lambda n: F.struct(n.alias("k"), xml_unescape(F.element_at(F.filter(F.transform(names, lambda m, i: F.when(m == n, F.element_at(values, i + 1))), lambda v: v.isNotNull()), -1)).alias("v"))))
    return last


def cell(x: Column) -> Column:
    """Text for a markdown table cell."""
    return F.regexp_replace(F.replace(F.coalesce(x.cast("string"), F.lit("")), F.lit("|"), F.lit(r"\|")), r"\r?\n", " ")


def row_field(x: Column) -> Column:
    """A value that can stand in a pipe-delimited row."""
    return F.replace(F.regexp_replace(F.coalesce(x.cast("string"), F.lit("")), f"{WS}+", "_"), F.lit("|"), F.lit("/"))


def normal_code(x: Column) -> Column:
    """Line feeds only, no blanks at line ends, no empty lines at the end."""
    x = F.regexp_replace(F.coalesce(x, F.lit("")), r"\r\n|\r", "\n")
    return F.regexp_replace(F.regexp_replace(x, r"(?m)[ \t]+$", ""), r"\n+\z", "")


def leading_int(x: Column) -> Column:
    """The integer a string begins with, else null."""
    return F.nullif(F.regexp_extract(x.cast("string"), rf"^{WS}*([+-]?\d+)", 1), F.lit("")).try_cast("long")


def fence(x: Column) -> Column:
    """Backticks enough to enclose x: one more than its longest run, at least three."""
    runs = F.transform(F.regexp_extract_all(F.coalesce(x, F.lit("")), F.lit("`+"), F.lit(0)), F.length)
    return F.repeat(F.lit("`"), F.greatest(F.lit(3), F.coalesce(F.array_max(runs), F.lit(0)) + 1))


def lines(x: Column) -> Column:
    return F.split(x, "\n")


def first_distinct(items: Column, most: int) -> Column:
    """Compacted, non-empty, distinct items in order of first appearance, at most ``most``."""
    return F.slice(F.array_distinct(F.filter(F.transform(items, compact), lambda t: t != "")), 1, most)


def is_uuid(x: Column) -> Column:
    return x.rlike(r"^[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}$")


def is_sha256(x: Column) -> Column:
    return x.rlike("^[0-9a-f]{64}$")


def is_range(a: Column, b: Column) -> Column:
    return a.isNotNull() & b.isNotNull() & (a >= 0) & (b >= a)


def fingerprint(x: Column) -> Column:
    """Digest of a value's JSON."""
    return sha256(F.to_json(x))
