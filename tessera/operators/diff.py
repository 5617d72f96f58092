"""Formatting of tool calls and their results; line differences."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.text import drop_newline_end, or_else, sha256, trim_ws
from tessera.sources.transcripts import get, part_text, text_of

#: Fixed values of the formats.
CONTEXT, SMALL_EDIT, WRITE_HEAD, WRITE_TAIL = 3, 400, 40, 10
PAIRS = "array<struct<type:string,line:string,count:int>>"


def relative(path: Column, prefix: Column) -> Column:
    """A path without the prefix and the slashes behind it; others, and the prefix itself, as they are; (unknown) where there is none."""
    path, prefix = trim_ws(F.coalesce(path, F.lit(""))), F.coalesce(prefix, F.lit(""))
    rest = F.regexp_replace(F.substring(path, F.length(prefix) + 1, F.length(path)), "^/+", "")
    return or_else(F.when((prefix != "") & F.startswith(path, prefix), or_else(rest, path)).otherwise(path), F.lit("(unknown)"))


def first_of(v: Column, *names: str) -> Column:
    return F.coalesce(*(F.nullif(text_of(v, f"$.{n}"), F.lit("")) for n in names), F.lit(""))


def edits(input_: Column) -> Column:
    """array<struct<old,new>> of an edit input, under any of its names; several where it has ``edits``."""
    some = lambda v, *names: F.coalesce(*(get(v, f"$.{n}") for n in names), F.lit(""))
    one = lambda v: F.struct(some(v, "old_str", "old_string", "oldString").alias("old"), some(v, "new_str", "new_string", "newString").alias("new"))
    many = F.try_variant_get(input_, "$.edits", "array<variant>")
    return F.when(F.size(many) > 0, F.transform(many, one)).otherwise(F.array(one(input_)))


def file_of(input_: Column) -> Column:
    return first_of(input_, "file_path", "path", "filePath")


def _codes(*texts: str) -> tuple[list[str], list[np.ndarray]]:
    """The texts' distinct lines, and each text as numbers of its lines."""
    number: dict[str, int] = {}
    coded = [np.array([number.setdefault(x, len(number)) for x in re.split("\r\n|\r|\n", t or "")]) for t in texts]
    return list(number), coded


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """How many leading values agree."""
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[:n] != b[:n])
    return int(differ[0]) if len(differ) else n


def _above(x: int, b: np.ndarray, below: np.ndarray) -> np.ndarray:
    """Lengths of the longest common subsequences of x + (the lines of below) with each end of b, from those without x."""
    best = np.where(b == x, below[1:] + 1, below[:-1])
    return np.append(np.maximum.accumulate(best[::-1])[::-1], 0)


def _script(a: np.ndarray, b: np.ndarray) -> Iterator[tuple[str, int]]:
    """Kinds and lines that turn a into b by a longest common subsequence; where a removal and an addition leave equally much in common, the removal is first.

    Rows of lengths are kept at every root-th line and made again between them, so memory is the root of the work.
    """
    m, n = len(a), len(b)
    step = max(1, math.isqrt(m))
    saved, row = {m: np.zeros(n + 1, np.int32)}, np.zeros(n + 1, np.int32)
    for i in range(m - 1, -1, -1):
        row = _above(a[i], b, row)
        if i % step == 0:
            saved[i] = row
    j = 0
    for top in range(0, m, step):
        end = min(m, top + step)
        rows = [saved.pop(end) if end < m else saved[m]]
        for i in range(end - 1, top - 1, -1):
            rows.append(_above(a[i], b, rows[-1]))
        for i in range(top, end):
            here, below = rows[end - i], rows[end - i - 1]
            while j < n and a[i] != b[j] and below[j] < here[j + 1]:
                yield "add", b[j]
                j += 1
            same = j < n and a[i] == b[j]
            yield "same" if same else "remove", a[i]
            j += same
    for x in b[j:]:
        yield "add", x


def line_pairs(old: str, new: str, context: int = CONTEXT) -> list[dict]:
    """Lines in order with what became of them; long unchanged runs between changes shrink to their ends."""
    names, (a, b) = _codes(old, new)
    lead = _common(a, b)
    trail = _common(a[lead:][::-1], b[lead:][::-1])
    pair = lambda kind, x: {"type": kind, "line": names[x], "count": None}
    out = [pair("context", x) for x in a[:lead]]
    for kind, run in groupby(_script(a[lead : len(a) - trail], b[lead : len(b) - trail]), lambda s: s[0]):
        out += shrunk([pair("context" if kind == "same" else kind, x) for _, x in run], context)
    return out + [pair("context", x) for x in a[len(a) - trail :]]


def shrunk(run: list[dict], context: int = CONTEXT) -> list[dict]:
    """A run of context without its middle, if it is long; another run as it is."""
    left_out = len(run) - 2 * context
    if left_out <= 0 or run[0]["type"] != "context":
        return run
    return [*run[:context], {"type": "elide", "line": None, "count": left_out}, *run[len(run) - context :]]


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("type", T.StringType()), T.StructField("line", T.StringType()), T.StructField("count", T.IntegerType())])))
def line_diff(old: pd.Series, new: pd.Series) -> pd.Series:
    return pd.Series([line_pairs(a or "", b or "") for a, b in zip(old, new, strict=True)])


def diff_body(pairs: Column, path: Column) -> Column:
    shown = F.transform(pairs, lambda p: F.when(p["type"] == "elide", F.concat(F.lit("[... "), p["count"].cast("string"), F.lit(" unchanged lines ...]"))).otherwise(F.concat(F.when(p["type"] == "remove", "-").when(p["type"] == "add", "+").otherwise(" "), p["line"])))
    head = F.when(path != "", F.array(F.concat(F.lit("--- a/"), path), F.concat(F.lit("+++ b/"), path))).otherwise(F.array().cast("array<string>"))
    return F.array_join(F.concat(head, shown), "\n")


def counted(pairs: Column, kind: str) -> Column:
    return F.size(F.filter(pairs, lambda p: p["type"] == kind))


def header(name: Column, line: Column | None = None, record_hash: Column | None = None) -> Column:
    more = [] if line is None else [F.concat(F.lit("line="), F.lpad(line.cast("string"), 6, "0"))]
    more += [] if record_hash is None else [F.concat(F.lit("sha256="), record_hash)]
    return F.concat_ws(" ", F.concat(F.lit("@@tool "), F.coalesce(name, F.lit("unknown"))), *more)


def footer(added: Column, removed: Column, digest: Column) -> Column:
    return F.concat(F.lit("stats: +"), added.cast("string"), F.lit(" -"), removed.cast("string"), F.lit(" lines | input_sha256="), digest)


def file_lines(path: Column, prefix: Column | None) -> list[Column]:
    """The line that names a file, and one with its whole path where the first shows less."""
    shown, whole = relative(path, F.lit(None).cast("string") if prefix is None else prefix), trim_ws(path)
    return [F.concat(F.lit("@@file "), shown), F.when((whole != "") & (whole != shown), F.concat(F.lit("@@file_abs "), whole))]


def edit_block(name: Column, path: Column, old: Column, new: Column, pairs: Column, line: Column | None = None, record_hash: Column | None = None, prefix: Column | None = None) -> Column:
    """A small edit as its lines, a larger one as its difference (pairs)."""
    small = F.length(old) + F.length(new) <= SMALL_EDIT
    ls = lambda x, sign: F.transform(F.split(x, "\r\n|\r|\n"), lambda y: F.concat(F.lit(sign), y))
    plain = F.array_join(F.concat(ls(old, "-"), ls(new, "+")), "\n")
    digest = sha256(F.to_json(F.struct(path.alias("filePath"), old.alias("oldText"), new.alias("newText"))))
    count = lambda kind, x: F.when(small, F.size(F.split(x, "\r\n|\r|\n"))).otherwise(counted(pairs, kind))
    shown = relative(path, F.lit(None).cast("string") if prefix is None else prefix)
    return F.concat_ws("\n", header(name, line, record_hash), *file_lines(path, prefix), F.when(small, plain).otherwise(diff_body(pairs, shown)), footer(count("add", new), count("remove", old), digest))


def write_block(name: Column, path: Column, contents: Column, line: Column | None = None, record_hash: Column | None = None, prefix: Column | None = None) -> Column:
    """Contents of a written file: all lines if few, else the first 40 and last 10. Null contents are empty."""
    contents = F.coalesce(contents, F.lit(""))
    ls = F.split(contents, "\r\n|\r|\n")
    n = F.size(ls)
    short = F.concat_ws("\n", F.array_join(F.slice(ls, 1, WRITE_HEAD), "\n"), F.concat(F.lit("[... "), (n - WRITE_HEAD - WRITE_TAIL).cast("string"), F.lit(" lines omitted ...]")), F.array_join(F.slice(ls, F.greatest(n - WRITE_TAIL + 1, F.lit(1)), F.lit(WRITE_TAIL)), "\n"))
    body = F.when(n <= WRITE_HEAD + WRITE_TAIL, drop_newline_end(contents)).otherwise(short)
    digest = sha256(F.to_json(F.struct(path.alias("filePath"), contents.alias("contents"))))
    return F.concat_ws("\n", header(name, line, record_hash), *file_lines(path, prefix), F.lit("```"), body, F.lit("```"), F.concat(F.lit("stats: lines="), n.cast("string"), F.lit(" | input_sha256="), digest))


def patch_block(name: Column, patch: Column, line: Column | None = None, record_hash: Column | None = None) -> Column:
    return F.concat_ws("\n", header(name, line, record_hash), F.lit("```diff"), drop_newline_end(patch), F.lit("```"), F.concat(F.lit("stats: input_sha256="), sha256(patch)))


RESULT_LINES = "array<struct<type string,content string>>"


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("type", T.StringType()), T.StructField("line", T.StringType()), T.StructField("count", T.IntegerType())])))
def result_pairs(diff_lines: pd.Series) -> pd.Series:
    """Pairs of a structured result's lines (type unchanged, removed, added or another; content); unchanged runs shrink."""
    kind = {"unchanged": "context", "removed": "remove", "added": "add"}

    def of(rows) -> list[dict] | None:
        if rows is None:
            return None
        rows = [((x["type"] or "unchanged"), {"type": kind.get(x["type"] or "unchanged", "plain"), "line": x["content"] or "", "count": None}) for x in rows]
        return [p for _, run in groupby(rows, lambda r: r[0] == "unchanged") for p in shrunk([p for _, p in run])]

    return pd.Series([of(x) for x in diff_lines])


def result_block(path: Column, pairs: Column, digest: Column, line: Column | None = None, record_hash: Column | None = None, prefix: Column | None = None) -> Column:
    """A structured result as a difference."""
    shown = relative(path, F.lit(None).cast("string") if prefix is None else prefix)
    return F.concat_ws("\n", header(F.lit("EditResult"), line, record_hash), *file_lines(path, prefix), diff_body(pairs, shown), footer(counted(pairs, "add"), counted(pairs, "remove"), digest))
