"""Rendering of entries for prompts: clean-up of bodies and four record formats."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.text import BLANK, BOX, RENDER_WS, lines, or_else, row_field, trim_ws
from tessera.operators import compress, dspc, tools
from tessera.sources import transcripts


def is_separator(line: Column) -> Column:
    """A rule across the page: box drawing and blanks, or one of = - _ *, 20 characters at least."""
    t = F.regexp_replace(line, f"^{RENDER_WS}+|{RENDER_WS}+$", "")
    return (F.length(t) >= 20) & (t.rlike(f"^(?:[{BOX}]|{RENDER_WS})+$") | t.rlike(r"^[=\-_*]+$"))


def is_blank(line: Column) -> Column:
    return line.rlike(f"^{RENDER_WS}*$")


def without_separators(ls: Column) -> Column:
    return F.filter(ls, lambda x: ~is_separator(x))


def short_blank_runs(x: Column, most: int = 2) -> Column:
    """At most ``most`` blank lines in a row, and those empty; two substitutions over the whole text."""
    x = F.regexp_replace(x, f"(?md)^{BLANK}+$", "")
    run, end = "\n" * (most + 1), "\n" * most
    x = F.regexp_replace(x, f"\n{{{most + 2},}}", run)
    x = F.regexp_replace(F.regexp_replace(x, f"\\A\n{{{most + 1},}}", end), f"\n{{{most + 1},}}\\z", end)
    return F.regexp_replace(x, f"\\A\n{{{most},}}\\z", "\n" * (most - 1))


#: Where code starts, words first; which lines end it; which lines a list or quote has.
CODE_START = r"(?:match|if|else|for|while|switch|case|return|let|fn|Ok|Err|None|Some)(?![A-Za-z0-9_])|sub_[A-Za-z0-9_]+|[^\n]*(?:[{};]|=>|::|->)"
CODE_END = r"```|\d+\||@@(?:RECORD|END_RECORD)(?![A-Za-z0-9_])|</?record(?![A-Za-z0-9_])"
LISTED = r"[-*+]|\d+[.)]|>|#{1,6}\s"
#: Lines that a block has at least, and columns it must stand from the left, as a whole or from its first line on.
BLOCK_LINES, BLOCK_INDENT, CODE_INDENT = 3, 8, 12

_PARAGRAPH = re.compile(rf"(?:^(?!{BLANK}*$)[^\n]*(?:\n|\Z))+", re.M)
_CODE = re.compile(rf"^( {{{CODE_INDENT},}})(?![ \t])(?:{CODE_START})[^\n]*(?:\n(?!\s*$)(?![^\S\n]*(?:{CODE_END}))[^\n]*)*", re.M)
_FIXED = re.compile(rf"^[ \t]*\t|\A(?:\s*\|[^\n]*\|[^\S\n]*(?:\n|\Z))+\Z|\A(?:[^\S\n]*(?:{LISTED})[^\n]*(?:\n|\Z))+\Z", re.M)


def _moved(block: str, most: int | None, least: int = 1) -> str:
    """The block moved to the left by the smallest indent of its lines, or each line by up to ``most``; as it is if it mustn't move."""
    body = block.removesuffix("\n")
    if body.count("\n") + 1 < BLOCK_LINES or _FIXED.search(body):
        return block
    if most is None:
        most = min(len(m) for m in re.findall("^ *", body, re.M))
    return re.sub(f"^ {{1,{most}}}", "", block, flags=re.M) if most >= least else block


def _dedented(text: str) -> tuple[str, int]:
    """Moves blocks of code to the left; gives the text and the number of blocks moved."""
    moved = 0

    def by(most) -> Callable[[re.Match], str]:
        def move(m: re.Match) -> str:
            nonlocal moved
            out = most(m)
            moved += out != m[0]
            return out

        return move

    text = _PARAGRAPH.sub(by(lambda m: _moved(m[0], None, BLOCK_INDENT)), text)
    return _CODE.sub(by(lambda m: _moved(m[0], len(m[1]))), text), moved


@F.pandas_udf(T.StructType([T.StructField("body", T.StringType()), T.StructField("blocks", T.IntegerType())]))
def dedented(texts: pd.Series) -> pd.DataFrame:
    """Second pass of clean-up: indented code moved to the left."""
    return pd.DataFrame([_dedented(t or "") for t in texts], columns=["body", "blocks"])


def with_clean(df: DataFrame, text: str, out: str = "clean") -> DataFrame:
    """df with the cleaned text and a struct of what was removed; counted only where text got shorter.

    Texts without a line indented by eight spaces skip the Python pass.
    """
    kept = without_separators(lines(F.col(text)))
    df = df.withColumn("_kept", kept).withColumn("_joined", short_blank_runs(F.array_join("_kept", "\n")))
    indented = F.col("_joined").rlike(rf"(?m)^ {{{BLOCK_INDENT}}}")
    df = df.withColumn("_moved", F.when(indented, dedented(F.when(indented, F.col("_joined")))).otherwise(F.struct(F.col("_joined").alias("body"), F.lit(0).alias("blocks"))))
    fewer = F.length(text) - F.length("_moved.body")
    counted = lambda x: F.when(fewer > 0, x).otherwise(0).cast("long")
    left = F.when(F.size("_kept") > 0, F.size(lines(F.col("_joined")))).otherwise(0)
    stats = F.struct(counted(fewer).alias("removed_chars"), counted(F.size(lines(F.col(text))) - left).alias("removed_lines"), counted(F.col("_moved.blocks")).alias("dedented_blocks"))
    return df.withColumn(f"{out}_stats", stats).withColumn(out, F.col("_moved.body")).drop("_kept", "_joined", "_moved")


def with_clean_lines(df: DataFrame, text: str, out: str = "clean") -> DataFrame:
    """The first two steps alone: separators and blank runs. Null texts stay null."""
    return df.withColumn(out, short_blank_runs(F.array_join(without_separators(lines(F.col(text))), "\n")))


def padded(line: Column) -> Column:
    return F.lpad(line.cast("string"), 6, "0")


def onto(line: Column, kind: Column, role: Column, at: Column, body: Column, raw: Column, record_hash: Column) -> Column:
    body = F.regexp_replace(body, r"(?m)^(\d+\|)", " $1")
    return F.concat(F.concat_ws("|", line.cast("string"), row_field(kind)), F.lit("\n"), body)


def stripped(line: Column, kind: Column, role: Column, at: Column, body: Column, raw: Column, record_hash: Column) -> Column:
    q = lambda name, x: F.when(x != "", F.concat(F.lit(f' {name}="'), F.replace(x, F.lit('"'), F.lit("'")), F.lit('"')))
    unparsed = F.concat(F.lit(' kind="unparsed"'))
    named = F.when(kind == "unparsed", unparsed).otherwise(F.concat_ws("", q("type", kind), q("role", role), q("timestamp", at)))
    return F.concat(F.lit('<record line="'), padded(line), F.lit('"'), named, F.lit(">\n"), body, F.lit("\n</record>"))


def sentinel(line: Column, kind: Column, role: Column, at: Column, body: Column, raw: Column, record_hash: Column) -> Column:
    body = F.regexp_replace(body, r"(?m)^(@@(?:RECORD|END_RECORD)(?![A-Za-z0-9_]))", " $1")
    f = lambda name, x: F.when(x != "", F.concat(F.lit(f"{name}="), F.regexp_replace(x, r"\s+", "_")))
    fields = F.concat_ws(" ", F.concat(F.lit("line="), padded(line)), f("type", kind), f("role", role), f("ts", at), F.concat(F.lit("chars="), F.length(body).cast("string")))
    unparsed = F.concat_ws(" ", F.concat(F.lit("line="), padded(line)), F.lit("kind=unparsed"), F.concat(F.lit("sha256="), record_hash))
    return F.concat(F.lit("@@RECORD "), F.when(kind == "unparsed", unparsed).otherwise(fields), F.lit("\n"), body, F.lit("\n@@END_RECORD line="), padded(line))


def jsonl(line: Column, kind: Column, role: Column, at: Column, body: Column, raw: Column, record_hash: Column) -> Column:
    return F.concat(F.lit('<record line="'), padded(line), F.lit('">\n'), raw, F.lit("\n</record>"))


RENDERERS: dict[str, Callable[..., Column]] = {"onto": onto, "stripped": stripped, "sentinel": sentinel, "jsonl": jsonl}
COMPRESSING = {"onto", "sentinel"}


def with_old(entries: DataFrame, after: int = 64) -> DataFrame:
    """entries with ``old``: more than ``after`` records of the session follow; never for 0."""
    count = F.count(F.lit(1)).over(Window.partitionBy("session_id"))
    return entries.withColumn("old", (F.lit(after) > 0) & (F.col("line") <= count - after))


def rendered(entries: DataFrame, renderer: str = "onto", after: int = 64, strategy: str = "headtail", **limits: int) -> DataFrame:
    """entries with ``rendered``, ``body`` and ``stats``; stale tool records are compressed by renderers that do so."""
    if renderer not in RENDERERS:
        raise ValueError(f"unknown renderer {renderer!r}")
    r, line, digest = F.col("record"), F.col("line"), F.col("hash")
    kind = F.when(r.isNull(), "unparsed").otherwise(or_else(transcripts.get(r, "$.type"), F.lit("unknown")))
    text = or_else(trim_ws(F.col("_prompt")), or_else(F.col("preview"), F.lit("[no textual content extracted]")))
    df = tools.with_prompt_text(with_old(entries, after), "_prompt").withColumn("_kind", kind).withColumn("_text", F.when(r.isNull(), F.col("raw")).otherwise(text))
    none = F.struct(F.col("_text").alias("body"), F.lit(False).alias("compressed"), F.lit(None).cast("long").alias("original_chars"), F.lit(None).cast("long").alias("omitted_chars"))
    if renderer in COMPRESSING:
        stale = F.col("old") & transcripts.is_tool_output(r)
        output = F.when(stale, compress.compressed("headtail" if strategy == "dspc" else strategy, F.col("_text"), line, digest, **limits))
        if strategy == "dspc":
            key = F.struct("session_id", "line")
            bodies = dspc.compressed(df.where(stale).select(key.alias("key"), F.col("_text").alias("text"), "line", "hash"), **limits)
            df = df.join(bodies.withColumnRenamed("c", "_dspc"), key == F.col("key"), "left").drop("key")
            output = F.coalesce(F.when(stale, F.col("_dspc")), output)
        use = F.when(F.col("old") & transcripts.is_tool_use(r), compress.shortened_edit(F.col("_text"), line, digest))
        df = df.withColumn("_c", F.coalesce(output, use, none))
    else:
        df = df.withColumn("_c", none)
    df = with_clean(df.withColumn("_body", F.col("_c.body")), "_body", "body")
    df = df.withColumn("body", F.when(r.isNull(), F.col("raw")).otherwise(F.col("body")))
    made = RENDERERS[renderer](line, F.col("_kind"), F.coalesce(transcripts.get(r, "$.message.role"), F.lit("")), F.coalesce(transcripts.get(r, "$.timestamp"), F.lit("")), F.col("body"), F.col("raw"), digest)
    stats = F.struct(F.col("_c.compressed"), F.col("_c.original_chars"), F.col("_c.omitted_chars"), F.col("body_stats.*"))
    return df.withColumn("rendered", made).withColumn("stats", stats).drop("_kind", "_prompt", "_text", "_c", "_body", "_dspc", "body_stats")


def wrapped(rendered_entries: DataFrame, renderer: str = "onto") -> DataFrame:
    """One text a session: the header and its records in order."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("line", "rendered"))), lambda s: s["rendered"])
    head = F.when(F.lit(renderer == "onto"), F.concat(F.lit("@@ONTO Transcript["), F.count(F.lit(1)).cast("string"), F.lit("] fields=line|type")))
    return rendered_entries.groupBy("session_id").agg(F.concat_ws("\n", head, F.array_join(ordered, "\n")).alias("transcript"))
