"""Tool calls and their results inside records, as text for prompts.

Records without tool parts keep the text that column expressions give them. Of the others each part
is a row: what must keep the order of a JSON object's keys is read from the raw line, differences are
made by a pandas UDF over edits alone, and the parts' texts are joined again by record.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.text import or_else, sha256
from tessera.operators import diff
from tessera.sources import transcripts
from tessera.sources.transcripts import get, is_kind, text_of

#: Tools that edit, and the one part type each of calls and results.
EDIT_TOOLS = ["Edit", "StrReplace", "MultiEdit", "NotebookEdit"]
CALL, RESULT = "tool_use", "tool_result"


@F.pandas_udf(T.StringType())
def pretty(texts: pd.Series) -> pd.Series:
    """JSON with two blanks of indent a level, keys in their order."""
    return pd.Series([None if t is None else json.dumps(json.loads(t), indent=2, ensure_ascii=False) for t in texts])


def bare(part: Column) -> Column:
    """A part that has an input, but is no call or result, has no text and lists no parts."""
    plain = F.coalesce(text_of(part, "$.text"), text_of(part, "$.content")).isNull() & transcripts.listed(part).isNull()
    return F.coalesce(~F.coalesce(get(part, "$.type"), F.lit("")).isin(CALL, RESULT) & is_kind(part, "$.input", "OBJECT") & plain, F.lit(False))


def has_tools(record: Column) -> Column:
    return F.coalesce(F.exists(transcripts.parts(record), lambda p: F.coalesce(get(p, "$.type").isin(CALL, RESULT), F.lit(False))), F.lit(False))


def result_text(content: Column) -> Column:
    """A result's text: a string, or its parts' texts by line; content is a VARIANT."""
    one = lambda p: F.coalesce(F.when(is_kind(p, "$", "STRING"), get(p, "$")), text_of(p, "$.text"), text_of(p, "$.content"), F.lit(""))
    parts = F.when(is_kind(content, "$", "ARRAY"), F.try_variant_get(content, "$", "array<variant>"))
    joined = F.array_join(F.filter(F.transform(parts, one), lambda t: t != ""), "\n")
    return F.coalesce(F.when(is_kind(content, "$", "STRING"), get(content, "$")), joined, F.lit(""))


def part_rows(entries: DataFrame) -> DataFrame:
    """(session_id, line, hash, prefix, part, p, given): a row for each content part; given is a call's input as JSON."""
    r = F.col("record")
    at = F.when(F.try_variant_get(r, "$.message.content", "variant").isNotNull(), "$.message.content").otherwise("$.content")
    placed = F.transform(transcripts.parts(r), lambda p, i: F.struct(F.concat(F.lit("["), i.cast("string"), F.lit("]")).alias("path"), p.alias("p")))
    return _given(entries.withColumn("_parts", placed), at)


def leaf_rows(entries: DataFrame) -> DataFrame:
    """part_rows of the message's parts that list no others, at any depth, numbered in the order of the text."""
    return _given(entries.withColumn("_parts", transcripts.leaves(transcripts.message_parts(F.col("record")))), F.lit("$.message.content"))


def _given(entries: DataFrame, at: Column) -> DataFrame:
    rows = entries.select("session_id", "line", "hash", "raw", "prefix", at.alias("at"), F.posexplode("_parts").alias("part", "x"))
    rows = rows.select("session_id", "line", "hash", "raw", "prefix", "part", F.concat("at", "x.path", F.lit(".input")).alias("at"), "x.p")
    given = F.expr("get_json_object(raw, at)")
    return rows.withColumn("given", F.when((get(F.col("p"), "$.type") == CALL) | bare(F.col("p")), F.coalesce(given, F.lit("{}")))).drop("raw", "at")


def texts(parts: DataFrame, evidence: bool = False) -> DataFrame:
    """part_rows with the text of each part; as evidence a result without text has none, and any part with an input is a call."""
    p, meta = F.col("p"), (F.col("line"), F.col("hash"), F.col("prefix"))
    kind, name = F.coalesce(get(p, "$.type"), F.lit("")), or_else(F.when(get(p, "$.type") == CALL, get(p, "$.name")), F.lit("unknown"))
    call, edit = (kind == CALL) | (bare(p) if evidence else F.lit(False)), (kind == CALL) & name.isin(EDIT_TOOLS)
    v = F.try_variant_get(p, "$.input", "variant")
    path, several = diff.file_of(v), F.coalesce(F.size(F.try_variant_get(v, "$.edits", "array<variant>")) > 0, F.lit(False))

    calls = parts.where(edit).withColumn("several", several).withColumn("path", path).withColumn("name", name).select("*", F.posexplode(diff.edits(v)).alias("nth", "e"))
    label = F.when(F.col("several"), F.concat("name", F.lit("["), F.col("nth").cast("string"), F.lit("]"))).otherwise(F.col("name"))
    calls = calls.withColumn("pairs", diff.line_diff(F.col("e.old"), F.col("e.new")))
    calls = calls.withColumn("text", diff.edit_block(label, F.col("path"), F.col("e.old"), F.col("e.new"), F.col("pairs"), *meta))
    key = ["session_id", "line", "part"]
    calls = calls.groupBy(*key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", "text"))), lambda x: x["text"]), "\n\n").alias("text"))

    given, wrote = F.col("given"), F.coalesce(get(v, "$.contents"), get(v, "$.content"), F.lit(""))
    other = F.concat_ws("\n", diff.header(name, *meta[:2]), pretty(F.when(call & ~name.isin("Write", "apply_patch"), given)), F.concat(F.lit("stats: input_sha256="), sha256(given)))
    patch = F.coalesce(get(v, "$.patch"), get(v, "$.input"), F.lit(""))
    rest = parts.where(~edit).withColumn("told", F.when(kind == RESULT, result_text(F.try_variant_get(p, "$.content", "variant"))))
    rest = rest.withColumn("object", F.when(F.ltrim("told").startswith("{"), F.try_parse_json("told")))
    where = diff.first_of(F.col("object"), "file_path", "path")
    changed = F.when(where != "", F.when(is_kind(F.col("object"), "$.diffLines", "ARRAY"), F.try_variant_get(F.col("object"), "$.diffLines", diff.RESULT_LINES)))
    rest = rest.withColumn("changed", changed).withColumn("pairs", diff.result_pairs(F.col("changed")))
    shown = F.when(F.col("changed").isNotNull(), diff.result_block(where, F.col("pairs"), sha256(F.get_json_object("told", "$")), *meta)).otherwise(F.col("told"))
    result = F.concat_ws("\n", F.lit("[tool_result]"), F.nullif(shown, F.lit("")))
    if evidence:
        result = F.when(shown != "", result).otherwise("")
    text = F.when(call & (name == "Write"), diff.write_block(F.lit("Write"), path, wrote, *meta)).when(call & (name == "apply_patch"), diff.patch_block(name, patch, *meta[:2])).when(call, other)
    rest = rest.withColumn("text", text.when(kind == RESULT, result).otherwise(transcripts.part_text(p)))
    return calls.select(*key, "text").union(rest.select(*key, "text"))


def with_prompt_text(entries: DataFrame, out: str, prefix: Column | None = None) -> DataFrame:
    """entries (session_id, line, hash, raw, record) with their text for prompts, tool calls and results formatted.

    prefix: a folder that paths are shown without. Records that aren't JSON have null.
    """
    r = F.col("record")
    with_tools = entries.where(has_tools(r)).withColumn("prefix", F.lit(None).cast("string") if prefix is None else prefix)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "text"))), lambda x: F.nullif(x["text"], F.lit(""))), "\n\n")
    made = texts(part_rows(with_tools)).groupBy("session_id", "line").agg(joined.alias("_made"))
    own = F.when(has_tools(r), or_else(F.col("_made"), transcripts.fallback(r))).otherwise(transcripts.prompt_text(r))
    return entries.join(made, ["session_id", "line"], "left").withColumn(out, F.when(r.isNotNull(), own)).drop("_made")


def with_evidence_text(entries: DataFrame, out: str = "text", prefix: Column | None = None) -> DataFrame:
    """entries with the text that spans are rehydrated from, tool calls and results formatted; empty for records that can't be cited."""
    r = F.col("record")
    tool = lambda p: F.coalesce(get(p, "$.type").isin(CALL, RESULT), F.lit(False)) | bare(p)
    has = F.exists(transcripts.leaves(transcripts.message_parts(r)), lambda x: tool(x["p"]))
    with_tools = entries.where(has).withColumn("prefix", F.lit(None).cast("string") if prefix is None else prefix)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "text"))), lambda x: F.nullif(x["text"], F.lit(""))), "\n\n")
    made = texts(leaf_rows(with_tools), evidence=True).groupBy("session_id", "line").agg(joined.alias("_made"))
    plain = transcripts.evidence_text(r)
    attached = F.to_json(F.try_variant_get(r, "$.attachment", "variant"))
    plain = F.when(transcripts.truthy(r, "$.attachment") & (plain == attached), pretty(F.when(transcripts.truthy(r, "$.attachment"), F.get_json_object("raw", "$.attachment")))).otherwise(plain)
    own = F.coalesce(F.when(has, F.coalesce(text_of(r, "$.content"), F.nullif("_made", F.lit("")))), plain, F.lit(""))
    return entries.join(made, ["session_id", "line"], "left").withColumn(out, own).drop("_made")


def citable(lines: DataFrame, prefix: Column | None = None) -> DataFrame:
    """Entries that can be cited, numbered among themselves: lines (session_id, ord, raw) whose record has evidence text."""
    from pyspark.sql import Window

    own = with_evidence_text(transcripts.numbered(lines), "text", prefix).where("text <> ''")
    return own.withColumn("line", F.row_number().over(Window.partitionBy("session_id").orderBy("ord")))
