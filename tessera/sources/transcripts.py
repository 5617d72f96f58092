"""Transcripts: line-delimited JSON records by session, and their projections.

A record's content is polymorphic, so records are VARIANT columns; parts are arrays of VARIANT.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.text import WS, bound, compact, or_else, sha256

RECORD_TYPES = ["last-prompt", "mode", "permission-mode", "ai-title", "queue-operation"]


def get(v: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(v, path, kind)


def is_kind(v: Column, path: str, kind: str) -> Column:
    return F.schema_of_variant(F.try_variant_get(v, path, "variant")).startswith(kind)


def text_of(v: Column, path: str) -> Column:
    """A field where it is a string, else null."""
    return F.when(is_kind(v, path, "STRING"), get(v, path))


def truthy(v: Column, path: str) -> Column:
    """Present and neither null, false, zero nor empty."""
    x = F.try_variant_get(v, path, "variant")
    s = F.to_json(x)
    return F.coalesce(~s.isin("null", "false", "0", '""'), F.lit(False))


def read_lines(spark: SparkSession, path: str, session: Column | None = None) -> DataFrame:
    """(session_id, ord, raw) of files with a record a line; CRLF and blank lines are dropped.

    ord numbers a file's lines in order from 0; each file is a session unless told otherwise. Files are
    read in splits: a line's place is its split's, then its own within it.
    """
    rows = spark.read.option("lineSep", "\n").text(path)
    placed = rows.select(
        (F.col("_metadata.file_path") if session is None else session).alias("session_id"), F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_split"),
        F.monotonically_increasing_id().alias("_line"), F.regexp_replace("value", "\r$", "").alias("raw"),
    )
    number = F.row_number().over(Window.partitionBy("session_id").orderBy("_file", "_split", "_line")) - 1
    return placed.where(F.regexp_replace("raw", f"{WS}+", "") != "").select("session_id", number.alias("ord"), "raw")


def parsed(lines: DataFrame) -> DataFrame:
    """lines with ``record``, null where a line isn't JSON."""
    return lines.withColumn("record", F.try_parse_json("raw"))


def strict(lines: DataFrame) -> DataFrame:
    """parsed, but the first line that isn't JSON ends the query with its record number."""
    number = F.row_number().over(Window.partitionBy("session_id").orderBy("ord"))
    out = parsed(lines).withColumn("_n", number)
    bad = F.raise_error(F.format_string("Invalid JSONL at logical record %d", F.col("_n")))
    return out.withColumn("record", F.when(F.col("record").isNull(), bad.cast("string").try_cast("variant")).otherwise(F.col("record"))).drop("_n")


def parts(record: Column) -> Column:
    """The record's content parts as an array of VARIANT; empty where content isn't an array."""
    inner = F.when(is_kind(record, "$.message.content", "ARRAY"), F.try_variant_get(record, "$.message.content", "array<variant>"))
    outer = F.when(is_kind(record, "$.content", "ARRAY") & F.try_variant_get(record, "$.message.content", "variant").isNull(), F.try_variant_get(record, "$.content", "array<variant>"))
    return F.coalesce(inner, outer, F.array().cast("array<variant>"))


def content_text(record: Column) -> Column:
    """Content where it is a string: the message's, else the record's."""
    return F.coalesce(text_of(record, "$.message.content"), F.when(F.try_variant_get(record, "$.message.content", "variant").isNull(), text_of(record, "$.content")))


def part_text(part: Column) -> Column:
    return F.coalesce(text_of(part, "$.text"), text_of(part, "$.content"), F.lit(""))


def is_result(part: Column) -> Column:
    return (get(part, "$.type") == "tool_result") | truthy(part, "$.tool_use_id")


def plain_text(record: Column) -> Column:
    """String content, or the parts' texts by line."""
    return F.coalesce(content_text(record), F.array_join(F.filter(F.transform(parts(record), part_text), lambda t: t != ""), "\n"))


def user_text(record: Column) -> Column:
    """What the user wrote: plain text without tool results."""
    own = F.filter(parts(record), lambda p: ~F.coalesce(is_result(p), F.lit(False)))
    texts = F.filter(F.transform(own, lambda p: F.coalesce(text_of(p, "$.text"), text_of(p, "$.content"))), lambda t: t.isNotNull())
    return F.coalesce(content_text(record), F.array_join(texts, "\n"))


def fallback(record: Column) -> Column:
    return F.coalesce(*(F.nullif(text_of(record, f"$.{n}"), F.lit("")) for n in ("lastPrompt", "aiTitle", "summary")), F.lit(""))


def prompt_text(record: Column, part: object = part_text) -> Column:
    """Text for prompts: string content as it is, else rendered parts, else a fallback field."""
    rendered = F.array_join(F.filter(F.transform(parts(record), part), lambda t: t != ""), "\n\n")
    return F.coalesce(content_text(record), or_else(rendered, fallback(record)))


#: Fixed value: a text that nests more than a thousand levels isn't JSON to the parser, and each part inside another takes two.
DEEPEST = 500
TOOL_TYPES = ["tool_use", "tool_result"]


def listed(part: Column) -> Column:
    """The parts that a part without text of its own lists, as an array; null where there are none, and for tool calls and results."""
    plain = lambda: ~F.coalesce(get(part, "$.type"), F.lit("")).isin(TOOL_TYPES) & F.coalesce(text_of(part, "$.text"), text_of(part, "$.content")).isNull()
    return bound(F.try_variant_get(part, "$.content", "array<variant>"), lambda inner: F.when(F.when(F.size(inner) > 0, plain()), inner))


def leaves(parts: Column) -> Column:
    """All parts that list no others, at any depth, in the order of the text: array of (path, p).

    A walk without recursion: each step puts the listed parts in their part's place, until none lists any. path
    leads from the array to the part, as in [0].content[2].
    """

    def opened(x: Column) -> Column:
        placed = lambda inner: F.transform(inner, lambda p, i: F.struct(F.concat(x["path"], F.lit(".content["), i.cast("string"), F.lit("]")).alias("path"), p.alias("p")))
        return bound(listed(x["p"]), lambda inner: F.when(inner.isNull(), F.array(x)).otherwise(placed(inner)))

    def state(xs: Column) -> Column:
        return bound(xs, lambda v: F.struct(v.alias("parts"), F.exists(v, lambda x: listed(x["p"]).isNotNull()).alias("more")))

    def step(s: Column, _: Column) -> Column:
        return F.when(s["more"], state(F.flatten(F.transform(s["parts"], opened)))).otherwise(s)

    top = F.transform(parts, lambda p, i: F.struct(F.concat(F.lit("["), i.cast("string"), F.lit("]")).alias("path"), p.alias("p")))
    walk = lambda s: F.when(s["more"], F.aggregate(F.sequence(F.lit(1), F.lit(DEEPEST)), s, step, lambda t: t["parts"])).otherwise(s["parts"])
    return bound(state(top), walk)


def deep_text(part: Column) -> Column:
    """A part's text, or those of the parts inside it, however deep."""
    return joined_text(leaves(F.array(part)))


def joined_text(leaves: Column) -> Column:
    return F.array_join(F.filter(F.transform(leaves, lambda x: part_text(x["p"])), lambda t: t != ""), "\n\n")


def message_parts(record: Column) -> Column:
    """Parts of the record's message; empty where its content isn't an array."""
    return F.coalesce(F.try_variant_get(record, "$.message.content", "array<variant>"), F.array().cast("array<variant>"))


def evidence_text(record: Column) -> Column:
    """Text that spans are rehydrated from; a record without any can't be cited.

    The record's own content comes first, then the message's; parts may nest to any depth.
    """
    rendered = joined_text(leaves(message_parts(record)))
    result = F.when(truthy(record, "$.toolUseResult"), F.coalesce(text_of(record, "$.toolUseResult"), F.to_json(F.try_variant_get(record, "$.toolUseResult", "variant"))))
    attached = F.when(truthy(record, "$.attachment"), F.to_json(F.try_variant_get(record, "$.attachment", "variant")))
    return F.coalesce(text_of(record, "$.content"), text_of(record, "$.message.content"), F.nullif(rendered, F.lit("")), result, attached, fallback(record))


def preview(raw: Column, record: Column) -> Column:
    """One line on a record: type, uuid, role, and 160 characters of text."""
    texts = F.array_join(F.transform(parts(record), lambda p: F.coalesce(text_of(p, "$.text"), F.lit(""))), " ")
    text = F.coalesce(text_of(record, "$.content"), text_of(record, "$.message.content"), texts)
    short = lambda t: F.left(F.regexp_replace(t, f"{WS}+", " "), F.lit(160))
    named = [F.when(truthy(record, p), F.concat(F.lit(f"{n}="), get(record, p))) for n, p in (("type", "$.type"), ("uuid", "$.uuid"), ("role", "$.message.role"))]
    return F.when(record.isNull(), short(raw)).otherwise(F.concat_ws(" | ", *named, F.when(text != "", F.concat(F.lit("text="), short(text)))))


def is_tool_output(record: Column) -> Column:
    return truthy(record, "$.toolUseResult") | truthy(record, "$.sourceToolAssistantUUID") | F.exists(parts(record), lambda p: F.coalesce(is_result(p), F.lit(False)))


def is_tool_use(record: Column) -> Column:
    inner = F.when(is_kind(record, "$.message.content", "ARRAY"), F.try_variant_get(record, "$.message.content", "array<variant>"))
    return F.coalesce(F.exists(inner, lambda p: F.coalesce(get(p, "$.type") == "tool_use", F.lit(False))), F.lit(False))


def is_user_message(record: Column) -> Column:
    hidden = truthy(record, "$.isMeta") | truthy(record, "$.isCompactSummary") | truthy(record, "$.isVisibleInTranscriptOnly")
    mine = F.coalesce(get(record, "$.type") == "user", F.lit(False)) | F.coalesce(get(record, "$.message.role") == "user", F.lit(False))
    return record.isNotNull() & ~hidden & ~is_tool_output(record) & mine & (compact(user_text(record)) != "")


def is_preserved(record: Column) -> Column:
    """Records that the tail of a compacted transcript may keep."""
    return get(record, "$.type").isin("user", "assistant", "system", "attachment") & ~truthy(record, "$.isCompactSummary")


def kind(record: Column) -> Column:
    """What a record is; earlier tests win."""
    kind_of, role = get(record, "$.type"), get(record, "$.message.role")
    out = F.when(record.isNull(), "unparsed").when(truthy(record, "$.isCompactSummary"), "compact_summary")
    out = out.when(kind_of == "attachment", "attachment").when(kind_of == "file-history-snapshot", "file_history_snapshot")
    out = out.when(is_tool_output(record), "tool_output").when(is_tool_use(record), "tool_use")
    out = out.when(role == "user", "user_message").when(role == "assistant", "assistant_message")
    out = out.when(kind_of == "system", "system").when(kind_of.isin(*RECORD_TYPES), "metadata")
    return out.otherwise(or_else(kind_of, F.lit("unknown")))


def numbered(lines: DataFrame, citable: bool = False) -> DataFrame:
    """Entries: lines numbered from 1 in their session, with hash, preview and text.

    citable: records without text that can be cited are dropped first, and the rest renumbered.
    """
    out = lines if "record" in lines.columns else parsed(lines)
    out = out.withColumn("text", evidence_text(F.col("record")))
    if citable:
        out = out.where("text <> ''")
    number = F.row_number().over(Window.partitionBy("session_id").orderBy("ord"))
    return described(out.withColumn("line", number))


def described(rows: DataFrame) -> DataFrame:
    """Rows (raw, record) with hash, preview and, where it isn't there yet, text."""
    if "text" not in rows.columns:
        rows = rows.withColumn("text", evidence_text(F.col("record")))
    return rows.withColumn("hash", sha256(F.col("raw"))).withColumn("preview", preview(F.col("raw"), F.col("record")))


def blocks(entries: DataFrame) -> DataFrame:
    """A row for each content block of (session_id, line, record): type, raw and prompt text."""
    r = F.col("record")
    whole = content_text(r)
    named = F.transform(parts(r), lambda p: F.struct(F.coalesce(F.when(F.schema_of_variant(p).startswith("STRING"), "string_part"), F.nullif(get(p, "$.type"), F.lit("")), F.when(truthy(p, "$.tool_use_id"), "tool_result"), F.when(F.schema_of_variant(p).startswith("OBJECT"), "object_part"), F.lit("empty_part")).alias("type"), F.coalesce(F.when(F.schema_of_variant(p).startswith("STRING"), get(p, "$")), F.to_json(p)).alias("raw"), F.coalesce(F.when(F.schema_of_variant(p).startswith("STRING"), get(p, "$")), part_text(p)).alias("prompt")))
    text = F.array(F.struct(F.lit("string_content").alias("type"), whole.alias("raw"), whole.alias("prompt")))
    attached = F.array(F.struct(F.concat(F.lit("attachment:"), or_else(get(r, "$.attachment.type"), F.lit("unknown"))).alias("type"), F.to_json(F.try_variant_get(r, "$.attachment", "variant")).alias("raw"), F.lit("").alias("prompt")))
    all_blocks = F.when(whole.isNotNull(), text).when(F.size(parts(r)) > 0, named).when(is_kind(r, "$.attachment", "OBJECT"), attached)
    return entries.select("session_id", "line", F.posexplode(all_blocks).alias("block", "b")).select("session_id", "line", "block", "b.*")


def metadata(entries: DataFrame) -> DataFrame:
    """By session: fields of its first record, first cwd and branch, last user uuid, last real model."""
    r = F.col("record")
    base = F.struct(*(get(r, f"$.{n}").alias(n) for n in ("sessionId", "version", "userType", "entrypoint", "slug", "cwd", "gitBranch")))
    at = lambda c, when: F.max_by(c, F.when(when, F.col("line")))
    uuid, model = get(r, "$.uuid"), get(r, "$.message.model")
    return entries.groupBy("session_id").agg(
        F.min_by(base, F.when(r.isNotNull(), F.col("line"))).alias("base"),
        F.min_by(get(r, "$.cwd"), F.when(truthy(r, "$.cwd"), F.col("line"))).alias("cwd"),
        F.min_by(get(r, "$.gitBranch"), F.when(truthy(r, "$.gitBranch"), F.col("line"))).alias("git_branch"),
        at(uuid, (get(r, "$.type") == "user") & uuid.isNotNull()).alias("last_user_uuid"),
        at(model, model.isNotNull() & (model != "<synthetic>")).alias("model"),
    )


def from_turns(turns: DataFrame) -> DataFrame:
    """A table of (conv_id, turn, role, text) as transcript lines."""
    record = F.struct(F.col("role").alias("type"), F.struct(F.col("role").alias("role"), F.col("text").alias("content")).alias("message"))
    return turns.select(F.col("conv_id").cast("string").alias("session_id"), F.col("turn").alias("ord"), F.to_json(record).alias("raw"))
