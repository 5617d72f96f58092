"""Server-sent event text as rows, and what provider families put into events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: JSON paths by provider family.
FAMILIES = {
    "responses": {"delta": "$.delta", "done": "type = 'response.completed'", "failed": "type IN ('response.failed', 'error')", "usage": ["$.response.usage"], "id": "$.response.id"},
    "anthropic": {"delta": "$.delta.text", "done": "type = 'message_stop'", "failed": "type = 'error'", "usage": ["$.usage", "$.message.usage"], "id": "$.message.id"},
    "gemini": {"delta": "$.candidates[0].content.parts[0].text", "done": "get_json_object(data, '$.candidates[0].finishReason') IS NOT NULL", "failed": "get_json_object(data, '$.error') IS NOT NULL", "usage": ["$.usageMetadata"], "id": None},
    "chat": {"delta": "$.choices[0].delta.content", "done": "type = 'done_sentinel' OR get_json_object(data, '$.choices[0].finish_reason') IS NOT NULL", "failed": "get_json_object(data, '$.error') IS NOT NULL", "usage": ["$.usage"], "id": "$.id"},
}


def block_event(block: Column) -> Column:
    """struct(event, data, type, ok) of one block; null for a block without data.

    Several data lines join by line feed; ``[DONE]`` has the type done_sentinel; data that isn't
    JSON has the type unparsed.
    """
    ls = F.split(block, "\r?\n")
    value = lambda p: F.transform(F.filter(ls, lambda x: x.startswith(p)), lambda x: F.regexp_replace(x, f"^{p} ?", ""))
    data = F.array_join(value("data:"), "\n")
    event = F.get(value("event:"), F.lit(0))
    parsed = F.try_parse_json(data)
    kind = F.when(data == "[DONE]", "done_sentinel").when(parsed.isNull(), "unparsed").otherwise(F.coalesce(F.try_variant_get(parsed, "$.type", "string"), event))
    made = F.struct(event.alias("event"), data.alias("data"), kind.alias("type"), (parsed.isNotNull() | (data == "[DONE]")).alias("ok"))
    return F.when(F.size(value("data:")) > 0, made)


def events(df: DataFrame) -> DataFrame:
    """Rows of (stream_id, raw): one each event, numbered by stream from 0."""
    blocks = F.filter(F.transform(F.split("raw", "\r?\n\r?\n"), block_event), lambda e: e.isNotNull())
    return df.select("stream_id", F.posexplode(blocks).alias("n", "e")).select("stream_id", "n", "e.*")


def signs(family: str) -> tuple[Column, Column]:
    """What an event (type, data, ok) adds to the text, and whether it ends the stream."""
    f = FAMILIES[family]
    return F.when(F.col("ok"), F.get_json_object("data", f["delta"])), F.expr(f["done"])


def outcome(ev: DataFrame, family: str) -> DataFrame:
    """By stream: assembled text, completion, failure, last usage, id."""
    f = FAMILIES[family]
    delta, done = signs(family)
    full = F.get_json_object("data", "$.response.output_text")
    usage = F.coalesce(*(F.get_json_object("data", p) for p in f["usage"]))
    ordered = lambda x: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", x.alias("x")))), lambda s: s["x"]), "")
    out = ev.groupBy("stream_id").agg(
        ordered(delta).alias("deltas"), F.max_by(full, F.when(full.isNotNull(), F.col("n"))).alias("full"), F.max(done).alias("completed"), F.max(F.expr(f["failed"])).alias("failed"),
        F.max_by(usage, F.when(usage.isNotNull(), F.col("n"))).alias("usage"), (F.min_by(F.get_json_object("data", f["id"]), F.when(F.get_json_object("data", f["id"]).isNotNull(), F.col("n"))) if f["id"] else F.lit(None).cast("string")).alias("id"),
    )
    return out.withColumn("text", F.trim(F.coalesce(F.nullif("deltas", F.lit("")), "full", F.lit("")))).drop("deltas", "full")
