"""End to end: a transcript compacted to a boundary, a summary record and its preserved tail."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import sha256, tokens
from tessera.operators import ledger
from tessera.sources import transcripts

#: Fixed value: records of the tail that stay.
TAIL = 16


def made_id(*parts: Column) -> Column:
    """An id that depends on the rows alone."""
    return F.left(sha256(F.concat_ws(":", *parts)), F.lit(32))


def preserved_tail(entries: DataFrame, most: int = TAIL) -> DataFrame:
    """Last records that may be kept, with new ids; each one's parent is the one before, the first one's the summary."""
    own = entries.where(transcripts.is_preserved(F.col("record")))
    by = Window.partitionBy("session_id")
    own = own.withColumn("_r", F.row_number().over(by.orderBy(F.col("line").desc()))).where(F.col("_r") <= most).drop("_r")
    own = own.withColumn("new_uuid", made_id(F.col("session_id"), F.lit("tail"), F.col("line").cast("string")))
    summary = made_id(F.col("session_id"), F.lit("summary"), F.lit("0"))
    return own.withColumn("parent", F.lag("new_uuid").over(by.orderBy("line"))).withColumn("parent", F.coalesce("parent", summary))


def compacted(entries: DataFrame, summaries: DataFrame, most: int = TAIL) -> DataFrame:
    """(session_id, ord, raw) of the compacted transcript: boundary, summary with ledger, tail.

    The ledger holds what earlier rounds carried over, and the users' messages of this one.
    """
    return with_ledger(entries, summaries, ledger.selected(ledger.of_entries(entries)), most)


def with_ledger(entries: DataFrame, summaries: DataFrame, chosen: DataFrame, most: int = TAIL) -> DataFrame:
    """compacted with the messages of the ledger chosen before: (session_id, ord, rendered)."""
    tail = preserved_tail(entries, most)
    text = chosen.groupBy("session_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "rendered"))), lambda s: s["rendered"]), "\n").alias("messages"))
    heads = summaries.select("session_id", "summary").join(text, "session_id", "left")
    boundary = heads.select("session_id", F.lit(0).alias("ord"), F.to_json(F.struct(F.lit("system").alias("type"), F.lit("compact_boundary").alias("subtype"), made_id(F.col("session_id"), F.lit("boundary"), F.lit("0")).alias("uuid"))).alias("raw"))
    body = F.concat_ws("\n\n", "summary", F.concat(F.lit("## User Messages\n"), F.col("messages")))
    record = F.struct(F.lit("user").alias("type"), F.lit(True).alias("isCompactSummary"), made_id(F.col("session_id"), F.lit("summary"), F.lit("0")).alias("uuid"), F.struct(F.lit("user").alias("role"), body.alias("content")).alias("message"))
    summary = heads.select("session_id", F.lit(1).alias("ord"), F.to_json(record).alias("raw"))
    kept = F.to_json(F.struct(transcripts.get(F.col("record"), "$.type").alias("type"), F.col("new_uuid").alias("uuid"), F.col("parent").alias("parentUuid"), transcripts.get(F.col("record"), "$.uuid").alias("originalUuid"), transcripts.get(F.col("record"), "$.timestamp").alias("timestamp"), F.struct(transcripts.get(F.col("record"), "$.message.role").alias("role"), transcripts.prompt_text(F.col("record")).alias("content")).alias("message")))
    rest = tail.select("session_id", (F.col("line") + 1).alias("ord"), kept.alias("raw"))
    return boundary.unionByName(summary).unionByName(rest)


def results(before: DataFrame, after: DataFrame) -> DataFrame:
    """By session: records and estimated tokens before and after, and their ratio."""
    size = lambda df, p: df.groupBy("session_id").agg(F.count(F.lit(1)).alias(f"{p}_records"), tokens(F.sum(F.length("raw") + 1)).alias(f"{p}_tokens"))
    out = size(before, "before").join(size(after, "after"), "session_id")
    return out.withColumn("ratio", F.round(F.col("after_tokens") / F.col("before_tokens"), 9))


def result_rows(before: DataFrame, after: DataFrame, messages: DataFrame, selected: DataFrame, carried: DataFrame, items: DataFrame, summaries: DataFrame, renderer: str = "onto") -> DataFrame:
    """A row of metrics for each session's compaction.

    before, after: entries and the compacted lines; messages, selected: the ledger and what of it fits; carried: messages of
    earlier rounds; items: (session_id, kind, anchor, spans); summaries: (session_id, summary_blocks, ...) as summary.SCHEMA.
    Sessions without messages, items or summaries have zeros there.
    """
    from tessera.operators import handoff, scoring, spans, stats

    count = lambda df, name: df.groupBy("session_id").agg(F.count(F.lit(1)).alias(name))
    taken = selected.groupBy("session_id").agg(F.count(F.lit(1)).alias("handoff_user_message_selected_count"), F.sum("rendered_tokens").alias("handoff_user_message_token_estimate"), F.sum("rendered_lines").alias("handoff_user_message_line_count"))
    sizes = {"summary_blocks": "summary_blocks_count", "rules_and_invariants": "rules_and_invariants_count", "plans_and_task_state": "plans_and_task_state_count", "promises_made": "promises_made_count"}
    told = summaries.select("session_id", *(F.greatest(F.size(a), F.lit(0)).alias(n) for a, n in sizes.items()))
    cited = scoring.span_metrics(spans.numbered(items)).withColumnsRenamed({"spans": "rehydrated_span_count", "invalid": "invalid_span_count", "unique_lines": "rehydrated_unique_lines"})
    dense = scoring.density(scoring.density_counts(items)).withColumnsRenamed({"pass": "density_pass", "score": "density_score"}).drop("shortfalls", "promises")
    out = results(before, after).join(stats.transcript_stats(before).select("session_id", F.col("citable").alias("citable_records"), F.col("bytes").alias("before_bytes")), "session_id")
    out = out.join(after.groupBy("session_id").agg(F.sum(F.octet_length("raw") + 1).cast("long").alias("after_bytes")), "session_id")
    for part in (handoff.message_metrics(messages), taken, count(carried, "carried_user_message_count"), told, cited, dense):
        out = out.join(part, "session_id", "left")
    out = out.fillna(0).withColumn("non_citable_records", F.col("before_records") - F.col("citable_records"))
    out = out.withColumn("handoff_user_message_omitted_older_count", F.col("user_message_count") + F.col("carried_user_message_count") - F.col("handoff_user_message_selected_count"))
    return out.withColumn("renderer", F.lit(renderer)).withColumn("density_pass", F.coalesce("density_pass", F.lit(False)))


def verified(runs: DataFrame, spans: int = 30) -> DataFrame:
    """Recorded runs (run_id, ok, live, response, judge_pass, spans) that fail a check, with the first reason."""
    reason = F.when(~F.coalesce("ok", F.lit(False)), "not ok").when(~F.coalesce("live", F.lit(False)), "not live").when(F.coalesce(F.col("response") == "", F.lit(True)), "no response")
    reason = reason.when(~F.coalesce("judge_pass", F.lit(False)), "judge failed").when(~F.coalesce(F.col("spans") >= spans, F.lit(False)), "too few spans")
    return runs.select("run_id", reason.alias("reason")).where("reason IS NOT NULL")
