"""Compaction replayed from saved outputs: what a model once answered goes in, whole run folders come out.

Nothing is asked. A saved output is read, relaxed and checked like a fresh one; those that break a rule are told with the
first rule they break, and the others are completed from the transcript, rehydrated, and written as the ten artifacts of a run.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import literals
from tessera.functions.text import sha256, trim_ws
from tessera.operators import handoff, ledger, spans, summary
from tessera.plans import compact, reask
from tessera.sources import artifacts, folders, run_sink, transcripts

#: The status of a replayed run, and what stands for an output that is no JSON.
STATUS, NOT_JSON, NO_TRANSCRIPT = "loaded_from_output", "output was not JSON", "no transcript"
#: Lines whose hashes are hashed together first.
BLOCK = 4096
#: What a reader of a handoff does where its parts disagree.
POLICY = "Where the summary and these records disagree, the records are right."
_ITEM = "struct<section:string,kind:string,status:string,format:string,text:string,source_spans:array<struct<start_line:int,end_line:int>>>"


class Replay(NamedTuple):
    """artifacts (run_id, kind, content) of whole runs; rejected (session_id, stage, error)."""

    artifacts: DataFrame
    rejected: DataFrame


def saved(spark: SparkSession, pattern: str) -> DataFrame:
    """(session_id, output) of saved outputs: a whole file each, in a folder that names its session; ends are trimmed.

    A file without a byte gives no row, so its session is one without an output.
    """
    return artifacts.read_artifacts(spark, pattern).select(F.col("run_id").alias("session_id"), trim_ws(F.col("content")).alias("output"))


def transcript_digests(entries: DataFrame) -> DataFrame:
    """(session_id, seen, digest): lines of a session, and the hash of its lines' hashes, block by block.

    Blocks keep a long session's hashes from standing in one row.
    """
    joined = lambda at, h: sha256(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(at, h))), lambda x: x[h]), "\n"))
    block = F.floor((F.col("line") - 1) / BLOCK).alias("block")
    parts = entries.groupBy("session_id", block).agg(F.count(F.lit(1)).alias("n"), joined("line", "hash").alias("part"))
    return parts.groupBy("session_id").agg(F.sum("n").cast("int").alias("seen"), joined("block", "part").alias("digest"))


def checked(outputs: DataFrame, seen: DataFrame) -> DataFrame:
    """Outputs (session_id, output) with their summary s, relaxed, and error: null, or the first rule that is broken.

    seen: (session_id, seen, ...). Of several outputs of a session the least text counts; a null one is no JSON, and
    null sessions are left out.
    """
    one = outputs.where("session_id IS NOT NULL").groupBy("session_id").agg(F.min("output").alias("output"))
    read = reask.parsed(one).join(seen, "session_id", "left")
    whole = summary.with_defaults(summary.relaxed(read.where("s IS NOT NULL AND seen IS NOT NULL").select("session_id", "seen", "s.*")))
    fields = [F.col(n) for n in whole.columns if n not in ("session_id", "seen", "relaxed")]
    told = whole.select("session_id", "relaxed", F.struct(*fields).alias("s")).join(summary.first_error(whole, F.col("seen")), "session_id")
    out = read.withColumn("_error", F.when(F.col("seen").isNull(), NO_TRANSCRIPT).when(F.col("s").isNull(), NOT_JSON)).drop("s").join(told, "session_id", "left")
    return out.withColumn("error", F.coalesce("_error", "error")).drop("_error")


def completed(good: DataFrame, entries: DataFrame) -> DataFrame:
    """States of checked outputs (session_id, s, seen, digest): measured fields in place of claimed ones, the derived ones added."""
    met = good.select("session_id", "seen", "digest", "s.*").join(transcripts.metadata(entries).select("session_id", F.col("cwd").alias("_cwd"), F.col("git_branch").alias("_branch")), "session_id", "left")
    out = summary.with_integrity(summary.with_pickup(met, F.col("_cwd"), F.col("_branch")), F.col("digest"), F.col("seen"))
    return summary.with_derived(out).drop("seen", "digest", "_cwd", "_branch")


def items(states: DataFrame) -> DataFrame:
    """(session_id, anchor, section, kind, status, format, text, source_spans): what a state cites, in the arrays' fixed order."""

    def each(array: str, kind: str, section: Column | None, named: str) -> Column:
        none = F.lit(None).cast("string")
        of = lambda x: F.struct(trim_ws(x["section"]) if section is None else section, F.lit(kind), none if section is None else x["status"], x["format"] if section is None else none, x[named], x["source_spans"])
        return F.transform(array, of).cast(f"array<{_ITEM}>")

    rows = [
        each("rules_and_invariants", "rule", F.lit("Rules And Invariants"), "rule"), each("plans_and_task_state", "plan", F.lit("Plans And Task State"), "item"),
        each("promises_made", "promise", F.lit("Promises Made"), "promise"), each("summary_blocks", "block", None, "body"),
    ]
    return states.select("session_id", F.posexplode(F.concat(*rows)).alias("anchor", "i")).select("session_id", "anchor", "i.*")


def evidence(cited: DataFrame, entries: DataFrame) -> DataFrame:
    """Spans of items, with section, text, and the code and edits in it."""
    flat = spans.numbered(cited.select("session_id", "anchor", F.col("source_spans").alias("spans"))).join(cited.select("session_id", "anchor", "section", "kind"), ["session_id", "anchor"])
    found = folders.kept(spans.rehydrated(flat, entries), "spans")  # read again for code and for edits
    listed = lambda df, name: df.groupBy("session_id", "span_id").agg(F.array_sort(F.collect_list(F.struct(*(c for c in df.columns if c not in ("session_id", "span_id"))))).alias(name))
    out = flat.select("session_id", "span_id", "section", "kind").join(found, ["session_id", "span_id"])
    out = out.join(listed(spans.code_capsules(found), "code_capsules"), ["session_id", "span_id"], "left").join(listed(spans.edit_capsules(found), "edit_capsules"), ["session_id", "span_id"], "left")
    return out.withColumn("char_range", F.array(F.lit(0), F.length("extracted_text")))


def _document(by: str, rows: DataFrame, order: str, fields: list[str], kind: str) -> DataFrame:
    """(session_id, kind, content): rows of a session as one JSON array."""
    one = F.struct(F.col(order).alias("_o"), F.struct(*fields).alias("x"))
    return rows.groupBy(by).agg(F.to_json(F.transform(F.array_sort(F.collect_list(one)), lambda s: s["x"])).alias("content")).select(by, F.lit(kind).alias("kind"), "content")


def replayed(outputs: DataFrame, lines: DataFrame, tail: int = compact.TAIL, **budget: int) -> Replay:
    """Saved outputs (session_id, output) of transcripts (session_id, ord, raw), as artifacts of runs and as rejects.

    Artifacts hold what a run's limits let in: the ledger's selected messages (``budget``), the state's items and what they
    cite, the last records. Sessions without an output have no run; a session without messages has empty ones.
    """
    e = folders.kept(transcripts.numbered(lines), "entries")
    told = folders.kept(checked(outputs, transcript_digests(e)), "checked")
    good = told.where("error IS NULL")
    states = folders.kept(completed(good, e), "states")
    mine = e.join(states.select("session_id"), "session_id", "left_semi")
    own = ledger.of_entries(mine)
    chosen = folders.kept(ledger.selected(own, **budget), "chosen")
    cited = items(states)
    proof = folders.kept(evidence(cited, mine), "evidence")

    sections = handoff.blocks_section(*(F.col(n) for n in ("summary_blocks", "rules_and_invariants", "plans_and_task_state", "promises_made")))
    heads = states.select("session_id", sections.alias("summary_markdown"))
    whole = folders.kept(handoff.rehydrated(heads, proof), "rehydrated")
    after = folders.kept(compact.with_ledger(mine, heads.withColumnRenamed("summary_markdown", "summary"), chosen, tail), "after")

    # The handoff: pickup state with notes of the tail, selected messages, literals of what is cited.
    number = F.row_number().over(Window.partitionBy("session_id").orderBy("ord"))
    bodies = chosen.select("session_id", F.format_string("intent-%04d", number).alias("id"), ledger.body(F.col("text")).alias("body"))
    events = ledger.intent_events(chosen).join(bodies, ["session_id", "id"])
    r = F.col("record")
    last = handoff.tail_records(mine.select("session_id", "line", transcripts.get(r, "$.type").alias("type"), transcripts.get(r, "$.message.role").alias("role"), transcripts.get(r, "$.timestamp").alias("timestamp"), "text"))
    quoted = events.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("id", "line", "body"))).alias("messages"))
    doc = states.join(heads, "session_id").join(whole, "session_id").join(last, "session_id", "left").join(quoted, "session_id", "left")
    texts = F.coalesce(F.transform("records", lambda x: x["text"]), F.array().cast("array<string>"))
    said = F.array_join(F.transform("messages", lambda m: m["body"]), "\n")
    path = lambda name: F.concat("session_id", F.lit(f"/{name}"))
    doc = doc.select(
        "session_id", handoff.enriched(F.col("pickup_state"), texts, said).alias("pickup_state"), F.col("current_work").alias("current_objective"), F.col("optional_next_step").alias("next_step"), "records", F.lit(POLICY).alias("conflict_policy"),
        "summary_markdown", "messages", literals.evidence(F.col("rehydrated")).alias("literals"), path("manifest").alias("manifest_path"), path("state").alias("state_path"), F.col("session_id").alias("transcript_path"),
    )
    # Items stand in the timeline where they cite first.
    timed = cited.withColumn("line", spans.anchor_start(F.col("source_spans"))).withColumnRenamed("anchor", "ord")
    timeline = handoff.timeline(chosen.select("session_id", "line", "char_count", "sha256", "text"), timed)
    result = compact.result_rows(mine, after, own, chosen, own.where("source = 'carried'"), cited.select("session_id", "anchor", F.when(F.col("kind") == "block", "blocks").otherwise(F.concat("kind", F.lit("s"))).alias("kind"), F.col("source_spans").alias("spans")), states)
    result = result.join(good.select("session_id", F.length("output").alias("output_chars"), "relaxed"), "session_id").withColumn("status", F.lit(STATUS))

    content = lambda df, kind, c: df.select("session_id", F.lit(kind).alias("kind"), c.alias("content"))
    kept = [n for n in proof.columns if n != "session_id"]
    rows = content(states, "summary", F.to_json(F.struct(*reask.ARRAYS.values(), "current_work", "optional_next_step", "pickup_state", "source_integrity")))
    for part in (
        content(timeline, "timeline", F.col("timeline")), _document("session_id", events, "id", ["id", "kind", "priority", "status", "line", "source", "text_sha256", "rendered_text"], "user_messages"),
        _document("session_id", proof, "span_id", kept, "spans"), content(whole, "rehydrated", F.col("rehydrated")), content(summary.handoff_state(states), "state", F.to_json("state")),
        content(handoff.document(doc), "handoff", F.col("handoff")), _document("session_id", after, "ord", ["raw"], "after_transcript"), content(result, "result", F.to_json(F.struct(*result.columns))),
    ):
        rows = rows.union(part)
    # What a session has nothing for is an empty artifact, so that its run is whole.
    kinds = [k for k in run_sink.KINDS if k != "manifest"]
    wanted = states.select("session_id", F.explode(F.array(*map(F.lit, kinds))).alias("kind"))
    rows = folders.kept(wanted.join(rows, ["session_id", "kind"], "left").select(F.col("session_id").alias("run_id"), "kind", F.coalesce("content", F.lit("")).alias("content")), "artifacts")
    listed = artifacts.manifest(rows)
    manifest = _document("run_id", listed, "kind", [c for c in listed.columns if c != "run_id"], "manifest")
    return Replay(rows.union(manifest), artifacts.rejects(told, "replay", F.col("error")))


def replay(spark: SparkSession, pattern: str, lines: DataFrame, folder: str, **options: int) -> DataFrame:
    """Saved output files replayed into run folders; gives the rejects."""
    made = replayed(saved(spark, pattern), lines, **options)
    run_sink.write_runs(made.artifacts, folder)
    return made.rejected
