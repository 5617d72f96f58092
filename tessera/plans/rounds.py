"""Compaction in rounds: what one round writes is read again as the next one's transcript.

Each round parses the lines that the last one wrote, so gates are taken on real output: the ledger has to survive being
rendered and read back, and its size has to stay. A round's summary is made from the state the last one left, with all
citations on the record that carries it, as no model is asked again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import or_else, sha256, tokens
from tessera.operators import handoff, ledger, scoring
from tessera.plans import compact, reask
from tessera.sources import folders, transcripts

#: What stands where a state says nothing.
SECTION, NO_WORK, NO_STEP = "Current State", "The state of work was kept.", "Go on from the saved state."


def record_columns() -> list[Column]:
    """All that a round asks of a line's record; the same for each round, so built once."""
    r = F.col("record")
    made = {"hash": sha256(F.col("raw")), "text": transcripts.evidence_text(r), "is_summary": transcripts.truthy(r, "$.isCompactSummary"), "carried": ledger.summary_messages(r), "own": ledger.own_message(r, F.col("line"), sha256(F.col("raw")))}
    return [F.col("session_id"), F.col("line"), F.col("raw"), *(x.alias(n) for n, x in made.items())]


def entries_of(lines: DataFrame, columns: list[Column]) -> DataFrame:
    """Entries of lines (session_id, ord, raw), with ``columns`` of record_columns, written once.

    A round reads its entries some ten times; none of its steps parses a record or looks for messages again.
    """
    number = F.row_number().over(Window.partitionBy("session_id").orderBy("ord"))
    numbered = lines.select("session_id", "raw", number.alias("line"))  # lines are dealt, not what is made of them
    return folders.kept(transcripts.parsed(numbered).select(*columns), "entries")


def summary_line(entries: DataFrame) -> DataFrame:
    """(session_id, seen, cited): lines of a session, and the line of its summary record (the first one where there is none)."""
    return entries.groupBy("session_id").agg(F.count(F.lit(1)).cast("int").alias("seen"), F.coalesce(F.min(F.when(F.col("is_summary"), F.col("line"))), F.lit(1)).cast("int").alias("cited"))


def from_state(states: DataFrame, entries: DataFrame) -> DataFrame:
    """Outputs (session_id, s) of the next round from states (session_id, s) and the entries that it reads."""
    out = states.join(summary_line(entries), "session_id")
    s = F.col("s")
    span = F.array(F.struct(F.col("cited").alias("start_line"), F.col("cited").alias("end_line")))
    cited = lambda n: F.transform(F.coalesce(s[n], F.array().cast(states.schema["s"].dataType[n].dataType)), lambda x: x.withField("source_spans", span))
    work, step = or_else(s["current_work"], F.lit("")), or_else(s["optional_next_step"], F.lit(NO_STEP))
    alone = F.array(F.struct(F.lit(SECTION).alias("section"), F.lit("paragraph").alias("format"), or_else(work, F.lit(NO_WORK)).alias("body"), span.alias("source_spans")))
    blocks = F.when(F.size(s["summary_blocks"]) > 0, cited("summary_blocks")).otherwise(alone)
    made = s.withField("summary_blocks", blocks).withField("current_work", or_else(work, blocks[0]["body"])).withField("optional_next_step", step)
    for n in ("rules_and_invariants", "plans_and_task_state", "promises_made"):
        made = made.withField(n, cited(n))
    integrity = F.struct(F.lit(None).cast("string").alias("transcript_sha256"), F.col("seen").alias("transcript_lines_seen"), F.lit(True).alias("verbatim_span_grounded"), F.lit("").alias("limitations"))
    return out.select("session_id", made.withField("source_integrity", integrity.cast(states.schema["s"].dataType["source_integrity"].dataType)).alias("s"))


def _sections() -> Column:
    c = lambda n: F.coalesce(F.col("s")[n], F.array())
    return handoff.blocks_section(c("summary_blocks"), c("rules_and_invariants"), c("plans_and_task_state"), c("promises_made"))


def round_of(e: DataFrame, states: DataFrame, literals: DataFrame, tail: int = compact.TAIL, columns: list[Column] | None = None, **budget: int) -> tuple[DataFrame, DataFrame]:
    """One round over entries: the entries of what it writes (without ``columns``, for the last one, its lines), and its metrics by session."""
    chosen = folders.kept(ledger.selected(ledger.of_messages(e), **budget).select("session_id", "ord", "sha256", "priority", "rendered"), "chosen")
    after = compact.with_ledger(transcripts.parsed(e), states.select("session_id", _sections().alias("summary")), chosen, tail)
    after = entries_of(after, columns) if columns else folders.kept(after, "after")
    text = reask.rehydrated(states, e)
    state = F.to_json(F.col("s"))
    # Artifacts go to the folder with the hash of what was meant, and are read again to see what is there.
    made = states.select("session_id", F.lit("state").alias("kind"), state.alias("content")).union(text.select("session_id", F.lit("rehydrated"), "text"))
    stored = folders.kept(made.select(F.col("session_id").alias("run_id"), "kind", "content", sha256(F.col("content")).alias("meant")), "artifacts")
    bad = scoring.bad_hashes(stored.select("run_id", "kind", F.col("meant").alias("sha256")), stored)
    bad = bad.groupBy(F.col("run_id").alias("session_id")).agg(F.count(F.lit(1)).alias("bad"))
    lost = scoring.missing_literals(literals.select(F.col("session_id").alias("run_id"), "literal"), stored.where("kind = 'rehydrated'").select("run_id", F.col("content").alias("text")))
    lost = lost.groupBy(F.col("run_id").alias("session_id")).agg(F.count(F.lit(1)).alias("missing"))
    strong = F.when(F.col("priority").isin("must_keep", "high"), F.col("sha256"))
    intents = chosen.groupBy("session_id").agg(F.count(F.lit(1)).alias("messages"), F.array_sort(F.collect_set(strong)).alias("hashes"))  # at most a ledger's messages
    size = after.groupBy("session_id").agg(F.count(F.lit(1)).alias("records"), tokens(F.sum(F.length("raw") + 1)).alias("tokens"), F.sum(F.octet_length("raw") + 1).alias("bytes"))
    told = states.join(summary_line(e), "session_id").select(
        "session_id", sha256(F.coalesce("s.current_work", F.lit(""))).alias("objective"), sha256(F.coalesce("s.optional_next_step", F.lit(""))).alias("next_step"),
        (F.col("s.source_integrity.transcript_lines_seen") == F.col("seen")).alias("echo"), F.size(F.flatten(F.concat(*(F.coalesce(F.col("s")[n]["source_spans"], F.array()) for n in reask.ARRAYS.values())))).alias("capsules"),
    )
    out = size.join(told, "session_id")
    for part in (intents, bad, lost):
        out = out.join(part, "session_id", "left")
    out = out.fillna(0, ["messages", "bad", "missing"]).withColumn("hashes", F.coalesce("hashes", F.array().cast("array<string>")))
    return after, folders.kept(out, "metrics")


def rounds(lines: DataFrame, outputs: DataFrame, literals: DataFrame, most: int = 5, tail: int = 0, growth: float = 1.1, **budget: int) -> DataFrame:
    """Metrics and gates of ``most`` rounds, a row a session and round.

    lines: (session_id, ord, raw); outputs: (session_id, output) of the first round; literals: (session_id, literal) that must stay.
    """
    # Outputs are few bytes and much work: dealt to all tasks, and parsed once, as a filter before the write would do it again.
    states = folders.kept(reask.parsed(folders.dealt(outputs, "session_id")).select("session_id", "s"), "states").where("s IS NOT NULL")
    columns = record_columns()
    e, out = entries_of(lines, columns), None
    for n in range(1, most + 1):
        e, metrics = round_of(e, states, literals, tail, columns if n < most else None, **budget)
        metrics = metrics.withColumn("round", F.lit(n))  # of what this round has written
        out = metrics if out is None else out.union(metrics)
        if n < most:
            states = folders.kept(from_state(states, e), "states")
    return scoring.rounds(out.withColumnRenamed("session_id", "run_id"), growth)
