"""Scores of handoffs: density, spans, evidence, literals, the deterministic score and its gate, pickup readiness."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.literals import is_command
from tessera.functions.text import half_up, is_range, is_sha256, word
from tessera.operators import search

#: Thresholds of the density gate.
DENSITY = {"capsules": 30, "cited": 25, "promises": 0}


def ratio(actual: Column, required: Column, points: int) -> Column:
    """Points for a share reached; all of them where nothing is required."""
    part = F.floor(F.least(F.lit(1.0), F.greatest(F.lit(0.0), actual / required)) * points + 0.5)
    return F.when(F.coalesce(required, F.lit(0)) == 0, F.lit(points)).otherwise(part).cast("long")


def points(condition: Column, n: int) -> Column:
    return F.when(condition, n).otherwise(0).cast("long")


def density_counts(items: DataFrame) -> DataFrame:
    """By session, of items (kind, spans): spans, distinct end points they cite, promises."""
    flat = items.select("session_id", "kind", "anchor", F.explode_outer("spans").alias("s"))
    ends = F.when(F.col("s").isNotNull(), F.array("s.start_line", "s.end_line"))
    counted = flat.groupBy("session_id").agg(F.count("s").alias("evidence_capsules"), F.count_distinct(F.when(F.col("kind") == "promises", F.col("anchor"))).alias("promises"))
    cited = flat.select("session_id", F.explode(ends).alias("line")).groupBy("session_id").agg(F.count_distinct("line").alias("cited_unique_lines"))
    return counted.join(cited, "session_id", "left").select("session_id", "evidence_capsules", F.coalesce("cited_unique_lines", F.lit(0).cast("long")).alias("cited_unique_lines"), "promises")


def density(counts: DataFrame, least: dict[str, int] = DENSITY) -> DataFrame:
    """Shortfalls, pass, and the mean share reached of the first two thresholds."""
    c, l, p = F.col("evidence_capsules"), F.col("cited_unique_lines"), F.col("promises")
    short = F.filter(F.array(F.when(c < least["capsules"], F.lit("capsules")), F.when(l < least["cited"], F.lit("cited")), F.when(p < least["promises"], F.lit("promises"))), lambda x: x.isNotNull())
    share = lambda x, n: F.least(F.lit(1.0), x / max(1, n))
    return counts.withColumn("shortfalls", short).withColumn("pass", F.size("shortfalls") == 0).withColumn("score", (share(c, least["capsules"]) + share(l, least["cited"])) / 2)


def span_metrics(spans: DataFrame) -> DataFrame:
    """By session: spans, invalid ones, distinct lines over whole spans."""
    good = is_range(F.col("start_line") - 1, F.col("end_line") - 1)
    counted = spans.groupBy("session_id").agg(F.count(F.lit(1)).alias("spans"), F.count_if(~good).alias("invalid"))
    lines = spans.where(good).select("session_id", F.explode(F.sequence("start_line", "end_line")).alias("line")).groupBy("session_id").agg(F.count_distinct("line").alias("unique_lines"))
    return counted.join(lines, "session_id", "left").withColumn("unique_lines", F.coalesce("unique_lines", F.lit(0).cast("long")))


#: Fixed value: levels that a state can nest, as the parser has it.
LEVELS = 1_000


def spans_of(state: Column) -> Column:
    """Every span that a state (VARIANT) lists under source_spans, wherever that is: array of (start_line, end_line).

    A walk by levels without recursion: the values of all objects and arrays of one level are the next. Spans
    whose ends aren't both whole numbers don't count.
    """
    whole = lambda v: F.when(F.schema_of_variant(v).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), F.try_variant_get(v, "$", "decimal(38,9)"))
    end = lambda s, n: whole(F.try_variant_get(s, f"$.{n}", "variant"))
    span = lambda s: F.struct(end(s, "start_line").alias("start_line"), end(s, "end_line").alias("end_line"))
    good = lambda s: F.coalesce((s["start_line"] == F.floor(s["start_line"])) & (s["end_line"] == F.floor(s["end_line"])), F.lit(False))
    none, kind = F.array().cast("array<variant>"), "array<struct<start_line:bigint,end_line:bigint>>"

    def found(level: Column) -> Column:
        listed = F.transform(level, lambda v: F.filter(F.transform(F.coalesce(F.try_variant_get(v, "$.source_spans", "array<variant>"), none), span), good))
        return F.flatten(listed).cast(kind)

    def inside(v: Column) -> Column:
        return F.filter(F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.map_values(F.try_variant_get(v, "$", "map<string,variant>")), none), lambda x: x.isNotNull())

    def step(s: Column, _: Column) -> Column:
        deeper = F.flatten(F.transform(s["level"], inside))
        return F.when(F.size(s["level"]) > 0, F.struct(deeper.alias("level"), F.concat(s["spans"], found(s["level"])).alias("spans"))).otherwise(s)

    start = F.struct(F.filter(F.array(state), lambda v: v.isNotNull()).alias("level"), F.array().cast(kind).alias("spans"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(LEVELS)), start, step, lambda s: s["spans"])


def state_spans(states: DataFrame) -> DataFrame:
    """(session_id, start_line, end_line): a row for each span anywhere in states (session_id, state as JSON)."""
    return states.select("session_id", F.explode(spans_of(F.try_parse_json("state"))).alias("s")).select("session_id", "s.*")


def evidence_metrics(capsules: DataFrame) -> DataFrame:
    """By session: capsules, bad ones (a hash or range that isn't one), empty segments, segment characters."""
    bad = ~F.coalesce(is_sha256(F.col("start_hash")) & is_sha256(F.col("end_hash")) & is_sha256(F.col("raw_slice_sha256")) & F.forall("text_segments", lambda s: is_range(s["char_range"][0], s["char_range"][1])), F.lit(False))
    return capsules.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("capsules"), F.sort_array(F.collect_list(F.when(bad, F.col("id")))).alias("bad"),
        F.sum(F.size(F.filter("text_segments", lambda s: s["char_count"] <= 0))).alias("empty_text_segments"),
        F.sum(F.aggregate("text_segments", F.lit(0).cast("long"), lambda a, s: a + s["char_count"])).alias("segment_chars"),
    )


def literal_hits(literals: DataFrame, texts: DataFrame) -> DataFrame:
    """(run_id, literal) pairs where the text holds the literal; empty and null literals are found nowhere."""
    return search.hits(literals, texts, "run_id")


def missing_literals(literals: DataFrame, texts: DataFrame) -> DataFrame:
    """(run_id, literal) that a run's text lacks; literals are of one run each: (run_id, literal)."""
    wanted = literals.select("run_id", "literal").distinct()
    met = wanted.join(texts.select("run_id", "text"), "run_id", "left")
    return met.where(~F.coalesce(F.contains("text", "literal"), F.lit(False))).select("run_id", "literal")


def bad_hashes(manifest: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Manifest rows (run_id, kind, sha256) whose artifact has another hash or is missing."""
    now = artifacts.select("run_id", "kind", F.sha2("content", 256).alias("actual"))
    return manifest.join(now, ["run_id", "kind"], "left").where("actual IS NULL OR actual <> sha256")


def best_attempt(attempts: DataFrame) -> DataFrame:
    """By run: fewest missing literals, then highest density, then the last."""
    return attempts.groupBy("run_id").agg(F.max_by(F.struct("attempt", "missing", "density"), F.struct(-F.col("missing"), "density", "attempt")).alias("b")).select("run_id", "b.*")


def deterministic(runs: DataFrame) -> DataFrame:
    """Scores out of 100 in six categories, and the gate.

    Needs counts and flags by run: ok, bad_hashes, hashes_passed, bad_capsules, capsules, min_capsules,
    unique_lines, min_lines, empty_segments, invalid_spans, intents, min_intents, objective, next_step,
    rules, plans, promises, found, required, unsupported, after_tokens, after_bytes, echo, need_echo.
    """
    c = F.col
    good = (c("bad_hashes") == 0, c("bad_capsules") == 0)
    out = runs.withColumns({
        "integrity": points(c("ok"), 8) + points(good[0], 9) + points(c("hashes_passed") | good[0], 4) + points(good[1], 4),
        "grounding": ratio(c("capsules"), c("min_capsules"), 8) + ratio(c("unique_lines"), c("min_lines"), 3) + points(c("empty_segments") == 0, 2) + points(good[1] & (c("invalid_spans") == 0), 2),
        "continuity": ratio(c("intents"), c("min_intents"), 6) + points(c("objective"), 4) + points(c("next_step"), 4) + points(c("rules") > 0, 2) + points(c("plans") > 0, 2) + points(c("promises") > 0, 2),
        "literals": ratio(c("found"), c("required"), 20),
        "supported": points(c("unsupported") == 0, 10),
        "footprint": points((c("after_tokens") > 0) & (c("after_bytes") > 0), 10),
    })
    out = out.withColumn("score", c("integrity") + c("grounding") + c("continuity") + c("literals") + c("supported") + c("footprint"))
    gate = c("ok") & good[0] & good[1] & (c("invalid_spans") == 0) & (c("found") >= c("required")) & c("objective") & c("next_step") & (~c("need_echo") | c("echo")) & (c("score") >= 85)
    return out.withColumn("gate_pass", gate)


#: Points for each sign of readiness.
PICKUP_POINTS = {
    "current_task": 0.7, "next_action": 0.7, "cwd": 0.3, "git_branch": 0.2, "pickup_rendered": 0.4, "command_extracted": 0.8, "command_rendered": 0.4, "action_concrete": 1.2, "active_files": 0.7, "verification": 0.7, "caveats_present": 0.3,
    "tail_rendered": 0.5, "tail_count": 0.5, "tail_final": 0.3, "tail_policy": 0.2, "capsules": 0.5, "blocks": 0.3, "active_state": 0.2, "stale_run": 1.0, "pickup_first": 0.4, "tail_first": 0.4, "ok": 0.2,
}
#: Words of actions that need a command, of runs, of verification; marks of a finished run.
ACTION_WORDS, RUN_WORDS, CHECK_WORDS = "run|execute|rerun|re-run|test|verify|build|command", "run|execute|rerun|re-run", "test|tests|tested|verify|verified|lint|check|pass|passed"
FINISHED = r"(?i)completed \(exit code 0\)|<status>completed</status>|\"status\"\s*:\s*\"completed\""
FINISHED_IN_TAIL = r"(?i)completed \(exit code 0\)"
PICKUP, TAIL, USERS = "## Pickup State", "## Latest Transcript Tail", "## User Messages"
TAIL_RECORDS, ACTION_CHARS = 8, 12


def _place() -> dict[str, Column]:
    """Whether folder and branch are those of the source, where it tells them."""
    same = lambda own, source: F.when(F.col(source) != "", F.col(own) == F.col(source)).otherwise(F.col(own).isNotNull())
    return {"cwd": same("cwd", "source_cwd"), "git_branch": same("git_branch", "source_branch")}


def _action(full: Callable[[str], Column]) -> dict[str, Column]:
    """An action that asks for a command has one, which the handoff shows; another is told in some words."""
    asks = F.lower("next_action").rlike(word(ACTION_WORDS))
    asks = F.coalesce(asks, F.lit(False))
    return {
        "current_task": full("current_task"), "next_action": full("next_action"), "action_concrete": ~asks & (F.length(F.trim("next_action")) >= ACTION_CHARS),
        "command_extracted": asks & is_command(F.col("next_command")), "command_rendered": asks & full("next_command") & F.contains("handoff", "next_command"),
    }


def _history(listed: Callable[[str], Column]) -> dict[str, Column]:
    """A finished run that is asked for again is explained; verification that the handoff speaks of is listed."""
    asked = F.concat_ws("\n", "current_task", "next_action", "objective", "next_step").rlike("(?i)" + word(RUN_WORDS))
    explained = listed("known_caveats") | (F.coalesce("conflicts", F.lit(0)) > 0) | F.array_join("tail_texts", "\n").rlike(FINISHED_IN_TAIL)
    told = F.col("handoff").rlike("(?i)" + word(CHECK_WORDS))
    return {"stale_run": ~(F.col("handoff").rlike(FINISHED) & asked) | explained, "verification": listed("tests_run") | ~told, "caveats_present": F.col("known_caveats").isNotNull() & F.col("conflicts").isNotNull(), "active_files": listed("active_files")}


def _document(full: Callable[[str], Column]) -> dict[str, Column]:
    """Pickup state and tail stand in the handoff, before the messages of users."""
    at = lambda s: F.instr("handoff", s)
    early = lambda s: (at(s) > 0) & ((at(USERS) == 0) | (at(s) < at(USERS)))
    last = F.trim(F.get("tail_texts", F.size("tail_texts") - 1))
    return {
        "pickup_rendered": at(PICKUP) > 0, "pickup_first": early(PICKUP), "tail_rendered": at(TAIL) > 0, "tail_first": early(TAIL), "tail_policy": full("tail_policy"), "tail_final": last != "",
        "tail_count": F.size("tail_texts") >= F.least(F.lit(TAIL_RECORDS), F.coalesce("lines_seen", F.lit(TAIL_RECORDS))),
    }


def pickup(states: DataFrame) -> DataFrame:
    """Readiness out of 10 from weighted checks; gives each check's points and the clamped sum.

    Needs, by run: current_task, next_action, next_command, cwd, git_branch, source_cwd, source_branch,
    active_files, tests_run, known_caveats, conflicts (count, null if absent), objective, next_step, handoff,
    tail_texts, tail_policy, lines_seen, capsules, blocks, ok. What a check can't tell counts as missed.
    """
    full = lambda n: F.trim(F.col(n)) != ""
    listed = lambda n: F.coalesce(F.exists(F.col(n), lambda v: F.trim(v) != ""), F.lit(False))
    state = {"capsules": F.col("capsules") > 0, "blocks": F.col("blocks") > 0, "active_state": full("objective") & full("next_step"), "ok": F.col("ok")}
    met = _place() | _action(full) | _history(listed) | _document(full) | state
    rows = F.array(*(F.struct(F.lit(n).alias("check"), F.when(F.coalesce(met[n], F.lit(False)), F.lit(p)).otherwise(0.0).alias("points")) for n, p in PICKUP_POINTS.items()))
    total = F.aggregate("checks", F.lit(0.0), lambda s, x: s + x["points"])
    return states.withColumn("checks", rows).withColumn("score", half_up(F.greatest(F.lit(0.0), F.least(F.lit(10.0), total)), 1))


def rounds(metrics: DataFrame, growth: float = 1.1) -> DataFrame:
    """Gates of compaction rounds against the first: (run_id, round, tokens, hashes, objective, next_step, missing, bad, echo)."""
    first = metrics.where("round = 1").select("run_id", F.col("tokens").alias("t1"), F.col("hashes").alias("h1"), F.col("objective").alias("o1"), F.col("next_step").alias("n1"))
    out = metrics.join(first, "run_id")
    gates = {"kept_intents": F.size(F.array_except("h1", "hashes")) == 0, "same_objective": F.col("objective").eqNullSafe(F.col("o1")), "same_next_step": F.col("next_step").eqNullSafe(F.col("n1")), "no_missing": F.col("missing") == 0, "no_bad": F.col("bad") == 0, "sound": F.col("echo"), "bounded": F.col("tokens") <= F.ceil(F.col("t1") * growth)}
    out = out.withColumns({n: F.coalesce(g, F.lit(False)) for n, g in gates.items()})
    passed = F.lit(True)
    for g in gates:
        passed = passed & F.col(g)
    return out.withColumn("pass", passed).drop("t1", "h1", "o1", "n1")


def coupling(lines: DataFrame, categories: dict[str, str]) -> DataFrame:
    """Distinct lines that match any category's pattern, and matches by category."""
    hits = F.filter(F.array(*(F.when(F.col("text").rlike(p), F.lit(n)) for n, p in categories.items())), lambda x: x.isNotNull())
    flat = lines.withColumn("category", F.explode(hits))
    return flat.groupBy("session_id").agg(F.count_distinct("line").alias("coupled_lines"), *(F.count_if(F.col("category") == n).alias(n) for n in categories))
