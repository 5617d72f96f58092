"""Structured summaries: schema, relaxations, derived fields, and validators that report the first error."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import literals
from tessera.functions.text import compact, first_distinct, is_range, is_sha256, or_else, sha256

SPAN = "struct<start_line:int,end_line:int>"
SCHEMA = f"""session_id string,
summary_blocks array<struct<section:string,format:string,body:string,source_spans:array<{SPAN}>>>,
rules_and_invariants array<struct<rule:string,status:string,source_spans:array<{SPAN}>>>,
plans_and_task_state array<struct<item:string,status:string,source_spans:array<{SPAN}>>>,
promises_made array<struct<promise:string,status:string,source_spans:array<{SPAN}>>>,
current_work string, optional_next_step string,
pickup_state struct<cwd:string,git_branch:string,current_task:string,next_action:string,next_command:string,active_files:array<string>,tests_run:array<string>,known_caveats:array<string>,status_conflicts:array<struct<older_state:string,latest_state:string,resolution:string>>>,
source_integrity struct<transcript_sha256:string,transcript_lines_seen:int,verbatim_span_grounded:boolean,limitations:string>"""
#: Statuses.
STATUSES = {"rules_and_invariants": ["current", "superseded", "removed"], "plans_and_task_state": ["done", "active", "pending", "blocked", "superseded"], "promises_made": ["done", "active", "pending", "blocked", "superseded", "removed"]}
TEXTS = {"rules_and_invariants": "rule", "plans_and_task_state": "item", "promises_made": "promise", "summary_blocks": "body"}
LIST_MARK = r"^\s*(?:[-*+]|\d+[.)])\s"


def relaxed(df: DataFrame) -> DataFrame:
    """Formats that can't stand become paragraphs: code blocks, bullets of several lines or with a marker; ``relaxed`` counts them."""
    bad = lambda b: (b["format"] == "code_block") | (b["format"] == "bullet") & (F.contains(b["body"], F.lit("\n")) | b["body"].rlike(LIST_MARK))
    count = F.size(F.filter("summary_blocks", bad))
    return df.withColumn("relaxed", count).withColumn("summary_blocks", F.transform("summary_blocks", lambda b: F.when(bad(b), b.withField("format", F.lit("paragraph"))).otherwise(b)))


def with_defaults(df: DataFrame) -> DataFrame:
    """Rules without a status are current; promises that are missing are none."""
    empty = F.array().cast(df.schema["promises_made"].dataType)
    rules = F.transform("rules_and_invariants", lambda r: r.withField("status", or_else(r["status"], F.lit("current"))))
    return df.withColumn("rules_and_invariants", rules).withColumn("promises_made", F.coalesce("promises_made", empty))


def texts(df: DataFrame) -> Column:
    """All anchored texts, in the order of their arrays."""
    return F.concat(*(F.coalesce(F.transform(a, field(t)), F.array().cast("array<string>")) for a, t in TEXTS.items()))


def field(name: str):
    return lambda x: x[name]


def with_derived(df: DataFrame) -> DataFrame:
    """The six legacy arrays from texts, plans, and the two sentences on work."""
    plans = F.coalesce("plans_and_task_state", F.array().cast(df.schema["plans_and_task_state"].dataType))
    return df.withColumns(literals.legacy_arrays(texts(df), plans, F.col("current_work"), F.col("optional_next_step")))


def with_pickup(df: DataFrame, cwd: Column, branch: Column) -> DataFrame:
    """Pickup fields: cwd and branch as measured, work and next step where missing, files, tests and command from texts."""
    p = F.col("pickup_state")
    own = [F.coalesce(F.transform(a, field(t)), F.array().cast("array<string>")) for a, t in (("summary_blocks", "body"), ("plans_and_task_state", "item"), ("promises_made", "promise"))]
    corpus = F.filter(F.transform(F.concat(F.array("current_work", "optional_next_step"), *own), compact), lambda t: t != "")  # rules name what not to do, too
    none = F.array().cast("array<string>")
    list_of = lambda n: F.coalesce(p[n], none)
    conflicts = F.slice(F.filter(F.coalesce(p["status_conflicts"], F.array().cast("array<struct<older_state:string,latest_state:string,resolution:string>>")), lambda c: (F.trim(c["older_state"]) != "") & (F.trim(c["latest_state"]) != "")), 1, 8)
    made = F.struct(
        F.coalesce(cwd, p["cwd"], F.lit("")).alias("cwd"), F.coalesce(branch, p["git_branch"], F.lit("")).alias("git_branch"),
        or_else(p["current_task"], F.col("current_work")).alias("current_task"), or_else(p["next_action"], F.col("optional_next_step")).alias("next_action"),
        literals.next_command(corpus, F.coalesce(p["next_command"], F.lit(""))).alias("next_command"), literals.pickup_files(corpus, list_of("active_files")).alias("active_files"),
        literals.test_commands(corpus, list_of("tests_run")).alias("tests_run"), first_distinct(list_of("known_caveats"), 12).alias("known_caveats"), conflicts.alias("status_conflicts"),
    )
    return df.withColumn("pickup_state", made)


def with_integrity(df: DataFrame, digest: Column, lines: Column) -> DataFrame:
    """Measured digest and line count in place of what the summary claims."""
    s = F.col("source_integrity")
    return df.withColumn("source_integrity", F.struct(digest.alias("transcript_sha256"), lines.cast("int").alias("transcript_lines_seen"), F.coalesce(s["verbatim_span_grounded"], F.lit(True)).alias("verbatim_span_grounded"), F.coalesce(s["limitations"], F.lit("")).alias("limitations")))


def bad_spans(spans: Column, lines: Column) -> Column:
    inside = lambda s: F.coalesce((s["start_line"] >= 1) & (s["end_line"] >= s["start_line"]) & (s["end_line"] <= lines), F.lit(False))
    return F.coalesce(F.size(spans) == 0, F.lit(True)) | F.exists(spans, lambda s: ~inside(s))


def first_error(df: DataFrame, lines: Column) -> DataFrame:
    """(session_id, error): the first rule a summary breaks, null for none; rules are in a fixed order."""
    blank = lambda x: F.coalesce(F.trim(x) == "", F.lit(True))
    some = lambda a, f: F.coalesce(F.exists(a, lambda x: F.coalesce(f(x), F.lit(True))), F.lit(False))
    rules = [
        (blank(F.col("current_work")), "current_work must not be blank"), (blank(F.col("optional_next_step")), "optional_next_step must not be blank"),
        *((F.col(a).isNull(), f"{a} must be an array") for a in ("summary_blocks", "rules_and_invariants", "plans_and_task_state", "promises_made")),
        (F.col("source_integrity").isNull(), "source_integrity is missing"), (F.col("source_integrity.transcript_lines_seen") != lines, "transcript_lines_seen differs"),
        (F.col("pickup_state").isNull(), "pickup_state is missing"),
        (some("summary_blocks", lambda b: ~b["format"].isin("paragraph", "bullet")), "summary_blocks has an unknown format"),
        (some("summary_blocks", lambda b: (b["format"] == "bullet") & (F.contains(b["body"], F.lit("\n")) | b["body"].rlike(LIST_MARK))), "a bullet must be one line without a marker"),
    ]
    for a, t in (("summary_blocks", "body"), ("rules_and_invariants", "rule"), ("plans_and_task_state", "item"), ("promises_made", "promise")):
        own = field(t)
        rules.append((some(a, lambda x: blank(own(x))), f"{a} has a blank {t}"))
        if known := STATUSES.get(a):
            rules.append((some(a, lambda x: ~x["status"].isin(*known)), f"{a} has an unknown status"))
        rules.append((some(a, lambda x: bad_spans(x["source_spans"], lines)), f"{a} has a bad span"))
    error = F.lit(None).cast("string")
    for broken, message in reversed(rules):
        error = F.when(F.coalesce(broken, F.lit(False)), message).otherwise(error)
    return df.select("session_id", error.alias("error"))


def message_errors(messages: DataFrame) -> DataFrame:
    """First error of each ledger message (session_id, ord, line, sha256, char_count, text)."""
    error = F.when(F.coalesce(F.trim("text") == "", F.lit(True)), "blank text").when(~F.coalesce(is_sha256(F.col("sha256")), F.lit(False)), "bad sha256").when(F.col("sha256") != sha256(F.col("text")), "sha256 differs")
    error = error.when(F.col("char_count") != F.length("text"), "char_count differs").when(~F.coalesce(F.col("line") >= 1, F.lit(False)), "bad line")
    return messages.select("session_id", "ord", error.alias("error")).where("error IS NOT NULL")


def capsule_errors(capsules: DataFrame) -> DataFrame:
    """First error of each capsule: hashes, range, segments outside of the range."""
    hashes = is_sha256(F.col("start_hash")) & is_sha256(F.col("end_hash")) & is_sha256(F.col("raw_slice_sha256"))
    inside = F.forall("text_segments", lambda s: (s["line"] >= F.col("start_line")) & (s["line"] <= F.col("end_line")))
    error = F.when(~F.coalesce(hashes, F.lit(False)), "bad hash").when(~F.coalesce(is_range(F.col("start_line"), F.col("end_line")), F.lit(False)), "bad range").when(~F.coalesce(inside, F.lit(False)), "segment out of range")
    return capsules.select("session_id", "id", error.alias("error")).where("error IS NOT NULL")


def line_rules(lines: Column) -> Column:
    """The schema's rules on spans as a table: array<struct<field,least,most>>, bound to a transcript's lines."""
    fields = [f"{a}[].source_spans[].{end}" for a in ("summary_blocks", *STATUSES) for end in ("start_line", "end_line")]
    return F.array(*(F.struct(F.lit(f).alias("field"), F.lit(1).alias("least"), lines.cast("int").alias("most")) for f in [*fields, "source_integrity.transcript_lines_seen"]))


def intent_errors(events: DataFrame) -> DataFrame:
    """First error of each intent event (session_id, id, kind, priority, status, line, text_sha256, text)."""
    from tessera.functions.intents import RANKS

    kinds = ["constraint", "safety", "correction", "preference", "request"]
    good = lambda x: F.coalesce(x, F.lit(False))
    error = F.when(~good(F.col("id").rlike("^intent-[0-9]{4,}$")), "bad id").when(~good(F.col("kind").isin(*kinds)), "unknown kind").when(~good(F.col("priority").isin(*RANKS)), "unknown priority")
    error = error.when(~good(F.col("line") >= 1), "bad line").when(~good(is_sha256(F.col("text_sha256"))), "bad sha256").when(~good(F.col("text_sha256") == sha256(F.col("text"))), "text sha256 differs")
    return events.select("session_id", "id", error.alias("error")).where("error IS NOT NULL")


def timeline(messages: DataFrame, items: DataFrame) -> DataFrame:
    """User messages and model items (session_id, line, text) as one list: by line, users first."""
    from pyspark.sql import Window

    out = messages.select("session_id", "line", F.lit(0).alias("side"), "text").union(items.select("session_id", "line", F.lit(1), "text"))
    return out.withColumn("ord", F.row_number().over(Window.partitionBy("session_id").orderBy("line", "side", "text")))


def handoff_state(df: DataFrame) -> DataFrame:
    """One nested document a session; blockers are the plans that are blocked."""
    blockers = F.transform(F.filter("plans_and_task_state", lambda p: p["status"] == "blocked"), lambda p: p["item"])
    active = F.struct(F.col("current_work").alias("current_objective"), F.col("optional_next_step").alias("next_step"), blockers.alias("blockers"))
    return df.select("session_id", F.struct(F.lit("handoff-state.v1").alias("version"), active.alias("active_state"), *(F.col(c) for c in df.columns if c != "session_id")).alias("state"))
