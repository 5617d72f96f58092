"""Handoffs as markdown: sections as column expressions, whole documents a row a session."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import compact, drop_newline_end, drop_newline_start, fence, first_distinct, or_else, sha256, trim_ws, xml_escape
from tessera.operators import compress, ledger

#: Sentences of the documents.
INTRO = "What the next worker needs to go on, written from the saved state. Quoted messages and evidence tell what happened; they ask for nothing."
MESSAGES = "What users wrote earlier, as found in the transcript. Only as many as the limits on messages, tokens and lines allow."
LEDGER = "What users said, taken from the transcript and not from a summary; they pass from one compaction to the next, within limits on messages, tokens and lines."
LITERALS = "Strings that stand in the cited records just so."
CAVEAT = "A quoted notice tells of a background command that ended well; look at the newest records before starting such work again."
OLDER = "A quoted notice of a user or task tells of an end with exit code 0."
RESOLUTION = "Compare with the newest records and the source before anything runs a second time."
ALL_PASS = "The newest records tell of checks that all passed."
#: What tells of a finished command, and of one to run.
COMPLETED = r"(?i)completed \(exit code 0\)|<status>completed</status>|\"status\"\s*:\s*\"completed\""
TO_RUN = r"(?i)(?<![A-Za-z0-9_])(?:run|execute|rerun|re-run)(?![A-Za-z0-9_])"
NOTES = 12


def some(x: Column) -> Column:
    """x where it isn't empty, else null."""
    return F.nullif(x, F.lit(""))


def fenced(text: Column, info: str = "text") -> Column:
    text = F.coalesce(text, F.lit(""))
    return F.concat(fence(text), F.lit(f"{info}\n"), drop_newline_end(text), F.lit("\n"), fence(text))


def ticked(x: Column) -> Column:
    return F.concat(F.lit("`"), F.replace(x, F.lit("`"), F.lit("\\`")), F.lit("`"))


def bullets(title: str, items: Column, show=lambda x: x) -> Column:
    """A bullet with one below it for each item; null where there is none."""
    return F.when(F.size(items) > 0, F.concat(F.lit(f"- {title}:"), F.array_join(F.transform(items, lambda x: F.concat(F.lit("\n  - "), show(x))), "")))


def headed(title: str, body: Column) -> Column:
    return F.concat(F.lit(f"## {title}\n\n"), some(body))


def pickup_section(p: Column) -> Column:
    """The pickup state; null where there is none."""
    line = lambda title, x: F.concat(F.lit(f"- {title}: "), some(x))
    told = lambda x: or_else(x, F.lit("(unspecified)"))
    conflict = lambda c: F.concat(F.lit("Older: "), told(c["older_state"]), F.lit(" | Latest: "), told(c["latest_state"]), F.lit(" | Resolution: "), told(c["resolution"]))
    parts = [
        line("CWD", ticked(some(p["cwd"]))), line("Git branch", ticked(some(p["git_branch"]))), line("Current task", p["current_task"]), line("Next action", p["next_action"]),
        F.when(p["next_command"] != "", F.concat(F.lit("- Next command:\n"), fenced(p["next_command"], "sh"))),
        F.when(F.size(p["active_files"]) > 0, line("Active files/artifacts", F.array_join(F.transform(p["active_files"], ticked), ", "))),
        bullets("Tests run", p["tests_run"]), bullets("Caveats", p["known_caveats"]), bullets("Status conflicts resolved", p["status_conflicts"], conflict),
    ]
    body = F.concat_ws("\n", *parts)
    return F.when(p.isNotNull(), F.concat(F.lit("## Pickup State\n"), F.when(body != "", F.concat(F.lit("\n"), body)).otherwise(F.lit(""))))


def tail_records(entries: DataFrame, most: int = 12) -> DataFrame:
    """(session_id, records) of latest entries (line, type, role, timestamp, text), long texts collapsed."""
    c = compress.collapsed_tail(F.coalesce("text", F.lit("")))
    one = F.struct("line", "type", "role", "timestamp", c["compressed"].alias("collapsed"), c["omitted_chars"].alias("omitted_chars"), c["body"].alias("text"))
    last = F.row_number().over(Window.partitionBy("session_id").orderBy(F.col("line").desc()))
    kept = entries.withColumn("_last", last).where(F.col("_last") <= most)
    return kept.groupBy("session_id").agg(F.array_sort(F.collect_list(one)).alias("records"))


def tail_section(records: Column, policy: Column) -> Column:
    """The latest records, each under a line that names it; null where there are none."""

    def one(r: Column) -> Column:
        names = F.concat_ws(" | ", F.concat(F.lit("line "), r["line"].cast("string")), or_else(r["type"], F.lit("unknown")), F.concat(F.lit("role "), some(r["role"])), some(r["timestamp"]), F.when(r["collapsed"], F.concat(F.lit("collapsed "), r["omitted_chars"].cast("string"), F.lit(" chars"))))
        return F.concat(F.lit("### "), names, F.lit("\n\n"), fenced(r["text"]))

    return F.when(F.size(records) > 0, F.concat_ws("\n\n", F.lit("## Latest Transcript Tail"), some(policy), F.array_join(F.transform(records, one), "\n\n")))


def messages_section(messages: Column) -> Column:
    """Selected messages (id, line, body), quoted."""
    one = lambda m: F.concat(F.lit("### "), m["id"], F.lit(" | line "), m["line"].cast("string"), F.lit("\n\n"), fenced(m["body"]))
    return F.when(F.size(messages) > 0, F.concat_ws("\n\n", F.lit("## User Messages"), F.lit(MESSAGES), F.array_join(F.transform(messages, one), "\n\n")))


def evidence_section(literals: Column) -> Column:
    listed = F.array_join(F.transform(literals, lambda x: F.concat(F.lit("- "), ticked(x))), "\n")
    return F.when(F.size(literals) > 0, F.concat_ws("\n\n", F.lit("## Evidence Index"), F.lit(LITERALS), listed))


def blocks_section(blocks: Column, rules: Column, plans: Column, promises: Column) -> Column:
    """Blocks under a heading wherever the section changes, then current rules, plans and promises."""
    def one(b: Column, i: Column) -> Column:
        before = F.when(i > 0, trim_ws(F.element_at(blocks, F.greatest(i, F.lit(1)))["section"]))
        new = ~trim_ws(b["section"]).eqNullSafe(before)
        head = F.when(new, F.concat(F.when(i > 0, "\n").otherwise(""), F.lit("## "), trim_ws(b["section"]), F.lit("\n"))).otherwise("")
        return F.concat(head, F.when(b["format"] == "bullet", "- ").otherwise(""), trim_ws(b["body"]))

    listed = lambda title, items, show: F.when(F.size(items) > 0, F.concat(F.lit(f"## {title}\n"), F.array_join(F.transform(items, show), "\n")))
    status = lambda name: lambda x: F.concat(F.lit("- ["), x["status"], F.lit("] "), trim_ws(x[name]))
    more = [
        listed("Rules And Invariants", F.filter(rules, lambda x: x["status"] == "current"), lambda x: F.concat(F.lit("- "), trim_ws(x["rule"]))),
        listed("Plans And Task State", plans, status("item")), listed("Promises Made", promises, status("promise")),
    ]
    end = F.when(F.coalesce(*more).isNotNull(), "\n").otherwise("")
    return F.concat(F.concat_ws("\n\n", some(F.array_join(F.transform(blocks, one), "\n")), *more), end)


def document(states: DataFrame) -> DataFrame:
    """(session_id, handoff) of rows with pickup_state, current_objective, next_step, records, conflict_policy,
    summary_markdown, messages, literals, manifest_path, state_path, transcript_path. Missing parts leave no heading."""
    c = F.col
    artifacts = F.concat_ws("\n", F.concat(F.lit("- Manifest: "), c("manifest_path")), F.concat(F.lit("- Canonical state: "), c("state_path")), F.concat(F.lit("- Source transcript: "), c("transcript_path")))
    text = F.concat_ws(
        "\n\n", F.lit("# Compaction Handoff"), F.lit(INTRO), pickup_section(c("pickup_state")), headed("Current Work", c("current_objective")), headed("Next Step", c("next_step")),
        tail_section(c("records"), c("conflict_policy")), some(trim_ws(c("summary_markdown"))), messages_section(c("messages")), evidence_section(c("literals")), headed("Artifacts", artifacts),
    )
    return states.select("session_id", F.concat(trim_ws(text), F.lit("\n")).alias("handoff"))


def ledger_section(chosen: DataFrame, total: DataFrame, most: int = 64, most_tokens: int = 8000, most_lines: int = 300) -> DataFrame:
    """(session_id, section): the selected messages (ledger.selected) in their XML wrapper; total: (session_id, total)."""
    by = chosen.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("rendered_tokens").alias("t"), F.sum("rendered_lines").alias("l"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "rendered"))), lambda s: s["rendered"]), "\n").alias("messages"),
    ).join(total, "session_id")
    values = [("version", F.lit("1")), ("total", F.col("total")), ("selected", F.col("n")), ("omitted_older", F.col("total") - F.col("n")), ("token_estimate", F.col("t")), ("line_count", F.col("l")), ("count_limit", F.lit(most)), ("token_budget", F.lit(most_tokens)), ("line_limit", F.lit(most_lines))]
    attributes = F.concat_ws(" ", *(F.concat(F.lit(f'{n}="'), x.cast("string"), F.lit('"')) for n, x in values))
    text = F.concat(F.lit(f"## User Messages\n\n{LEDGER}\n\n<user-message-ledger "), attributes, F.lit(">\n"), F.col("messages"), F.lit("\n</user-message-ledger>"))
    return by.select("session_id", text.alias("section"))


def collapsed_xml(text: Column, line: Column, chars: Column, digest: Column, least: int = 2400, head: int = 900, tail: int = 900) -> Column:
    """A user message of the timeline."""
    a, b = compress.cut(text, head, tail)
    note = F.concat(F.lit("\n\n[... omitted "), F.greatest(F.length(text) - F.length(a) - F.length(b), F.lit(0)).cast("string"), F.lit(" chars; full text in user-messages.json line "), line.cast("string"), F.lit(" ...]\n\n"))
    body = F.when(F.length(text) > least, F.concat(drop_newline_end(a), note, drop_newline_end(drop_newline_start(b)))).otherwise(drop_newline_end(text))
    return F.concat(F.lit('<user-message line="'), line.cast("string"), F.lit('" chars="'), chars.cast("string"), F.lit('" sha256="'), xml_escape(digest), F.lit('">\n'), body, F.lit("\n</user-message>"))


def item_text(kind: Column, status: Column, form: Column, text: Column) -> Column:
    """A model item of the timeline."""
    return F.concat(F.when(kind.isin("rule", "plan", "promise"), F.concat(F.lit("- ["), status, F.lit("] "))).when(form == "bullet", "- ").otherwise(""), trim_ws(text))


def timeline(messages: DataFrame, items: DataFrame) -> DataFrame:
    """(session_id, timeline): messages (line, char_count, sha256, text) and items (line, ord, section, kind, status, format, text) by line, messages first."""
    own = messages.select("session_id", "line", F.lit(0).alias("side"), F.col("line").cast("long").alias("ord"), F.lit("user").alias("title"), collapsed_xml(F.col("text"), F.col("line"), F.col("char_count"), F.col("sha256")).alias("body"))
    rest = items.select("session_id", "line", F.lit(1).alias("side"), F.col("ord").cast("long").alias("ord"), F.col("section").alias("title"), item_text(F.col("kind"), F.col("status"), F.col("format"), F.col("text")).alias("body"))
    part = F.concat(F.lit("## line "), F.lpad(F.col("line").cast("string"), 6, "0"), F.lit(" | "), F.col("title"), F.lit("\n\n"), F.col("body"))
    rows = own.unionByName(rest).withColumn("part", part)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "side", "ord", "part"))), lambda s: s["part"]), "\n\n")
    return rows.groupBy("session_id").agg(F.concat(trim_ws(F.concat(F.lit("# Compaction Timeline\n\n"), joined)), F.lit("\n")).alias("timeline"))


def rehydrated(summaries: DataFrame, spans: DataFrame) -> DataFrame:
    """(session_id, rehydrated) of summaries (session_id, summary_markdown) and spans with section, char_range, extracted_text, code_capsules, edit_capsules (null: none)."""
    c = F.col
    n = lambda x: F.coalesce(F.greatest(F.size(x), F.lit(0)), F.lit(0))
    between = lambda r: F.concat(r[0].cast("string"), F.lit("-"), r[1].cast("string"))
    head = F.concat(
        F.lit("- "), c("span_id"), F.lit(" | "), c("section"), F.lit(" | lines "), c("start_line").cast("string"), F.lit("-"), c("end_line").cast("string"), F.lit(" | chars "), between(c("char_range")), F.lit(" | code capsules "), n(c("code_capsules")).cast("string"),
        F.when(n(c("edit_capsules")) > 0, F.concat(F.lit(" | edit capsules "), n(c("edit_capsules")).cast("string"))).otherwise(""),
    )
    info = F.when(compress.is_formatted_edit(c("extracted_text")) | F.contains("extracted_text", F.lit("@@tool EditResult")), "diff").otherwise("")
    code = F.transform("code_capsules", lambda x: F.concat(F.lit("- code "), x["id"], F.lit(" | "), x["language"], F.lit(" | chars "), between(x["char_range"]), F.lit(" | exact_sha256 "), x["exact_text_sha256"]))
    edit = F.transform("edit_capsules", lambda x: F.concat(F.lit("- edit "), x["id"], F.lit(" | "), x["file_path"], F.lit(" | +"), x["lines_added"].cast("string"), F.lit(" -"), x["lines_removed"].cast("string"), F.lit(" | diff_sha256 "), x["diff_sha256"]))
    part = F.concat_ws("\n", head, F.concat(F.lit("```"), info), drop_newline_end(c("extracted_text")), F.lit("```"), code, edit)
    by = spans.withColumn("part", part).groupBy("session_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("span_id", "part"))), lambda s: s["part"]), "\n\n").alias("parts"))
    text = F.concat(trim_ws(c("summary_markdown")), F.lit("\n\n## Rehydration Spans\n"), F.coalesce("parts", F.lit("")))
    return summaries.join(by, "session_id", "left").select("session_id", F.concat(trim_ws(text), F.lit("\n")).alias("rehydrated"))


def tail_notes(texts: Column) -> Column:
    """What the latest records say of verification, in the order of records: descriptions, commands, all-pass notes."""

    def of(t: Column) -> Column:
        found = lambda p: some(F.regexp_extract(t, p, 1))
        behaviour = found(r"(?i)(?<![A-Za-z0-9_])Behavior check \((all pass)\)")
        return F.array(
            found(r'"description"\s*:\s*"([^"]*(?:[Vv]erify|[Tt]est|[Cc]heck)[^"]*)"'), found(r'(?i)"command"\s*:\s*"([^"]*(?:test|verify|check|lint|pytest|vitest|jest)[^"]*)"'),
            F.when(t.rlike(r"(?<![A-Za-z0-9_])ALL PASS(?![A-Za-z0-9_])"), F.lit(ALL_PASS)), F.when(behaviour.isNotNull(), F.concat(F.lit("Behavior check ("), F.lower(behaviour), F.lit(")."))),
        )

    return F.filter(F.flatten(F.transform(texts, of)), lambda x: x.isNotNull())


def enriched(p: Column, tail_texts: Column, selected_text: Column) -> Column:
    """The pickup state with notes from the tail; a finished run that is asked for again becomes a caveat and a conflict."""
    none, conflicts = F.array().cast("array<string>"), F.coalesce(p["status_conflicts"], F.array().cast("array<struct<older_state:string,latest_state:string,resolution:string>>"))
    tests = F.coalesce(p["tests_run"], none)
    asked = F.concat_ws("\n", F.coalesce(p["current_task"], F.lit("")), F.coalesce(p["next_action"], F.lit("")))
    stale = F.coalesce(selected_text.rlike(COMPLETED) & asked.rlike(TO_RUN), F.lit(False))
    caveats = F.coalesce(p["known_caveats"], none)
    told = F.exists(conflicts, lambda c: F.concat_ws(" ", c["older_state"], c["latest_state"], c["resolution"]).rlike("(?i)completed"))
    more = F.array(F.struct(F.lit(OLDER).alias("older_state"), trim_ws(asked).alias("latest_state"), F.lit(RESOLUTION).alias("resolution")))
    added = lambda have, new: F.concat(have, F.slice(F.array_except(F.array_distinct(F.transform(new, compact)), F.transform(have, compact)), F.lit(1), F.greatest(F.lit(NOTES) - F.size(have), F.lit(0))))
    p = p.withField("tests_run", added(tests, tail_notes(tail_texts)))
    p = p.withField("known_caveats", F.when(stale, added(caveats, F.array(F.lit(CAVEAT)))).otherwise(caveats))
    return p.withField("status_conflicts", F.when(stale & ~told, F.concat(conflicts, more)).otherwise(conflicts))


def message_metrics(messages: DataFrame, longer: int = 2400) -> DataFrame:
    """By session of ledger messages: count, characters in all, the longest, and how many are shown collapsed."""
    return messages.groupBy("session_id").agg(F.count(F.lit(1)).alias("user_message_count"), F.sum("char_count").cast("long").alias("user_message_total_chars"), F.max("char_count").cast("long").alias("user_message_max_chars"), F.count_if(F.col("char_count") > longer).alias("user_message_collapsed_count"))


def source_hashes(items: DataFrame, entries: DataFrame) -> DataFrame:
    """(session_id, hashes): distinct hashes of the first and last lines that items (session_id, spans) cite."""
    ends = items.select("session_id", F.explode("spans").alias("s")).select("session_id", F.explode(F.array("s.start_line", "s.end_line")).alias("line")).distinct()
    return ends.join(entries.select("session_id", "line", "hash"), ["session_id", "line"]).groupBy("session_id").agg(F.sort_array(F.collect_set("hash")).alias("hashes"))


def carried(events: Column) -> Column:
    """Messages of an earlier round from its typed intent events (array of VARIANT); events without text are left out."""
    from tessera.functions.text import leading_int
    from tessera.sources.transcripts import get, text_of

    def one(e: Column) -> Column:
        field = lambda n: some(get(e, f"$.source.{n}"))
        line = F.coalesce(leading_int(get(e, "$.source.line")), leading_int(get(e, "$.source.original_line")), F.lit(1).cast("long"))
        text = text_of(e, "$.text")
        return F.struct(
            F.lit("carried").alias("source"), line.alias("line"), F.coalesce(leading_int(get(e, "$.source.original_line")), line).alias("original_line"), field("uuid").alias("uuid"), field("original_uuid").alias("original_uuid"), field("timestamp").alias("timestamp"),
            F.coalesce(some(get(e, "$.text_sha256")), some(get(e, "$.message_sha256")), sha256(text)).alias("sha256"), field("record_sha256").alias("record_sha256"), field("source_transcript_sha256").alias("source_transcript_sha256"),
            F.coalesce(leading_int(get(e, "$.char_count")), F.length(text).cast("long")).alias("char_count"), text.alias("text"), text_of(e, "$.rendered_text").alias("rendered_text"), some(get(e, "$.id")).alias("intent_event_id"),
        )

    return F.transform(F.filter(events, lambda e: F.coalesce(trim_ws(text_of(e, "$.text")) != "", F.lit(False))), one)


def message_body(m: Column) -> Column:
    """A message as handoffs show it: as it was rendered before, else its text, collapsed."""
    return or_else(trim_ws(m["rendered_text"]), ledger.body(m["text"]))


def distinct_notes(items: Column, most: int = NOTES) -> Column:
    return first_distinct(items, most)
