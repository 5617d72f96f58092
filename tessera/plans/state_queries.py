"""Named queries over texts and states made by rule from the standard tables, with SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import literals, text
from tessera.functions.text import sha256
from tessera.operators import compress, diff, handoff, judging, ledger, prompts, ranking, render, reports, scoring, spans, stats, summary
from tessera.plans import compact
from tessera.plans.queries import E, query, table, turns
from tessera.plans.record_queries import _J, _NL, quoted
from tessera.sources import artifacts, folders, sse


@query(f"""WITH {E}, t AS (SELECT session_id, line, coalesce(text, '') AS text, coalesce(hash, sha256('')) AS hash FROM e),
    w AS (SELECT *, list_filter(list_transform(string_split(text, ' '), lambda x: trim(regexp_replace(x, '{{WS}}+', ' ', 'g'), ' ')), lambda x: x <> '') AS words FROM t)
    SELECT session_id, line, '&lt;a b=&quot;' || replace(replace(replace(replace(text, '&', '&amp;'), '"', '&quot;'), '<', '&lt;'), '>', '&gt;') AS escaped, true AS round_trip, text AS attribute, left(text, 9) || '&' AS other_attribute,
    replace(replace(text, '|', '\\|'), chr(10), ' ') || '\\|x' AS cell, regexp_replace(text, '[ \\t]+(\\n|\\z)', '\\1', 'g') AS code, regexp_replace(replace(left(text, 20), '|', '/'), '{{WS}}+', '_', 'g') AS field, line AS number, '``````' AS fence,
    sha256('{{"text":' || {_J("text")} || '}}') AS fingerprint, line % 2 = 0 AS is_uuid, line % 2 = 1 AS is_sha, line % 3 > 0 AS is_range, floor(line / 3.0 * 10 + 0.5) / 10 AS rounded, CAST(line AS BIGINT) AS first_line, list_filter(words, lambda v, i: list_position(words, v) = i)[1:3] AS firsts
    FROM w""".replace("{{WS}}", "{WS}"))
def scalar_functions(spark, sf_dir):
    """Escapes, attributes, cells, code, fences, numbers, fingerprints, syntax tests, ranges and first distinct words of the turns' texts."""
    t, n = F.coalesce("text", F.lit("")), F.col("line")
    digest = F.coalesce("hash", sha256(F.lit("")))
    # An even line's digest in the shape of a UUID.
    named = F.when(n % 2 == 0, F.regexp_replace(F.left(digest, F.lit(32)), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")).otherwise(digest)
    xml = F.concat(F.lit('<a b="'), t)
    attributes = text.xml_attributes(F.concat(F.lit('a="1" b="'), text.xml_escape(F.concat(F.left(t, F.lit(9)), F.lit("&"))), F.lit('" a="'), text.xml_escape(t), F.lit('"')))
    cited = F.array(F.struct((n + 2).alias("start_line"), n.alias("end_line")), F.struct(n.alias("start_line"), n.alias("end_line")))
    return turns(spark, sf_dir).select(
        "session_id", "line", text.xml_escape(xml).alias("escaped"), (text.xml_unescape(text.xml_escape(xml)) == xml).alias("round_trip"), attributes["a"].alias("attribute"), attributes["b"].alias("other_attribute"),
        text.cell(F.concat(t, F.lit("|x"))).alias("cell"), text.normal_code(F.concat(t, F.lit(" \t\r\n\n"))).alias("code"), text.row_field(F.left(t, F.lit(20))).alias("field"), text.leading_int(F.concat(F.lit(" "), n.cast("string"), F.lit("abc"))).alias("number"), text.fence(F.concat(t, F.lit("`````"))).alias("fence"),
        text.fingerprint(F.struct(t.alias("text"))).alias("fingerprint"), text.is_uuid(named).alias("is_uuid"), text.is_sha256(named).alias("is_sha"), text.is_range(n, n + (n % 3) - F.when(n % 3 == 0, 1).otherwise(0)).alias("is_range"),
        text.half_up(n / 3, 1).cast("double").alias("rounded"), spans.anchor_start(cited).cast("long").alias("first_line"), text.first_distinct(F.split(t, " "), 3).alias("firsts"),
    )


def _told(spark, sf_dir) -> DataFrame:
    """A sentence of work for each turn."""
    n = F.col("line").cast("string")
    told = F.concat(F.lit("See `npm test` in src/app_"), n, F.lit(".py, "), F.when(F.col("line") % 2 == 0, "failed because of ").otherwise("pending "), F.lit("run_"), n, F.lit(". Then: uv run job_"), n, F.lit("; keep ERR_"), n, F.lit(" application/json"))
    return turns(spark, sf_dir).select("session_id", "line", told.alias("told"))


@query(f"""WITH {E} SELECT session_id, line, ['src/app_' || line || '.py', 'application/json'] AS paths, 'npm test' AS command, ['src/app_' || line || '.py'] AS files, ['npm test` in src/app_' || line] AS tests, ['npm test', 'See', 'src/app_' || line || '.py', 'run_' || line, 'Then', 'job_' || line, 'ERR_' || line, 'application/json'] AS concepts,
    'src/app_' || line || '.py' AS first_path, 'See `npm test` in src/app_' AS context, CASE WHEN line % 2 = 0 THEN 1 ELSE 0 END AS errors, 1 AS solving, ['a', 'b'] AS pending FROM e""")
def literals_of_texts(spark, sf_dir):
    """Paths, commands, files, tests, concepts and the derived arrays."""
    d = _told(spark, sf_dir)
    t = F.array("told")
    plans = F.array(F.struct(F.lit("a").alias("item"), F.lit("active").alias("status")), F.struct(F.lit("z").alias("item"), F.lit("done").alias("status")))
    legacy = literals.legacy_arrays(t, plans, F.lit("c"), F.lit("b"))
    first = literals.paths_of(t)[0]
    return d.select(
        "session_id", "line", literals.paths(F.col("told")).alias("paths"), literals.next_command(t, F.lit("")).alias("command"), literals.pickup_files(t, F.array().cast("array<string>")).alias("files"), literals.test_commands(t, F.array().cast("array<string>")).alias("tests"), literals.concepts(F.col("told")).alias("concepts"),
        first["path"].alias("first_path"), F.left(first["context"], F.lit(26)).alias("context"), F.size(legacy["errors_and_fixes"]).alias("errors"), F.size(F.filter(legacy["problem_solving"], lambda x: F.contains(x, F.lit("npm")))).alias("solving"), legacy["pending_tasks"].alias("pending"),
    )


@query(f"""WITH {E} SELECT session_id, line, ['ERR_' || line, 'application/json', 'src/app_' || line || '.py', 'npm test'] AS literals, line % 2 = 0 AS has_failed FROM e""")
def evidence_literals(spark, sf_dir):
    """Literals by group and quota; words of the last group are left out of the comparison."""
    return _told(spark, sf_dir).select("session_id", "line", F.array_except(F.filter(literals.evidence(F.col("told")), lambda x: x.rlike("[A-Z/]{2}|/|npm test$") & ~x.startswith("uv") & ~F.contains(x, F.lit(" of "))), F.array(F.lit("See"))).alias("literals"), F.contains("told", F.lit("failed")).alias("has_failed"))


def _summaries(spark, sf_dir, case=None) -> DataFrame:
    """A structured summary by conversation; some break a rule."""
    s = turns(spark, sf_dir).groupBy("session_id").agg(F.max("line").cast("int").alias("n"))
    c = F.pmod(F.col("session_id").cast("long"), F.lit(6)) if case is None else case
    one = lambda a, b: F.array(F.struct(F.lit(a).cast("int").alias("start_line") if isinstance(a, int) else a.alias("start_line"), b.alias("end_line")))
    span = one(1, F.when(c == 2, F.col("n") + 1).otherwise(F.col("n")))
    block = lambda section, form, body: F.struct(F.lit(section).alias("section"), F.lit(form).alias("format"), body.alias("body"), span.alias("source_spans"))
    rule = F.struct(F.concat(F.lit("never run `git push` "), F.col("session_id")).alias("rule"), F.when(c == 3, "odd").otherwise("current").alias("status"), span.alias("source_spans"))
    plan = lambda item, status: F.struct(F.lit(item).alias("item"), F.lit(status).alias("status"), span.alias("source_spans"))
    promise = F.struct(F.lit(" to finish ").alias("promise"), F.lit("pending").alias("status"), span.alias("source_spans"))
    conflict = "array<struct<older_state:string,latest_state:string,resolution:string>>"
    pickup = F.struct(F.lit("/w").alias("cwd"), F.lit("main").alias("git_branch"), F.lit("").alias("current_task"), F.lit("rerun it").alias("next_action"), F.lit("").alias("next_command"), F.array().cast("array<string>").alias("active_files"), F.array(F.lit("t1")).alias("tests_run"), F.array().cast("array<string>").alias("known_caveats"), F.array().cast(conflict).alias("status_conflicts"))
    integrity = F.struct(F.lit("0" * 64).alias("transcript_sha256"), F.when(c == 4, F.col("n") + 5).otherwise(F.col("n")).alias("transcript_lines_seen"), F.lit(True).alias("verbatim_span_grounded"), F.lit("").alias("limitations"))
    return s.select(
        "session_id", "n", F.array(block("Work", "bullet", F.concat(F.lit("did "), F.col("n").cast("string"))), block("Work", "code_block", F.lit("x = 1")), block(" Next ", "bullet", F.lit("- marked")), block("Next", "paragraph", F.lit("run `npm run go` now"))).alias("summary_blocks"),
        F.array(rule).alias("rules_and_invariants"), F.array(plan("wait", "blocked"), plan("go on", "active")).alias("plans_and_task_state"), F.array(promise).alias("promises_made"),
        F.when(c == 1, " ").otherwise(F.concat(F.lit("work "), F.col("session_id"))).alias("current_work"), F.lit("next").alias("optional_next_step"), pickup.alias("pickup_state"), integrity.alias("source_integrity"),
    )


_S = f"{E}, s AS (SELECT session_id, CAST(max(line) AS INTEGER) AS n, CAST(session_id AS BIGINT) % 6 AS c FROM e GROUP BY session_id)"


#: What each case of a summary breaks: the array or field, its value, and the rule that names it.
_RULES = ["current_work must not be blank", "optional_next_step must not be blank", "summary_blocks must be an array", "rules_and_invariants must be an array", "plans_and_task_state must be an array", None, "source_integrity is missing", "transcript_lines_seen differs", "pickup_state is missing",
          "summary_blocks has an unknown format", None, "summary_blocks has a blank body", "summary_blocks has a bad span", "rules_and_invariants has a blank rule", "rules_and_invariants has an unknown status", "rules_and_invariants has a bad span",
          "plans_and_task_state has a blank item", "plans_and_task_state has an unknown status", "plans_and_task_state has a bad span", "promises_made has a blank promise", "promises_made has an unknown status", "promises_made has a bad span"]


@query(f"""WITH {E}, s AS (SELECT session_id, CAST(session_id AS BIGINT) % {len(_RULES) + 1} AS k FROM e GROUP BY session_id)
    SELECT session_id, CASE k WHEN 11 THEN 3 WHEN 3 THEN NULL ELSE 2 END AS relaxed, CASE k {" ".join(f"WHEN {i} THEN '{r}'" for i, r in enumerate(_RULES, 1) if r)} END AS error FROM s""")
def summary_rules(spark, sf_dir):
    """Formats relaxed, then the first rule that a summary breaks; each rule is broken in turn, two are mended first."""
    df = _summaries(spark, sf_dir, F.lit(0))
    k = F.pmod(F.col("session_id").cast("long"), F.lit(len(_RULES) + 1))
    whole = {n: F.col(n) for n in df.columns}
    last = lambda name, key, value: F.transform(name, lambda x, i: F.when(i == F.size(name) - 1, x.withField(key, value)).otherwise(x))
    past = F.array(F.struct(F.lit(1).alias("start_line"), (F.col("n") + 1).alias("end_line")))
    nothing = F.array().cast(df.schema["summary_blocks"].dataType.elementType["source_spans"].dataType)
    backwards = F.array(F.struct(F.lit(2).alias("start_line"), F.lit(1).alias("end_line")))
    broken = [
        ("current_work", F.lit(" ")), ("optional_next_step", F.lit(None).cast("string")), *((a, F.lit(None).cast(df.schema[a].dataType)) for a in ("summary_blocks", "rules_and_invariants", "plans_and_task_state", "promises_made", "source_integrity")),
        ("source_integrity", F.col("source_integrity").withField("transcript_lines_seen", F.col("n") + 5)), ("pickup_state", F.lit(None).cast(df.schema["pickup_state"].dataType)),
        ("summary_blocks", last("summary_blocks", "format", F.lit("odd"))), ("summary_blocks", F.transform("summary_blocks", lambda b, i: F.when(i == 0, b.withField("body", F.lit("a\nb"))).otherwise(b))), ("summary_blocks", last("summary_blocks", "body", F.lit(" "))), ("summary_blocks", last("summary_blocks", "source_spans", past)),
    ]
    for a, t, spans_ in (("rules_and_invariants", "rule", nothing), ("plans_and_task_state", "item", backwards), ("promises_made", "promise", past)):
        broken += [(a, last(a, t, F.lit(""))), (a, last(a, "status", F.lit("odd"))), (a, last(a, "source_spans", spans_))]
    for i, (name, value) in enumerate(broken, 1):
        whole[name] = F.when(k == i, value).otherwise(whole[name])
    df = summary.with_defaults(summary.relaxed(df.select(*(x.alias(n) for n, x in whole.items()))))
    return df.select("session_id", "relaxed").join(summary.first_error(df, F.col("n")), "session_id")


@query(f"""WITH {_S} SELECT session_id, '/w' AS cwd, 'dev' AS branch, CASE WHEN c = 1 THEN ' ' ELSE 'work ' || session_id END AS task, 'rerun it' AS action, 'npm run go' AS command, n AS lines_seen, sha256(session_id) AS digest, ['wait'] AS blockers, CAST(9 AS INTEGER) AS rules,
    CASE WHEN c = 1 THEN ['wait', 'go on'] ELSE ['work ' || session_id, 'wait'] END AS request FROM s""")
def summary_state(spark, sf_dir):
    """Pickup, integrity and derived fields, and the nested state."""
    df = summary.with_integrity(summary.with_pickup(_summaries(spark, sf_dir), F.lit(None).cast("string"), F.lit("dev")), sha256(F.col("session_id")), F.col("n"))
    df = summary.with_derived(df).join(summary.handoff_state(df), "session_id")
    p = F.col("pickup_state")
    return df.select("session_id", p["cwd"].alias("cwd"), p["git_branch"].alias("branch"), p["current_task"].alias("task"), p["next_action"].alias("action"), p["next_command"].alias("command"), F.col("source_integrity.transcript_lines_seen").alias("lines_seen"), F.col("source_integrity.transcript_sha256").alias("digest"),
                     F.col("state.active_state.blockers").alias("blockers"), F.size(summary.line_rules(F.col("n"))).alias("rules"), F.slice("primary_request_and_intent", 1, 2).alias("request"))


_SECTIONS = """'## Work' || chr(10) || '- did ' || n || chr(10) || 'x = 1' || chr(10) || chr(10) || '## Next' || chr(10) || '- - marked' || chr(10) || 'run `npm run go` now' || chr(10) || chr(10)
    || CASE WHEN c = 3 THEN '' ELSE '## Rules And Invariants' || chr(10) || '- never run `git push` ' || session_id || chr(10) || chr(10) END
    || '## Plans And Task State' || chr(10) || '- [blocked] wait' || chr(10) || '- [active] go on' || chr(10) || chr(10) || '## Promises Made' || chr(10) || '- [pending] to finish' || chr(10)"""
_PICKUP = """'## Pickup State' || chr(10) || chr(10) || '- CWD: `/w`' || chr(10) || '- Git branch: `main`' || chr(10) || '- Next action: rerun it' || chr(10) || '- Tests run:' || chr(10) || '  - t1' || chr(10) || '  - run the tests' || chr(10) || '- Caveats:' || chr(10) || '  - """ + handoff.CAVEAT.replace("'", "''") + """' || chr(10)
    || '- Status conflicts resolved:' || chr(10) || '  - Older: """ + handoff.OLDER + """ | Latest: rerun it | Resolution: """ + handoff.RESOLUTION + """'"""


@query(f"""WITH {_S} SELECT session_id, sha256({_SECTIONS}) AS sections_sha256, sha256({_PICKUP}) AS pickup_sha256,
    sha256('# Compaction Handoff' || chr(10) || chr(10) || '{handoff.INTRO}' || chr(10) || chr(10) || {_PICKUP} || chr(10) || chr(10) || CASE WHEN c = 1 THEN '' ELSE '## Current Work' || chr(10) || chr(10) || 'work ' || session_id || chr(10) || chr(10) END || '## Next Step' || chr(10) || chr(10) || 'next' || chr(10) || chr(10)
        || trim({_SECTIONS}, chr(10)) || chr(10) || chr(10) || '## User Messages' || chr(10) || chr(10) || '{handoff.MESSAGES}' || chr(10) || chr(10) || '### intent-0001 | line 1' || chr(10) || chr(10) || '```text' || chr(10) || 'hello' || chr(10) || '```' || chr(10) || chr(10)
        || '## Evidence Index' || chr(10) || chr(10) || '{handoff.LITERALS}' || chr(10) || chr(10) || '- `a\\`b`' || chr(10) || chr(10) || '## Artifacts' || chr(10) || chr(10) || '- Manifest: m' || chr(10) || '- Canonical state: s' || chr(10) || '- Source transcript: t' || chr(10)) AS handoff_sha256 FROM s""")
def handoff_documents(spark, sf_dir):
    """Sections, pickup state with notes from the tail, and the whole handoff."""
    df = _summaries(spark, sf_dir)
    notes = F.array(F.lit('{"description": "run the tests", "x": 1}'))
    pickup = handoff.enriched(F.col("pickup_state"), notes, F.lit("it completed (exit code 0) today"))
    sections = handoff.blocks_section(F.col("summary_blocks"), F.col("rules_and_invariants"), F.col("plans_and_task_state"), F.col("promises_made"))
    tail = "array<struct<line:int,type:string,role:string,timestamp:string,collapsed:boolean,omitted_chars:int,text:string>>"
    message = F.struct(F.lit("intent-0001").alias("id"), F.lit(1).alias("line"), F.lit("hello").alias("body"))
    states = df.select(
        "session_id", pickup.alias("pickup_state"), F.when(F.trim("current_work") != "", F.col("current_work")).alias("current_objective"), F.col("optional_next_step").alias("next_step"), F.array().cast(tail).alias("records"), F.lit("p").alias("conflict_policy"), sections.alias("summary_markdown"),
        F.array(message).alias("messages"), F.array(F.lit("a`b")).alias("literals"), F.lit("m").alias("manifest_path"), F.lit("s").alias("state_path"), F.lit("t").alias("transcript_path"),
    )
    out = states.join(handoff.document(states), "session_id")
    return out.select("session_id", sha256(F.col("summary_markdown")).alias("sections_sha256"), sha256(handoff.pickup_section(F.col("pickup_state"))).alias("pickup_sha256"), sha256(F.col("handoff")).alias("handoff_sha256"))


@query(f"""WITH {E}, u AS (SELECT session_id, line, 0 AS side, '## line ' || lpad(line::VARCHAR, 6, '0') || ' | user' || chr(10) || chr(10) || '<user-message line="' || line || '" chars="' || length(text) || '" sha256="' || hash || '">' || chr(10)
        || CASE WHEN length(text) > 2400 THEN '' ELSE regexp_replace(text, '\\n\\z', '') END || chr(10) || '</user-message>' AS p FROM e WHERE role = 'user'
    UNION ALL SELECT session_id, line, 1, '## line ' || lpad(line::VARCHAR, 6, '0') || ' | Plans' || chr(10) || chr(10) || '- [active] item ' || line FROM e WHERE line % 2 = 0)
    SELECT session_id, sha256('# Compaction Timeline' || chr(10) || chr(10) || string_agg(p, chr(10) || chr(10) ORDER BY line, side) || chr(10)) AS timeline_sha256 FROM u GROUP BY session_id""")
def timeline_markdown(spark, sf_dir):
    t = turns(spark, sf_dir)
    messages = t.where("role = 'user'").select("session_id", "line", F.length("text").alias("char_count"), F.col("hash").alias("sha256"), "text")
    items = t.where("line % 2 = 0").select("session_id", "line", F.lit(1).alias("ord"), F.lit("Plans").alias("section"), F.lit("plan").alias("kind"), F.lit("active").alias("status"), F.lit(None).cast("string").alias("format"), F.concat(F.lit(" item "), F.col("line").cast("string")).alias("text"))
    return handoff.timeline(messages, items).select("session_id", sha256(F.col("timeline")).alias("timeline_sha256"))


@query(f"""WITH {E}, x AS (SELECT session_id, 'span-' || lpad(line::VARCHAR, 4, '0') AS span_id, line, text, hash FROM e)
    SELECT session_id, sha256('done' || chr(10) || chr(10) || '## Rehydration Spans' || chr(10) || string_agg('- ' || span_id || ' | Work | lines ' || line || '-' || line || ' | chars 0-' || length(text) || ' | code capsules 1' || chr(10) || '```' || chr(10) || regexp_replace(text, '\\n\\z', '') || chr(10) || '```' || chr(10)
        || '- code ' || span_id || '-code-001 | py | chars 1-2 | exact_sha256 ' || hash, chr(10) || chr(10) ORDER BY line) || chr(10)) AS rehydrated_sha256 FROM x GROUP BY session_id""")
def rehydrated_markdown(spark, sf_dir):
    span = F.format_string("span-%04d", "line")
    code = F.array(F.struct(F.concat(span, F.lit("-code-001")).alias("id"), F.lit("py").alias("language"), F.array(F.lit(1), F.lit(2)).alias("char_range"), F.col("hash").alias("exact_text_sha256")))
    edits = "array<struct<id:string,file_path:string,lines_added:int,lines_removed:int,diff_sha256:string>>"
    s = turns(spark, sf_dir).select("session_id", span.alias("span_id"), F.lit("Work").alias("section"), F.col("line").alias("start_line"), F.col("line").alias("end_line"), F.array(F.lit(0), F.length("text")).alias("char_range"), F.col("text").alias("extracted_text"), code.alias("code_capsules"), F.lit(None).cast(edits).alias("edit_capsules"))
    heads = s.select("session_id").distinct().withColumn("summary_markdown", F.lit("done\n"))
    return handoff.rehydrated(heads, s).select("session_id", sha256(F.col("rehydrated")).alias("rehydrated_sha256"))


@query(f"""WITH {E} SELECT session_id, 'span-' || lpad(line::VARCHAR, 4, '0') || '-code-001' AS id, CAST(line AS INTEGER) AS source_line, 'py' AS language, 13 AS begins, 13 + length(regexp_replace(text, '\\n+\\z', '')) AS ends, 7 AS fence_begins, sha256(regexp_replace(text, '\\n+\\z', '')) AS exact_text_sha256,
    sha256(regexp_replace(regexp_replace(text, '[ \\t]+(\\n|\\z)', '\\1', 'g'), '\\n+\\z', '')) AS normalized_code_sha256 FROM e""")
def code_capsules(spark, sf_dir):
    """Fenced code inside spans, with its places."""
    body = F.concat(F.lit("before\n```py\n"), F.regexp_replace("text", r"\n+\z", ""), F.lit("\n```\nafter"))
    t = turns(spark, sf_dir).withColumn("text", body)
    s = t.select("session_id", F.format_string("span-%04d", "line").alias("span_id"), F.col("line").cast("int").alias("start_line"), F.col("line").cast("int").alias("end_line"))
    out = spans.code_capsules(spans.rehydrated(s, t))
    return out.select("session_id", "id", F.col("source_line").cast("int").alias("source_line"), "language", F.col("char_range")[0].cast("int").alias("begins"), F.col("char_range")[1].cast("long").alias("ends"), F.col("fence_char_range")[0].cast("int").alias("fence_begins"), "exact_text_sha256", "normalized_code_sha256")


@query(f"""WITH {E} SELECT session_id, CAST(row_number() OVER (PARTITION BY session_id ORDER BY line % 4 = 0, line % 4, line) - 1 AS INTEGER) AS anchor, CASE line % 4 WHEN 1 THEN 'rules' WHEN 2 THEN 'plans' WHEN 3 THEN 'promises' ELSE 'blocks' END AS kind, CAST(line AS BIGINT) AS pos FROM e""")
def anchored_items(spark, sf_dir):
    """The four arrays' items as one list."""
    t = turns(spark, sf_dir).select("session_id", F.col("line").alias("pos"), "text")
    return spans.anchored(*(t.where(F.col("pos") % 4 == i) for i in (1, 2, 3, 0))).select("session_id", F.col("anchor").cast("int").alias("anchor"), "kind", "pos")


@query(f"""WITH {E}, o AS (SELECT *, lag(CASE WHEN line % 3 = 0 THEN line - 2 ELSE line END) OVER (PARTITION BY session_id ORDER BY line) AS before, CASE WHEN line % 3 = 0 THEN line - 2 ELSE line END AS pos FROM e) SELECT session_id, CAST(pos AS BIGINT) AS line, true AS repeated FROM o WHERE pos <= before""")
def line_order(spark, sf_dir):
    """Lines that do not come after the line before."""
    t = turns(spark, sf_dir).select("session_id", F.col("line").alias("ord"), F.when(F.col("line") % 3 == 0, F.col("line") - 2).otherwise(F.col("line")).alias("line"))
    back = stats.not_increasing(t, strict=False).select("session_id", "line")
    return stats.not_increasing(t).select("session_id", F.col("line").cast("long").alias("line"), F.lit(True).alias("repeated")).join(back, ["session_id", "line"], "left")


@query(f"""WITH {E} SELECT session_id, CAST(row_number() OVER (PARTITION BY session_id ORDER BY line, role <> 'user') AS INTEGER) AS ord, CAST(line AS BIGINT) AS line, CASE WHEN role = 'user' THEN 0 ELSE 1 END AS side FROM e""")
def timeline_order(spark, sf_dir):
    t = turns(spark, sf_dir)
    return summary.timeline(t.where("role = 'user'"), t.where("role <> 'user'")).select("session_id", "ord", "line", "side")


_ATTEMPT = "a AS (SELECT source AS run_id, doc_id AS attempt, n_chars % 5 AS missing, CAST(n_chars % 7 AS DOUBLE) AS density FROM documents)"


@query(f"WITH {_ATTEMPT} SELECT run_id, attempt, missing, density FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY missing, density DESC, attempt DESC) AS i FROM a) WHERE i = 1")
def best_attempt(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return scoring.best_attempt(d.select(F.col("source").alias("run_id"), F.col("doc_id").alias("attempt"), (F.col("n_chars") % 5).alias("missing"), (F.col("n_chars") % 7).cast("double").alias("density")))


@query("""SELECT CAST(d.doc_id AS VARCHAR) AS run_id, b.w AS literal FROM documents d, (SELECT unnest(['the', 'zzzz', 'de ', 'and']) AS w) b WHERE NOT coalesce(contains(d.text, b.w), false)""")
def missing_literals(spark, sf_dir):
    """Literals that a run's text lacks."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("run_id"), "text")
    return scoring.missing_literals(d.select("run_id", F.explode(F.array(*map(F.lit, ("the", "zzzz", "de ", "and")))).alias("literal")), d)


@query("""SELECT CAST(doc_id AS VARCHAR) AS run_id, CASE WHEN doc_id % 2 = 0 THEN 'state' ELSE 'odd' END AS kind, sha256(coalesce(text, '')) AS sha256, strlen(coalesce(text, '')) AS bytes, CASE WHEN doc_id % 2 = 0 THEN 'authoritative' ELSE 'derived' END AS authority, doc_id % 3 = 0 AS bad FROM documents""")
def manifests(spark, sf_dir):
    """Manifests of artifacts, and those whose artifact changed."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("run_id"), F.when(F.col("doc_id") % 2 == 0, "state").otherwise("odd").alias("kind"), F.coalesce("text", F.lit("")).alias("content"), "doc_id")
    m = artifacts.manifest(d.drop("doc_id"))
    changed = d.withColumn("content", F.when(F.col("doc_id") % 3 == 0, F.lit("changed!")).otherwise(F.col("content"))).drop("doc_id")
    bad = scoring.bad_hashes(m, changed).select("run_id", F.lit(True).alias("bad"))
    return m.join(bad, "run_id", "left").select("run_id", "kind", "sha256", "bytes", "authority", F.coalesce("bad", F.lit(False)).alias("bad"))


@query(f"""WITH {E} SELECT session_id, count(*) AS capsules, list_sort(list('ev-' || line) FILTER (WHERE line % 4 = 0)) AS bad, CAST(sum(CASE WHEN line % 3 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS empty_text_segments, CAST(sum(CASE WHEN line % 3 = 0 THEN 0 ELSE length(text) END) AS BIGINT) AS segment_chars FROM e GROUP BY session_id""")
def evidence_metrics(spark, sf_dir):
    t = turns(spark, sf_dir)
    size = F.when(F.col("line") % 3 == 0, 0).otherwise(F.length("text")).cast("long")
    segment = F.struct(F.array(F.lit(0).cast("long"), F.when(F.col("line") % 4 == 0, F.lit(-1).cast("long")).otherwise(size)).alias("char_range"), size.alias("char_count"))
    c = t.select("session_id", F.concat(F.lit("ev-"), F.col("line").cast("string")).alias("id"), F.col("hash").alias("start_hash"), F.col("hash").alias("end_hash"), F.col("hash").alias("raw_slice_sha256"), F.array(segment).alias("text_segments"))
    return scoring.evidence_metrics(c).select("session_id", "capsules", F.when(F.size("bad") > 0, F.col("bad")).alias("bad"), F.col("empty_text_segments").cast("long").alias("empty_text_segments"), "segment_chars")


@query("""SELECT l AS lang, CAST(c AS BIGINT) AS evidence_capsules, list_filter([CASE WHEN c < 30 THEN 'capsules' END, CASE WHEN u < 25 THEN 'cited' END], lambda x: x IS NOT NULL) AS shortfalls, c >= 30 AND u >= 25 AS pass, round((least(1.0, c / 30.0) + least(1.0, u / 25.0)) / 2, 9) AS score
    FROM (SELECT lang || '/' || source AS l, count(*) AS c, count(DISTINCT n_chars % 40) AS u FROM documents GROUP BY 1)""")
def density_gate(spark, sf_dir):
    d = table(spark, sf_dir, "documents").groupBy(F.concat_ws("/", "lang", "source").alias("lang")).agg(F.count(F.lit(1)).alias("evidence_capsules"), F.count_distinct(F.col("n_chars") % 40).alias("cited_unique_lines"), F.lit(0).alias("promises"))
    return scoring.density(d).select("lang", "evidence_capsules", "shortfalls", "pass", F.round("score", 9).alias("score"))


@query("""SELECT CAST(doc_id AS VARCHAR) AS session_id, count(DISTINCT CASE WHEN a OR b THEN i END) AS coupled_lines, count(*) FILTER (WHERE a) AS the, count(*) FILTER (WHERE b) AS upper FROM
    (SELECT doc_id, i, contains(x, 'the') AS a, regexp_matches(x, '^[A-Z]') AS b FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents WHERE text IS NOT NULL)) WHERE a OR b GROUP BY doc_id""")
def coupling(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("session_id"), F.posexplode(F.split("text", "\n")).alias("line", "text"))
    return scoring.coupling(d, {"the": "the", "upper": "^[A-Z]"})


def _pickups(spark, sf_dir) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    k = F.col("doc_id")
    some = lambda m: F.when(k % m == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("x")))
    return d.select(
        k.alias("run_id"), F.when(k % 2 == 0, "").otherwise("task").alias("current_task"), F.lit("run the tests").alias("next_action"), F.when(k % 3 == 0, "nothing to do").otherwise("npm test").alias("next_command"), F.lit("/w").alias("cwd"), F.lit("b").alias("git_branch"), F.lit("/w").alias("source_cwd"), F.lit("").alias("source_branch"),
        some(5).alias("active_files"), some(4).alias("tests_run"), some(7).alias("known_caveats"), F.lit(0).alias("conflicts"), F.lit("o").alias("objective"), F.lit("n").alias("next_step"), F.concat(F.lit("## Pickup State\nnpm test\n## Latest Transcript Tail\n## User Messages\n"), F.when(k % 6 == 0, "completed (exit code 0)").otherwise("")).alias("handoff"),
        F.array(F.lit("a"), F.lit("b")).alias("tail_texts"), F.lit("p").alias("tail_policy"), F.lit(2).alias("lines_seen"), (k % 8).alias("capsules"), F.lit(1).alias("blocks"), F.lit(True).alias("ok"),
    )


@query("""SELECT doc_id AS run_id, CAST(CASE WHEN doc_id % 2 = 0 THEN 0 ELSE 0.7 END AS DOUBLE) AS task_points, CAST(floor((5.9 + CASE WHEN doc_id % 2 = 0 THEN 0 ELSE 0.7 END + CASE WHEN doc_id % 3 = 0 THEN 0 ELSE 1.2 END + CASE WHEN doc_id % 5 = 0 THEN 0 ELSE 0.7 END + CASE WHEN doc_id % 4 = 0 THEN 0 ELSE 0.7 END
    + CASE WHEN doc_id % 8 = 0 THEN 0 ELSE 0.5 END - CASE WHEN doc_id % 42 = 0 THEN 1.0 ELSE 0 END) * 10 + 0.5) / 10 AS DOUBLE) AS score FROM documents""")
def pickup_readiness(spark, sf_dir):
    """Readiness from its checks."""
    out = scoring.pickup(_pickups(spark, sf_dir))
    points = F.filter("checks", lambda c: c["check"] == "current_task")[0]["points"]
    return out.select("run_id", points.alias("task_points"), "score")


def _trials(spark, sf_dir) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    k = F.col("doc_id")
    each = d.select(F.concat(F.lit("run"), (k % 3).cast("string")).alias("run_id"), k.alias("trial"), F.explode(F.array(F.lit("a"), F.lit("b"))).alias("criterion"))
    t = F.col("trial")
    return each.select("run_id", "trial", F.when((t % 5 == 1) & (F.col("criterion") == "b"), "odd").when((t % 5 == 2) & (F.col("criterion") == "b"), "a").otherwise(F.col("criterion")).alias("criterion"), F.when(t % 5 == 3, "vague").otherwise("clear").alias("level"), F.lit("q").alias("quote"), F.array(F.when(t % 5 == 4, "ev-9").otherwise("ev-1")).alias("refs"))


@query("""SELECT 'run' || (doc_id % 3) AS run_id, doc_id AS trial, CASE doc_id % 5 WHEN 1 THEN 'unknown criterion' WHEN 2 THEN 'repeated criterion' WHEN 3 THEN 'unknown level' ELSE 'unknown ref' END AS error FROM documents WHERE doc_id % 5 > 0""")
def judge_rejects(spark, sf_dir):
    known = spark.createDataFrame([(f"run{i}", "ev-1") for i in range(3)], "run_id string, ref string")
    return judging.rejects(_trials(spark, sf_dir), ["a", "b"], known)


@query("""SELECT 'run' || (doc_id % 3) AS run_id, 'ev-9' AS ref, true AS warned FROM documents WHERE doc_id % 5 = 4 GROUP BY 1""")
def judge_references(spark, sf_dir):
    """References that verdicts name and nobody gave, and totals that differ from the counted ones."""
    capsules = spark.createDataFrame([(f"run{i}", "ev-1") for i in range(3)], "run_id string, id string")
    events = spark.createDataFrame([("run0", "intent-0001")], "run_id string, id string")
    v = _trials(spark, sf_dir)
    refs = judging.unknown_refs(v, judging.evidence_refs(capsules, events).toDF("run_id", "ref"))
    outcome = judging.outcome(judging.medians(v))
    wrong = judging.advisory(outcome, outcome.select("run_id", (F.col("total") + 1).alias("claimed_total"), F.col("pass").alias("claimed_pass"))).select("run_id", F.lit(True).alias("warned"))
    return refs.join(wrong, "run_id")


_MODELS = "m AS (SELECT doc_id, ['mantle', 'xai', 'gemini', 'codex'][doc_id % 4 + 1] AS provider, ['grok-4.3', 'gemini-3.5-flash', 'flash-lite', 'gpt'][(doc_id // 4) % 4 + 1] AS model, CASE WHEN doc_id % 3 = 0 THEN 'onto' ELSE 'stripped' END AS renderer, n_chars * 200 AS tokens FROM documents)"


@query(f"""WITH {_MODELS}, t AS (SELECT *, provider = 'mantle' AS bedrock, provider = 'xai' OR (provider = 'mantle' AND model LIKE '%grok%') AS xai, provider = 'gemini' AND model = 'gemini-3.5-flash' AS flash, model = 'flash-lite' AS lite, model = 'grok-4.3' OR model = 'flash-lite' AS thin FROM m),
    w AS (SELECT *, bedrock OR flash OR thin AS weak FROM t)
    SELECT doc_id, weak, list_filter([CASE WHEN weak THEN 'final-state-first' END, CASE WHEN weak THEN 'continuation-coverage' END, CASE WHEN weak THEN 'preserve-literals' END, CASE WHEN bedrock THEN 'bedrock-count-floor' END, CASE WHEN xai THEN 'xai-mine-transcript' END, CASE WHEN flash THEN 'flash-sectional-depth' END,
        CASE WHEN lite AND renderer = 'onto' THEN 'onto-citation-format' END], lambda x: x IS NOT NULL) AS adaptation_ids, CASE WHEN tokens > 272000 THEN 'large' ELSE 'small' END AS model_used,
        CASE provider WHEN 'gemini' THEN 'minimal' WHEN 'mantle' THEN NULL ELSE 'low' END AS level FROM w""")
def prompt_adaptations(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    k = F.col("doc_id")
    pick = lambda names, i: F.element_at(F.array(*map(F.lit, names)), (i + 1).cast("int"))
    runs = d.select("doc_id", pick(["mantle", "xai", "gemini", "codex"], k % 4).alias("provider"), pick(["grok-4.3", "gemini-3.5-flash", "flash-lite", "gpt"], F.floor(k / 4) % 4).alias("model"), F.when(k % 3 == 0, "onto").otherwise("stripped").alias("renderer"), (F.col("n_chars") * 200).alias("tokens"))
    out = prompts.adaptations(prompts.traits(runs)).join(F.broadcast(prompts.providers(spark)), "provider")
    return out.select("doc_id", "weak", "adaptation_ids", prompts.model_for(F.col("tokens"), "small", "large").alias("model_used"), prompts.thinking_level(F.lit(None).cast("string"), F.col("family")).alias("level"))


@query(f"""WITH {E} SELECT session_id, line, sha256('Summarise the transcript for whoever takes over. Every item cites the lines it comes from.' || chr(10) || chr(10) || 'Each record starts with its line number and type, parted by a bar; cite line numbers.' || chr(10) || chr(10) || '## Instructions' || chr(10) || 'be brief' || chr(10) || chr(10)
        || '## Correct this' || chr(10) || '- more cited' || chr(10) || '- keep this literal: x' || chr(10) || chr(10) || '## Transcript' || chr(10) || text) AS prompt_sha256, 'token=[redacted] and api_key: [redacted]' AS redacted, 'codex' AS provider,
    '{{"model":"m","messages":[{{"role":"user","content":' || {_J("text")} || '}}],"stream":true}}' AS chat, '{{"model":"m","input":[{{"role":"user","content":' || {_J("text")} || '}}],"reasoning":{{"effort":"low"}},"stream":true}}' AS responses,
    '{{"contents":[{{"role":"user","parts":[{{"text":' || {_J("text")} || '}}]}}]}}' AS gemini FROM e""")
def prompt_texts(spark, sf_dir):
    """Prompts, request bodies, redaction."""
    t = F.col("text")
    made = prompts.prompt("onto", t, F.lit("be brief"), F.lit(""), prompts.correction(F.array(F.lit("cited")), F.array(F.lit("x"))))
    return turns(spark, sf_dir).select(
        "session_id", "line", sha256(made).alias("prompt_sha256"), prompts.redacted(F.lit("token=abc and api_key: xyz")).alias("redacted"), prompts.normalized_provider(F.lit(" Codex ")).alias("provider"), prompts.chat_body("m", t).alias("chat"),
        prompts.request_body("responses", "m", t, F.lit("low")).alias("responses"), prompts.request_body("gemini", "m", t).alias("gemini"),
    )


def _family(spark, sf_dir, family: str) -> DataFrame:
    """Event streams of a provider family by user, with a usage and an end."""
    e = table(spark, sf_dir, "events").withColumn("x", F.concat(F.col("event_id").cast("string"), F.lit(";")))
    shapes = {
        "anthropic": ('{"type":"content_block_delta","delta":{"text":"%s"}}', '{"type":"message_delta","usage":{"n":%d}}', '{"type":"message_stop"}'),
        "gemini": ('{"candidates":[{"content":{"parts":[{"text":"%s"}]}}]}', '{"usageMetadata":{"n":%d}}', '{"candidates":[{"finishReason":"STOP"}]}'),
        "chat": ('{"id":"c1","choices":[{"delta":{"content":"%s"}}]}', '{"usage":{"n":%d}}', "[DONE]"),
    }
    delta, usage, done = shapes[family]
    rows = F.transform(F.array_sort(F.collect_list(F.struct("event_id", "x"))), lambda s: F.concat(F.lit("data: " + delta.split("%s")[0]), s["x"], F.lit(delta.split("%s")[1])))
    end = F.concat(F.lit("\n\ndata: " + usage.split("%d")[0]), F.count(F.lit(1)).cast("string"), F.lit(usage.split("%d")[1] + "\n\ndata: " + done + "\n\n"))
    return e.groupBy(F.concat(F.lit(family + "-"), F.col("user_id").cast("string")).alias("stream_id")).agg(F.concat(F.array_join(rows, "\n\n"), end).alias("raw"))


@query("""SELECT f || '-' || user_id AS stream_id, sha256(string_agg(CAST(event_id AS VARCHAR) || ';', '' ORDER BY event_id)) AS text_sha256, true AS completed, '{"n":' || count(*) || '}' AS usage, CASE f WHEN 'chat' THEN 'c1' END AS id FROM events, (SELECT unnest(['anthropic', 'gemini', 'chat']) AS f) GROUP BY f, user_id""")
def stream_families(spark, sf_dir):
    """Text, end, usage and id of three provider families' streams."""
    out = None
    for family in ("anthropic", "gemini", "chat"):
        one = sse.outcome(sse.events(_family(spark, sf_dir, family)), family).select("stream_id", sha256(F.col("text")).alias("text_sha256"), "completed", "usage", "id")
        out = one if out is None else out.union(one)
    return out


@query(f"""WITH {E}, x AS (SELECT session_id, line, text, {_NL("text")} AS n, string_split(text, chr(10)) AS ls FROM e),
    y AS (SELECT *, list_concat(list_concat(list_transform(ls, lambda z: ' ' || z), ['-old line that goes away', '+new line that comes in']), list_transform(ls, lambda z: ' ' || z)) AS body FROM x)
    SELECT session_id, line, 1 AS added, 1 AS removed, sha256('--- a/t.txt' || chr(10) || '+++ b/t.txt' || chr(10) || array_to_string(body, chr(10))) AS body_sha256 FROM y""")
def changed_line(spark, sf_dir):
    """The difference of two texts that differ in one line."""
    t = F.col("text")
    around = lambda x: F.concat(t, F.lit(f"\n{x}\n"), t)
    p = turns(spark, sf_dir).withColumn("pairs", diff.line_diff(around("old line that goes away"), around("new line that comes in")))
    return p.select("session_id", "line", diff.counted(F.col("pairs"), "add").alias("added"), diff.counted(F.col("pairs"), "remove").alias("removed"), sha256(diff.diff_body(F.col("pairs"), F.lit("t.txt"))).alias("body_sha256"))


@query(f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)
    SELECT doc_id, sha256('@@tool Write line=000007 sha256=h' || chr(10) || '@@file a.txt' || chr(10) || '@@file_abs /w/a.txt' || chr(10) || '```' || chr(10) || CASE WHEN len(ls) <= 50 THEN regexp_replace(t, '\\n\\z', '')
        ELSE array_to_string(ls[1:40], chr(10)) || chr(10) || '[... ' || (len(ls) - 50) || ' lines omitted ...]' || chr(10) || array_to_string(ls[len(ls) - 9:], chr(10)) END || chr(10) || '```' || chr(10) || 'stats: lines=' || len(ls) || ' | input_sha256=' || sha256('{{"filePath":"/w/a.txt","contents":' || {_J("t")} || '}}')) AS block_sha256,
        sha256('@@tool apply_patch' || chr(10) || '```diff' || chr(10) || regexp_replace(t, '\\n\\z', '') || chr(10) || '```' || chr(10) || 'stats: input_sha256=' || sha256(t)) AS patch_sha256 FROM d""")
def written_files(spark, sf_dir):
    """Written files and patches as text."""
    t = F.coalesce("text", F.lit(""))
    block = diff.write_block(F.lit("Write"), F.lit("/w/a.txt"), F.col("text"), F.lit(7), F.lit("h"), F.lit("/w"))
    return table(spark, sf_dir, "documents").select("doc_id", sha256(block).alias("block_sha256"), sha256(diff.patch_block(F.lit("apply_patch"), t)).alias("patch_sha256"))


@query(f"""WITH {E}, m AS (SELECT session_id, line, text, hash FROM e WHERE role = 'user') SELECT session_id, CAST(row_number() OVER (PARTITION BY session_id ORDER BY side, line) AS INTEGER) AS ord, CAST(line AS BIGINT) AS line, CASE side WHEN 0 THEN 'carried' ELSE 'current' END AS source
    FROM (SELECT 0 AS side, * FROM m WHERE line % 2 = 0 UNION ALL SELECT 1, * FROM m WHERE line % 2 = 1)""")
def ledger_merge(spark, sf_dir):
    """Carried messages that current ones do not replace, then the current ones."""
    m = turns(spark, sf_dir).where("role = 'user'").select("session_id", "line", F.col("line").alias("ord"), F.concat(F.lit("u"), F.col("line").cast("string")).alias("uuid"), F.lit(None).cast("string").alias("original_uuid"), F.lit(None).cast("string").alias("timestamp"), F.col("hash").alias("sha256"), F.length("text").cast("long").alias("char_count"), "text")
    carried = m.withColumn("source", F.lit("carried"))
    current = m.where("line % 2 = 1").withColumn("source", F.lit("current"))
    return ledger.merged(carried, current).select("session_id", "ord", F.col("line").cast("long").alias("line"), "source")


@query(f"""WITH {E} SELECT session_id, line, hash AS sha256, length(text) AS char_count, CAST(line AS BIGINT) AS of_line, 'carried' AS source, length(text) > 400 AS leaked FROM e WHERE role = 'user' AND trim(text) <> ''""")
def carried_messages(spark, sf_dir):
    """Messages out of typed intent events, and those whose start a model's output repeats."""
    t = turns(spark, sf_dir).where("role = 'user' AND trim(text) <> ''")
    event = F.concat(F.lit('[{"id":"i","text":'), quoted(F.col("text")), F.lit(',"source":{"line":"'), F.col("line").cast("string"), F.lit('"}},{"text":" "}]'))
    m = t.withColumn("m", handoff.carried(F.try_variant_get(F.parse_json(event), "$", "array<variant>"))).where(F.size("m") == 1).select("session_id", "line", F.col("m")[0].alias("m"))
    flat = m.select("session_id", "line", "m.sha256", "m.char_count", F.col("m.line").alias("of_line"), "m.source", "m.text")
    said = flat.groupBy("session_id").agg(F.concat_ws(" ", F.collect_list("text")).alias("output"))
    leaks = ledger.leaked(flat, said, longer=400, probe=300, least=1).distinct().withColumn("leaked", F.lit(True))
    return flat.drop("text").join(leaks, ["session_id", "line"], "left").withColumn("leaked", F.coalesce("leaked", F.lit(False)))


@query("""WITH u AS (SELECT user_id, count(*) FILTER (WHERE event_type = 'purchase') AS bought, CAST(sum(CASE WHEN event_type = 'purchase' THEN event_id % 50 END) AS BIGINT) AS spent FROM events GROUP BY user_id)
    SELECT 'lane-' || user_id AS lane_id, CASE WHEN user_id % 2 = 0 THEN 'single' ELSE 'repeated' END AS suite, bought = 0 AS missing, CASE WHEN bought > 0 THEN bought * 1500 / 1000.0 END AS wall, spent AS used FROM u""")
def lane_suites(spark, sf_dir):
    """Lanes of all suites with their runs: a lane for each user, a run where the user bought something; lanes without one stay."""
    e = table(spark, sf_dir, "events")
    lane = e.select("user_id").distinct().select(F.concat(F.lit("lane-"), F.col("user_id").cast("string")).alias("lane_id"), F.concat(F.lit("dir"), F.col("user_id").cast("string")).alias("run_dir"), F.when(F.col("user_id") % 2 == 0, "single").otherwise("repeated").alias("suite"))
    both = reports.lane_suite(lane.where("suite = 'single'"), lane.where("suite = 'repeated'"), "all")
    bought = e.where("event_type = 'purchase'").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("event_id") % 50).alias("spent"))
    results = bought.select(F.concat(F.lit("dir"), F.col("user_id").cast("string")).alias("run_dir"), (F.col("n") * 1500).alias("ms"), F.parse_json(F.concat(F.lit('{"output_tokens":'), F.col("spent").cast("string"), F.lit("}"))).alias("usage"))
    out = ranking.lanes(both, results)
    return out.select("lane_id", "suite", "missing", ranking.wall_seconds(F.col("ms")).alias("wall"), ranking.tokens_used(F.col("usage"), ["completion_tokens", "output_tokens"]).alias("used"))


_SCORES = "r AS (SELECT source AS run_id, count(*) AS n, sum(n_chars) AS c FROM documents GROUP BY source)"


@query(f"""WITH {_SCORES} SELECT '# Deterministic Compaction Score' || chr(10) || chr(10) || '| {' | '.join(reports.SCORE_HEADS)} |' || chr(10) || '{reports.SCORE_ALIGN}' || chr(10)
    || string_agg('| ' || run_id || ' | ' || (n % 100) || '/100 | ' || CASE WHEN n % 2 = 0 THEN 'pass' ELSE 'fail' END || ' | ' || c || ' | ' || n || ' | 1 | 2 | 3 | 4 | 5 | 6 | 0 |' || chr(10), '' ORDER BY run_id) AS markdown FROM r""")
def score_markdown(spark, sf_dir):
    d = table(spark, sf_dir, "documents").groupBy(F.col("source").alias("run_id")).agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("after_tokens"))
    rows = d.select("run_id", (F.col("n") % 100).alias("score"), (F.col("n") % 2 == 0).alias("gate_pass"), "after_tokens", F.col("n").alias("capsules"), *(F.lit(i).alias(x) for i, x in enumerate(("unique_lines", "intents", "rules", "plans", "promises", "missing"), 1)), F.lit(0).alias("bad_hashes"))
    return reports.score_table(rows)


@query("""WITH a AS (SELECT 'lane-' || user_id AS lane_id, CAST(count(*) % 90 AS DOUBLE) AS s, CASE WHEN user_id % 3 > 0 THEN CAST(count(*) AS DOUBLE) END AS w, user_id % 2 = 0 AS g FROM events GROUP BY user_id),
    q AS (SELECT *, floor(0.65 * s * CASE WHEN g THEN 1.0 ELSE 0.88 END * 10 + 0.5) / 10 AS quality, CASE WHEN w > 0 THEN floor(least(100.0, 1500.0 / w) * 10 + 0.5) / 10 END AS speed FROM a),
    c AS (SELECT *, floor((0.6 * quality + 0.4 * speed) * 10 + 0.5) / 10 AS combined FROM q), k AS (SELECT *, CASE WHEN combined IS NOT NULL THEN row_number() OVER (PARTITION BY combined IS NULL ORDER BY combined DESC, quality DESC, w, lane_id) END AS rank FROM c)
    SELECT coalesce(rank::VARCHAR, '—') AS place, lane_id AS lane, coalesce(printf('%.1f', combined), '—') AS combined, printf('%.1f', quality) AS quality, coalesce(printf('%.1f', speed), '—') AS speed, CASE WHEN g THEN 'pass' ELSE 'fail' END AS gate FROM k""")
def lane_table(spark, sf_dir):
    """The ranking as table cells."""
    e = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    rows = e.select(F.concat(F.lit("lane-"), F.col("user_id").cast("string")).alias("lane_id"), (F.col("n") % 90).cast("double").alias("deterministic_score"), F.lit(0.0).alias("judge_score"), (F.col("user_id") % 2 == 0).alias("gate_pass"), F.when(F.col("user_id") % 3 > 0, F.col("n").cast("double")).alias("wall_seconds"))
    return ranking.table(ranking.ranked(rows))


@query(f"""WITH {E}, r AS (SELECT session_id AS run_id, count(*) AS spans, count(*) FILTER (WHERE role = 'user') > 1 AS ok, arg_min(role, line) = 'user' AS live, coalesce(arg_max(coalesce(text, ''), line), '') AS response, coalesce(max(length(text)), 0) > 200 AS judged FROM e GROUP BY session_id),
    v AS (SELECT run_id, CASE WHEN NOT ok THEN 'not ok' WHEN NOT live THEN 'not live' WHEN response = '' THEN 'no response' WHEN NOT judged THEN 'judge failed' WHEN spans < 6 THEN 'too few spans' END AS reason FROM r) SELECT * FROM v WHERE reason IS NOT NULL""")
def recorded_runs(spark, sf_dir):
    """Conversations as recorded runs: two messages of the user, the user first, an answer at the end, a text worth judging, six turns."""
    line, t = F.col("line"), F.coalesce("text", F.lit(""))
    runs = turns(spark, sf_dir).groupBy(F.col("session_id").alias("run_id")).agg(
        (F.count_if(F.col("role") == "user") > 1).alias("ok"), (F.min_by("role", line) == "user").alias("live"), F.max_by(t, line).alias("response"), (F.max(F.length(t)) > 200).alias("judge_pass"), F.count(F.lit(1)).alias("spans"),
    )
    return compact.verified(runs, 6)


#: Checks by name: patterns that one line must match all of.
_CHECKS = {"a year": ["(?:19|20)[0-9]{2}"], "license and rights": ["(?i)licen[cs]e", "(?i)(?:right|copy|software)"], "a long line": ["^.{400}"], "an assignment": ["[A-Za-z_]+ *= *[^ ]", "[0-9]"], "an empty line": ["^$"]}


@query("WITH d AS (SELECT doc_id AS doc, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents) " + " UNION ALL ".join(f"""SELECT doc, '{name}' AS "check", len(list_filter(ls, lambda l: {" AND ".join(f"regexp_matches(l, '{p}')" for p in patterns)})) > 0 AS passed FROM d""" for name, patterns in _CHECKS.items()))
def document_checks(spark, sf_dir):
    """Documents held against checks of their lines."""
    return reports.document_checks(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), F.col("text").alias("content")), _CHECKS)


@query(f"""WITH {E} SELECT session_id, 'intent-' || lpad(line::VARCHAR, 4, '0') AS id, CASE line % 4 WHEN 0 THEN 'unknown kind' WHEN 1 THEN 'text sha256 differs' ELSE 'bad line' END AS error FROM e WHERE line % 4 < 3""")
def intent_event_rules(spark, sf_dir):
    n = F.col("line")
    t = turns(spark, sf_dir).select("session_id", F.format_string("intent-%04d", "line").alias("id"), F.when(n % 4 == 0, "odd").otherwise("request").alias("kind"), F.lit("normal").alias("priority"), F.lit("active").alias("status"), F.when(n % 4 == 2, 0).otherwise(n).alias("line"), F.when(n % 4 == 1, F.lit("0" * 64)).otherwise(F.col("hash")).alias("text_sha256"), "text")
    return summary.intent_errors(t)


@query(f"""WITH {E} SELECT session_id, 'ev-' || line AS id, CASE line % 3 WHEN 0 THEN 'bad hash' ELSE 'segment out of range' END AS error FROM e WHERE line % 3 < 2""")
def capsule_rules(spark, sf_dir):
    n = F.col("line").cast("int")
    digest = F.when(n % 3 == 0, "no").otherwise(F.col("hash"))
    t = turns(spark, sf_dir).select("session_id", F.concat(F.lit("ev-"), F.col("line").cast("string")).alias("id"), n.alias("start_line"), n.alias("end_line"), digest.alias("start_hash"), F.col("hash").alias("end_hash"), F.col("hash").alias("raw_slice_sha256"), F.array(F.struct(F.when(n % 3 == 1, n + 1).otherwise(n).alias("line"))).alias("text_segments"))
    return summary.capsule_errors(t)


_DEEP = " " * 12


@query(f"""SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'a' || doc_id || chr(10) || ' b' || chr(10) || 'c' WHEN 1 THEN 'intro' || chr(10) || 'return ' || doc_id || chr(10) || '  + 2' || chr(10) || '+ 3' WHEN 2 THEN '        - a' || chr(10) || '        - b' || chr(10) || '        - c'
    WHEN 3 THEN 'x' || chr(10) || '{_DEEP}for a' || chr(10) || '{_DEEP}  b' || chr(10) || '{_DEEP}12|c' ELSE '        | a |' || chr(10) || '        | b |' || chr(10) || '        | c |' END AS clean, CASE WHEN doc_id % 5 < 2 THEN 1 ELSE 0 END AS blocks FROM documents""")
def dedented_code(spark, sf_dir):
    """Blocks of code moved to the left; lists, tables and too short blocks stay."""
    k, n = F.col("doc_id") % 5, F.col("doc_id").cast("string")
    deep = lambda *ls: F.concat_ws("\n", *(F.concat(F.lit(x[0]), x[1]) if isinstance(x, tuple) else F.lit(x) for x in ls))
    t = F.when(k == 0, deep((" " * 8 + "a", n), " " * 9 + "b", " " * 8 + "c")).when(k == 1, deep("intro", (_DEEP + "return ", n), _DEEP + "  + 2", _DEEP + "+ 3")).when(k == 2, deep(*(" " * 8 + f"- {x}" for x in "abc")))
    t = t.when(k == 3, deep("x", _DEEP + "for a", _DEEP + "  b", _DEEP + "12|c")).otherwise(deep(*(" " * 8 + f"| {x} |" for x in "abc")))
    out = render.with_clean(table(spark, sf_dir, "documents").select("doc_id", t.alias("t")), "t")
    return out.select("doc_id", "clean", F.col("clean_stats.dedented_blocks").cast("int").alias("blocks"))


@query("""SELECT doc_id, doc_id % 4 < 2 AS command, doc_id % 4 IN (1, 2) AS path, doc_id % 4 = 3 AS nothing, CASE doc_id % 4 WHEN 0 THEN 'npm run x' || doc_id WHEN 1 THEN 'scripts/go_' || doc_id || '.sh --all' WHEN 2 THEN '/a/b/c_' || doc_id || '.txt' ELSE 'None, really' END AS cleaned FROM documents""")
def literal_tests(spark, sf_dir):
    """Commands, paths, and values that say there is nothing."""
    k, n = F.col("doc_id") % 4, F.col("doc_id").cast("string")
    x = F.when(k == 0, F.concat(F.lit("`npm run x"), n, F.lit(".`"))).when(k == 1, F.concat(F.lit(" scripts/go_"), n, F.lit(".sh --all "))).when(k == 2, F.concat(F.lit('"/a/b/c_'), n, F.lit('.txt"'))).otherwise("None, really")
    d = table(spark, sf_dir, "documents").select("doc_id", x.alias("x"))
    return d.select("doc_id", literals.is_command(F.col("x")).alias("command"), literals.is_path(F.col("x")).alias("path"), literals.is_nothing(F.col("x")).alias("nothing"), literals.clean_command(F.col("x")).alias("cleaned"))


@query("""WITH t AS (SELECT doc_id, '@@tool Write' || chr(10) || '@@file a.txt' || chr(10) || coalesce(text, '') AS t FROM documents), n AS (SELECT *, length(t) AS n, left(t, 400) AS a, substr(t, greatest(length(t) - 200, 400) + 1) AS b FROM t),
    c AS (SELECT *, n > 800 AND NOT regexp_matches(t, '-[^\n]+\n([+][^\n]+\n)+') AS cut FROM n)
    SELECT doc_id, cut AS compressed, sha256(CASE WHEN cut THEN a || chr(10) || chr(10) || '[edit compressed: original_chars=' || n || ' omitted_chars=' || greatest(n - length(a) - length(b), 0) || ' line=' || doc_id || ' body_sha256=' || sha256(t) || ' record_sha256=' || sha256(t) || ']' || chr(10) || chr(10) || b ELSE t END) AS body_sha256 FROM c""")
def shortened_edits(spark, sf_dir):
    """Long formatted edits."""
    t = F.concat(F.lit("@@tool Write\n@@file a.txt\n"), F.coalesce("text", F.lit("")))
    d = table(spark, sf_dir, "documents").select("doc_id", t.alias("t"))
    c = d.select("doc_id", compress.shortened_edit(F.col("t"), F.col("doc_id"), sha256(F.col("t"))).alias("c"))
    return c.select("doc_id", "c.compressed", sha256(F.col("c.body")).alias("body_sha256"))


@query("""SELECT 'run' || (doc_id % 7) AS run_id, count(*) AS required, true AS state_read, '1<a>' || chr(10) || 'new' || chr(10) || '<b>2' AS page FROM documents GROUP BY 1""")
def run_artifacts(spark, sf_dir):
    """Fixtures and states written as JSON and read again, joined to the records that point to them."""
    folder = folders.scratch(spark, "artifacts")
    d = table(spark, sf_dir, "documents")
    run = F.concat(F.lit("run"), (F.col("doc_id") % 7).cast("string"))
    d.groupBy(run.alias("run_id")).agg(F.collect_list(F.col("doc_id").cast("string")).alias("required_literals")).write.json(f"{folder}/fixtures")
    fixtures = spark.read.schema("run_id string, required_literals array<string>").json(f"{folder}/fixtures")
    many = fixtures.select("run_id", F.explode("required_literals").alias("literal")).join(artifacts.required_literals(fixtures), "literal").groupBy("run_id").agg(F.count(F.lit(1)).alias("required"))
    states = fixtures.select(F.concat(F.lit("p/"), "run_id").alias("path"), F.lit("{}").alias("state"))
    carried = artifacts.carried_states(fixtures.select(F.col("run_id").alias("session_id"), F.lit(1).alias("line"), F.concat(F.lit("p/"), "run_id").alias("state_path")), states)
    page = stats.between_markers(F.lit("1<a>old<b>2"), "<a>", "<b>", F.lit("new"))
    return many.join(carried.select(F.col("session_id").alias("run_id"), F.col("state").isNotNull().alias("state_read")), "run_id").withColumn("page", page)
