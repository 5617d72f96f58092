"""The engine's operators on records made by hand."""

import functools
import hashlib
import json
import random
import re

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from tessera.functions import intents, literals, text
from tessera.functions.text import RENDER_WS
from tessera.operators import compress, diff, dspc, judging, ledger, prompts, ranking, render, reports, scoring, spans, stats, summary, tools
from tessera.plans import compact
from tessera.sources import artifacts, sse, transcripts
from tessera.streaming import sse_stream


def value(spark, column, **given):
    names = list(given)
    df = spark.createDataFrame([tuple(given.values())], names) if names else spark.range(1)
    return df.select(column.alias("v")).first().v


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


RECORDS = [
    {"type": "user", "uuid": "u1", "cwd": "/w", "message": {"role": "user", "content": "Never commit  the\npassword"}},
    {"type": "assistant", "message": {"role": "assistant", "model": "m1", "content": [{"type": "text", "text": "ok"}, {"type": "tool_use", "name": "Bash", "input": {"command": "ls"}}]}},
    {"type": "user", "message": {"role": "user", "content": [{"type": "tool_result", "tool_use_id": "t", "content": "x" * 3000}]}},
    {"type": "ai-title", "aiTitle": "A title"},
    {"type": "system"},
    {"type": "user", "uuid": "u2", "message": {"role": "user", "content": "Please continue"}},
]


@pytest.fixture(scope="module")
def entries(spark):
    rows = [("s", i, json.dumps(r)) for i, r in enumerate(RECORDS)] + [("s", 99, "{broken")]
    return transcripts.numbered(spark.createDataFrame(rows, "session_id string, ord int, raw string")).cache()


def test_text_semantics(spark):
    assert value(spark, text.utf16_length(F.col("x")), x="a😀") == 3
    assert value(spark, text.compact(F.col("x")), x=" a  \n b ") == "a b"
    assert value(spark, F.col("x").rlike(text.word("na")), x="naïve") is True
    assert value(spark, text.half_up(F.col("x"), 1), x=0.25) == 0.3
    assert value(spark, text.fence(F.col("x")), x="a ```` b") == "`````"
    assert value(spark, text.xml_unescape(text.xml_escape(F.col("x"))), x='<a b="&amp;">') == '<a b="&amp;">'
    assert value(spark, text.xml_attributes(F.col("x")), x='a="1" b="&lt;" a="2"') == {"a": "2", "b": "<"}
    assert value(spark, text.leading_int(F.col("x")), x=" 12px") == 12
    assert value(spark, text.normal_code(F.col("x")), x="a \r\nb\t\n\n") == "a\nb"


def test_records(spark, entries):
    rows = {r.line: r for r in entries.withColumn("kind", transcripts.kind(F.col("record"))).withColumn("user", transcripts.is_user_message(F.col("record"))).collect()}
    assert [rows[i].kind for i in range(1, 8)] == ["user_message", "tool_use", "tool_output", "metadata", "system", "user_message", "unparsed"]
    assert rows[1].preview == "type=user | uuid=u1 | role=user | text=Never commit the password"
    assert rows[4].text == "A title" and rows[5].text == "" and rows[7].preview == "{broken"
    assert [i for i in rows if rows[i].user] == [1, 6]
    assert transcripts.numbered(entries.select("session_id", "ord", "raw"), citable=True).agg(F.max("line")).first()[0] == 5
    m = transcripts.metadata(entries).first()
    assert (m.cwd, m.last_user_uuid, m.model) == ("/w", "u2", "m1")
    assert {(b.line, b.type) for b in transcripts.blocks(entries).collect()} >= {(1, "string_content"), (2, "text"), (2, "tool_use"), (3, "tool_result")}


def test_strict_reading_names_the_record(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"a":1}\r\n\r\n{bad\n')
    lines = transcripts.read_lines(spark, str(tmp_path))
    assert lines.count() == 2
    with pytest.raises(Exception, match="logical record 2"):
        transcripts.strict(lines).select("record").collect()


def test_compression_keeps_counts(spark):
    body = "\n".join(f"line {i}" for i in range(600))
    c = value(spark, compress.headtail(F.col("x"), F.lit(7), F.lit("h")), x=body)
    head, tail = body[:900].removesuffix("\n"), body[-500:].removeprefix("\n").removesuffix("\n")
    assert c.compressed and c.omitted_chars == len(body) - len(head) - len(tail) and c.body.startswith(head) and c.body.endswith(tail) and f"body_sha256={sha(body)}" in c.body
    assert value(spark, compress.mask(F.col("x"), F.lit(7), F.lit("h")), x=body).omitted_chars == len(body)
    assert value(spark, compress.headtail(F.col("x"), F.lit(7), F.lit("h")), x="short").body == "short"
    with pytest.raises(ValueError):
        compress.compressed("zip", F.lit("x"), F.lit(1), F.lit("h"))


def test_cleanup(spark):
    body = "\n".join(["a", "─" * 24, "=" * 20, "│ kept │", " ", "​", "", "", "b", "", *["        " + x for x in ("x = 1", "y = 2", "z = 3")], "", "\tt"])
    df = render.with_clean(spark.createDataFrame([(body,)], ["t"]), "t")
    r = df.first()
    assert r.clean.split("\n") == ["a", "│ kept │", "", "", "b", "", "x = 1", "y = 2", "z = 3", "", "\tt"]
    assert r.clean_stats.removed_lines == 4 and r.clean_stats.dedented_blocks == 1
    again = render.with_clean(spark.createDataFrame([(r.clean,)], ["t"]), "t").first()
    assert again.clean == r.clean


def test_renderers(spark, entries):
    onto = {r.line: r for r in render.rendered(entries, "onto", after=2).collect()}
    assert onto[1].rendered.startswith("1|user\nNever") and onto[7].rendered == "7|unparsed\n{broken"
    assert onto[3].stats.compressed and "tool output compressed" in onto[3].rendered
    stripped = {r.line: r for r in render.rendered(entries, "stripped", after=2).collect()}
    assert not stripped[3].stats.compressed and stripped[1].rendered.startswith('<record line="000001" type="user" role="user">')
    sentinel = {r.line: r for r in render.rendered(entries, "sentinel").collect()}
    assert sentinel[6].rendered == "@@RECORD line=000006 type=user role=user chars=15\nPlease continue\n@@END_RECORD line=000006"
    assert render.wrapped(render.rendered(entries, "onto")).first().transcript.startswith("@@ONTO Transcript[7] fields=line|type\n1|user\n")


def test_dspc_keeps_the_rare_line(spark):
    body = "\n".join(["The same dull words again and again."] * 60 + ["Xylophone error 4711 in module quux!"] + ["The same dull words again and again."] * 60)
    got = dspc.selected(spark.createDataFrame([(1, body)], ["key", "text"]), budget=300).first()
    assert "Xylophone error 4711" in got.kept and len(got.kept) <= 320 and got.n == 121 and got.kept1 == 84


def test_intents(spark):
    for t, k, p in [("never use the password", "constraint", "high"), ("the API token", "safety", "must_keep"), ("actually no", "correction", "high"), ("I prefer tabs", "preference", "normal"), ("do it", "request", "normal")]:
        kind = intents.kind(F.col("x"))
        assert (value(spark, kind, x=t), value(spark, intents.priority(kind, F.col("x")), x=t)) == (k, p)


def test_ledger_skips_what_does_not_fit(spark):
    rows = [("s", i, i, None, None, None, None, "current", sha(t), None, len(t), t) for i, t in enumerate(["never stop", "word " * 400, "tiny", "last"], 1)]
    schema = "session_id string, ord int, line int, uuid string, original_uuid string, parent_uuid string, timestamp string, source string, sha256 string, record_sha256 string, char_count int, text string"
    df = spark.createDataFrame(rows, schema)
    got = sorted(r.ord for r in ledger.selected(df, most_tokens=150).collect())
    assert got == [1, 3, 4]
    assert sorted(r.ord for r in ledger.selected(df, most=2).collect()) == [1, 4]
    assert ledger.selected(df, most=0).count() == 0
    carried = spark.createDataFrame([("s", 1, 1, None, None, None, None, "carried", sha("tiny"), None, 4, "tiny"), ("s", 2, 9, "u9", None, None, None, "carried", sha("z"), None, 1, "z")], schema)
    assert [r.text for r in ledger.merged(carried, df).orderBy("ord").collect()] == ["z", "never stop", "word " * 400, "tiny", "last"]


def test_spans(spark):
    e = spark.createDataFrame([("s", i, sha(str(i)), t) for i, t in enumerate(["alpha", "", "```py\nx = 1\n```", "d"], 1)], "session_id string, line int, hash string, text string")
    items = spark.createDataFrame([("s", 0, [Row(start_line=1, end_line=3)]), ("s", 1, [Row(start_line=4, end_line=4)])], "session_id string, anchor int, spans array<struct<start_line:int,end_line:int>>")
    got = spans.rehydrated(spans.numbered(items), e)
    r = {x.span_id: x for x in got.collect()}
    assert r["span-0001"].extracted_text == "alpha\n\n```py\nx = 1\n```" and [s.char_range for s in r["span-0001"].segments] == [[0, 5], [7, 22]]
    c = spans.code_capsules(got).collect()
    assert len(c) == 1 and c[0].language == "py" and c[0].source_line == 3 and c[0].exact_text_sha256 == sha("x = 1")


def test_edit_capsules(spark):
    pairs = diff.line_diff(F.col("old"), F.col("new"))
    block = diff.edit_block(F.lit("Edit"), F.lit("a.py"), F.col("old"), F.col("new"), pairs)
    df = spark.createDataFrame([("s", "span-0001", "a\nb", "a\nc\nd")], ["session_id", "span_id", "old", "new"]).withColumn("extracted_text", block)
    c = spans.edit_capsules(df).first()
    assert (c.id, c.tool_name, c.file_path, c.lines_added, c.lines_removed) == ("span-0001-edit-001", "Edit", "a.py", 3, 2) and len(c.input_sha256) == 64


def test_line_diff():
    old = "\n".join(["p", "q", *[f"c{i}" for i in range(10)], "r", "tail"])
    new = "\n".join(["p", "Q", *[f"c{i}" for i in range(10)], "R", "tail"])
    got = [(x["type"], x["line"] or x["count"]) for x in diff.line_pairs(old, new)]
    assert got == [("context", "p"), ("remove", "q"), ("add", "Q"), ("context", "c0"), ("context", "c1"), ("context", "c2"), ("elide", 4), ("context", "c7"), ("context", "c8"), ("context", "c9"), ("remove", "r"), ("add", "R"), ("context", "tail")]


def test_literals(spark):
    assert value(spark, literals.next_command(F.array(F.col("x")), F.lit("")), x="Next: `uv run pytest -q`. Then rest") == "uv run pytest -q"
    assert value(spark, literals.paths(F.col("x")), x="see src/a.py and (/etc/hosts) now") == ["src/a.py", "/etc/hosts"]
    assert value(spark, literals.is_nothing(F.col("x")), x="None needed") is True
    assert value(spark, literals.is_command(F.col("x")), x="note: git push") is False
    assert value(spark, literals.is_path(F.col("x")), x="https://a/b.c") is False
    assert "FOO_BAR" in value(spark, literals.evidence(F.col("x")), x="set FOO_BAR in `conf`")


def test_ranking_numbers(spark):
    q = lambda d, j, g: value(spark, ranking.quality(F.lit(float(d)), F.lit(float(j)), F.lit(g)))
    assert q(94, 10, True) == 96.1 and q(94, 10, False) == 84.6
    assert value(spark, ranking.speed(F.lit(36.4))) == 41.2 and value(spark, ranking.speed(F.lit(3.4))) == 100.0 and value(spark, ranking.speed(F.lit(0.0))) is None
    assert value(spark, ranking.combined(F.lit(96.1), F.lit(41.2))) == 74.1


def test_judging(spark):
    rows = [("r", t, c, lv, f"q{t}", ["ev-1"]) for t, lvs in enumerate([("clear", "absent"), ("partial", "clear"), ("clear", "clear"), ("clear", "partial")]) for c, lv in zip("ab", lvs, strict=True)]
    v = spark.createDataFrame(rows, "run_id string, trial int, criterion string, level string, quote string, refs array<string>")
    got = {r.criterion: (r.value, r.quote) for r in judging.medians(v).collect()}
    assert got == {"a": (2, "q0"), "b": (1, "q3")}
    o = judging.outcome(judging.medians(v)).first()
    assert (o.total, o.absent, o["pass"]) == (3, 0, False)
    known = spark.createDataFrame([("r", "ev-2")], "run_id string, ref string")
    assert judging.unknown_refs(v, known).count() == 1
    assert {r.error for r in judging.rejects(v, ["a", "b"], known).collect()} == {"unknown ref"}


def test_sse_batch_and_stream_agree(spark, tmp_path):
    raw = 'event: a\r\ndata: {"type":"x","delta":"he"}\r\n\r\ndata: {"delta":\ndata: "y"}\n\ndata: [DONE]\n\ndata: {oops\n\n'
    batch = sse.events(spark.createDataFrame([("s", raw)], ["stream_id", "raw"])).collect()
    assert [(e.type, e.ok) for e in batch] == [("x", True), (None, True), ("done_sentinel", True), ("unparsed", False)]
    assert sse.outcome(sse.events(spark.createDataFrame([("s", raw)], ["stream_id", "raw"])), "chat").first().completed
    schema = "stream_id string, seq long, chunk string"
    for i in range(3):
        spark.createDataFrame([("s", i, raw[i * 40 : (i + 1) * 40 if i < 2 else None])], schema).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    q = sse_stream.events(spark.readStream.schema(schema).json(str(tmp_path / "in"))).writeStream.format("memory").queryName("sse_out").outputMode("append").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert sorted((r.n, r.data) for r in spark.table("sse_out").collect()) == [(e.n, e.data) for e in batch]


def test_unfinished_streams_are_flushed_and_filed(spark, tmp_path):
    schema = "stream_id string, seq long, chunk string"
    chunks = [("s", 0, 'data: {"choices":[{"delta":{"content":"a"}}]}\n\nda'), ("s", 1, 'ta: {"choices":[{"delta":{"content":"b"}}]}'), ("s", 2, None), ("t", 0, 'data: {"choices":[{"delta":{"content":"open"}}]}')]
    spark.createDataFrame(chunks, schema).coalesce(1).write.json(str(tmp_path / "in"), ignoreNullFields=False)
    for q in sse_stream.side_files(spark.readStream.schema(schema).json(str(tmp_path / "in")), str(tmp_path / "out")):
        q.awaitTermination(120)
    assert {r.stream_id: r.text for r in sse_stream.texts_so_far(spark, str(tmp_path / "out"), "chat").collect()} == {"s": "ab"}
    assert spark.read.json(str(tmp_path / "out" / "raw")).count() == 4


def test_lines_keep_their_order_over_splits(spark, tmp_path):
    rows = [json.dumps({"i": i, "x": "y" * (i % 50)}) for i in range(4000)]
    (tmp_path / "a.jsonl").write_text("\r\n".join(rows) + "\n\n")
    (tmp_path / "b.jsonl").write_text("\n".join(rows[:5]))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        got = transcripts.read_lines(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    by = {}
    for r in got:
        by.setdefault(r.session_id[-7:], {})[r.ord] = r.raw
    assert [by["a.jsonl"][i] for i in range(4000)] == rows and [by["b.jsonl"][i] for i in range(5)] == rows[:5]


def test_summary_validation(spark):
    base = {"session_id": "s", "current_work": "w", "optional_next_step": "n", "summary_blocks": [{"section": "A", "format": "bullet", "body": "- x", "source_spans": [{"start_line": 1, "end_line": 2}]}], "rules_and_invariants": [], "plans_and_task_state": [{"item": "p", "status": "blocked", "source_spans": [{"start_line": 1, "end_line": 1}]}], "promises_made": None, "pickup_state": {"cwd": "/a"}, "source_integrity": {"transcript_lines_seen": 9}}
    df = spark.read.schema(summary.SCHEMA).json(spark.sparkContext.parallelize([json.dumps(base)]))
    assert summary.first_error(df, F.lit(9)).first().error == "promises_made must be an array"
    ready = summary.with_defaults(df)
    assert summary.first_error(ready, F.lit(9)).first().error == "a bullet must be one line without a marker"
    fixed = summary.relaxed(ready)
    assert fixed.first().relaxed == 1 and summary.relaxed(fixed).first().relaxed == 0
    assert summary.first_error(fixed, F.lit(9)).first().error is None
    assert summary.first_error(fixed, F.lit(1)).first().error == "transcript_lines_seen differs"
    done = summary.with_derived(summary.with_pickup(fixed, F.lit("/w"), F.lit("main")))
    r = done.first()
    assert r.pickup_state.cwd == "/w" and r.pickup_state.current_task == "w" and r.pending_tasks == ["p", "n"]
    assert summary.handoff_state(fixed).first().state.active_state.blockers == ["p"]


def test_scores(spark):
    assert value(spark, scoring.ratio(F.lit(5), F.lit(10), 20)) == 10 and value(spark, scoring.ratio(F.lit(0), F.lit(None).cast("int"), 8)) == 8
    counts = spark.createDataFrame([("s", 15, 50, 0)], "session_id string, evidence_capsules long, cited_unique_lines long, promises long")
    d = scoring.density(counts).first()
    assert d.score == 0.75 and not d["pass"] and d.shortfalls == ["capsules"]
    tries = spark.createDataFrame([("r", 1, 0, 0.5), ("r", 2, 0, 0.5), ("r", 3, 1, 1.0)], "run_id string, attempt int, missing int, density double")
    assert scoring.best_attempt(tries).first().attempt == 2


def test_compaction(spark, entries):
    s = spark.createDataFrame([("s", "what happened")], ["session_id", "summary"])
    out = compact.compacted(entries, s, 2).orderBy("ord").collect()
    records = [json.loads(r.raw) for r in out]
    assert [r["type"] for r in records] == ["system", "user", "system", "user"] and records[1]["isCompactSummary"]
    assert records[2]["parentUuid"] == records[1]["uuid"] and records[3]["parentUuid"] == records[2]["uuid"]
    assert "Never commit" in records[1]["message"]["content"]
    again = transcripts.numbered(spark.createDataFrame([("s", r.ord, r.raw) for r in out], "session_id string, ord int, raw string"))
    assert {r.text for r in ledger.from_summaries(again).collect()} >= {"Please continue"}


def test_manifest_and_prompts(spark):
    a = spark.createDataFrame([("r", "state", "{}"), ("r", "odd", "x")], "run_id string, kind string, content string")
    m = {r.kind: r for r in artifacts.manifest(a).collect()}
    assert m["state"].authority == "authoritative" and m["odd"].authority == "derived" and m["odd"].sha256 == sha("x")
    assert scoring.bad_hashes(artifacts.manifest(a), a).count() == 0
    t = prompts.adaptations(prompts.traits(spark.createDataFrame([("gemini", "gemini-3.5-flash", "onto")], "provider string, model string, renderer string"))).first()
    assert t.adaptation_ids == ["final-state-first", "continuation-coverage", "preserve-literals", "flash-sectional-depth"]
    assert "[redacted]" in value(spark, prompts.redacted(F.col("x")), x='{"api_key": "abc123"}')
    table = stats.markdown(a, ["kind", "content"], [F.col("kind")]).first().markdown
    assert table.split("\n")[2] == "| odd | x |"
    assert value(spark, stats.between_markers(F.col("x"), "<a>", "<b>", F.lit("new")), x="1<a>old<b>2") == "1<a>\nnew\n<b>2"


def test_tool_calls_and_results_are_rendered(spark):
    old, new = "\n".join(f"line {i} of a file that is long enough" for i in range(30)), "\n".join(f"line {i} of a file that is {'changed' if i == 15 else 'long enough'}" for i in range(30))
    call = lambda name, given: {"type": "assistant", "message": {"role": "assistant", "content": [{"type": "tool_use", "id": "t", "name": name, "input": given}]}}
    result = lambda content: {"type": "user", "message": {"role": "user", "content": [{"type": "tool_result", "tool_use_id": "t", "content": content}]}}
    diff_lines = [{"type": "unchanged", "content": f"u{i}"} for i in range(9)] + [{"type": "removed", "content": "a"}, {"type": "added", "content": "b"}]
    structured = json.dumps({"path": "/w/a.py", "diffLines": diff_lines}, separators=(",", ":"))
    given = {"command": "ls -l", "a": [1, {}], "e": []}
    records = [
        call("Bash", given), call("Edit", {"file_path": "/w/a.py", "old_string": "x", "new_string": "y\nz"}), call("Edit", {"file_path": "/w/a.py", "old_string": old, "new_string": new}),
        call("MultiEdit", {"file_path": "/w/a.py", "edits": [{"old_string": "1", "new_string": "2"}, {"old_string": "3", "new_string": ""}]}), call("Write", {"file_path": "b.txt", "content": "one\ntwo\n"}),
        call("apply_patch", {"patch": "*** Begin\n"}), result([{"type": "text", "text": "first"}, "second", {"content": "third"}]), result(structured), result(""), result("plain"),
    ]
    raw = [json.dumps(r, separators=(",", ":")) for r in records]
    e = transcripts.numbered(spark.createDataFrame([("s", i, x) for i, x in enumerate(raw)], "session_id string, ord int, raw string"))
    got = {r.line: r.p for r in tools.with_prompt_text(e, "p", F.lit("/w")).collect()}
    head = lambda name, i: f"@@tool {name} line={i:06d} sha256={sha(raw[i - 1])}"
    compact = lambda x: json.dumps(x, separators=(",", ":"))
    edit = lambda path, a, b: sha(compact({"filePath": path, "oldText": a, "newText": b}))
    nl = "\n"
    assert got[1] == f"{head('Bash', 1)}\n{json.dumps(given, indent=2)}\nstats: input_sha256={sha(compact(given))}"
    assert got[2] == f"{head('Edit', 2)}\n@@file a.py\n@@file_abs /w/a.py\n-x\n+y\n+z\nstats: +2 -1 lines | input_sha256={edit('/w/a.py', 'x', 'y' + nl + 'z')}"
    assert got[3].split("\n")[:5] == [head("Edit", 3), "@@file a.py", "@@file_abs /w/a.py", "--- a/a.py", "+++ b/a.py"]
    assert f"stats: +1 -1 lines | input_sha256={edit('/w/a.py', old, new)}" in got[3]
    assert got[4].split("\n\n")[1].startswith(f"{head('MultiEdit[1]', 4)}\n@@file a.py\n@@file_abs /w/a.py\n-3\n+\nstats: +1 -1 lines")
    assert got[5].split("\n")[1:6] == ["@@file b.txt", "```", "one", "two", "```"] and "stats: lines=3 |" in got[5]
    assert got[6] == f"{head('apply_patch', 6)}\n```diff\n*** Begin\n```\nstats: input_sha256={sha('*** Begin' + nl)}"
    assert got[7] == "[tool_result]\nfirst\nsecond\nthird"
    body = "\n".join([" u0", " u1", " u2", "[... 3 unchanged lines ...]", " u6", " u7", " u8", "-a", "+b"])
    assert got[8] == f"[tool_result]\n{head('EditResult', 8)}\n@@file a.py\n@@file_abs /w/a.py\n--- a/a.py\n+++ b/a.py\n{body}\nstats: +1 -1 lines | input_sha256={sha(structured)}"
    assert (got[9], got[10]) == ("[tool_result]", "[tool_result]\nplain")
    stale = {r.line: r for r in render.rendered(e, "onto", after=1).collect()}
    assert stale[1].rendered.startswith("1|assistant\n@@tool Bash line=000001") and stale[7].rendered == "7|user\n[tool_result]\nfirst\nsecond\nthird"


def test_long_calls_and_outputs_are_compressed(spark):
    body = "\n".join(f"Sentence {i} tells of thing {i % 7}. It goes on for some time!" for i in range(100))
    records = [
        {"type": "assistant", "message": {"role": "assistant", "content": [{"type": "tool_use", "name": "Write", "input": {"file_path": "a", "content": "\n".join(f"new line {i}" + "-" * 30 for i in range(200))}}]}},
        {"type": "user", "message": {"role": "user", "content": [{"type": "tool_result", "tool_use_id": "t", "content": body}]}},
        {"type": "user", "message": {"role": "user", "content": [{"type": "tool_result", "tool_use_id": "t", "content": "x" * 5000}]}},
        *({"type": "user", "message": {"role": "user", "content": "go"}} for _ in range(3)),
    ]
    e = transcripts.numbered(spark.createDataFrame([("s", i, json.dumps(r)) for i, r in enumerate(records)], "session_id string, ord int, raw string"))
    got = {r.line: r for r in render.rendered(e, "onto", after=2, strategy="dspc").collect()}
    assert "edit compressed:" in got[1].rendered and got[1].stats.compressed
    assert "strategy=dspc" in got[2].rendered and "stage1_kept=" in got[2].rendered and len(got[2].rendered) < 2500 and got[2].stats.compressed
    assert "stage1_kept=1/2 stage2_kept=1]" in got[3].rendered  # "[tool_result]" and one more sentence
    assert not got[4].stats.compressed and len(got) == 6


def test_scripts_match_their_definition():
    def script(a, b):
        @functools.cache
        def common(x, y):
            return 0 if not x or not y else max(common(x[1:], y), common(x, y[1:]), (x[0] == y[0]) + common(x[1:], y[1:]) if x[0] == y[0] else 0)

        if not a or not b:
            return [("remove", x) for x in a] + [("add", x) for x in b]
        if a[0] == b[0]:
            return [("same", a[0]), *script(a[1:], b[1:])]
        return [("remove", a[0]), *script(a[1:], b)] if common(a[1:], b) >= common(a, b[1:]) else [("add", b[0]), *script(a, b[1:])]

    r = random.Random(4)
    for _ in range(150):
        a, b = (tuple(r.randrange(4) for _ in range(r.randrange(10))) for _ in range(2))
        assert [(k, int(x)) for k, x in diff._script(np.array(a, int), np.array(b, int))] == script(a, b)


def test_dedenting():
    deep = " " * 12
    cases = {
        f"{deep}if x {{\n{deep}  y;\n{deep}}}": ("if x {\n  y;\n}", 1),
        f"intro\n{deep}return 1\n{deep}  + 2\n{deep}  + 3": ("intro\nreturn 1\n  + 2\n  + 3", 1),
        f"intro\n{deep}return 1\n\n{deep}two": (f"intro\n{deep}return 1\n\n{deep}two", 0),
        "        - a\n        - b\n        - c": ("        - a\n        - b\n        - c", 0),
        "        a\n\t\tb\n        c": ("        a\n\t\tb\n        c", 0),
        "        | a |\n        | b |\n        | c |": ("        | a |\n        | b |\n        | c |", 0),
        f"x\n{deep}for a\n{deep}  b\n{deep}12|c\n{deep}d": (f"x\n{deep}for a\n{deep}  b\n{deep}12|c\n{deep}d", 0),
        f"a\nb\n\n{deep}c\n{deep} d\n{deep}e\n\nf": ("a\nb\n\nc\n d\ne\n\nf", 1),
    }
    for text, want in cases.items():
        assert render._dedented(text) == want, text


@pytest.mark.parametrize("text", ["", "\n", "\n\n\n\n", "a", "\n\n\n\na\n \n\t\n​\n\nb\n\n\n\n", " \n \n ", "a\n\n\nb", "a\r\n\r\n\r\n\r\nb", "\n\n\na"])
def test_blank_runs_match_a_loop(spark, text):
    out, run = [], 0
    for line in text.split("\n"):
        blank = re.fullmatch(RENDER_WS + "*", line) is not None
        run = run + 1 if blank else 0
        if run <= 2:
            out.append("" if blank else line)
    assert value(spark, render.short_blank_runs(F.col("x")), x=text) == "\n".join(out)


def test_judge_schema_and_report_sections(spark):
    schema = reports.judge_schema(["a", "b"], "r1", {"state_sha256": "x"})
    assert schema["properties"]["dimensions"]["minItems"] == 2 and schema["properties"]["candidate_hashes"]["properties"]["state_sha256"]["enum"] == ["x"]
    assert schema["properties"]["total_level_score"]["maximum"] == 4 and "enum" not in schema["properties"]["candidate_hashes"]["properties"]["handoff_md_sha256"]
    t = spark.createDataFrame([("b", 1500), ("a|c", 2)], "k string, n long")
    one = reports.table(t, {"K": F.col("k"), "N": reports.thousands(F.col("n"))}, [F.col("n").desc()])
    assert reports.sections([("## X", one)]).first().text == "## X\n\n| K | N |\n| --- | --- |\n| b | 1,500 |\n| a\\|c | 2 |"
    with pytest.raises(ValueError):
        reports.lane_suite(t, t, "other")
