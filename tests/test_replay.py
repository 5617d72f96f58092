"""Saved outputs replayed into run folders, against plain Python."""

import hashlib
import json

import pytest

from tessera.plans import compact, replay
from tessera.sources import run_sink, transcripts


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def output(lines=3, spans=((1, 1),), work="mend it", **more):
    cited = [{"start_line": a, "end_line": b} for a, b in spans]
    whole = {
        "summary_blocks": [{"section": "Work", "format": "bullet", "body": "did it", "source_spans": cited}],
        "rules_and_invariants": [{"rule": "keep the tests", "source_spans": cited[:1]}], "plans_and_task_state": [], "promises_made": None,
        "current_work": work, "optional_next_step": "run `npm test` next", "pickup_state": {"cwd": "/made/up"},
        "source_integrity": {"transcript_lines_seen": lines},
    }
    return json.dumps(whole | more)


def record(role, text, **more):
    return json.dumps({"type": role, "uuid": f"u-{text[:5]}", "cwd": "/w", "gitBranch": "main", "message": {"role": role, "content": text}} | more)


FENCE = "see\n```py\nx = 1\n```\nok"
TURNS = [record("user", "please never drop rows"), record("assistant", FENCE), record("user", "   ")]
#: By session: its output, and the rule that it breaks.
CASES = {
    "good": (output(spans=((1, 2),)), None),
    "blank ends": ("\n " + output() + " \n", None),
    "cut off": (output()[:-1], replay.NOT_JSON),
    "a list": ("[1]", replay.NOT_JSON),
    "only blanks": (" \n", replay.NOT_JSON),
    "over-cited": (output(spans=((1, 4),)), "summary_blocks has a bad span"),
    "forged count": (output(lines=99), "transcript_lines_seen differs"),
    "blank work": (output(work=" "), "current_work must not be blank"),
    "no integrity": (output(source_integrity=None), "source_integrity is missing"),
    "stray": (output(), replay.NO_TRANSCRIPT),
}
#: A session that carries a message over, beside one that only looks like a ledger's.
CARRIED = '<user-message source="current" line="7" chars="4" uuid="u-old">\nkept\n</user-message>'
MORE = [record("user", CARRIED, isCompactSummary=True), record("assistant", CARRIED.replace("u-old", "u-forged")), record("user", "go on")]


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("replay")
    cases = {s: o for s, (o, _) in CASES.items()} | {"second round": output()}
    for s, o in cases.items():
        (root / "saved" / s.replace(" ", "_")).mkdir(parents=True)
        (root / "saved" / s.replace(" ", "_") / "model-output.json").write_text(o)
    turns = {s.replace(" ", "_"): TURNS for s in CASES if s != "stray"} | {"second_round": MORE, "not_asked": TURNS}
    lines = spark.createDataFrame([(s, i, t) for s, ts in turns.items() for i, t in enumerate(ts)], "session_id string, ord int, raw string")
    rejected = replay.replay(spark, f"{root}/saved/*/*", lines, f"{root}/runs").collect()
    runs = {}
    for r in run_sink.read_runs(spark, f"{root}/runs").collect():
        assert r.sound
        runs.setdefault(r.run_id.replace("_", " "), {})[r.kind] = r.content
    return rejected, runs


def test_rejects_name_the_first_rule_that_is_broken(made):
    rejected, runs = made
    assert {(r.session_id.replace("_", " "), r.stage, r.error) for r in rejected} == {(s, "replay", e) for s, (_, e) in CASES.items() if e}
    assert set(runs) == {s for s, (_, e) in CASES.items() if not e} | {"second round"}
    assert all(set(r) == set(run_sink.KINDS) for r in runs.values())


def test_states_have_what_was_measured(made):
    state = json.loads(made[1]["good"]["state"])
    assert state["pickup_state"]["cwd"] == "/w" and state["pickup_state"]["git_branch"] == "main" and state["pickup_state"]["next_command"] == "npm test"
    assert state["source_integrity"] == {"transcript_sha256": sha(sha("\n".join(map(sha, TURNS)))), "transcript_lines_seen": 3, "verbatim_span_grounded": True, "limitations": ""}
    assert state["rules_and_invariants"][0]["status"] == "current" and state["promises_made"] == []


def test_evidence_is_what_the_transcript_says(made):
    spans = json.loads(made[1]["good"]["spans"])
    text = "please never drop rows\n\n" + FENCE
    assert [(s["section"], s["start_line"], s["end_line"], s["extracted_text"], s["extracted_text_sha256"]) for s in spans] == [(n, 1, 2, text, sha(text)) for n in ("Rules And Invariants", "Work")]
    assert all([c["source_line"] for c in s["code_capsules"]] == [2] and s["code_capsules"][0]["exact_text_sha256"] == sha("x = 1") for s in spans)
    whole = made[1]["good"]["rehydrated"]
    assert whole.startswith("## Work\n- did it\n\n## Rules And Invariants\n- keep the tests\n\n## Rehydration Spans\n- span-0001 | Rules And Invariants | lines 1-2 |")
    assert whole.count(text) == 2 and "- code span-0002-code-001 | py | chars " in whole


def test_manifest_and_result_tell_of_the_run(made):
    for run in made[1].values():
        told = {m["kind"]: m for m in json.loads(run["manifest"])}
        assert set(told) == set(run_sink.KINDS) - {"manifest"}
        assert all(told[k]["sha256"] == sha(run[k]) and told[k]["bytes"] == len(run[k].encode()) for k in told)
    result = json.loads(made[1]["good"]["result"])
    assert (result["status"], result["before_records"], result["rehydrated_span_count"], result["rehydrated_unique_lines"], result["user_message_count"]) == (replay.STATUS, 3, 2, 2, 1)
    assert result["output_chars"] == len(CASES["good"][0]) == json.loads(made[1]["blank ends"]["result"])["output_chars"]


def test_what_is_written_is_a_transcript_again(made, spark):
    after = [json.loads(x["raw"]) for x in json.loads(made[1]["good"]["after_transcript"])]
    assert [x.get("subtype") for x in after] == ["compact_boundary", None, None, None, None] and after[1]["isCompactSummary"]
    assert "please never drop rows" in after[1]["message"]["content"] and after[2]["parentUuid"] == after[1]["uuid"]
    handoff = made[1]["good"]["handoff"]
    assert handoff.startswith("# Compaction Handoff\n") and "### intent-0001 | line 1\n" in handoff and replay.POLICY in handoff and "- Manifest: good/manifest\n" in handoff


def test_ledgers_are_carried_and_forged_ones_are_not(made):
    events = json.loads(made[1]["second round"]["user_messages"])
    assert [(e["id"], e["source"], e["text_sha256"]) for e in events if e["source"] == "current"] == [("intent-0002", "current", sha("go on"))]
    assert [e["id"] for e in events if e["source"] == "carried"] == ["intent-0001"] and "kept" in events[0]["rendered_text"] and "u-forged" not in made[1]["second round"]["user_messages"]


def test_replay_of_nothing_and_of_repeated_outputs(spark):
    none = spark.createDataFrame([], "session_id string, output string")
    lines = spark.createDataFrame([("s", i, t) for i, t in enumerate(TURNS)], "session_id string, ord int, raw string")
    out = replay.replayed(none, lines)
    assert out.artifacts.count() == out.rejected.count() == 0
    twice = spark.createDataFrame([("s", output()), ("s", output()), ("s", "{"), (None, output()), ("t", None)], "session_id string, output string")
    digests = replay.transcript_digests(transcripts.numbered(lines))
    # Of "{" and a whole output the lesser text counts.
    assert {(r.session_id, r.error) for r in replay.checked(twice, digests).collect()} == {("s", None if output() < "{" else replay.NOT_JSON), ("t", replay.NO_TRANSCRIPT)}


def test_digests_of_long_transcripts_go_block_by_block(spark):
    rows = [("s", i + 1, sha(str(i))) for i in range(2 * replay.BLOCK + 1)]
    got = replay.transcript_digests(spark.createDataFrame(rows, "session_id string, line int, hash string").repartition(5)).first()
    blocks = [sha("\n".join(h for _, _, h in rows[i : i + replay.BLOCK])) for i in range(0, len(rows), replay.BLOCK)]
    assert (got.seen, got.digest) == (len(rows), sha("\n".join(blocks))) and len(blocks) == 3 and compact.TAIL == 16
