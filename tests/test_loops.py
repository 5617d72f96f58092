"""Loops over sessions: asking again, and rounds of compaction."""

import json

import pytest

from tessera.operators import ledger, scoring
from tessera.plans import reask, rounds
from tessera.sources import folders

LEAST = {"capsules": 2, "cited": 2, "promises": 1}


def output(lines, promises=1):
    span = lambda i: [{"start_line": i, "end_line": i}]
    return json.dumps({"summary_blocks": [{"section": "W", "format": "bullet", "body": "b", "source_spans": span(i)} for i in lines], "promises_made": [{"promise": "p", "status": "pending", "source_spans": span(1)}] * promises})


#: By session: answers in order of attempts, and what must come out: attempts made, pass, best attempt, error.
CASES = {
    "at once": ([output([1, 2])], (1, True, 0, None)),
    "cut off first": (["{\"summary_blocks\": [", output([1, 2])], (2, True, 1, None)),
    "loses a literal": ([output([1]), output([1, 3]), output([1, 2]), output([1])], (3, True, 2, None)),
    "never dense": ([output([2, 1], 0)] * 2 + [output([2], 0)] * 3 + [output([1, 2])], (5, False, 1, "handoff did not pass")),
    "never json": (["[1]"] * 12, (5, False, None, "output was not JSON")),
    "no more answers": ([output([3])], (1, False, 0, "handoff did not pass")),
    "none at all": ([], None),
    "bad spans": ([output([-4, 9]), output([2, 1])], (2, True, 1, None)),
}


@pytest.fixture(scope="module")
def made(spark):
    e = spark.createDataFrame([(s, i, "h", t) for s in CASES for i, t in enumerate(["alpha", "needle in line two", "gamma"], 1)], "session_id string, line int, hash string, text string").cache()
    literals = spark.createDataFrame([(s, "needle") for s in CASES if s != "none at all"], "session_id string, literal string")
    answers = spark.createDataFrame([(s, i, o) for s, (outs, _) in CASES.items() for i, o in enumerate(outs)], "session_id string, attempt int, output string")
    asked = []

    def answer(df):
        asked.append({r.session_id: r.feedback for r in df.collect()})
        return reask.recorded(answers)(df)

    out = reask.attempts(e.select("session_id").distinct(), answer, lambda o: reask.judged(o, e, literals, LEAST), most=4).cache()
    return out, asked


def test_loop_stops_what_passes_and_keeps_the_best(made):
    out, _ = made
    got = {r.session_id: (r.made, r["pass"], r.attempt, r.error) for r in reask.chosen(out, 4).collect()}
    assert got == {s: want for s, (_, want) in CASES.items() if want}


def test_loop_asks_fewer_sessions_each_time_and_tells_them_why(made):
    _, asked = made
    assert len(asked) == 5 and all(set(b) <= set(a) for a, b in zip(asked, asked[1:], strict=False))
    assert set(asked[0].values()) == {None} and set(asked[0]) == set(CASES)
    assert asked[1]["cut off first"] == reask.TERSER and asked[1]["never json"] == reask.TERSER
    assert asked[1]["loses a literal"] == "- more cited\n- keep this literal: needle" and "at once" not in asked[1]
    assert set(asked[3]) == {"never dense", "never json"} and asked[1]["never dense"] == "- more promises" and asked[4]["never dense"] == "- more capsules\n- more cited\n- more promises"


def test_best_attempt_equals_brute_force(spark, made):
    out, _ = made
    best = {}
    for r in sorted(out.collect(), key=lambda r: r.attempt):
        if r.valid and (r.session_id not in best or (len(r.missing), -r.density) <= best[r.session_id][0]):
            best[r.session_id] = ((len(r.missing), -r.density), r.attempt)
    assert {r.session_id: r.attempt for r in reask.chosen(out).collect() if r.attempt is not None} == {s: a for s, (_, a) in best.items()}
    assert scoring.best_attempt(spark.createDataFrame([], "run_id string, attempt int, missing int, density double")).count() == 0


def test_empty_loop(spark):
    none = spark.createDataFrame([], "session_id string")
    assert reask.attempts(none, None, None).count() == 0


def test_rounds_keep_the_ledger_through_their_own_output(spark):
    """Five rounds with a tail: messages stay, ids stay, sizes stay, and a literal that was cited in the first stays in what carries it."""
    told = [("user", "u1", "never push to main"), ("assistant", None, "ok"), ("user", "u2", "the token is in the file"), ("user", "u3", "x" * 3000), ("assistant", None, "done"), ("user", "u4", "please go on")]
    raw = [json.dumps({"type": r, "message": {"role": r, "content": t}} | ({"uuid": u} if u else {})) for r, u, t in told]
    lines = spark.createDataFrame([("s", i, x) for i, x in enumerate(raw)] + [("t", 0, raw[0])], "session_id string, ord int, raw string")
    out = json.loads(output([1, 3])) | {"current_work": "work", "optional_next_step": "step", "source_integrity": {"transcript_lines_seen": 6}}
    outputs = spark.createDataFrame([("s", json.dumps(out)), ("t", json.dumps(json.loads(output([1])) | {"source_integrity": {"transcript_lines_seen": 9}}))], "session_id string, output string")
    literals = spark.createDataFrame([("s", "never push"), ("t", "nowhere")], "session_id string, literal string")
    got = {(r.run_id, r["round"]): r for r in rounds.rounds(lines, outputs, literals, most=3, tail=2).collect()}
    assert set(got) == {(s, n) for s in "st" for n in (1, 2, 3)}
    first = got["s", 1]
    assert first.messages == 4 and len(first.hashes) == 2 and first.records == 4
    for n in (1, 2, 3):
        r = got["s", n]
        assert r["pass"] and (r.messages, r.hashes, r.missing, r.bad) == (4, first.hashes, 0, 0) and r.tokens <= first.tokens * 1.1
        assert not got["t", n]["pass"] and got["t", n].missing == 1
    assert not got["t", 1].sound and got["t", 2].sound  # the first output told of another transcript


def test_damaged_artifacts_and_lost_intents_fail_their_gates(spark):
    row = lambda n, **x: {"run_id": "r", "round": n, "tokens": 100, "hashes": ["a", "b"], "objective": "o", "next_step": "n", "missing": 0, "bad": 0, "echo": True} | x
    rows = [row(1), row(2, tokens=110), row(3, tokens=112), row(4, hashes=["a"]), row(5, bad=1), row(6, echo=None), row(7, objective="p"), row(8, missing=2), row(9, hashes=["a", "b", "c"])]
    schema = "run_id string, round int, tokens long, hashes array<string>, objective string, next_step string, missing int, bad int, echo boolean"
    got = {r["round"]: r["pass"] for r in scoring.rounds(spark.createDataFrame([tuple(x.values()) for x in rows], schema)).collect()}
    assert got == {1: True, 2: True, 3: False, 4: False, 5: False, 6: False, 7: False, 8: False, 9: True}


def test_a_round_parses_its_lines_once(spark, monkeypatch):
    """No step of a round but the one that writes its entries parses a line; a ledger without budgets is chosen without a pass in Python."""
    lines = spark.createDataFrame([("s", i, json.dumps({"type": r, "message": {"role": r, "content": t}})) for i, (r, t) in enumerate([("user", "never push"), ("assistant", "ok"), ("user", "go on")])], "session_id string, ord int, raw string")
    outputs = spark.createDataFrame([("s", output([1, 3]))], "session_id string, output string")
    literals = spark.createDataFrame([("s", "never push")], "session_id string, literal string")
    plans, kept = [], folders.kept

    def seen(df, name):
        plans.append((name, df._jdf.queryExecution().optimizedPlan().toString()))
        return kept(df, name)

    monkeypatch.setattr(folders, "kept", seen)
    got = rounds.rounds(lines, outputs, literals, most=3, tail=0, most_tokens=0, most_lines=0)
    parsing = [(name, n) for name, plan in [*plans, ("end", got._jdf.queryExecution().optimizedPlan().toString())] if (n := plan.count("parseJson(raw"))]
    assert parsing == [("entries", 1)] * 3
    assert not any("MapInArrow" in plan for _, plan in plans)
    assert [(r["round"], r.messages, len(r.hashes), r.missing, r.bad) for r in got.orderBy("round").collect()] == [(n, 2, 1, 0, 0) for n in (1, 2, 3)]


@pytest.mark.parametrize("most", [0, 1, 3, 64])
def test_a_ledger_without_budgets_has_the_strongest_and_newest(spark, most):
    texts = {"a": ["go on", "never push", "the token", "go on", "keep it"], "b": ["go on"] * 70, "c": ["the key"]}
    rows = [(s, i, "u", t) for s, ts in texts.items() for i, t in enumerate(ts)]
    schema = "session_id string, ord int, uuid string, text string"
    df = spark.createDataFrame(rows, schema).selectExpr("*", "cast(null AS string) AS source", "ord AS line", "length(text) AS char_count", "'h' AS sha256", "'r' AS record_sha256", "cast(null AS string) AS original_uuid", "cast(null AS string) AS timestamp")
    got = ledger.selected(df, most, most_tokens=0, most_lines=0)
    wide = ledger.selected(df, most, most_tokens=10**9, most_lines=10**9)
    strength = {"the token": 0, "the key": 0, "never push": 1, "keep it": 1, "go on": 2}
    want = {(s, o) for s, ts in texts.items() for _, o in sorted((strength[t], -i) for i, t in enumerate(ts))[:most] for o in [-o]}
    assert {(r.session_id, r.ord) for r in got.collect()} == want and got.columns == wide.columns
    assert sorted(got.collect()) == sorted(wide.collect())
