"""Content and states that nest to any depth, against recursion in Python."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import scoring, tools
from tessera.sources import transcripts


def nested(r, depth):
    """Parts with others inside, calls and results among them."""
    out = []
    for _ in range(r.randrange(1, 4)):
        kind = r.randrange(9)
        if depth and kind < 4:
            out.append({"type": "group", "content": nested(r, depth - 1)})
        elif kind == 4:
            out.append({"type": "tool_use", "name": "Bash", "input": {"z": r.randrange(9), "a": f"ls {depth}"}})
        elif kind == 5:
            out.append({"type": "tool_result", "tool_use_id": "t", "content": [{"text": f"r{depth}"}, "s"]})
        elif kind == 6:
            out.append(r.choice([{"text": ""}, {"content": ""}, {"content": []}, "bare", 5, None, {"content": None}, {"text": 3, "content": [{"text": "under a number"}]}, {"content": [1, "x"]}]))
        else:
            out.append(r.choice([{"type": "text", "text": f"text {depth} {r.randrange(99)}"}, {"content": f"content {depth}"}]))
    return out


def plain(part):
    """Text of a part without calls and results: what leaves give."""
    if not isinstance(part, dict) or part.get("type") in ("tool_use", "tool_result"):
        return []
    for n in ("text", "content"):
        if isinstance(part.get(n), str):
            return [part[n]] if part[n] else []
    if isinstance(part.get("content"), list):
        return [t for p in part["content"] for t in plain(p)]
    return []


def evidence(part):
    if isinstance(part, dict) and part.get("type") == "tool_use":
        return ["@@tool"]
    if isinstance(part, dict) and part.get("type") == "tool_result":
        told = "\n".join(p if isinstance(p, str) else p["text"] for p in part["content"])
        return [f"[tool_result]\n{told}"]
    if isinstance(part, dict) and not any(isinstance(part.get(n), str) for n in ("text", "content")) and isinstance(part.get("content"), list):
        return [t for p in part["content"] for t in evidence(p)]
    return plain(part)


@pytest.fixture(scope="module")
def records():
    r = random.Random(3)
    return [{"type": "user", "message": {"role": "user", "content": nested(r, i % 7)}} for i in range(120)]


def test_leaves_of_any_depth(spark, records):
    deep = {"text": "bottom"}
    for i in range(300):
        deep = {"content": [deep, {"text": f"after {i}"}] if i % 50 == 0 else [deep]}
    rows = [*records, {"message": {"content": [deep, {"text": "last"}]}}, {"message": {"content": []}}, {"message": {}}, {"message": {"content": "string"}}]
    df = spark.createDataFrame([(i, json.dumps(x)) for i, x in enumerate(rows)], "i int, raw string").withColumn("record", F.try_parse_json("raw"))
    got = {x.i: x for x in df.select("i", transcripts.leaves(transcripts.message_parts(F.col("record")))["path"].alias("paths"), transcripts.joined_text(transcripts.leaves(transcripts.message_parts(F.col("record")))).alias("t")).collect()}
    for i, x in enumerate(rows):
        content = x["message"].get("content")
        assert got[i].t == "\n\n".join(t for p in (content if isinstance(content, list) else []) for t in plain(p))
    assert got[len(records)].paths[0] == "[0]" + ".content[0]" * 300 and got[len(records)].t.startswith("bottom\n\nafter 0\n\nafter 50")


def test_citable_records_keep_deep_text_and_calls(spark, records):
    lines = spark.createDataFrame([("s", i, json.dumps(x)) for i, x in enumerate(records)], "session_id string, ord int, raw string")
    want = ["\n\n".join(t for p in x["message"]["content"] for t in evidence(p)) for x in records]
    e = tools.with_evidence_text(transcripts.numbered(lines), "text").orderBy("line").collect()
    for x, w in zip(e, want, strict=True):
        calls = [t for t in x.text.split("\n\n") if t.startswith("@@tool")]
        assert "\n\n".join("@@tool" if t.startswith("@@tool") else t for t in x.text.split("\n\n")) == w
        assert all('"z": ' in c and c.index('"z": ') < c.index('"a": ') for c in calls)  # the input's keys keep their order
    assert tools.citable(lines).count() == sum(w != "" for w in want) < len(want)


def walk(value, out):
    if isinstance(value, list):
        for x in value:
            walk(x, out)
    elif isinstance(value, dict):
        if isinstance(value.get("source_spans"), list):
            out += [(int(s["start_line"]), int(s["end_line"])) for s in value["source_spans"] if isinstance(s, dict) and all(isinstance(s.get(n), (int, float)) and not isinstance(s.get(n), bool) and s[n] == int(s[n]) for n in ("start_line", "end_line"))]
        for x in value.values():
            walk(x, out)
    return out


def state(r, depth):
    if not depth or r.random() < 0.2:
        return r.choice([1, "x", None, True, [], {}])
    span = lambda: r.choice([{"start_line": r.randrange(9), "end_line": r.randrange(9)}, {"start_line": 1.5, "end_line": 2}, {"start_line": "1", "end_line": 2}, {"start_line": 2.0, "end_line": 3}, {"start_line": True, "end_line": 1}, 7, {"end_line": 1}])
    if r.random() < 0.4:
        return [state(r, depth - 1) for _ in range(r.randrange(4))]
    out = {f"k{i}": state(r, depth - 1) for i in range(r.randrange(4))}
    if r.random() < 0.6:
        out["source_spans"] = r.choice([[span() for _ in range(r.randrange(4))], [span(), {"inner": {"source_spans": [span()]}}], "none", None, {"source_spans": [span()]}])
    return out


def test_spans_from_any_place_of_a_state(spark):
    r = random.Random(8)
    states = [state(r, 7) for _ in range(150)] + [None, [], {"a": 1}]
    deep = {"source_spans": [{"start_line": 1, "end_line": 2}]}
    for _ in range(200):
        deep = {"x": [deep]}
    states.append(deep)
    df = spark.createDataFrame([(str(i), json.dumps(s)) for i, s in enumerate(states)] + [("broken", "{"), ("null", None)], "session_id string, state string")
    got = sorted((x.session_id, x.start_line, x.end_line) for x in scoring.state_spans(df).collect())
    assert got == sorted((str(i), a, b) for i, s in enumerate(states) for a, b in walk(s, [])) and len(got) > 100
    assert ("153", 1, 2) in got
