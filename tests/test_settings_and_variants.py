"""Settings with their checks, and perturbed handoffs against plain Python."""

import re

import pytest
from pyspark.sql import functions as F

from tessera.operators import perturb
from tessera.plans import settings as S

HANDOFF = """# Handoff

- work
## Next Step
- run it


## Rules And Invariants
- never push
## Open Constraints
- keep it
## Active files
- a.py
## Artifacts
- m
## Artifacts of others
- see `src/x` or `plain` and main.rs
- [pending] a
- [In Progress] b
- [done] c
text"""


def drop(text, heading):
    ls = text.split("\n")
    start = next((i for i, x in enumerate(ls) if (m := re.match(r"^## (.+)$", x)) and re.search(heading, m[1], re.I)), None)
    if start is None:
        return text
    end = next((i for i in range(start + 1, len(ls)) if ls[i].startswith("## ")), len(ls))
    return "\n".join(ls[:start] + ls[end:])


def plain(t, path, wrong):
    tidy = lambda x: re.sub(r"\n{3,}", "\n\n", x)
    bare = t
    for h in (r"active.*(?:file|workspace)", "workspace structure", "^artifacts?$", "evidence index"):
        bare = drop(bare, h)
    end = r"\.(?:py|mjs|js|md|json|proto|bin|toml|ya?ml|sh|rs|txt)\b"
    bare = re.sub(r"`[^`]*`", lambda m: "(omitted)" if re.search(rf"/|{end}", m[0]) else m[0], bare)
    bare = re.sub(rf"(?im)^.*(?:/[\w.-]+|\b[\w-]+{end}).*$", "", bare)
    ls = t.split("\n")
    at = next((i + 1 for i, x in enumerate(ls) if x.startswith("# ")), 0)
    return {
        "clean": t, "drop_next_action": tidy(re.sub(r"(?im)^.*\[(?:pending|todo|in[_ -]?progress|open|active|[ ])\].*$", "", drop(t, "next step|unresolved|next action"))),
        "drop_rules": drop(drop(t, "rules|invariants"), "constraint"), "strip_artifacts": bare, "inject_overstatement": "\n".join([*ls[:at], "", f"- {perturb.OVERSTATED}", *ls[at:]]),
        "factual_drift": t.replace(path, wrong), "reformat_headers": tidy(re.sub(r"(?m)^## (.+)$", r"=== \1 ===", t)), "bullet_restyle": re.sub(r"(?m)^- ", "* ", t),
    }


def test_variants_match_plain_python(spark):
    texts = [HANDOFF, "", "no title\n## Unresolved", "x\n# Late title\nrest", "## Next action now\n- a\n## Rules\n", "## \n- [ ] open", "# T", "plain /a/b\nkeep"]
    df = spark.createDataFrame(list(enumerate(texts)), "run_id int, handoff string")
    got = {(r.run_id, r.variant): r for r in perturb.variants(df, F.lit("main.rs"), F.lit("wrong.rs")).collect()}
    for i, t in enumerate(texts):
        for name, want in plain(t, "main.rs", "wrong.rs").items():
            assert got[i, name].text == want, (i, name)
            assert got[i, name].applied == (name == "clean" or want != t)
    assert got[0, "factual_drift"].applied and not got[1, "drop_rules"].applied


def test_discrimination(spark):
    v = perturb.variants(spark.createDataFrame([("r", HANDOFF)], "run_id string, handoff string"), F.lit("main.rs"), F.lit("wrong.rs"))
    level = {"clean": (2, 2), "drop_next_action": (0, 2), "drop_rules": (2, 2), "bullet_restyle": (2, 2), "reformat_headers": (2, 1)}
    rows = [("r", n, c, x) for n, xs in level.items() for c, x in zip(("next_step_actionability", "faithfulness"), xs, strict=True)]
    got = {r.variant: r for r in perturb.discrimination(spark.createDataFrame(rows, "run_id string, variant string, criterion string, value int"), v).collect()}
    assert set(got) == set(level) - {"clean"}
    assert (got["drop_next_action"].delta, got["drop_next_action"].dropped, got["drop_next_action"].as_expected, got["drop_next_action"].right) == (-2, ["next_step_actionability"], True, True)
    assert not got["drop_rules"].right and got["bullet_restyle"].right and not got["reformat_headers"].right


def test_settings_and_what_follows_from_them(spark):
    s = S.settings()
    assert (s["reask.most"], s["temperature"], s["prompt.adapt"], s["call.after"], s["renderer"]) == (0, None, False, 64, "onto")
    lite = S.settings({"model": "Gemini-3.1-Flash-Lite", "provider": "gemini", "output.after": 5})
    assert (lite["reask.until-pass"], lite["reask.most"], lite["temperature"], lite["prompt.adapt"], lite["call.after"]) == (True, 10, 0.4, True, 5)
    own = S.settings({"model": "x-flash-lite", "reask.until-pass": False, "temperature": 0, "call.after": 1})
    assert (own["reask.most"], own["temperature"], own["call.after"]) == (0, 0.0, 1)
    assert S.settings({"reask.until-pass": True, "provider": "codex"})["prompt.adapt"] is False and S.settings({"reask.most": 3})["reask.most"] == 3
    assert S.settings({"stats.renderers": "onto, jsonl,"})["stats.renderers"] == ["onto", "jsonl"]
    spark.conf.set("tessera.density.cited", "7")
    try:
        assert S.density(S.settings(spark=spark)) == {"capsules": 30, "cited": 7, "promises": 0} and S.settings({"density.cited": 8}, spark)["density.cited"] == 8
    finally:
        spark.conf.unset("tessera.density.cited")
    assert S.ledger_budget(s) == {"most": 64, "most_tokens": 8000, "most_lines": 300}


@pytest.mark.parametrize(("key", "value"), [("tail.records", -1), ("tail.records", "many"), ("tail.records", 1.5), ("temperature", "hot"), ("temperature", "nan"), ("dspc.keep", "inf"), ("renderer", "xml"), ("stats.renderers", "onto,xml"), ("output.strategy", "zip"), ("prompt.adapt", "maybe"), ("density.cites", 3)])
def test_settings_out_of_range_name_their_key(key, value):
    with pytest.raises(S.SettingError, match=re.escape(key)):
        S.settings({key: value})
