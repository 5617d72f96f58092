"""The report of a renderer against plain Python; checks of documents."""

import pytest
from pyspark.sql import functions as F

from tessera.operators import reports, stats

FACT = "session_id string, line int, type string, role string, kind string, hash string, preview string, compressed boolean, original_chars bigint, omitted_chars bigint, raw string, body string, rendered string"


def facts(n):
    out = []
    for i in range(n):
        cut = i % 5 == 2
        raw = "é|" * (i * 7 % 23 + 1)
        kind = ["user_message", "tool_output", "metadata"][i % 3]
        out.append((f"s{i % 2}", i // 2 + 1, ["user", "assistant", None][i % 3], ["user", "(none)"][i % 2], kind, f"{i:064x}"[::-1], f"p|{i}\r\nrest " + "x" * 150, cut, 900 + i if cut else None, 40 + i % 3 if cut else None, raw, raw[: i % 9], "" if i == 4 else f"[{raw}]" * 100))
    return out


def blocks(rows):
    return [(s, line, b, t, "r" * (line * 3 + b), "p" * (line * 1200 + b)) for s, line, *_ in rows if line % 4 for b, t in enumerate(["text", "tool_use", "text"][: line % 3 + 1])]


def table(heads, rows):
    cell = lambda x: ("" if x is None else str(x)).replace("|", "\\|").replace("\r\n", " ").replace("\n", " ")
    return "| " + " | ".join(heads) + " |\n|" + " --- |" * len(heads) + "".join("\n| " + " | ".join(map(cell, r)) + " |" for r in rows)


def expected(rows, parts):
    n = lambda x: f"{x:,}"
    named = [dict(zip([c.split()[0] for c in FACT.split(", ")], r, strict=True)) for r in rows]
    for r in named:
        r |= {"rb": len(r["raw"].encode()), "p": len(r["body"]), "rc": len(r["rendered"]), "b": len(r["rendered"].encode())}

    def groups(key, head):
        by = {}
        for r in named:
            by.setdefault(r[key], []).append(r)
        out = []
        for k, rs in by.items():
            some = [r for r in rs if r["rc"]]
            longest = min((-r["rc"], r["line"]) for r in some)[1] if some else None
            out.append((k, len(rs), sum(r["rb"] for r in rs), sum(r["p"] for r in rs), sum(r["b"] for r in rs), longest))
        out.sort(key=lambda g: (-g[4], -g[3], -g[1], g[0] or ""))
        return table([head, "Records", "Raw bytes", "Prompt chars", "Rendered bytes", "Max rendered line"], [(k, n(c), n(rb), n(p), n(b), m) for k, c, rb, p, b, m in out])

    of = {}
    for s, line, _, t, raw, prompt in parts:
        of.setdefault((s, line), []).append((t, len(raw), len(prompt)))
    flat = [(r, *x) for r in named for x in of.get((r["session_id"], r["line"]), [("(no content block)", 0, 0)])]

    def sums(key):
        by = {}
        for r, *x in flat:
            g = by.setdefault(key(r, x[0]), [set(), 0, 0, 0])
            g[0].add((r["session_id"], r["line"]))
            g[1], g[2], g[3] = g[1] + 1, g[2] + x[1], g[3] + x[2]
        return sorted(by.items(), key=lambda g: (-g[1][3], -g[1][1], g[0]))

    def top(by, some, extra):
        mine = sorted((r for r in some), key=lambda r: (-r[by], r["session_id"], r["line"]))[: reports.MOST]
        return table(["Line", "Type", "Role", "Kind", *extra, "Hash", "Preview"] if by != "omitted_chars" else ["Line", "Type", "Role", *extra, "Hash", "Preview"], [(r["line"], r["type"], r["role"], *([r["kind"]] if by != "omitted_chars" else []), *(n(r[x]) for x in extra.values()), r["hash"][:12], r["preview"][:140]) for r in mine])

    cut = [r for r in named if r["compressed"]]
    pair = sums(lambda r, t: " / ".join(x for x in (r["type"], t) if x is not None))[:30]
    return "\n\n".join([
        "# Renderer Stats Report", "## Renderer Comparison", table(["Records", "Raw bytes", "Rendered char/4 tokens", "Compressed records", "Omitted chars"], [(n(len(rows)), n(sum(r["rb"] for r in named)), n(-(-sum(r["rc"] for r in named) // 4)), n(len(cut)), n(sum(r["omitted_chars"] for r in cut)))]),
        "## Record Types", groups("type", "Type"), "## Roles", groups("role", "Role"), "## Derived Record Kinds", groups("kind", "Kind"),
        "## Content Block Types", table(["Block type", "Records containing", "Blocks", "Raw chars", "Prompt-visible chars"], [(k, n(len(g[0])), n(g[1]), n(g[2]), n(g[3])) for k, g in sums(lambda r, t: t)]),
        "## Record Type x Block Type", table(["Record / block", "Blocks", "Raw chars", "Prompt-visible chars"], [(k, n(g[1]), n(g[2]), n(g[3])) for k, g in pair]),
        "### Largest Omitted Tool Outputs", top("omitted_chars", cut, {"Omitted chars": "omitted_chars", "Original chars": "original_chars"}),
        "## Largest Rendered Records", top("b", named, {"Rendered bytes": "b", "Raw bytes": "rb"}), "## Largest Raw Records", top("rb", named, {"Raw bytes": "rb", "Rendered bytes": "b"}),
    ])


@pytest.mark.parametrize("n", [1, 61])
def test_report_equals_plain_python(spark, n):
    rows = facts(n)
    parts = blocks(rows)
    df = stats.measured(spark.createDataFrame(rows, FACT).repartition(3), "raw", "body", "rendered")
    of = spark.createDataFrame(parts, "session_id string, line int, block int, type string, raw string, prompt string")
    got = reports.renderer_report(df, of).first().text
    assert got.split("\n") == expected(rows, parts).split("\n")


def test_checks_ask_for_one_line_that_has_it_all(spark):
    docs = spark.createDataFrame([(1, "a year 2024\nand more"), (2, "a year\n2024"), (3, ""), (4, None), (5, "2024 year\n\nend")], "doc int, content string")
    checks = {"dated": ["year", "[0-9]{4}"], "blank": ["^$"]}
    got = [tuple(r) for r in reports.document_checks(docs, checks).collect()]
    assert got == [(1, "dated", True), (1, "blank", False), (2, "dated", False), (2, "blank", False), (3, "dated", False), (3, "blank", True), (4, "dated", False), (4, "blank", True), (5, "dated", True), (5, "blank", True)]
    assert reports.document_checks(docs.where(F.lit(False)), checks).count() == 0
