"""Reports as markdown: statistics of renderers, scores of runs, and the tables they are made of.

All tables are of report size: groups, top lists, runs; each is one row of text in the end.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import cell, tokens
from tessera.operators import stats

#: Headings of the score table, and how its columns are aligned.
SCORE_HEADS = ["Run", "Score", "Gate", "Tokens", "Evidence", "Cited Lines", "User Events", "Rules", "Plans", "Promises", "Missing Literals", "Bad Hashes"]
SCORE_ALIGN = "|---|---:|---|" + "---:|" * 9
MOST = 15


def thousands(x: Column) -> Column:
    return F.format_number(x.cast("double"), 0)


def table(df: DataFrame, columns: dict[str, Column], order: list[Column], name: str = "t") -> DataFrame:
    """(name, text): one row with the table as markdown."""
    cells = F.concat(F.lit("| "), F.concat_ws(" | ", *(cell(F.coalesce(x.cast("string"), F.lit(""))) for x in columns.values())), F.lit(" |"))
    rows = df.select(F.row_number().over(Window.orderBy(*order)).alias("n"), cells.alias("row"))
    head = "| " + " | ".join(columns) + " |\n|" + " --- |" * len(columns)
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "row"))), lambda s: F.concat(F.lit("\n"), s["row"])), "")
    return rows.agg(F.concat(F.lit(head), body).alias("text")).select(F.lit(name).alias("name"), "text")


def sections(parts: list[tuple[str, DataFrame]]) -> DataFrame:
    """(name, text): titled tables one after the other, parted by blank lines."""
    out = None
    for i, (title, df) in enumerate(parts):
        df = df.select(F.lit(i).alias("i"), F.concat(F.lit(f"{title}\n\n"), "text").alias("text"))
        out = df if out is None else out.union(df)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "text"))), lambda s: s["text"]), "\n\n")
    return out.agg(joined.alias("text"))


def block_facts(facts: DataFrame, blocks: DataFrame) -> DataFrame:
    """(type, block_type, line, session_id, raw_chars, prompt_chars) of every content block; a record without one counts once, as such."""
    have = facts.select("session_id", "line", "type").join(blocks.select("session_id", "line", F.col("type").alias("block_type"), F.length("raw").alias("raw_chars"), F.length("prompt").alias("prompt_chars")), ["session_id", "line"], "left")
    return have.select("session_id", "line", "type", F.coalesce("block_type", F.lit("(no content block)")).alias("block_type"), F.coalesce("raw_chars", F.lit(0)).cast("long").alias("raw_chars"), F.coalesce("prompt_chars", F.lit(0)).cast("long").alias("prompt_chars"))


def by_block_type(facts: DataFrame) -> DataFrame:
    """By block type: records that have it, blocks, characters."""
    return facts.groupBy("block_type").agg(F.count_distinct("session_id", "line").alias("records"), F.count(F.lit(1)).alias("blocks"), F.sum("raw_chars").alias("raw_chars"), F.sum("prompt_chars").alias("prompt_chars"))


def by_record_block(facts: DataFrame, most: int = 30) -> DataFrame:
    """By record type and block type, the largest first."""
    out = facts.groupBy(F.concat_ws(" / ", "type", "block_type").alias("key")).agg(F.count(F.lit(1)).alias("blocks"), F.sum("raw_chars").alias("raw_chars"), F.sum("prompt_chars").alias("prompt_chars"))
    return out.orderBy(F.col("prompt_chars").desc(), F.col("blocks").desc(), "key").limit(most)


def renderer_report(facts: DataFrame, blocks: DataFrame) -> DataFrame:
    """(text): the statistics of one renderer's records as markdown.

    facts: session_id, line, type, role, kind, hash, preview, compressed, original_chars, omitted_chars and the measures of
    stats.measured; blocks: transcripts.blocks.
    """
    c = F.col
    groups = stats.by_each(facts, ["type", "role", "kind"])
    largest = [c("rendered_bytes").desc(), c("prompt_chars").desc(), c("records").desc(), c("key")]
    shown = lambda first: {first: c("key"), "Records": thousands(c("records")), "Raw bytes": thousands(c("raw_bytes")), "Prompt chars": thousands(c("prompt_chars")), "Rendered bytes": thousands(c("rendered_bytes")), "Max rendered line": c("max_line")}
    group = lambda name, first: table(groups.where(c("grouping") == name), shown(first), largest)
    of = block_facts(facts, blocks)
    omitted = facts.where("compressed")
    total = facts.agg(F.count(F.lit(1)).alias("n"), F.sum("raw_bytes").alias("b"), F.sum("rendered_chars").alias("r"), F.count_if("compressed").alias("k"), F.coalesce(F.sum("omitted_chars"), F.lit(0)).alias("o"))
    tops = lambda by, extra: table(stats.top(facts, by, MOST), {"Line": c("line"), "Type": c("type"), "Role": c("role"), "Kind": c("kind"), **extra, "Hash": F.left("hash", F.lit(12)), "Preview": F.left("preview", F.lit(140))}, [c(by).desc(), c("session_id"), c("line")])
    return sections([
        ("# Renderer Stats Report\n\n## Renderer Comparison", table(total, {"Records": thousands(c("n")), "Raw bytes": thousands(c("b")), "Rendered char/4 tokens": thousands(tokens(c("r"))), "Compressed records": thousands(c("k")), "Omitted chars": thousands(c("o"))}, [c("n")])),
        ("## Record Types", group("type", "Type")), ("## Roles", group("role", "Role")), ("## Derived Record Kinds", group("kind", "Kind")),
        ("## Content Block Types", table(by_block_type(of), {"Block type": c("block_type"), "Records containing": thousands(c("records")), "Blocks": thousands(c("blocks")), "Raw chars": thousands(c("raw_chars")), "Prompt-visible chars": thousands(c("prompt_chars"))}, [c("prompt_chars").desc(), c("blocks").desc(), c("block_type")])),
        ("## Record Type x Block Type", table(by_record_block(of), {"Record / block": c("key"), "Blocks": thousands(c("blocks")), "Raw chars": thousands(c("raw_chars")), "Prompt-visible chars": thousands(c("prompt_chars"))}, [c("prompt_chars").desc(), c("blocks").desc(), c("key")])),
        ("### Largest Omitted Tool Outputs", table(stats.top(omitted, "omitted_chars", MOST), {"Line": c("line"), "Type": c("type"), "Role": c("role"), "Omitted chars": thousands(c("omitted_chars")), "Original chars": thousands(c("original_chars")), "Hash": F.left("hash", F.lit(12)), "Preview": F.left("preview", F.lit(140))}, [c("omitted_chars").desc(), c("session_id"), c("line")])),
        ("## Largest Rendered Records", tops("rendered_bytes", {"Rendered bytes": thousands(c("rendered_bytes")), "Raw bytes": thousands(c("raw_bytes"))})),
        ("## Largest Raw Records", tops("raw_bytes", {"Raw bytes": thousands(c("raw_bytes")), "Rendered bytes": thousands(c("rendered_bytes"))})),
    ])


def score_table(scores: DataFrame) -> DataFrame:
    """(markdown): scores (run_id, score, gate_pass, and counts) as a table, by run."""
    s = lambda n: F.coalesce(F.col(n).cast("string"), F.lit("0"))
    cells = [F.col("run_id"), F.concat(s("score"), F.lit("/100")), F.when(F.col("gate_pass"), "pass").otherwise("fail"), *(s(n) for n in ("after_tokens", "capsules", "unique_lines", "intents", "rules", "plans", "promises", "missing", "bad_hashes"))]
    row = F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |\n"))
    head = "# Deterministic Compaction Score\n\n| " + " | ".join(SCORE_HEADS) + " |\n" + SCORE_ALIGN + "\n"
    rows = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("run_id", row.alias("row")))), lambda x: x["row"]), "")
    return scores.agg(F.concat(F.lit(head), rows).alias("markdown"))


def lane_suite(single: DataFrame, repeated: DataFrame, suite: str) -> DataFrame:
    """The lanes of a suite: single-shot, until-pass, or all of both."""
    suites = {"single-shot": [single], "until-pass": [repeated], "all": [single, repeated]}
    if suite not in suites:
        raise ValueError(f"unknown suite {suite!r}")
    first, *rest = suites[suite]
    for df in rest:
        first = first.unionByName(df)
    return first


def judge_schema(criteria: list[str], rubric: str = "", hashes: dict[str, str] | None = None) -> dict:
    """JSON schema of a judge's output for one candidate; known values are the only ones allowed."""
    text = lambda v="": {"type": "string", "enum": [v]} if v else {"type": "string"}
    closed = lambda **p: {"type": "object", "additionalProperties": False, "required": list(p), "properties": p}
    listed = {"type": "array", "items": {"type": "string"}}
    names = ["handoff_md_sha256", "rehydrated_md_sha256", "state_sha256"]
    verdict = closed(criterion={"type": "string", "enum": criteria}, evidence_quote=text(), reason=text(), level={"type": "string", "enum": ["absent", "partial", "clear"]}, evidence_refs=listed)
    return closed(
        schema=text("semantic-compaction-judge-output.v3"), rubric_version=text(rubric), candidate_hashes=closed(**{n: text((hashes or {}).get(n, "")) for n in names}),
        total_level_score={"type": "integer", "minimum": 0, "maximum": 2 * len(criteria)}, overall_pass={"type": "boolean"},
        dimensions={"type": "array", "minItems": len(criteria), "maxItems": len(criteria), "items": verdict}, unknowns=listed, evidence_refs=listed,
    )


def document_checks(documents: DataFrame, checks: dict[str, list[str]]) -> DataFrame:
    """(doc, check, passed) of documents (doc, content): a check passes where one line matches all of its patterns.

    A null or empty document passes only what an empty line matches; checks come in their given order within a document.
    """
    lines = F.split(F.coalesce("content", F.lit("")), "\n")
    every = lambda patterns: lambda line: reduce(and_, (line.rlike(p) for p in patterns))
    told = F.array(*(F.struct(F.lit(name).alias("check"), F.exists(lines, every(patterns)).alias("passed")) for name, patterns in checks.items()))
    return documents.select("doc", F.explode(told).alias("c")).select("doc", "c.check", "c.passed")
