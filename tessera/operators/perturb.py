"""Handoffs made worse, or only different, on purpose: whether a judge tells one from the other.

A variant that degrades must cost points against the handoff as it was, one that only looks different must not. Both are
column expressions over a handoff's text; a variant that changes nothing is not applicable.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import bound

#: Headings by what they hold, open tasks, and what names a file.
NEXT, RULES, CONSTRAINTS = "next step|unresolved|next action", "rules|invariants", "constraint"
LISTINGS = ["active.*(?:file|workspace)", "workspace structure", "^artifacts?$", "evidence index"]
OPEN_TASK = r"(?im)^.*\[(?:pending|todo|in[_ -]?progress|open|active|[ ])\].*$"
ENDING = r"\.(?:py|mjs|js|md|json|proto|bin|toml|ya?ml|sh|rs|txt)\b"
NAMES_A_FILE = rf"(?im)^.*(?:/[\w.-]+|\b[\w-]+{ENDING}).*$"
OVERSTATED = "All work is done and checked; nothing is pending, unresolved or left to follow up."


def without_section(text: Column, heading: str) -> Column:
    """text without the first section (from its ``## `` line to the next one) whose heading matches."""

    def rest(ls: Column, heads: Column) -> Column:
        """heads: (place, whether it matches) of all lines that are headings."""
        start = F.array_min(F.transform(F.filter(heads, lambda h: h["hit"]), lambda h: h["i"]))

        def kept(start: Column) -> Column:
            end = F.coalesce(F.array_min(F.transform(F.filter(heads, lambda h: h["i"] > start), lambda h: h["i"])), F.size(ls))
            return F.array_join(F.filter(ls, lambda x, i: (i < start) | (i >= end)), "\n")

        return bound(start, lambda s: F.when(s.isNull(), F.array_join(ls, "\n")).otherwise(kept(s)))

    def headings(ls: Column) -> Column:
        hit = lambda x: (F.length(x) > 3) & F.substring(x, 4, 1 << 30).rlike(f"(?i){heading}")
        return F.filter(F.transform(ls, lambda x, i: F.struct(i.alias("i"), x.startswith("## ").alias("head"), hit(x).alias("hit"))), lambda h: h["head"])

    return bound(F.split(text, "\n", -1), lambda ls: bound(headings(ls), lambda heads: rest(ls, heads)))


def without_open_tasks(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, OPEN_TASK, ""), r"\n{3,}", "\n\n")


def without_artifacts(text: Column) -> Column:
    """No listings of files, no code that names one, no line that does."""
    for heading in LISTINGS:
        text = without_section(text, heading)
    text = F.regexp_replace(text, rf"`[^`]*(?:/|{ENDING})[^`]*`", "(omitted)")
    return F.regexp_replace(text, NAMES_A_FILE, "")


def with_claim(text: Column, claim: str) -> Column:
    """A bullet below the title, or at the top where there is none."""
    bullet = F.lit(f"\n- {claim}")
    titled = F.regexp_replace(text, r"(?s)\A((?:(?!# )[^\n]*\n)*# [^\n]*)(.*)\z", "$1\x00$2")
    return F.when(F.contains(titled, F.lit("\x00")), F.replace(titled, F.lit("\x00"), F.concat(F.lit("\n"), bullet))).otherwise(F.concat(bullet, F.lit("\n"), text))


def perturbations(path: Column, wrong: Column) -> list[tuple[str, str, str | None, Callable[[Column], Column]]]:
    """(name, kind, criterion that must suffer, change); path and wrong: a real path of the handoff, and what to put for it."""
    return [
        ("clean", "baseline", None, lambda t: t),
        ("drop_next_action", "degrade", "next_step_actionability", lambda t: without_open_tasks(without_section(t, NEXT))),
        ("drop_rules", "degrade", "constraint_promise_preservation", lambda t: without_section(without_section(t, RULES), CONSTRAINTS)),
        ("strip_artifacts", "degrade", "state_artifact_recoverability", without_artifacts),
        ("inject_overstatement", "degrade", "faithfulness", lambda t: with_claim(t, OVERSTATED)),
        ("factual_drift", "degrade", "faithfulness", lambda t: F.replace(t, path, wrong)),
        ("reformat_headers", "preserve", None, lambda t: F.regexp_replace(F.regexp_replace(t, r"(?m)^## (.+)$", "=== $1 ==="), r"\n{3,}", "\n\n")),
        ("bullet_restyle", "preserve", None, lambda t: F.regexp_replace(t, r"(?m)^- ", "* ")),
    ]


def variants(handoffs: DataFrame, path: Column, wrong: Column) -> DataFrame:
    """(run_id, variant, kind, expect, applied, text) of handoffs (run_id, handoff, ...)."""
    t = F.col("handoff")
    rows = [F.struct(F.lit(n).alias("variant"), F.lit(k).alias("kind"), F.lit(e).alias("expect"), change(t).alias("text")) for n, k, e, change in perturbations(path, wrong)]
    out = handoffs.select("run_id", "handoff", F.explode(F.array(*rows)).alias("v")).select("run_id", "handoff", "v.*")
    return out.withColumn("applied", (F.col("variant") == "clean") | (F.col("text") != F.col("handoff"))).drop("handoff")


def discrimination(levels: DataFrame, variants: DataFrame) -> DataFrame:
    """How a judge took each applied variant: total, delta against the clean handoff, criteria that lost, and whether that is right.

    levels: (run_id, variant, criterion, value), a median level of each criterion.
    """
    clean = levels.where("variant = 'clean'").select("run_id", "criterion", F.col("value").alias("before"))
    met = levels.join(clean, ["run_id", "criterion"])
    by = met.groupBy("run_id", "variant").agg(F.sum("value").alias("total"), F.sum("before").alias("before"), F.array_sort(F.collect_list(F.when(F.col("value") < F.col("before"), F.col("criterion")))).alias("dropped"))  # a run's criteria
    out = variants.where("applied AND variant <> 'clean'").select("run_id", "variant", "kind", "expect").join(by, ["run_id", "variant"])
    right = F.when(F.col("kind") == "degrade", F.col("total") < F.col("before")).otherwise(F.col("total") >= F.col("before"))
    return out.select("run_id", "variant", "kind", "total", (F.col("total") - F.col("before")).alias("delta"), "dropped", F.array_contains("dropped", F.col("expect")).alias("as_expected"), right.alias("right"))
