"""Literals worth keeping: paths, commands, identifiers, concepts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.text import bound, compact, first_distinct, trim_ws, word

#: Tools that begin commands, script endings, project folders, stop words.
TOOLS = "npm|pnpm|yarn|bun|node|python3?|pytest|cargo|go|just|make|bash|sh|git|npx|uv|ruff|biome|tsc|vitest|jest|wrangler|claude"
RUNNERS = "npm|pnpm|yarn|bun|node|python3?|pytest|cargo|go|just|make|bash|sh|npx|uv"
ENDINGS = "sh|mjs|js|ts|py|rb|go|rs"
FOLDERS = r"scripts|src|test|tests|docs|runs|transcripts|references|plugins|packages|apps|\.agents|\.github"
STOP = "the and for with from that this into after current summary state".split()

#: What paths, scripts and commands that test look like, and the words of errors and of solving.
PATH = r"""(?:^|[\s("'`])((?:/[A-Za-z0-9._~+@:%-]+)+|(?:[A-Za-z0-9_.-]+/)+[A-Za-z0-9_.@:%+-]+)(?=$|[\s)"'`,;:])"""
PICKUP_PATH = rf"""(?:^|[\s("'`])((?:/[A-Za-z0-9._~+@:%-]+)+|(?:\.{{1,2}}/[A-Za-z0-9._~+@:%/-]+)|(?:(?:{FOLDERS})/[A-Za-z0-9._~+@:%/-]+))(?=$|[\s)"'`,;:])"""
SCRIPT = rf"(?:\.{{0,2}}/|[A-Za-z0-9_.-]+/)[A-Za-z0-9_./:@%+-]+\.(?:{ENDINGS})(?![A-Za-z0-9_])"
TEST_COMMAND = rf"(?i)(?<![A-Za-z0-9_])(?:{RUNNERS})\s+[^\n.;]*(?:test|check|lint|verify|gate|pytest|vitest|jest|cargo test)[^\n.;]*"
#: Patterns, captured group and cap of the evidence groups, in order.
EVIDENCE = [
    (r"(?m)^-\s+`((?:\\`|[^`]){2,220})`", 1, 128),
    (r"(?<![A-Za-z0-9_])(?:uv run|uv sync|python3?|\.venv/bin/python)[^\n`\"]{0,140}", 0, 24),
    (r"(?<![A-Za-z0-9_])[A-Z][A-Z0-9_]{2,}(?![A-Za-z0-9_])", 0, 28),
    (r"(?<![A-Za-z0-9_])[a-z]+/[a-z0-9.+-]+(?![A-Za-z0-9_])", 0, 16),
    (r"(?m)^@@file ([^\n]+)$", 1, 48),
    (PATH, 1, 48),
    (r"`([^`\n]{2,180})`", 1, 32),
    (r"(?<![A-Za-z0-9_])[a-z][a-z0-9_-]{6,}(?![A-Za-z0-9_])", 0, 24),
]


ERRORS = "error|failed|failure|bug|fix|fixed|blocked|exception|regression|root cause"
SOLVING = "decision|because|root cause|discovered|verified|implemented|active|pending|blocked|next"
#: Characters of text around a path.
AROUND = 240


def all_of(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(group))


def paths(text: Column, most: int = 20) -> Column:
    """Paths in order of first appearance."""
    return F.slice(F.array_distinct(all_of(text, PATH, 1)), 1, most)


def paths_of(texts: Column, most: int = 20) -> Column:
    """array<struct<path,context>>: paths of an array of texts by first appearance, each with its text's first characters."""
    each = F.flatten(F.transform(texts, lambda t: F.transform(F.array_distinct(all_of(t, PATH, 1)), lambda p: F.struct(p.alias("path"), F.left(compact(t), F.lit(AROUND)).alias("context")))))
    names = F.transform(each, lambda x: x["path"])
    first = F.filter(each, lambda x, i: F.array_position(names, x["path"]) == i + 1)
    return F.slice(first, 1, most)


def _named(text: Column) -> Column:
    """Backticked spans, then identifier-like tokens, of one text."""
    inline = all_of(text, r"`([^`\n]{2,80})`", 1)
    tokens = all_of(text, r"(?<![A-Za-z0-9_])[A-Za-z][A-Za-z0-9_.:/-]{2,}(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])", 0)
    return F.concat(inline, F.filter(tokens, lambda t: ~F.lower(t).isin(*STOP) & (t.rlike("[A-Z0-9_./:-]") | (F.length(t) >= 10))))


def concepts(text: Column, most: int = 16) -> Column:
    return first_distinct(_named(text), most)


def concepts_of(texts: Column, most: int = 16) -> Column:
    """Concepts of an array of texts, text by text."""
    return first_distinct(F.flatten(F.transform(texts, _named)), most)


def literal(x: Column, longest: int = 180) -> Column:
    return trim_ws(F.left(compact(x), F.lit(longest)))


def evidence(texts: Column, most: int = 128) -> Column:
    """Literals of all groups within each group's cap, distinct, in group order; texts: one string."""
    out = []
    for i, (pattern, group, cap) in enumerate(EVIDENCE):
        found = F.filter(F.transform(all_of(texts, pattern, group), lambda t: literal(t)), lambda t: F.length(t) >= 2)
        found = F.array_distinct(found)
        if i == 5:  # absolute ones first, then longer ones
            keyed = F.transform(found, lambda t: F.struct((~t.startswith("/")).alias("a"), (-F.length(t)).alias("b"), t.alias("t")))
            found = F.transform(F.array_sort(keyed), lambda s: s["t"])
        out.append(F.slice(found, 1, cap))
    return F.slice(F.array_distinct(F.concat(*out)), 1, most)


def clean_command(x: Column) -> Column:
    """Without one pair of enclosing marks and a full stop at the end."""

    def opened(t: Column) -> Column:
        enclosed = t.rlike(r"(?s)\A(?:`.*`|\".*\"|'.*'|\(.*\))\z") & (F.length(t) > 1)
        return F.when(enclosed, trim_ws(F.substring(t, F.lit(2), F.length(t) - 2))).otherwise(t)

    t = bound(trim_ws(F.coalesce(x, F.lit(""))), opened)
    return trim_ws(F.regexp_replace(t, r"[.。]\s*\z", ""))


def is_command(x: Column) -> Column:
    def known(t: Column) -> Column:
        named = t.rlike(rf"^(?:{TOOLS})(?![A-Za-z0-9_])") | t.rlike(f"^{SCRIPT}")
        return (t != "") & (F.length(t) <= 400) & ~t.rlike(r"^[^\s]+:\s+") & named

    return bound(clean_command(x), known)


def is_path(x: Column) -> Column:
    def known(t: Column) -> Column:
        shaped = t.rlike(r"^(?:/|\.{1,2}/)") | t.rlike(rf"^(?:{FOLDERS})/") | t.rlike(r"/[^/\s]+\.[A-Za-z0-9]{1,8}$")
        return (t != "") & (F.length(t) <= 240) & ~t.rlike("^https?://") & shaped

    return bound(clean_command(x), known)


def is_nothing(x: Column) -> Column:
    """Values that say there is nothing to pick up."""
    return compact(x).rlike(r"(?i)^(?:none|n/a|null|no action|not required)(?![A-Za-z0-9_]).*$")


def next_command(texts: Column, prior: Column) -> Column:
    """prior if it is a command, else the first command the texts name; empty if there is none."""

    def offered(t: Column) -> Column:
        colon = F.when(F.instr(t, ":") > 0, F.array(F.substring(t, F.instr(t, ":") + 1, F.length(t)))).otherwise(F.array().cast("array<string>"))
        first = lambda pattern, group: F.array(F.regexp_extract(F.coalesce(t, F.lit("")), pattern, group))  # empty where there is none, which is no command
        return F.concat(all_of(t, r"`([^`\n]{2,400})`", 1), colon, first(rf"(?<![A-Za-z0-9_])(?:{TOOLS})\s+[^\n;]{{1,360}}", 0), first(rf"(?:^|[\s:`])({SCRIPT}[^\n;]{{0,320}})", 1))

    found = F.filter(F.flatten(F.transform(texts, offered)), is_command)
    return F.when(is_command(prior), clean_command(prior)).otherwise(clean_command(F.get(found, F.lit(0))))


def pickup_files(texts: Column, given: Column, most: int = 12) -> Column:
    found = F.filter(F.flatten(F.transform(texts, lambda t: all_of(t, PICKUP_PATH, 1))), is_path)
    return first_distinct(F.concat(given, found), most)


def test_commands(texts: Column, given: Column, most: int = 12) -> Column:
    return first_distinct(F.concat(given, F.flatten(F.transform(texts, lambda t: all_of(t, TEST_COMMAND, 0)))), most)


def legacy_arrays(texts: Column, plans: Column, current: Column, following: Column) -> dict[str, Column]:
    """The six derived arrays; plans: array of struct(item, status)."""
    active = F.transform(F.filter(plans, lambda p: p["status"].isin("active", "pending", "blocked")), lambda p: p["item"])
    items = F.transform(plans, lambda p: p["item"])
    errors = F.filter(texts, lambda t: t.rlike("(?i)" + word(ERRORS)))
    solving = F.filter(texts, lambda t: t.rlike("(?i)" + word(SOLVING)))
    return {
        "primary_request_and_intent": first_distinct(F.concat(F.array(current), active, F.array(following)), 8),
        "key_technical_concepts": concepts_of(texts),
        "files_and_code_sections": paths_of(texts),
        "errors_and_fixes": first_distinct(errors, 12),
        "problem_solving": first_distinct(F.concat(solving, items), 12),
        "pending_tasks": first_distinct(F.concat(active, F.array(following)), 12),
    }
