"""Compression of stale bodies: head and tail, masks, collapsed messages, shortened edits.

Each operator maps columns to a struct of body, compressed, original_chars and omitted_chars.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.text import drop_newline_end, drop_newline_start, lit, sha256


def cut(text: Column, head: int, tail: int) -> tuple[Column, Column]:
    """The first ``head`` characters and the last ``tail`` of the rest."""
    n = F.length(text)
    start = F.greatest(n - tail, F.lit(head))
    return F.left(text, F.lit(head)), F.substring(text, start + 1, F.greatest(n - start, F.lit(0)))


def result(text: Column, when: Column, body: Column, omitted: Column) -> Column:
    return F.struct(
        F.when(when, body).otherwise(text).alias("body"), when.alias("compressed"),
        F.when(when, F.length(text)).cast("long").alias("original_chars"), F.when(when, omitted).cast("long").alias("omitted_chars"),
    )


def marker(label: str, text: Column, omitted: Column, line: Column, record_hash: Column, extra: str = "") -> Column:
    return F.concat(
        F.lit(f"[{label}{extra} original_chars="), F.length(text).cast("string"), F.lit(" omitted_chars="), omitted.cast("string"),
        F.lit(" line="), lit(line).cast("string"), F.lit(" body_sha256="), sha256(text), F.lit(" record_sha256="), lit(record_hash), F.lit("]"),
    )


def headtail(text: Column, line: Column, record_hash: Column, least: int = 2400, head: int = 900, tail: int = 500) -> Column:
    a, b = cut(text, head, tail)
    a, b = drop_newline_end(a), drop_newline_end(drop_newline_start(b))
    omitted = F.greatest(F.length(text) - F.length(a) - F.length(b), F.lit(0))
    body = F.concat_ws("\n", a, F.lit(""), marker("tool output compressed:", text, omitted, line, record_hash), F.lit(""), b)
    return result(text, F.length(text) > least, body, omitted)


def mask(text: Column, line: Column, record_hash: Column, least: int = 2400) -> Column:
    n = F.length(text)
    count = (n - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("string")
    body = F.concat(
        F.lit("[tool output masked: strategy=mask original_chars="), n.cast("string"), F.lit(" original_lines="), count, F.lit(" omitted_chars="), n.cast("string"),
        F.lit(" line="), lit(line).cast("string"), F.lit(" body_sha256="), sha256(text), F.lit(" record_sha256="), lit(record_hash), F.lit("]"),
    )
    return result(text, n > least, body, n)


def is_formatted_edit(text: Column) -> Column:
    return F.ltrim(text).startswith("@@tool ")


def shortened_edit(text: Column, line: Column, record_hash: Column, least: int = 800, head: int = 400, tail: int = 200) -> Column:
    """A long formatted edit; one that shows removed and then added lines stays whole."""
    a, b = cut(text, head, tail)
    named = text.rlike(r"(?m)^@@tool[^\n]*\n@@file [^\n]+\n")
    omitted = F.greatest(F.length(text) - F.length(a) - F.when(named, F.length(b)).otherwise(0), F.lit(0))
    note = marker("edit compressed:", text, omitted, line, record_hash)
    body = F.when(named, F.concat_ws("\n", a, F.lit(""), note, F.lit(""), b)).otherwise(F.concat(a, F.lit("\n\n"), note, F.lit("\n")))
    shown = named & text.rlike(r"-[^\n]+\n(?:\+[^\n]+\n)+")
    return result(text, is_formatted_edit(text) & (F.length(text) > least) & ~shown, body, omitted)


def collapsed_message(text: Column, least: int = 2400, head: int = 900, tail: int = 900) -> Column:
    """A user message as handoffs show it."""
    a, b = cut(text, head, tail)
    a, b = drop_newline_end(a), drop_newline_end(drop_newline_start(b))
    omitted = F.greatest(F.length(text) - F.length(a) - F.length(b), F.lit(0))
    body = F.concat_ws("\n", a, F.lit(""), F.concat(F.lit("[... omitted "), omitted.cast("string"), F.lit(" chars ...]")), F.lit(""), b)
    return result(text, F.length(text) > least, body, omitted)


def collapsed_tail(text: Column, least: int = 2400, head: int = 1200, tail: int = 800) -> Column:
    """A record of the latest tail."""
    return collapsed_message(text, least, head, tail)


def truncated(text: Column, most: int, share: float = 0.55) -> Column:
    """At most about ``most`` characters: more of the head than of the tail."""
    head = int(most * share)
    a, b = cut(text, head, most - head)
    note = F.concat(F.lit("[... omitted "), (F.length(text) - most).cast("string"), F.lit(" chars ...]"))
    return F.when(F.length(text) > most, F.concat_ws("\n", a, note, b)).otherwise(text)


#: Names of strategies for stale tool output; dspc works on frames (operators.dspc).
STRATEGIES = {"headtail": headtail, "mask": mask}


def compressed(strategy: str, text: Column, line: Column, record_hash: Column, **limits: int) -> Column:
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}")
    return STRATEGIES[strategy](text, line, record_hash, **limits)
