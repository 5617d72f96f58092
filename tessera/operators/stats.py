"""Statistics of rendered entries over several groupings of the same facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import tokens


def largest_line() -> Column:
    """Line of the longest rendering, the first of equals; null where all are empty."""
    return F.max_by("line", F.when(F.col("rendered_chars") > 0, F.struct("rendered_chars", -F.col("line"))))


MEASURES = ["raw_bytes", "raw_chars", "prompt_chars", "rendered_chars", "rendered_bytes"]


def measured(df: DataFrame, raw: str, prompt: str, rendered: str) -> DataFrame:
    return df.withColumns({"raw_bytes": F.octet_length(raw).cast("long"), "raw_chars": F.length(raw).cast("long"), "prompt_chars": F.length(prompt).cast("long"), "rendered_chars": F.length(rendered).cast("long"), "rendered_bytes": F.octet_length(rendered).cast("long")})


def sums() -> list[Column]:
    return [*(F.sum(m).alias(m) for m in MEASURES), F.max("rendered_chars").alias("max_rendered_chars"), largest_line().alias("max_line")]


def by_each(facts: DataFrame, keys: list[str]) -> DataFrame:
    """One pass, a group for each value of each key: (grouping, key, records, measures...)."""
    out = facts.groupingSets([[F.col(k)] for k in keys], *keys).agg(F.grouping_id().alias("g"), F.count(F.lit(1)).alias("records"), *sums())
    name, value = F.lit(None).cast("string"), F.lit(None).cast("string")
    for i, k in enumerate(keys):
        mine = F.col("g").bitwiseAND(1 << (len(keys) - 1 - i)) == 0
        name, value = F.when(mine, F.lit(k)).otherwise(name), F.when(mine, F.col(k)).otherwise(value)
    return out.withColumn("grouping", name).withColumn("key", value).drop("g", *keys)


def by_block(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """Blocks grouped by keys, with the number of records that have such blocks."""
    return blocks.groupBy(*keys).agg(F.count(F.lit(1)).alias("blocks"), F.count_distinct("session_id", "line").alias("records_containing"), F.sum(F.length("raw")).cast("long").alias("raw_chars"), F.sum(F.length("prompt")).cast("long").alias("prompt_chars"))


def largest_first(groups: DataFrame, most: int | None = None) -> DataFrame:
    out = groups.orderBy(F.col("rendered_bytes").desc(), F.col("prompt_chars").desc(), F.col("records").desc())
    return out if most is None else out.limit(most)


def top(facts: DataFrame, by: str, most: int = 15) -> DataFrame:
    """The report's ranking lists: largest values first, then earlier lines."""
    return facts.orderBy(F.col(by).desc(), "session_id", "line").limit(most)


def totals(facts: DataFrame, by: str = "session_id") -> DataFrame:
    out = facts.groupBy(by).agg(F.count(F.lit(1)).alias("records"), *sums())
    return out.withColumn("tokens", tokens(F.col("rendered_chars")))


def cleanup_totals(rendered: DataFrame) -> DataFrame:
    """Sums of the per-entry counters that renderers report."""
    s = lambda n: F.sum(f"stats.{n}").alias(n)
    return rendered.groupBy("session_id").agg(F.count_if("stats.compressed").alias("compressed_records"), s("original_chars"), s("omitted_chars"), s("removed_chars"), s("removed_lines"), s("dedented_blocks"))


def latest(entries: DataFrame, most: int = 12) -> DataFrame:
    """The last records of each session, in order."""
    w = Window.partitionBy("session_id").orderBy(F.col("line").desc())
    return entries.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= most).drop("_r")


def not_increasing(df: DataFrame, strict: bool = True) -> DataFrame:
    """Rows whose line isn't after (strict) or is before (else) that of the row ahead by ord."""
    before = F.lag("line").over(Window.partitionBy("session_id").orderBy("ord"))
    bad = F.col("line") <= before if strict else F.col("line") < before
    return df.where("line IS NOT NULL").withColumn("_bad", bad).where("_bad").drop("_bad")


def transcript_stats(entries: DataFrame) -> DataFrame:
    """By session: records, citable ones, bytes and estimated tokens of the raw lines."""
    return entries.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("records"), F.count_if(F.col("text") != "").alias("citable"), F.sum(F.octet_length("raw") + 1).cast("long").alias("bytes"), tokens(F.sum(F.length("raw") + 1)).alias("tokens"),
    )


def reduction(before_tokens: Column, after_chars: Column) -> Column:
    return tokens(after_chars) / F.nullif(before_tokens, F.lit(0))


def markdown(df: DataFrame, headers: list[str], order: list[Column]) -> DataFrame:
    """A one-row frame with the table as markdown; for small report tables."""
    from tessera.functions.text import cell

    row = F.concat(F.lit("| "), F.concat_ws(" | ", *(cell(F.col(h)) for h in headers)), F.lit(" |"))
    number = F.row_number().over(Window.orderBy(*order))
    body = df.select(number.alias("n"), row.alias("row")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "row"))), lambda s: s["row"]), "\n").alias("b"))
    head = "| " + " | ".join(headers) + " |\n|" + " --- |" * len(headers)
    return body.select(F.concat_ws("\n", F.lit(head), "b").alias("markdown"))


def between_markers(content: Column, start: str, end: str, replacement: Column) -> Column:
    """content with the text between two markers replaced; markers missing or inverted are an error."""
    a, b = F.instr(content, start), F.instr(content, end)
    made = F.concat(F.substring(content, F.lit(1), a + len(start) - 1), F.lit("\n"), replacement, F.lit("\n"), F.substring(content, b, F.length(content)))
    return F.when((a == 0) | (b < a), F.raise_error(F.lit("markers missing or inverted")).cast("string")).otherwise(made)
