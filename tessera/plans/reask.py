"""Asking again until a summary is dense enough and keeps the literals it must: a bounded loop over a shrinking set.

An attempt is a join: the sessions that are still asked, with what they are told to mend, go to ``answer``, whatever
that is (a recorded table, a service behind a UDF). Its rows are written before they are judged, so nothing is asked
twice when an executor is lost. Sessions that pass, and those that have no answer, are not asked again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators import handoff, prompts, scoring, spans, summary
from tessera.sources import folders

#: Fixed value: attempts after the first at most.
MOST = 10
ARRAYS = {"rules": "rules_and_invariants", "plans": "plans_and_task_state", "promises": "promises_made", "blocks": "summary_blocks"}
_SUMMARY = summary.SCHEMA.split(",", 1)[1]

TERSER = "The last answer ended before its JSON did. Give the same items again in fewer words: one short sentence each, more citations, nothing twice."


def recorded(answers: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """Answers from a table (session_id, attempt, output), as replay from saved output has them."""
    return lambda asked: asked.select("session_id", "attempt").join(answers.select("session_id", "attempt", "output"), ["session_id", "attempt"])


def parsed(outputs: DataFrame) -> DataFrame:
    """outputs (session_id, output) with the summary that the output is, null where it isn't JSON of an object."""
    whole = F.coalesce(F.schema_of_variant(F.try_parse_json("output")).startswith("OBJECT"), F.lit(False))
    return outputs.withColumn("s", F.when(whole, F.from_json("output", _SUMMARY)))


def items(summaries: DataFrame) -> DataFrame:
    """(session_id, kind, anchor, spans) of the four cited arrays of summaries (session_id, s), in their fixed order."""
    each = lambda kind, name: F.transform(F.coalesce(F.col("s")[name]["source_spans"], F.array().cast(f"array<array<{summary.SPAN}>>")), lambda x: F.struct(F.lit(kind).alias("kind"), F.coalesce(x, F.array().cast(f"array<{summary.SPAN}>")).alias("spans")))
    return summaries.select("session_id", F.posexplode(F.concat(*(each(k, n) for k, n in ARRAYS.items()))).alias("anchor", "i")).select("session_id", "i.kind", "anchor", "i.spans")


def rehydrated(summaries: DataFrame, entries: DataFrame) -> DataFrame:
    """(session_id, text): the summary's sections and the text of all that it cites; spans that cite what isn't there have none."""
    c = lambda n: F.coalesce(F.col("s")[n], F.array().cast(summaries.schema["s"].dataType[n].dataType))
    heads = summaries.select("session_id", handoff.blocks_section(c("summary_blocks"), c("rules_and_invariants"), c("plans_and_task_state"), c("promises_made")).alias("summary_markdown"))
    cited = spans.rehydrated(spans.numbered(items(summaries)).where("start_line BETWEEN 1 AND end_line"), entries)
    code = "array<struct<id:string,language:string,char_range:array<int>,exact_text_sha256:string>>"
    edit = "array<struct<id:string,file_path:string,lines_added:int,lines_removed:int,diff_sha256:string>>"
    cited = cited.withColumns({"section": F.lit("evidence"), "char_range": F.array(F.lit(0), F.length("extracted_text")), "code_capsules": F.lit(None).cast(code), "edit_capsules": F.lit(None).cast(edit)})
    return handoff.rehydrated(heads, cited).select("session_id", F.col("rehydrated").alias("text"))


def judged(outputs: DataFrame, entries: DataFrame, literals: DataFrame, least: dict[str, int] = scoring.DENSITY) -> DataFrame:
    """outputs (session_id, attempt, output) with valid, density, shortfalls, missing literals, and pass."""
    read = parsed(outputs)
    good = read.where("s IS NOT NULL")
    rows = items(good)
    heads = good.select("session_id")
    dense = heads.join(scoring.density_counts(rows), "session_id", "left").fillna(0, ["evidence_capsules", "cited_unique_lines", "promises"])
    dense = scoring.density(dense, least).select("session_id", F.col("score").alias("density"), "shortfalls", F.col("pass").alias("dense"))
    wanted = literals.join(heads, "session_id").select(F.col("session_id").alias("run_id"), "literal")
    lost = scoring.missing_literals(wanted, rehydrated(good, entries).withColumnRenamed("session_id", "run_id"))
    lost = lost.groupBy(F.col("run_id").alias("session_id")).agg(F.array_sort(F.collect_list("literal")).alias("missing"))  # a fixture's literals
    out = read.select("session_id", "attempt", "output", F.col("s").isNotNull().alias("valid")).join(dense, "session_id", "left").join(lost, "session_id", "left")
    none = F.array().cast("array<string>")
    out = out.withColumns({"missing": F.coalesce("missing", none), "shortfalls": F.coalesce("shortfalls", none)})
    return out.withColumn("pass", F.coalesce(F.col("valid") & F.col("dense") & (F.size("missing") == 0), F.lit(False))).drop("dense")


def feedback() -> Column:
    """What a judged attempt's next one has to mend."""
    return F.when(~F.col("valid"), F.lit(TERSER)).otherwise(prompts.correction(F.col("shortfalls"), F.col("missing")))


ATTEMPT = "session_id string, attempt int, output string, valid boolean, density double, shortfalls array<string>, missing array<string>, pass boolean, feedback string"


def attempts(sessions: DataFrame, answer: Callable[[DataFrame], DataFrame], judge: Callable[[DataFrame], DataFrame], most: int = MOST) -> DataFrame:
    """All attempts of sessions (session_id, ...): what was answered, how it was judged, and the feedback that was asked with.

    ``answer`` gets the sessions' columns with attempt (from 0) and feedback (null at first), and gives (session_id, attempt, output).
    """
    spark = sessions.sparkSession
    out = spark.createDataFrame([], ATTEMPT)
    asked = sessions.withColumn("attempt", F.lit(0)).withColumn("feedback", F.lit(None).cast("string"))
    more, n = not sessions.isEmpty(), 0
    while more:
        answers = folders.kept(answer(asked).select("session_id", "attempt", "output"), "answers")
        made = folders.kept(judge(answers).join(asked.select("session_id", "feedback"), "session_id").select(*out.columns), "attempts")
        out, n = out.union(made), n + 1
        again = made.where("NOT pass").select("session_id", feedback().alias("feedback"))
        asked = sessions.join(again, "session_id").withColumn("attempt", F.lit(n))
        more = n <= most and not again.isEmpty()
    return out


def chosen(attempts: DataFrame, most: int = MOST) -> DataFrame:
    """By session: the attempt with fewest missing literals, then most density, then the latest; attempts made, and why none is good."""
    best = scoring.best_attempt(attempts.where("valid").select(F.col("session_id").alias("run_id"), "attempt", F.size("missing").alias("missing"), "density")).withColumnRenamed("run_id", "session_id")
    by = attempts.groupBy("session_id").agg(F.count(F.lit(1)).alias("made"), F.max_by("valid", "attempt").alias("last_valid"), F.bool_or("pass").alias("pass"))
    out = by.join(best, "session_id", "left").join(attempts.select("session_id", "attempt", "output"), ["session_id", "attempt"], "left")
    error = F.when(~F.col("last_valid") & (F.col("made") > most), "output was not JSON").when(~F.col("pass"), "handoff did not pass")
    return out.select("session_id", "made", "pass", "attempt", "missing", "density", "output", error.alias("error"))
