"""Verdicts of several trials on several criteria: validation, medians, outcome."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: levels and their worth.
LEVELS = {"absent": 0, "partial": 1, "clear": 2}
PASS = 8


def level(name: str = "level"):
    out = F.lit(None).cast("int")
    for k, v in LEVELS.items():
        out = F.when(F.col(name) == k, v).otherwise(out)
    return out


def medians(verdicts: DataFrame) -> DataFrame:
    """By run and criterion of (run_id, trial, criterion, level, quote, refs): the lower median level, a quote of the first trial at it, distinct refs."""
    v = verdicts.withColumn("value", level())
    mid = v.groupBy("run_id", "criterion").agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY value)").cast("int").alias("value"), F.count(F.lit(1)).alias("trials"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("refs")))).alias("refs"))
    first = v.groupBy("run_id", "criterion", F.col("value").alias("v")).agg(F.min_by("quote", "trial").alias("quote")).withColumnsRenamed({"run_id": "r", "criterion": "c"})
    return mid.join(first, (mid.run_id == F.col("r")) & (mid.criterion == F.col("c")) & (mid.value == F.col("v"))).drop("r", "c", "v")


def outcome(levels: DataFrame) -> DataFrame:
    """By run: the sum, and pass if no criterion is absent and the sum is 8 or more."""
    out = levels.groupBy("run_id").agg(F.sum("value").alias("total"), F.count_if(F.col("value") == 0).alias("absent"), F.count(F.lit(1)).alias("criteria"))
    return out.withColumn("pass", (F.col("absent") == 0) & (F.col("total") >= PASS))


def advisory(outcomes: DataFrame, claimed: DataFrame) -> DataFrame:
    """Runs whose own total or verdict (run_id, claimed_total, claimed_pass) differs; a warning, not an error."""
    return outcomes.join(claimed, "run_id").where("claimed_total <> total OR claimed_pass <> pass")


def unknown_refs(verdicts: DataFrame, known: DataFrame) -> DataFrame:
    """(run_id, ref) that verdicts name and the run doesn't have."""
    named = verdicts.select("run_id", F.explode("refs").alias("ref")).distinct()
    return named.join(known, ["run_id", "ref"], "left_anti")


def rejects(verdicts: DataFrame, criteria: list[str], known: DataFrame) -> DataFrame:
    """First error of each trial, by the order of the rules: unknown criterion, level, repeated or missing criterion, unknown ref."""
    own = F.array(*map(F.lit, criteria))
    by = verdicts.groupBy("run_id", "trial").agg(F.collect_list("criterion").alias("c"), F.bool_and(F.coalesce(level().isNotNull(), F.lit(False))).alias("levels"), F.array_distinct(F.flatten(F.collect_list("refs"))).alias("refs"))
    refs = known.groupBy("run_id").agg(F.collect_set("ref").alias("k"))
    by = by.join(refs, "run_id", "left")
    error = F.when(F.size(F.array_except("c", own)) > 0, "unknown criterion").when(~F.col("levels"), "unknown level").when(F.size(F.array_distinct("c")) < F.size("c"), "repeated criterion")
    error = error.when(F.size(F.array_except(own, F.col("c"))) > 0, "missing criterion").when(F.size(F.array_except("refs", F.coalesce("k", F.array().cast("array<string>")))) > 0, "unknown ref")
    return by.select("run_id", "trial", error.alias("error")).where("error IS NOT NULL")


def evidence_refs(capsules: DataFrame, events: DataFrame, most: int = 80) -> DataFrame:
    """Refs a verdict may name: a run's first capsules and all of its intent events."""
    first = capsules.groupBy("run_id").agg(F.slice(F.array_sort(F.collect_list("id")), 1, most).alias("ids")).select("run_id", F.explode("ids").alias("ref"))
    return first.union(events.select("run_id", "id"))
