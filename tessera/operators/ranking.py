"""Ranking of benchmark lanes by quality and speed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import cell, half_up

#: Fixed values of the formulas.
DETERMINISTIC, JUDGE, PENALTY, TARGET_SECONDS, QUALITY, SPEED = 0.65, 0.35, 0.88, 15.0, 0.6, 0.4


def quality(score: Column, judge: Column, gate: Column) -> Column:
    """Rounded to one decimal; a gate that failed costs 12 %, an unknown one nothing."""
    return half_up((DETERMINISTIC * score + JUDGE * 10 * judge) * F.when(gate == F.lit(False), PENALTY).otherwise(1.0), 1)


def speed(seconds: Column) -> Column:
    return F.when(seconds > 0, half_up(F.least(F.lit(100.0), 100.0 * TARGET_SECONDS / seconds), 1))


def combined(quality_: Column, speed_: Column) -> Column:
    return half_up(QUALITY * quality_ + SPEED * speed_, 1)


def lanes(registry: DataFrame, results: DataFrame) -> DataFrame:
    """Lanes with their runs' results; lanes without one stay, as missing."""
    return registry.join(results.withColumn("_has", F.lit(True)), "run_dir", "left").withColumn("missing", F.col("_has").isNull()).drop("_has")


def wall_seconds(duration_ms: Column) -> Column:
    return duration_ms / 1000


def tokens_used(usage: Column, names: list[str]) -> Column:
    """The first of several providers' names for a count."""
    return F.coalesce(*(F.try_variant_get(usage, f"$.{n}", "long") for n in names))


def ranked(rows: DataFrame) -> DataFrame:
    """quality, speed, combined, and rank from 1: combined, quality, less time, lane; unranked where combined is null.

    Two steps, so no partition holds all lanes: places among lanes of one combined index, added to the
    number of lanes before that index. Indices have one decimal, so there are some thousands at most.
    """
    out = rows.withColumn("quality", quality(F.col("deterministic_score"), F.col("judge_score"), F.col("gate_pass")))
    out = out.withColumn("speed", speed(F.col("wall_seconds"))).withColumn("combined", combined(F.col("quality"), F.col("speed")))
    counts = out.where("combined IS NOT NULL").groupBy(F.col("combined").alias("_c")).agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select("_c", (F.sum("_n").over(Window.orderBy(F.col("_c").desc()).rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")).alias("_before"))
    within = F.row_number().over(Window.partitionBy("combined").orderBy(F.col("quality").desc(), "wall_seconds", "lane_id"))
    out = out.join(before, out.combined == before["_c"], "left").withColumn("rank", F.when(F.col("combined").isNotNull(), (within + F.col("_before")).cast("int")))
    return out.drop("_c", "_before")


def shown(x: Column) -> Column:
    """A table cell; an em dash for null."""
    return F.coalesce(cell(x), F.lit("—")) if x is not None else F.lit("—")


def table(rows: DataFrame) -> DataFrame:
    """Ranked rows first, then the others by lane id, as cells."""
    dash = lambda n, f="%.1f": F.when(F.col(n).isNull(), "—").otherwise(F.format_string(f, F.col(n)))
    cells = rows.select("rank", "lane_id", F.coalesce(F.col("rank").cast("string"), F.lit("—")).alias("place"), cell(F.col("lane_id")).alias("lane"), dash("combined").alias("combined"), dash("quality").alias("quality"), dash("speed").alias("speed"), F.when(F.col("gate_pass"), "pass").when(~F.col("gate_pass"), "fail").otherwise("—").alias("gate"))
    return cells.orderBy(F.col("rank").asc_nulls_last(), "lane_id").drop("rank", "lane_id")
