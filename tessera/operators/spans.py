"""Cited spans: numbering, rehydration from entries, segments, code and edit capsules."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.text import normal_code, sha256

#: Fixed value: the order of anchored arrays.
KINDS = ["rules", "plans", "promises", "blocks"]


def anchored(rules: DataFrame, plans: DataFrame, promises: DataFrame, blocks: DataFrame) -> DataFrame:
    """The four arrays' items (session_id, pos, text, spans) as one, in their fixed order: ``anchor`` from 0."""
    out = None
    for i, (name, df) in enumerate(zip(KINDS, (rules, plans, promises, blocks), strict=True)):
        df = df.withColumn("kind", F.lit(name)).withColumn("_k", F.lit(i))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out.withColumn("anchor", F.row_number().over(Window.partitionBy("session_id").orderBy("_k", "pos")) - 1).drop("_k")


def anchor_start(spans: Column) -> Column:
    """The first line an item cites; a billion where it cites none."""
    return F.coalesce(F.array_min(F.transform(spans, lambda s: s["start_line"])), F.lit(1000000000))


def numbered(items: DataFrame) -> DataFrame:
    """A row a span with ``span_id``, numbered over the session."""
    flat = items.select("session_id", "anchor", F.posexplode("spans").alias("span", "s")).select("session_id", "anchor", "span", "s.start_line", "s.end_line")
    number = F.row_number().over(Window.partitionBy("session_id").orderBy("anchor", "span"))
    return flat.withColumn("span_id", F.format_string("span-%04d", number))


def rehydrated(spans: DataFrame, entries: DataFrame) -> DataFrame:
    """Spans with the records they cite: hashes of both ends, text, and segments with character ranges.

    Lines are exploded and met by equality, never by range.
    """
    lines = spans.select("session_id", "span_id", "start_line", "end_line", F.explode(F.sequence("start_line", "end_line")).alias("line"))
    met = lines.join(entries.select("session_id", "line", "hash", "text"), ["session_id", "line"])
    w = Window.partitionBy("session_id", "span_id").orderBy("line")
    size = F.when(F.col("text") != "", F.length("text") + 2).otherwise(0)
    met = met.withColumn("b", F.sum(size).over(w) - size).withColumn("e", F.col("b") + F.length("text"))
    segment = F.when(F.col("text") != "", F.struct("line", F.col("hash").alias("record_sha256"), F.array(F.col("b"), F.col("e")).alias("char_range"), sha256(F.col("text")).alias("extracted_text_sha256"), F.length("text").cast("long").alias("char_count"), "text"))
    out = met.groupBy("session_id", "span_id", "start_line", "end_line").agg(
        F.array_sort(F.collect_list(segment)).alias("segments"),
        F.min_by("hash", "line").alias("start_hash"), F.max_by("hash", "line").alias("end_hash"), F.array_sort(F.collect_list(F.struct("line", "hash"))).alias("h"),
    )
    text = F.array_join(F.transform("segments", lambda s: s["text"]), "\n\n")
    out = out.withColumn("extracted_text", text).withColumn("extracted_text_sha256", sha256(text))
    return out.withColumn("raw_slice_sha256", sha256(F.array_join(F.transform("h", lambda x: x["hash"]), "\n"))).drop("h")


def source_line(segments: Column, at: Column) -> Column:
    """The first segment whose range holds a position, both ends included; by halving, as ranges rise and don't meet.

    struct(lo, hi): the answer, if there is one, is among the segments lo to hi - 1 (from 0). Of those that end before
    the position none can be it, so the first that doesn't is looked at.
    """
    some = F.size(segments) > 0
    halvings = F.ceil(F.log2(F.greatest(F.size(segments), F.lit(1)).cast("double") + 1)).cast("int") + 1
    start = F.struct(F.lit(0).alias("lo"), F.size(segments).alias("hi"))

    def halve(s, _):
        mid = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        early = F.element_at(segments, F.least(mid + 1, F.size(segments)))["char_range"][1] < at
        lo, hi = F.when(early, mid + 1).otherwise(s["lo"]), F.when(early, s["hi"]).otherwise(mid)
        return F.when(s["lo"] < s["hi"], F.struct(lo.alias("lo"), hi.alias("hi"))).otherwise(s)

    first = F.aggregate(F.sequence(F.lit(1), halvings), start, halve, lambda s: s["lo"])
    hit = F.when(some, F.get(segments, first))
    return F.when((at >= hit["char_range"][0]) & (at <= hit["char_range"][1]), hit["line"])


_FENCE = re.compile(r"(^|\n)(`{3,}|~{3,})([^\n]*)\n(.*?)(\n\2)(?=\n|\Z)", re.S)


_CODE = T.StructType([T.StructField("language", T.StringType()), *(T.StructField(n, T.IntegerType()) for n in ("start", "end", "fence_start", "fence_end")), T.StructField("body", T.StringType())])


@F.pandas_udf(T.ArrayType(_CODE))
def fenced(texts: pd.Series) -> pd.Series:
    """Fenced code with its places; a back reference finds the closing fence."""
    out = []
    for t in texts:
        found = []
        for m in _FENCE.finditer(t or ""):
            words = m[3].split()
            found.append({"language": words[0] if words else "text", "start": m.start(4), "end": m.end(4), "fence_start": m.end(1), "fence_end": m.end(5), "body": m[4]})
        out.append(found)
    return pd.Series(out)


def code_capsules(spans: DataFrame) -> DataFrame:
    """A row for each fenced block of rehydrated spans."""
    with_fence = spans.where(F.col("extracted_text").rlike("(?m)^(?:```|~~~)"))
    flat = with_fence.select("session_id", "span_id", "segments", F.posexplode(fenced("extracted_text")).alias("n", "c"))
    return flat.select(
        "session_id", "span_id", F.concat("span_id", F.format_string("-code-%03d", F.col("n") + 1)).alias("id"), source_line(F.col("segments"), F.col("c.start")).alias("source_line"),
        "c.language", F.array("c.start", "c.end").alias("char_range"), F.array("c.fence_start", "c.fence_end").alias("fence_char_range"),
        sha256(F.col("c.body")).alias("exact_text_sha256"), sha256(normal_code(F.col("c.body"))).alias("normalized_code_sha256"),
    )


def edit_capsules(spans: DataFrame) -> DataFrame:
    """A row for each formatted edit in rehydrated spans (span_id, extracted_text)."""
    pieces = F.filter(F.split("extracted_text", r"\n(?=@@tool )"), lambda b: b.startswith("@@tool ") & b.rlike("(?m)^@@file [^\n]+") & b.rlike(r"stats: \+\d+ -\d+ lines"))
    flat = spans.select("session_id", "span_id", F.posexplode(pieces).alias("n", "b"))
    get = lambda p: F.regexp_extract("b", p, 1)
    start, stop = F.instr("b", "\n--- a/"), F.instr("b", "\nstats:")
    diff = F.when((start > 0) & (stop > 0), F.trim(F.substring(F.col("b"), start + 1, stop - start - 1))).otherwise(F.trim("b"))
    name = F.trim(get("(?m)^@@file ([^\n]+)"))
    return flat.select(
        "session_id", "span_id", F.concat("span_id", F.format_string("-edit-%03d", F.col("n") + 1)).alias("id"), get(r"^@@tool (\S+)").alias("tool_name"), name.alias("file_path"),
        F.coalesce(F.nullif(F.trim(get("(?m)^@@file_abs ([^\n]+)")), F.lit("")), name).alias("file_path_abs"), get(r"stats: \+(\d+) -").cast("int").alias("lines_added"),
        get(r"stats: \+\d+ -(\d+) lines").cast("int").alias("lines_removed"), sha256(diff).alias("diff_sha256"), F.nullif(get(r"input_sha256=([0-9a-f]{64})"), F.lit("")).alias("input_sha256"),
    )


def capsules(spans: DataFrame) -> DataFrame:
    """Evidence without its texts: ids, ranges and hashes."""
    kept = F.transform("segments", lambda s: F.struct(s["line"].alias("line"), s["record_sha256"].alias("record_sha256"), s["char_range"].alias("char_range"), s["extracted_text_sha256"].alias("extracted_text_sha256"), s["char_count"].alias("char_count")))
    return spans.select("session_id", F.regexp_replace("span_id", "^span-", "ev-").alias("id"), "start_line", "end_line", "start_hash", "end_hash", kept.alias("text_segments"), "raw_slice_sha256", "extracted_text_sha256")


def cited_lines(spans: DataFrame) -> DataFrame:
    """(session_id, lines): the distinct lines that spans cover, in order."""
    each = spans.select("session_id", F.explode(F.sequence("start_line", "end_line")).alias("line")).distinct()
    return each.groupBy("session_id").agg(F.sort_array(F.collect_list("line")).alias("lines"))
