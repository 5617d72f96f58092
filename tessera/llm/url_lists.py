"""URL filter lists as of the time of a capture.

Entries (host, action, listed) say what holds for a host and all hosts below it from a time on.
They become validity intervals, each entry ending where the host's next begins. A capture is judged
by the entry of the most specific host that has one in force when the capture was fetched.

Captures are first reduced to distinct hosts and times. For the as-of join a host's questions, one for
itself and each domain above it, stand in one order of time with the entries of those names; each
takes the last entry before it. A name with very many questions, such as a top-level domain, is dealt
to several places by host, with its entries in each, so no place has many more than SHARE.

Defined cases: of entries of one host and time the alphabetically last action holds; entries with a
null column are skipped; captures with null or unparsable url, or null time, match nothing; each
capture row gives one row; no entries: nothing matches; other columns are kept, but ``host``,
``action``, ``matched`` and ``valid_from`` are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm import frames


def host_of(url: Column) -> Column:
    """Lower-case host of an absolute URL without user, port and trailing dot; null if there is none."""
    host = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:@]+)", 1)
    return F.nullif(F.regexp_replace(host, r"\.$", ""), F.lit(""))


def intervals(entries: DataFrame) -> DataFrame:
    """(host, action, valid_from, valid_to); the last of a host has no end."""
    at = entries.dropna(subset=["host", "action", "listed"]).groupBy(F.lower("host").alias("host"), "listed").agg(F.max("action").alias("action"))
    following = F.lead("listed").over(Window.partitionBy("host").orderBy("listed"))
    return at.select("host", "action", F.col("listed").alias("valid_from"), following.alias("valid_to"))


#: Questions on one name that are answered in one place.
SHARE = 1 << 18


def judged(captures: DataFrame, entries: DataFrame, url: str = "url", fetched: str = "fetched") -> DataFrame:
    """captures with host, action, matched (the entry's host) and valid_from; nulls where nothing matches."""
    captures = captures.drop("host", "action", "matched", "valid_from").withColumn("host", host_of(F.col(url)))
    asked = captures.select("host", F.col(fetched).alias("t")).where("host IS NOT NULL AND t IS NOT NULL").distinct()
    labels = F.split("host", r"\.")
    # A host and all domains above it, down to one label.
    names = F.transform(F.sequence(F.lit(0), F.size(labels) - 1), lambda i: F.array_join(F.slice(labels, i + 1, F.size(labels)), "."))
    asked = asked.withColumn("name", F.explode(names))
    many = asked.groupBy("name").agg(F.count(F.lit(1)).alias("q")).where(F.col("q") > SHARE).select("name", F.ceil(F.col("q") / SHARE).cast("int").alias("shares"))
    hot = F.broadcast(many)  # at most one name for each SHARE questions
    left = asked.join(hot, "name", "left").select("name", F.pmod(F.xxhash64("host"), F.coalesce("shares", F.lit(1))).cast("int").alias("place"), "t", "host", F.lit(None).cast("string").alias("action"))
    known = intervals(entries).withColumnRenamed("host", "name").join(hot, "name", "left")
    right = known.select("name", F.explode(F.sequence(F.lit(0), F.coalesce("shares", F.lit(1)) - 1)).alias("place"), F.col("valid_from").alias("t"), F.lit(None).cast("string").alias("host"), "action")
    before = Window.partitionBy("name", "place").orderBy("t", F.col("host").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    entry = F.last(F.when(F.col("action").isNotNull(), F.struct("action", F.col("name").alias("matched"), F.col("t").alias("valid_from"))), ignorenulls=True)
    met = left.union(right).withColumn("m", entry.over(before)).where("host IS NOT NULL AND m IS NOT NULL")
    best = met.groupBy("host", "t").agg(F.max_by("m", F.length("name")).alias("m"))
    asked_host, asked_time = frames.fresh(captures, "host"), frames.fresh(captures, "time")
    best = best.select(F.col("host").alias(asked_host), F.col("t").alias(asked_time), "m.*")
    return captures.join(best, (captures["host"] == best[asked_host]) & (captures[fetched] == best[asked_time]), "left").drop(asked_host, asked_time)
