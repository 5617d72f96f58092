"""The ledger of user messages: identity, merge over rounds, priority, and selection within budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import intents, token_counts
from tessera.functions.text import bound, or_else, sha256, xml_escape, xml_unescape
from tessera.operators import compress, greedy
from tessera.sources import transcripts


#: A message of the ledger.
MESSAGE_TYPE = "struct<line:bigint,uuid:string,original_uuid:string,parent_uuid:string,timestamp:string,source:string,sha256:string,record_sha256:string,char_count:bigint,text:string>"


def message_struct(record: Column, line: Column, record_hash: Column) -> Column:
    """A user's record as a message: place, ids, hashes, length and text."""
    ids = [transcripts.get(record, f"$.{n}").alias(a) for n, a in (("uuid", "uuid"), ("originalUuid", "original_uuid"), ("parentUuid", "parent_uuid"), ("timestamp", "timestamp"))]
    made = lambda text: F.struct(line.cast("long").alias("line"), *ids, F.lit("current").alias("source"), sha256(text).alias("sha256"), record_hash.alias("record_sha256"), F.length(text).cast("long").alias("char_count"), text.alias("text"))
    return bound(transcripts.user_text(record), made)


def messages(entries: DataFrame) -> DataFrame:
    """User messages of entries: place, ids, hashes, length and text."""
    r = F.col("record")
    own = entries.where(transcripts.is_user_message(r))
    return own.select("session_id", message_struct(r, F.col("line"), F.col("hash")).alias("m")).select("session_id", "m.*")


def identity() -> Column:
    named = or_else(F.col("uuid"), F.nullif(F.col("original_uuid"), F.lit("")))
    other = F.concat_ws(":", F.lit("sha"), F.coalesce("sha256", F.lit("")), F.coalesce("char_count", F.lit(0)).cast("string"), F.coalesce("timestamp", F.lit("")))
    return F.coalesce(F.concat(F.lit("uuid:"), named), other)


def names() -> Column:
    """Keys that a carried message of the same one may have."""
    named = lambda n: F.concat(F.lit("uuid:"), F.nullif(n, F.lit("")))
    return F.array_distinct(F.filter(F.array(identity(), named("uuid"), named("original_uuid")), lambda k: k.isNotNull()))


def merged(carried: DataFrame, current: DataFrame) -> DataFrame:
    """Carried messages that current ones don't replace, then the current ones; ``ord`` is the order by session.

    Both have ``ord``. Of carried rows with one key the first place and last value count; of current
    ones the last of both.
    """
    c, n = carried.withColumn("key", identity()), current.withColumn("key", identity())
    named = n.select("session_id", F.explode(names()).alias("key")).distinct()
    by = Window.partitionBy("session_id", "key")
    last = F.row_number().over(by.orderBy(F.col("ord").desc()))
    c = c.join(named, ["session_id", "key"], "left_anti").withColumn("_first", F.min("ord").over(by)).withColumn("_r", last).where("_r = 1")
    c = c.withColumn("ord", F.col("_first")).withColumn("_side", F.lit(0)).drop("_first", "_r")
    n = n.withColumn("_r", last).where("_r = 1").withColumn("_side", F.lit(1)).drop("_r")
    out = c.unionByName(n, allowMissingColumns=True)
    return out.withColumn("ord", F.row_number().over(Window.partitionBy("session_id").orderBy("_side", "ord"))).drop("_side", "key")


def body(text: Column) -> Column:
    return F.trim(compress.collapsed_message(F.coalesce(text, F.lit("")))["body"])


def rendered() -> Column:
    """A message as XML; empty attributes are left out."""
    fields = [("source", or_else(F.col("source"), F.lit("current"))), ("line", F.col("line")), ("original_line", F.col("line")), ("chars", F.col("char_count")), ("sha256", F.col("sha256")), ("record_sha256", F.col("record_sha256")), ("uuid", F.col("uuid")), ("original_uuid", F.col("original_uuid")), ("timestamp", F.col("timestamp"))]
    attrs = [F.when(x.cast("string") != "", F.concat(F.lit(f'{n}="'), xml_escape(x.cast("string")), F.lit('"'))) for n, x in fields]
    return F.concat(F.lit("<user-message "), F.concat_ws(" ", *attrs), F.lit(">\n"), body(F.col("text")), F.lit("\n</user-message>"))


def with_priority(df: DataFrame) -> DataFrame:
    df = df.withColumn("kind", intents.kind(F.col("text")))
    df = df.withColumn("priority", intents.priority(F.col("kind"), F.col("text")))
    return df.withColumn("rank", intents.rank(F.col("priority")))


def sized(df: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Messages with their XML, its tokens and lines."""
    df = token_counts.counted(df.withColumn("rendered", rendered()), "rendered", "rendered_tokens", tokenizer)
    return df.withColumn("rendered_lines", (F.length("rendered") - F.length(F.replace("rendered", F.lit("\n"), F.lit(""))) + 1).cast("long"))


def selected(df: DataFrame, most: int = 64, most_tokens: int = 8000, most_lines: int = 300, tokenizer: str | None = None) -> DataFrame:
    """Messages of (session_id, ord, ...) that fit the budgets: by rank, then newest first.

    The first always stays; one that doesn't fit is passed over. A budget of 0 tokens or lines is
    none; 0 messages selects nothing. The greedy pass works on the sizes alone; without budgets there are only messages to
    count, and no size is worked out before they are chosen. tokenizer: a file that tokens are counted by; without one they
    are estimated.
    """
    df = with_priority(df)
    if most and not most_tokens and not most_lines:
        place = F.row_number().over(Window.partitionBy("session_id").orderBy("rank", F.col("ord").desc()))
        return sized(df.withColumn("_place", place).where(F.col("_place") <= most).drop("_place"), tokenizer)
    df = sized(df, tokenizer)
    if most == 0:
        return df.limit(0)
    sizes = df.select("session_id", "ord", "rank", F.col("rendered_tokens").alias("t"), F.col("rendered_lines").alias("l"))
    chosen = greedy.within(sizes, "session_id", [F.col("rank"), F.col("ord").desc()], {"t": most_tokens or None, "l": most_lines or None}, most).select("session_id", "ord")
    return df.join(chosen, ["session_id", "ord"], "left_semi").select(*df.columns)


def intent_events(chosen: DataFrame) -> DataFrame:
    number = F.row_number().over(Window.partitionBy("session_id").orderBy("ord"))
    return chosen.select("session_id", F.format_string("intent-%04d", number).alias("id"), "kind", "priority", F.lit("active").alias("status"), "line", "source", F.col("sha256").alias("text_sha256"), F.col("rendered").alias("rendered_text"))


#: Messages that one summary record may carry, for their order over records.
PER_RECORD = 1 << 24


def carried_place(record, at):
    """Order of the at-th message of a record."""
    return record * PER_RECORD + at


def summary_messages(record: Column) -> Column:
    """Messages of the ledger that an earlier round left in a compact-summary record, in order; other records have none."""
    text = F.when(transcripts.truthy(record, "$.isCompactSummary"), transcripts.plain_text(record))
    pattern = r"(?s)<user-message ([^>]*)>\n(.*?)\n</user-message>"
    pairs = F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)).alias("a"), F.regexp_extract_all(text, F.lit(pattern), F.lit(2)).alias("b"))

    def one(p: Column) -> Column:
        got = lambda n: F.regexp_extract(p["a"], rf'(?:^|\s){n}="([^"]*)"', 1)
        some = lambda n: F.nullif(got(n), F.lit(""))
        fields = [("line", got("line").try_cast("long")), ("uuid", xml_unescape(some("uuid"))), ("original_uuid", xml_unescape(some("original_uuid"))), ("parent_uuid", F.lit(None).cast("string")), ("timestamp", some("timestamp")), ("source", F.lit("carried")), ("sha256", some("sha256")), ("record_sha256", some("record_sha256")), ("char_count", got("chars").try_cast("long")), ("text", p["b"])]
        return F.struct(*(x.alias(n) for n, x in fields))

    return F.coalesce(F.transform(pairs, one), F.array().cast(f"array<{MESSAGE_TYPE}>"))


def from_summaries(entries: DataFrame) -> DataFrame:
    """Messages of the ledger that an earlier round left in a compact-summary record; others are not trusted."""
    flat = entries.select("session_id", F.posexplode(summary_messages(F.col("record"))).alias("ord", "m"))
    return flat.select("session_id", "ord", "m.*").drop("parent_uuid")


def of_entries(entries: DataFrame) -> DataFrame:
    """The ledger of whole sessions: what summaries carry and current messages don't replace, then these."""
    carried = entries.select("session_id", "line", summary_messages(F.col("record")).alias("carried"))
    return _of_both(carried, messages(entries))


def own_message(record: Column, line: Column, record_hash: Column) -> Column:
    """The user's message that a record is; null for others."""
    return F.when(transcripts.is_user_message(record), message_struct(record, line, record_hash))


def of_messages(entries: DataFrame) -> DataFrame:
    """of_entries from (session_id, line, carried, own), summary_messages and own_message of each record; written before, as each is read several times."""
    return _of_both(entries, entries.where("own IS NOT NULL").select("session_id", "own.*"))


def _of_both(entries: DataFrame, current: DataFrame) -> DataFrame:
    at = entries.select("session_id", F.col("line").alias("_line"), F.posexplode("carried").alias("_at", "m"))
    carried = at.select("session_id", carried_place(F.col("_line").cast("long"), F.col("_at")).alias("ord"), "m.*")
    return merged(carried, current.withColumn("ord", F.col("line")))


def leaked(messages_df: DataFrame, outputs: DataFrame, longer: int = 2400, probe: int = 700, least: int = 200) -> DataFrame:
    """Sessions whose model output (session_id, output) holds the start of a long user message."""
    start = messages_df.where(F.col("char_count") > longer).select("session_id", "line", F.trim(F.left("text", F.lit(probe))).alias("probe"))
    return start.where(F.length("probe") >= least).join(outputs, "session_id").where(F.contains("output", "probe")).select("session_id", "line")
