"""Named queries over records made from conversations: tool calls, results, hidden and broken records.

Turn t of conversation c becomes a record of one of eight shapes, by (c + t) % 8; the SQL makes the same
JSON text and tells what each operator gives for it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import sha256, tokens
from tessera.operators import compress, handoff, ledger, render, reports, spans, stats, tools
from tessera.plans.queries import SENTENCES, query, table
from tessera.sources import artifacts, folders, transcripts

PREFIX = "/w"


def quoted(x: Column) -> Column:
    """A string as JSON."""
    return F.regexp_extract(F.to_json(F.array(x)), r"(?s)\A\[(.*)\]\z", 1)


def lines(spark, sf_dir) -> DataFrame:
    """(session_id, ord, raw): the conversations as transcript lines of eight shapes."""
    c = table(spark, sf_dir, "conversations").where("text IS NOT NULL")
    t, k, turn = F.col("text"), F.pmod(F.col("conv_id") + F.col("turn"), F.lit(8)), F.col("turn").cast("string")
    j = lambda *xs: F.concat(*(F.lit(x) if isinstance(x, str) else x for x in xs))
    call = lambda name, *given: j('{"type":"assistant","message":{"role":"assistant","content":[{"type":"tool_use","id":"t1","name":"' + name + '","input":{', *given, "}}]}}")
    raw = (
        F.when(k == 0, j('{"type":"user","uuid":"u-', F.col("conv_id").cast("string"), "-", turn, '","cwd":"/w","gitBranch":"b', turn, '","message":{"role":"user","content":', quoted(t), "}}"))
        .when(k == 1, j('{"type":"assistant","message":{"role":"assistant","model":"m', turn, '","content":[{"type":"text","text":', quoted(t), "}]}}"))
        .when(k == 2, call("Edit", '"file_path":"/w/f', turn, '.py","old_string":', quoted(F.left(t, F.lit(30))), ',"new_string":', quoted(F.substring(t, 31, 40))))
        .when(k == 3, j('{"type":"user","message":{"role":"user","content":[{"type":"tool_result","tool_use_id":"t1","content":', quoted(t), "}]}}"))
        .when(k == 4, call("Write", '"file_path":"/w/f', turn, '.txt","content":', quoted(t)))
        .when(k == 5, j('{"type":"user","isMeta":true,"message":{"role":"user","content":', quoted(t), "}}"))
        .when(k == 6, j('{"type":"summary","summary":', quoted(t), "}"))
        .otherwise(j("{broken ", turn))
    )
    return c.select(F.col("conv_id").cast("string").alias("session_id"), F.col("turn").alias("ord"), raw.alias("raw"))


def records(spark, sf_dir) -> DataFrame:
    return transcripts.numbered(lines(spark, sf_dir))


_J = lambda x: f"CAST(to_json({x}) AS VARCHAR)"
_NL = lambda x: f"(length({x}) - length(replace({x}, chr(10), '')) + 1)"
#: The same records: session_id, line, k, text, turn, raw, hash; and their texts for prompts and evidence.
R = f"""c AS (SELECT *, (conv_id + turn) % 8 AS k, left(text, 30) AS old, substr(text, 31, 40) AS new FROM conversations WHERE text IS NOT NULL),
    w AS (SELECT CAST(conv_id AS VARCHAR) AS session_id, turn, k, text, old, new, CASE k
        WHEN 0 THEN '{{"type":"user","uuid":"u-' || conv_id || '-' || turn || '","cwd":"/w","gitBranch":"b' || turn || '","message":{{"role":"user","content":' || {_J("text")} || '}}}}'
        WHEN 1 THEN '{{"type":"assistant","message":{{"role":"assistant","model":"m' || turn || '","content":[{{"type":"text","text":' || {_J("text")} || '}}]}}}}'
        WHEN 2 THEN '{{"type":"assistant","message":{{"role":"assistant","content":[{{"type":"tool_use","id":"t1","name":"Edit","input":{{"file_path":"/w/f' || turn || '.py","old_string":' || {_J("old")} || ',"new_string":' || {_J("new")} || '}}}}]}}}}'
        WHEN 3 THEN '{{"type":"user","message":{{"role":"user","content":[{{"type":"tool_result","tool_use_id":"t1","content":' || {_J("text")} || '}}]}}}}'
        WHEN 4 THEN '{{"type":"assistant","message":{{"role":"assistant","content":[{{"type":"tool_use","id":"t1","name":"Write","input":{{"file_path":"/w/f' || turn || '.txt","content":' || {_J("text")} || '}}}}]}}}}'
        WHEN 5 THEN '{{"type":"user","isMeta":true,"message":{{"role":"user","content":' || {_J("text")} || '}}}}'
        WHEN 6 THEN '{{"type":"summary","summary":' || {_J("text")} || '}}' ELSE '{{broken ' || turn END AS raw FROM c),
    h AS (SELECT *, sha256(raw) AS hash, CAST(row_number() OVER (PARTITION BY session_id ORDER BY turn) AS INTEGER) AS line, count(*) OVER (PARTITION BY session_id) AS n FROM w),
    r AS (SELECT *, CASE WHEN k IN (0, 1, 5, 6) THEN text
        WHEN k = 2 THEN '@@tool Edit line=' || lpad(line::VARCHAR, 6, '0') || ' sha256=' || hash || chr(10) || '@@file f' || turn || '.py' || chr(10) || '@@file_abs /w/f' || turn || '.py' || chr(10) || '-' || replace(old, chr(10), chr(10) || '-') || chr(10) || '+' || replace(new, chr(10), chr(10) || '+')
            || chr(10) || 'stats: +' || {_NL("new")} || ' -' || {_NL("old")} || ' lines | input_sha256=' || sha256('{{"filePath":"/w/f' || turn || '.py","oldText":' || {_J("old")} || ',"newText":' || {_J("new")} || '}}')
        WHEN k = 3 THEN '[tool_result]' || chr(10) || text
        WHEN k = 4 THEN '@@tool Write line=' || lpad(line::VARCHAR, 6, '0') || ' sha256=' || hash || chr(10) || '@@file f' || turn || '.txt' || chr(10) || '@@file_abs /w/f' || turn || '.txt' || chr(10) || '```' || chr(10) || regexp_replace(text, '\\n\\z', '') || chr(10) || '```'
            || chr(10) || 'stats: lines=' || {_NL("text")} || ' | input_sha256=' || sha256('{{"filePath":"/w/f' || turn || '.txt","contents":' || {_J("text")} || '}}') END AS prompt,
        CASE k WHEN 0 THEN 'user_message' WHEN 1 THEN 'assistant_message' WHEN 2 THEN 'tool_use' WHEN 3 THEN 'tool_output' WHEN 4 THEN 'tool_use' WHEN 5 THEN 'user_message' WHEN 6 THEN 'summary' ELSE 'unparsed' END AS kind,
        CASE WHEN k IN (0, 3, 5) THEN 'user' WHEN k IN (1, 2, 4) THEN 'assistant' WHEN k = 6 THEN 'summary' ELSE 'unparsed' END AS type, CASE WHEN k IN (0, 3, 5) THEN 'user' WHEN k IN (1, 2, 4) THEN 'assistant' END AS role FROM h)"""


@query(f"""WITH {R} SELECT session_id, line, hash, kind, k = 0 AS is_user, k = 3 AS is_output, k IN (2, 4) AS is_use, sha256(prompt) AS prompt_sha256, sha256(CASE WHEN k = 7 THEN '' ELSE prompt END) AS evidence_sha256,
    sha256(CASE WHEN k IN (0, 1, 5) THEN text ELSE '' END) AS user_sha256, sha256(CASE WHEN k IN (0, 1, 3, 5) THEN text ELSE '' END) AS plain_sha256, sha256(CASE WHEN k = 6 THEN text ELSE '' END) AS fallback_sha256, k IN (0, 1, 2, 3, 4, 5) AS preserved FROM r""")
def records_projected(spark, sf_dir):
    """Each record's kind, predicates, and texts for prompts, evidence, ledger and fallback."""
    r, prefix = F.col("record"), F.lit(PREFIX)
    e = tools.with_evidence_text(tools.with_prompt_text(records(spark, sf_dir), "prompt", prefix), "evidence", prefix)
    digest = lambda x: sha256(F.coalesce(x, F.lit("")))
    return e.select(
        "session_id", "line", "hash", transcripts.kind(r).alias("kind"), F.coalesce(transcripts.is_user_message(r), F.lit(False)).alias("is_user"), F.coalesce(transcripts.is_tool_output(r), F.lit(False)).alias("is_output"), F.coalesce(transcripts.is_tool_use(r), F.lit(False)).alias("is_use"),
        sha256(F.col("prompt")).alias("prompt_sha256"), digest(F.col("evidence")).alias("evidence_sha256"), digest(transcripts.user_text(r)).alias("user_sha256"), digest(transcripts.plain_text(r)).alias("plain_sha256"), digest(transcripts.fallback(r)).alias("fallback_sha256"), F.coalesce(transcripts.is_preserved(r), F.lit(False)).alias("preserved"),
    )


@query(f"""WITH {R} SELECT session_id, CAST(row_number() OVER (PARTITION BY session_id ORDER BY turn) AS INTEGER) AS line, hash FROM r WHERE k <> 7""")
def citable_records(spark, sf_dir):
    """Records that can be cited, numbered among themselves."""
    return tools.citable(lines(spark, sf_dir)).select("session_id", "line", "hash")


@query(f"""WITH {R}, b AS (SELECT session_id, line, 0 AS block, CASE WHEN k IN (0, 5) THEN 'string_content' WHEN k = 1 THEN 'text' WHEN k IN (2, 4) THEN 'tool_use' WHEN k = 3 THEN 'tool_result' END AS type,
    CASE WHEN k IN (2, 4) THEN '' WHEN k < 6 THEN text END AS prompt FROM r) SELECT session_id, line, block, type, prompt FROM b WHERE type IS NOT NULL""")
def content_blocks(spark, sf_dir):
    return transcripts.blocks(records(spark, sf_dir)).select("session_id", "line", "block", "type", "prompt")


_TRIM = lambda x: f"regexp_replace(regexp_replace({x}, '^\\s+', ''), '\\s+$', '')"
#: Bodies with tool calls and outputs of more than 200 characters compressed where two or more records follow.
_BODY = f"""o AS (SELECT *, line <= n - 2 AS aged, coalesce({_TRIM("prompt")}, raw) AS t FROM r),
    d AS (SELECT *, aged AND k = 3 AND length(t) > 200 AS cut, regexp_replace(left(t, 100), '\\n\\z', '') AS a, regexp_replace(regexp_replace(substr(t, greatest(length(t) - 50, 100) + 1), '\\A\\n', ''), '\\n\\z', '') AS b FROM o),
    x AS (SELECT *, greatest(length(t) - length(a) - length(b), 0) AS omitted FROM d),
    y AS (SELECT *, CASE WHEN cut THEN a || chr(10) || chr(10) || '[tool output compressed: original_chars=' || length(t) || ' omitted_chars=' || omitted || ' line=' || line || ' body_sha256=' || sha256(t) || ' record_sha256=' || hash || ']' || chr(10) || chr(10) || b ELSE t END AS body FROM x)"""


def _sentinel(spark, sf_dir) -> DataFrame:
    return render.rendered(records(spark, sf_dir), "sentinel", after=2, least=200, head=100, tail=50)


@query(f"""WITH {R}, {_BODY}
    SELECT session_id, line, cut AS compressed, CASE WHEN cut THEN omitted END AS omitted_chars, sha256(CASE WHEN k = 7 THEN '@@RECORD line=' || lpad(line::VARCHAR, 6, '0') || ' kind=unparsed sha256=' || hash
        ELSE '@@RECORD line=' || lpad(line::VARCHAR, 6, '0') || ' type=' || type || CASE WHEN role IS NULL THEN '' ELSE ' role=' || role END || ' chars=' || length(body) END || chr(10) || body || chr(10) || '@@END_RECORD line=' || lpad(line::VARCHAR, 6, '0')) AS rendered_sha256
    FROM y WHERE k NOT IN (2, 4)""")
def render_tool_output(spark, sf_dir):
    """Records as the sentinel renderer shows them, long outputs compressed; calls are told apart in render_tool_calls."""
    out = _sentinel(spark, sf_dir).where(~F.coalesce(transcripts.is_tool_use(F.col("record")), F.lit(False)))
    return out.select("session_id", "line", F.col("stats.compressed").alias("compressed"), F.col("stats.omitted_chars").alias("omitted_chars"), sha256(F.col("rendered")).alias("rendered_sha256"))


@query(f"""WITH {R} SELECT session_id, line, sha256(line || '|assistant' || chr(10) || replace(replace(prompt, '@@file f' || turn, '@@file /w/f' || turn), '@@file_abs /w/f' || turn || CASE k WHEN 2 THEN '.py' ELSE '.txt' END || chr(10), '')) AS rendered_sha256 FROM r WHERE k IN (2, 4)""")
def render_tool_calls(spark, sf_dir):
    """Calls as the onto renderer shows them, with whole paths."""
    out = render.rendered(records(spark, sf_dir), "onto").where(transcripts.is_tool_use(F.col("record")))
    return out.select("session_id", "line", sha256(F.col("rendered")).alias("rendered_sha256"))


@query(f"""WITH {R}, {_BODY}, z AS (SELECT * FROM y WHERE k NOT IN (2, 4))
    SELECT session_id, CAST(count(*) FILTER (WHERE cut) AS BIGINT) AS compressed_records, CAST(sum(CASE WHEN cut THEN length(t) END) AS BIGINT) AS original_chars, CAST(sum(CASE WHEN cut THEN omitted END) AS BIGINT) AS omitted_chars FROM z GROUP BY session_id""")
def render_stats(spark, sf_dir):
    """What compression left out, by session."""
    out = _sentinel(spark, sf_dir).where(~F.coalesce(transcripts.is_tool_use(F.col("record")), F.lit(False)))
    return stats.cleanup_totals(out).select("session_id", "compressed_records", "original_chars", "omitted_chars")


_FACTS = f"""{R}, f AS (SELECT session_id, line, type, coalesce(role, '(none)') AS role, kind, strlen(raw) AS raw_bytes, length(raw) AS raw_chars, coalesce(length(prompt), 0) AS prompt_chars, strlen(coalesce(prompt, raw)) AS rendered_bytes, length(coalesce(prompt, raw)) AS rendered_chars, k, text FROM r),
    g AS (SELECT 'type' AS grouping, type AS key, * FROM f UNION ALL SELECT 'role', role, * FROM f UNION ALL SELECT 'kind', kind, * FROM f)"""


def _facts(spark, sf_dir) -> DataFrame:
    r = F.col("record")
    e = tools.with_prompt_text(records(spark, sf_dir), "prompt", F.lit(PREFIX)).withColumn("shown", F.coalesce("prompt", "raw")).withColumn("prompt", F.coalesce("prompt", F.lit("")))
    e = e.withColumns({"kind": transcripts.kind(r), "type": F.when(r.isNull(), "unparsed").otherwise(transcripts.get(r, "$.type")), "role": F.coalesce(transcripts.get(r, "$.message.role"), F.lit("(none)"))})
    return stats.measured(e, "raw", "prompt", "shown")


@query(f"""WITH {_FACTS} SELECT grouping, key, count(*) AS records, CAST(sum(raw_bytes) AS BIGINT) AS raw_bytes, CAST(sum(raw_chars) AS BIGINT) AS raw_chars, CAST(sum(prompt_chars) AS BIGINT) AS prompt_chars, CAST(sum(rendered_chars) AS BIGINT) AS rendered_chars, CAST(sum(rendered_bytes) AS BIGINT) AS rendered_bytes,
    max(rendered_chars) AS max_rendered_chars, arg_max(line, rendered_chars * 100000 - line) AS max_line FROM g GROUP BY ALL""")
def report_groupings(spark, sf_dir):
    """Type, role and kind in one pass."""
    return stats.by_each(_facts(spark, sf_dir), ["type", "role", "kind"])


@query(f"""WITH {_FACTS}, b AS (SELECT *, CASE WHEN k IN (0, 5) THEN 'string_content' WHEN k = 1 THEN 'text' WHEN k IN (2, 4) THEN 'tool_use' WHEN k = 3 THEN 'tool_result' ELSE '(no content block)' END AS block_type, CASE WHEN k IN (0, 1, 3, 5) THEN length(text) ELSE 0 END AS p FROM f),
    t AS (SELECT 'block' AS grouping, block_type AS key, * FROM b UNION ALL SELECT 'record', type || ' / ' || block_type, * FROM b)
    SELECT grouping, key, count(*) AS blocks, CAST(sum(p) AS BIGINT) AS prompt_chars FROM t GROUP BY ALL""")
def report_blocks(spark, sf_dir):
    """Block types, and record types by block types."""
    facts = reports.block_facts(_facts(spark, sf_dir), transcripts.blocks(records(spark, sf_dir)))
    one = reports.by_block_type(facts).select(F.lit("block").alias("grouping"), F.col("block_type").alias("key"), "blocks", "prompt_chars")
    return one.union(reports.by_record_block(facts).select(F.lit("record"), "key", "blocks", "prompt_chars"))


@query(f"""WITH {_FACTS}, s AS (SELECT kind, count(*) AS n, sum(rendered_bytes) AS b, sum(prompt_chars) AS p FROM f GROUP BY kind), o AS (SELECT *, row_number() OVER (ORDER BY b DESC, p DESC, n DESC, kind) AS i FROM s)
    SELECT '| Kind | Records | Rendered bytes |' || chr(10) || '| --- | --- | --- |' || string_agg(chr(10) || '| ' || kind || ' | ' || format('{{:,}}', n) || ' | ' || format('{{:,}}', CAST(b AS BIGINT)) || ' |', '' ORDER BY i) AS text FROM o""")
def report_kinds_markdown(spark, sf_dir):
    """A table of the report."""
    c = F.col
    g = stats.by_each(_facts(spark, sf_dir), ["type", "role", "kind"]).where("grouping = 'kind'")
    return reports.table(g, {"Kind": c("key"), "Records": reports.thousands(c("records")), "Rendered bytes": reports.thousands(c("rendered_bytes"))}, [c("rendered_bytes").desc(), c("prompt_chars").desc(), c("records").desc(), c("key")]).select("text")


@query(f"""WITH {_FACTS} SELECT 'rendered' AS list, session_id, line FROM (SELECT *, row_number() OVER (ORDER BY rendered_bytes DESC, session_id, line) AS i FROM f) WHERE i <= 15
    UNION ALL SELECT 'raw', session_id, line FROM (SELECT *, row_number() OVER (ORDER BY raw_bytes DESC, session_id, line) AS i FROM f) WHERE i <= 15""")
def report_top_lists(spark, sf_dir):
    f = _facts(spark, sf_dir)
    return stats.top(f, "rendered_bytes").select(F.lit("rendered").alias("list"), "session_id", "line").union(stats.top(f, "raw_bytes").select(F.lit("raw"), "session_id", "line"))


@query(f"""WITH {R} SELECT session_id, count(*) AS records, count(*) FILTER (WHERE k <> 7) AS citable, CAST(sum(strlen(raw) + 1) AS BIGINT) AS bytes, CAST(ceil(sum(length(raw) + 1) / 4.0) AS BIGINT) AS tokens, count(*) FILTER (WHERE k = 0) AS users FROM r GROUP BY session_id""")
def transcript_statistics(spark, sf_dir):
    e = tools.with_evidence_text(records(spark, sf_dir))
    users = e.groupBy("session_id").agg(F.count_if(transcripts.is_user_message(F.col("record"))).alias("users"))
    return stats.transcript_stats(e).join(users, "session_id")


@query(f"""WITH {R} SELECT session_id, count(*) AS user_message_count, CAST(sum(length(text)) AS BIGINT) AS user_message_total_chars, max(length(text)) AS user_message_max_chars, count(*) FILTER (WHERE length(text) > 300) AS user_message_collapsed_count FROM r WHERE k = 0 GROUP BY session_id""")
def message_metrics(spark, sf_dir):
    return handoff.message_metrics(ledger.messages(records(spark, sf_dir)), 300)


@query(f"""WITH {R} SELECT line, hash, session_id, regexp_replace(CASE WHEN k = 7 THEN raw ELSE 'type=' || type || CASE WHEN k = 0 THEN ' | uuid=u-' || session_id || '-' || turn ELSE '' END || CASE WHEN role IS NULL THEN '' ELSE ' | role=' || role END
    || CASE WHEN k IN (0, 1, 5) THEN ' | text=' || left(regexp_replace(text, '{{WS}}+', ' ', 'g'), 160) ELSE '' END END, '[\\t\\r\\n]', ' ', 'g') AS preview FROM r""".replace("{{WS}}", "{WS}"))
def hash_sidecar(spark, sf_dir):
    return artifacts.hash_sidecar(records(spark, sf_dir))


#: Messages as the ledger renders them, and what they cost.
_XML = """m AS (SELECT session_id, line, text, hash, 'u-' || session_id || '-' || turn AS uuid, sha256(text) AS sha FROM r WHERE k = 0),
    v AS (SELECT *, '<user-message source="current" line="' || line || '" original_line="' || line || '" chars="' || length(text) || '" sha256="' || sha || '" record_sha256="' || hash || '" uuid="' || uuid || '">' || chr(10) || trim(text, ' ') || chr(10) || '</user-message>' AS rendered FROM m)"""


@query(f"""WITH {R}, {_XML} SELECT session_id, 'intent-' || lpad(CAST(row_number() OVER (PARTITION BY session_id ORDER BY line) AS VARCHAR), 4, '0') AS id, CAST(line AS BIGINT) AS line, sha AS text_sha256, sha256(rendered) AS rendered_sha256 FROM v""")
def intent_events(spark, sf_dir):
    m = ledger.messages(records(spark, sf_dir)).withColumn("ord", F.col("line"))
    out = ledger.intent_events(ledger.selected(m))
    return out.select("session_id", "id", F.col("line").cast("long").alias("line"), "text_sha256", sha256(F.col("rendered_text")).alias("rendered_sha256"))


@query(f"""WITH {R}, {_XML}, s AS (SELECT session_id, count(*) AS n, sum(ceil(length(rendered) / 4.0)) AS t, sum({_NL("rendered")}) AS l, string_agg(rendered, chr(10) ORDER BY line) AS x FROM v GROUP BY session_id)
    SELECT session_id, sha256('## User Messages' || chr(10) || chr(10) || '{handoff.LEDGER}' || chr(10) || chr(10) || '<user-message-ledger version="1" total="' || n || '" selected="' || n || '" omitted_older="0" token_estimate="' || CAST(t AS BIGINT) || '" line_count="' || CAST(l AS BIGINT)
        || '" count_limit="64" token_budget="8000" line_limit="300">' || chr(10) || x || chr(10) || '</user-message-ledger>') AS section_sha256 FROM s""")
def ledger_section(spark, sf_dir):
    """The ledger in its wrapper; no session of the tables is beyond the budgets."""
    m = ledger.messages(records(spark, sf_dir)).withColumn("ord", F.col("line"))
    total = m.groupBy("session_id").agg(F.count(F.lit(1)).alias("total"))
    return handoff.ledger_section(ledger.selected(m), total).select("session_id", sha256(F.col("section")).alias("section_sha256"))


@query(f"""WITH {R}, t AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY line DESC) AS k2 FROM r WHERE k <> 7), l AS (SELECT * FROM t WHERE k2 <= 3),
    p AS (SELECT session_id, '## Latest Transcript Tail' || chr(10) || chr(10) || 'Later wins.' || chr(10) || chr(10) || string_agg('### line ' || line || ' | ' || type || CASE WHEN role IS NULL THEN '' ELSE ' | role ' || role END || chr(10) || chr(10)
        || CASE WHEN contains(prompt, '```') THEN '````' ELSE '```' END || 'text' || chr(10) || regexp_replace(prompt, '\\n\\z', '') || chr(10) || CASE WHEN contains(prompt, '```') THEN '````' ELSE '```' END, chr(10) || chr(10) ORDER BY line) AS tail FROM l WHERE length(prompt) <= 2400 GROUP BY session_id)
    SELECT session_id, sha256(tail) AS tail_sha256 FROM p""")
def tail_section(spark, sf_dir):
    """The latest three records; none of the tables is long enough to be collapsed."""
    r = F.col("record")
    e = tools.with_evidence_text(records(spark, sf_dir), "text", F.lit(PREFIX)).where("text <> ''")
    e = stats.latest(e, 3).withColumns({"type": transcripts.get(r, "$.type"), "role": transcripts.get(r, "$.message.role"), "timestamp": transcripts.get(r, "$.timestamp")})
    out = handoff.tail_records(e)
    return out.select("session_id", sha256(handoff.tail_section(F.col("records"), F.lit("Later wins."))).alias("tail_sha256"))


def _spans(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Spans of two or three lines over the records, and the records."""
    e = tools.with_evidence_text(records(spark, sf_dir), "text", F.lit(PREFIX))
    n = F.count(F.lit(1)).over(Window.partitionBy("session_id"))
    own = e.withColumn("n", n).where("line % 2 = 1").select("session_id", F.col("line").alias("anchor"), F.array(F.struct(F.col("line").cast("int").alias("start_line"), F.least(F.col("n"), F.col("line") + 1 + F.col("line") % 2).cast("int").alias("end_line"))).alias("spans"))
    return spans.numbered(own), e


_SPANS = f"""{R}, sp AS (SELECT session_id, line AS s, CAST(least(n, line + 1 + line % 2) AS INTEGER) AS e, 'span-' || lpad(CAST(row_number() OVER (PARTITION BY session_id ORDER BY line) AS VARCHAR), 4, '0') AS span_id FROM r WHERE line % 2 = 1),
    q AS (SELECT sp.*, r.line, r.hash, coalesce(r.prompt, '') AS t, r.k, r.old, r.new, r.turn FROM sp JOIN r ON r.session_id = sp.session_id AND r.line BETWEEN s AND e)"""


@query(f"""WITH {_SPANS}, x AS (SELECT *, CAST(coalesce(sum(CASE WHEN t <> '' THEN length(t) + 2 ELSE 0 END) OVER (PARTITION BY session_id, span_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS b FROM q)
    SELECT session_id, span_id, line, b AS begins, b + length(t) AS ends, hash AS record_sha256, sha256(t) AS text_sha256 FROM x WHERE t <> ''""")
def span_segments(spark, sf_dir):
    """Segments of rehydrated spans with their character ranges."""
    out = spans.rehydrated(*_spans(spark, sf_dir)).select("session_id", "span_id", F.explode("segments").alias("g"))
    return out.select("session_id", "span_id", "g.line", F.col("g.char_range")[0].cast("long").alias("begins"), F.col("g.char_range")[1].cast("long").alias("ends"), "g.record_sha256", F.col("g.extracted_text_sha256").alias("text_sha256"))


@query(f"""WITH {_SPANS} SELECT session_id, 'ev-' || substr(span_id, 6) AS id, s AS start_line, e AS end_line, min_by(hash, line) AS start_hash, max_by(hash, line) AS end_hash, count(*) FILTER (WHERE t <> '') AS segments FROM q GROUP BY ALL""")
def evidence_capsules(spark, sf_dir):
    out = spans.capsules(spans.rehydrated(*_spans(spark, sf_dir)))
    return out.select("session_id", "id", "start_line", "end_line", "start_hash", "end_hash", F.size("text_segments").cast("long").alias("segments"))


@query(f"""WITH {_SPANS}, g AS (SELECT *, row_number() OVER (PARTITION BY session_id, span_id ORDER BY line) AS i FROM q WHERE k = 2)
    SELECT session_id, span_id, span_id || '-edit-' || lpad(i::VARCHAR, 3, '0') AS id, 'Edit' AS tool_name, 'f' || turn || '.py' AS file_path, '/w/f' || turn || '.py' AS file_path_abs, CAST({_NL("new")} AS INTEGER) AS lines_added, CAST({_NL("old")} AS INTEGER) AS lines_removed,
        sha256('{{"filePath":"/w/f' || turn || '.py","oldText":' || {_J("old")} || ',"newText":' || {_J("new")} || '}}') AS input_sha256 FROM g""")
def edit_capsules(spark, sf_dir):
    """Formatted edits inside spans."""
    return spans.edit_capsules(spans.rehydrated(*_spans(spark, sf_dir))).where("tool_name = 'Edit'").drop("diff_sha256").withColumn("id", F.format_string("%s-edit-%03d", "span_id", F.row_number().over(Window.partitionBy("session_id", "span_id").orderBy("id"))))


@query(f"""WITH {_SPANS}, l AS (SELECT DISTINCT session_id, line FROM q) SELECT session_id, list_sort(list(line)) AS lines FROM l GROUP BY session_id""")
def cited_lines(spark, sf_dir):
    return spans.cited_lines(_spans(spark, sf_dir)[0])


@query(f"""WITH {_SPANS}, a AS (SELECT DISTINCT session_id, unnest([s, e]) AS line FROM sp) SELECT a.session_id, list_sort(list(DISTINCT hash)) AS hashes FROM a JOIN r ON r.session_id = a.session_id AND r.line = a.line GROUP BY a.session_id""")
def source_hashes(spark, sf_dir):
    s, e = _spans(spark, sf_dir)
    return handoff.source_hashes(s.select("session_id", F.array(F.struct("start_line", "end_line")).alias("spans")), e)


@query(f"""WITH {R} SELECT session_id, count(*) AS before_records, least(4, count(*) FILTER (WHERE k < 6)) + 2 AS after_records, CAST(ceil(sum(length(raw) + 1) / 4.0) AS BIGINT) AS before_tokens, true AS ratio_of_both FROM r GROUP BY session_id""")
def compaction_metrics(spark, sf_dir):
    """A compaction's size before and after."""
    from tessera.plans import compact

    e = records(spark, sf_dir)
    s = e.groupBy("session_id").agg(F.lit("done").alias("summary"))
    out = compact.results(e, compact.compacted(e, s, 4))
    same = F.abs(F.col("ratio") - stats.reduction(F.col("before_tokens"), F.col("after_tokens") * 4)) < 1e-6
    return out.select("session_id", "before_records", "after_records", "before_tokens", same.alias("ratio_of_both"))


@query(f"""WITH {R} SELECT session_id, line, CAST(ceil(length(raw) / 4.0) AS BIGINT) AS tokens, strlen(raw) AS bytes, starts_with(ltrim(prompt), '@@tool ') AS formatted_edit FROM r WHERE k <> 7""")
def record_sizes(spark, sf_dir):
    e = tools.with_prompt_text(records(spark, sf_dir), "prompt").where("record IS NOT NULL")
    return e.select("session_id", "line", tokens(F.length("raw")).alias("tokens"), F.octet_length("raw").cast("long").alias("bytes"), compress.is_formatted_edit(F.col("prompt")).alias("formatted_edit"))


@query(f"""WITH {R} SELECT session_id, line - 1 AS ord, raw, k <> 7 AS parsed FROM r""")
def lines_round_trip(spark, sf_dir):
    """Transcripts written as files of lines, a folder a session, and read again."""
    folder = folders.scratch(spark, "lines")
    rows = folders.dealt(lines(spark, sf_dir), "session_id").sortWithinPartitions("session_id", "ord")
    rows.select("session_id", "raw").write.partitionBy("session_id").text(folder)
    again = transcripts.parsed(transcripts.read_lines(spark, folder, F.regexp_extract(F.col("_metadata.file_path"), "session_id=([^/]+)", 1)))
    return again.select("session_id", "ord", "raw", F.col("record").isNotNull().alias("parsed"))


@query(f"""WITH {R} SELECT session_id, 'parse' AS stage, 'line ' || line AS error FROM r WHERE k = 7""")
def rejected_lines(spark, sf_dir):
    """Lines that are not JSON, as rejects."""
    e = records(spark, sf_dir)
    return artifacts.rejects(e, "parse", F.when(F.col("record").isNull(), F.concat(F.lit("line "), F.col("line").cast("string"))))


@query(f"""WITH {R} SELECT session_id, max_by('u-' || session_id || '-' || turn, CASE WHEN k = 0 THEN line END) AS last_user_uuid, max_by('m' || turn, CASE WHEN k = 1 THEN line END) AS model, min_by('/w', CASE WHEN k = 0 THEN line END) AS cwd, min_by('b' || turn, CASE WHEN k = 0 THEN line END) AS git_branch FROM r GROUP BY session_id""")
def session_metadata(spark, sf_dir):
    """First folder and branch, last user record and model of each session."""
    return transcripts.metadata(records(spark, sf_dir)).select("session_id", "last_user_uuid", "model", "cwd", "git_branch")


@query(f"""WITH {R} SELECT session_id, line, sha256('<record line="' || lpad(line::VARCHAR, 6, '0') || '">' || chr(10) || raw || chr(10) || '</record>') AS rendered_sha256 FROM r""")
def render_jsonl(spark, sf_dir):
    """Raw lines in their wrapper."""
    return render.rendered(records(spark, sf_dir), "jsonl").select("session_id", "line", sha256(F.col("rendered")).alias("rendered_sha256"))


_LINES = [*(("unchanged", f"u{i}") for i in range(9)), ("removed", "old"), ("added", "new"), ("unchanged", "end")]
_OBJECT = '{"path":"/w/a.py","diffLines":[' + ",".join(f'{{"type":"{t}","content":"{x}"}}' for t, x in _LINES) + "]}"
_DIFF = ["@@file a.py", "@@file_abs /w/a.py", "--- a/a.py", "+++ b/a.py", " u0", " u1", " u2", "[... 3 unchanged lines ...]", " u6", " u7", " u8", "-old", "+new", " end"]
_RESULT = '{"type":"user","message":{"role":"user","content":[{"type":"tool_result","tool_use_id":"t","content":[{"type":"text","text":"T"},"second"]},{"type":"tool_result","tool_use_id":"u","content":Q}]}}'


@query(f"""WITH w AS (SELECT CAST(conv_id AS VARCHAR) AS session_id, turn, replace('{_RESULT}', '"T"', {_J("'t' || turn")}) AS a FROM conversations WHERE text IS NOT NULL),
    h AS (SELECT *, replace(a, ':Q}}', ':' || {_J(f"'{_OBJECT}'")} || '}}') AS raw FROM w), n AS (SELECT *, sha256(raw) AS hash, CAST(row_number() OVER (PARTITION BY session_id ORDER BY turn) AS INTEGER) AS line FROM h)
    SELECT session_id, line, '[tool_result]' || chr(10) || 't' || turn || chr(10) || 'second' || chr(10) || chr(10) || '[tool_result]' || chr(10) || '@@tool EditResult line=' || lpad(line::VARCHAR, 6, '0') || ' sha256=' || hash || chr(10) || replace('{"~".join(_DIFF)}', '~', chr(10))
        || chr(10) || 'stats: +1 -1 lines | input_sha256=' || sha256('{_OBJECT}') AS prompt FROM n""")
def structured_results(spark, sf_dir):
    """Results of several parts, and one that is a difference."""
    c = table(spark, sf_dir, "conversations").where("text IS NOT NULL")
    first, rest = _RESULT.split('"T"')
    middle, last = rest.split(":Q}")
    raw = F.concat(F.lit(first), quoted(F.concat(F.lit("t"), F.col("turn").cast("string"))), F.lit(middle + ":"), quoted(F.lit(_OBJECT)), F.lit("}" + last))
    e = transcripts.numbered(c.select(F.col("conv_id").cast("string").alias("session_id"), F.col("turn").alias("ord"), raw.alias("raw")))
    return tools.with_prompt_text(e, "prompt", F.lit(PREFIX)).select("session_id", "line", "prompt")


@query(f"""WITH {R}, {_XML} SELECT session_id, CAST(line AS BIGINT) AS line, uuid, sha AS sha256, hash AS record_sha256, CAST(length(text) AS BIGINT) AS char_count, 'carried' AS source, trim(text, ' ') AS text FROM v""")
def ledger_of_summary(spark, sf_dir):
    """The ledger that an earlier round left in its summary, read back."""
    m = ledger.messages(records(spark, sf_dir)).withColumn("xml", ledger.rendered())
    body = m.groupBy("session_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "xml"))), lambda s: s["xml"]), "\n").alias("x"))
    raw = F.concat(F.lit('{"type":"user","isCompactSummary":true,"message":{"role":"user","content":'), quoted(F.col("x")), F.lit("}}"))
    e = transcripts.numbered(body.select("session_id", F.lit(0).alias("ord"), raw.alias("raw")))
    return ledger.from_summaries(e).select("session_id", "line", "uuid", "sha256", "record_sha256", "char_count", "source", "text")


@query(f"""WITH {_FACTS}, s AS (SELECT kind, sum(rendered_bytes) AS b, sum(prompt_chars) AS p, count(*) AS n FROM f GROUP BY kind) SELECT kind FROM s ORDER BY b DESC, p DESC, n DESC LIMIT 3""")
def largest_kinds(spark, sf_dir):
    """The three largest kinds of records."""
    g = stats.by_each(_facts(spark, sf_dir), ["kind"])
    return stats.largest_first(g, 3).select(F.col("key").alias("kind"))


@query()
def renderer_report(spark, sf_dir):
    """The whole report of the sentinel renderer; its tables have queries of their own."""
    r = F.col("record")
    e = _sentinel(spark, sf_dir).withColumns({"kind": transcripts.kind(r), "type": F.when(r.isNull(), "unparsed").otherwise(transcripts.get(r, "$.type")), "role": F.coalesce(transcripts.get(r, "$.message.role"), F.lit("(none)")), "compressed": F.col("stats.compressed"), "original_chars": F.col("stats.original_chars"), "omitted_chars": F.col("stats.omitted_chars")})
    return reports.renderer_report(stats.measured(e, "raw", "body", "rendered"), transcripts.blocks(records(spark, sf_dir)))


@query(f"""WITH {R}, {_XML}, mm AS (SELECT session_id, count(*) AS c, sum(length(text)) AS total, max(length(text)) AS longest, sum(ceil(length(rendered) / 4.0)) AS t FROM v GROUP BY session_id),
    s AS (SELECT session_id, count(*) AS n, count(*) FILTER (WHERE k < 6) AS kept, count(*) FILTER (WHERE line % 2 = 1) AS sp, count(*) FILTER (WHERE k <> 7) AS citable FROM r GROUP BY session_id)
    SELECT s.session_id, n AS before_records, least(4, kept) + 2 AS after_records, citable AS citable_records, n - citable AS non_citable_records, coalesce(c, 0) AS user_message_count, CAST(coalesce(total, 0) AS BIGINT) AS user_message_total_chars, coalesce(longest, 0) AS user_message_max_chars,
        coalesce(c, 0) AS handoff_user_message_selected_count, CAST(coalesce(t, 0) AS BIGINT) AS handoff_user_message_token_estimate, CAST(0 AS BIGINT) AS handoff_user_message_omitted_older_count, sp AS rehydrated_span_count, CAST(0 AS BIGINT) AS invalid_span_count, n AS rehydrated_unique_lines, sp AS evidence_capsules, 1 AS rules_and_invariants_count,
        'onto' AS renderer, false AS density_pass FROM s LEFT JOIN mm ON mm.session_id = s.session_id""")
def result_rows(spark, sf_dir):
    """The metrics of whole compactions."""
    from tessera.plans import compact

    e = tools.with_evidence_text(records(spark, sf_dir))
    heads = e.groupBy("session_id").agg(F.lit("done").alias("summary"))
    m = ledger.messages(e).withColumn("ord", F.col("line"))
    n = F.count(F.lit(1)).over(Window.partitionBy("session_id"))
    items = e.withColumn("n", n).where("line % 2 = 1").select("session_id", F.col("line").alias("anchor"), F.lit("blocks").alias("kind"), F.array(F.struct(F.col("line").cast("int").alias("start_line"), F.least(F.col("n"), F.col("line") + 1).cast("int").alias("end_line"))).alias("spans"))
    one, none = F.array(F.struct(F.lit("r").alias("rule"))), F.lit(None).cast("array<string>")
    summaries = heads.select("session_id", none.alias("summary_blocks"), one.alias("rules_and_invariants"), none.alias("plans_and_task_state"), none.alias("promises_made"))
    out = compact.result_rows(e, compact.compacted(e, heads, 4), m, ledger.selected(m), m.where("line < 0"), items, summaries)
    return out.select("session_id", "before_records", "after_records", "citable_records", "non_citable_records", "user_message_count", "user_message_total_chars", "user_message_max_chars", "handoff_user_message_selected_count", "handoff_user_message_token_estimate", "handoff_user_message_omitted_older_count", "rehydrated_span_count", "invalid_span_count", "rehydrated_unique_lines", "evidence_capsules", "rules_and_invariants_count", "renderer", "density_pass")


_SOURCE = SENTENCES.replace("doc_id AS key", "key").replace("FROM documents WHERE length(text) > 2400", "FROM src WHERE length(text) > 200")


@query(f"""WITH RECURSIVE {R}, o AS (SELECT *, {_TRIM("prompt")} AS t FROM r WHERE line <= n - 2 AND k = 3), src AS (SELECT session_id || ':' || line AS key, t AS text FROM o), {_SOURCE},
    rr AS (SELECT key, seg, s, n, kept1, length(s) + 1 AS cost, row_number() OVER (PARTITION BY key ORDER BY alpha DESC, seg) AS i FROM al WHERE rank1 <= kept1 AND n > 1),
    ww AS (SELECT key, seg, s, n, kept1, i, cost AS used, true AS take FROM rr WHERE i = 1
           UNION ALL SELECT rr.key, rr.seg, rr.s, rr.n, rr.kept1, rr.i, CASE WHEN ww.used + rr.cost <= 150 THEN ww.used + rr.cost ELSE ww.used END, ww.used + rr.cost <= 150 FROM ww JOIN rr ON rr.key = ww.key AND rr.i = ww.i + 1),
    gg AS (SELECT *, coalesce(lag(seg) OVER (PARTITION BY key ORDER BY seg), -1) AS before FROM ww WHERE take),
    kk AS (SELECT key, any_value(n) AS n, any_value(kept1) AS kept1, count(*) AS many, string_agg(CASE WHEN seg > before + 1 THEN '[...]' || chr(10) ELSE '' END || s, chr(10) ORDER BY seg) || CASE WHEN max(seg) < any_value(n) - 1 THEN chr(10) || '[...]' ELSE '' END AS x FROM gg GROUP BY key),
    b AS (SELECT session_id, line, CASE WHEN length(t) > 200 THEN '[tool output compressed: strategy=dspc original_chars=' || length(t) || ' omitted_chars=' || greatest(length(t) - length(x), 0) || ' line=' || line || ' body_sha256=' || sha256(t) || ' record_sha256=' || hash
        || ' stage1_kept=' || kept1 || '/' || kk.n || ' stage2_kept=' || many || ']' || chr(10) || chr(10) || x ELSE t END AS body FROM o LEFT JOIN kk ON kk.key = session_id || ':' || line)
    SELECT session_id, line, sha256('@@RECORD line=' || lpad(line::VARCHAR, 6, '0') || ' type=user role=user chars=' || length(body) || chr(10) || body || chr(10) || '@@END_RECORD line=' || lpad(line::VARCHAR, 6, '0')) AS rendered_sha256 FROM b""")
def render_dspc(spark, sf_dir):
    """Stale tool outputs as the sentinel renderer shows them with sentence selection."""
    out = render.rendered(records(spark, sf_dir), "sentinel", after=2, strategy="dspc", least=200, head=100, tail=50).where("old")
    out = out.where(F.coalesce(transcripts.is_tool_output(F.col("record")), F.lit(False)))
    return out.select("session_id", "line", sha256(F.col("rendered")).alias("rendered_sha256"))
