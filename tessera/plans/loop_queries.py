"""Named queries of loops and streams over the conversations, with SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import token_counts
from tessera.functions.text import sha256
from tessera.operators import perturb, scoring, tools
from tessera.plans import reask, replay, rounds
from tessera.plans.queries import _INTENT, E, query, table, turns
from tessera.plans.record_queries import _J, quoted
from tessera.sources import folders, run_sink, saved_files, transcripts
from tessera.streaming import transcript_stream

#: Thresholds for conversations of a few turns.
LEAST = {"capsules": 4, "cited": 4, "promises": 0}
ANSWERS = 12


def _literal_line(n):
    return F.least(n, F.lit(5))


def _recorded(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Entries, a literal and answers by attempt of each conversation.

    Attempt a cites the first a + 1 turns, in blocks of their own; each fifth one breaks off.
    """
    e = folders.kept(turns(spark, sf_dir).withColumn("text", F.coalesce("text", F.lit(""))).withColumn("hash", F.sha2("text", 256)), "turns")
    s = e.groupBy("session_id").agg(F.max("line").alias("n"))
    literal = e.join(s, "session_id").where(F.col("line") == _literal_line(F.col("n"))).select("session_id", F.left("text", F.lit(40)).alias("literal")).where("literal <> ''")
    cited = F.transform(F.sequence(F.lit(1), F.least(F.col("n"), F.col("attempt") + 1)), lambda i: F.struct(F.lit("Work").alias("section"), F.lit("bullet").alias("format"), F.lit("done").alias("body"), F.array(F.struct(i.alias("start_line"), i.alias("end_line"))).alias("source_spans")))
    whole = F.to_json(F.struct(cited.alias("summary_blocks"), F.lit("go on").alias("current_work")))
    broken = F.pmod(F.col("session_id").cast("long") + F.col("attempt"), F.lit(5)) == 0
    made = s.withColumn("attempt", F.explode(F.sequence(F.lit(0), F.lit(ANSWERS)))).withColumn("output", F.when(broken, F.left(whole, F.length(whole) - 1)).otherwise(whole))
    return e, literal, made.select("session_id", "attempt", "output")


@query(f"""WITH RECURSIVE {E}, t AS (SELECT session_id, line, coalesce(text, '') AS text FROM e), s AS (SELECT session_id, max(line) AS n FROM t GROUP BY session_id),
    l AS (SELECT t.session_id, left(t.text, 40) AS literal FROM t JOIN s USING (session_id) WHERE t.line = least(s.n, 5) AND t.text <> ''),
    a AS (SELECT s.session_id, n, a, (CAST(session_id AS BIGINT) + a) % 5 <> 0 AS valid, least(n, a + 1) AS cited FROM s, (SELECT unnest(range(0, {ANSWERS + 1})) AS a)),
    v AS (SELECT a.*, least(1.0, cited / 4.0) AS density, l.literal IS NOT NULL AND NOT EXISTS (SELECT 1 FROM t WHERE t.session_id = a.session_id AND t.line <= a.cited AND contains(t.text, l.literal)) AS missing FROM a LEFT JOIN l USING (session_id)),
    w AS (SELECT session_id, a, valid, missing, density, valid AND NOT missing AND cited >= 4 AS pass FROM v),
    loop AS (SELECT * FROM w WHERE a = 0 UNION ALL SELECT w.* FROM loop JOIN w ON w.session_id = loop.session_id AND w.a = loop.a + 1 WHERE NOT loop.pass AND loop.a < 10),
    b AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY missing, density DESC, a DESC) AS r FROM loop WHERE valid),
    g AS (SELECT session_id, count(*) AS made, bool_or(pass) AS pass, arg_max(valid, a) AS last_valid FROM loop GROUP BY session_id)
    SELECT g.session_id, made, g.pass, CAST(b.a AS INTEGER) AS attempt, CAST(b.missing AS INTEGER) AS missing, CAST(density AS DOUBLE) AS density, CASE WHEN NOT last_valid AND made > 10 THEN 'output was not JSON' WHEN NOT g.pass THEN 'handoff did not pass' END AS error
    FROM g LEFT JOIN b ON b.session_id = g.session_id AND b.r = 1""")
def reask_loop(spark, sf_dir):
    """Recorded answers asked for until they pass, ten times more at most; each session's best."""
    entries, literal, answers = _recorded(spark, sf_dir)
    made = reask.attempts(entries.select("session_id").distinct(), reask.recorded(answers), lambda o: reask.judged(o, entries, literal, LEAST))
    return reask.chosen(made).drop("output")


@query(f"""WITH {E}, f AS (SELECT session_id, line, role, coalesce(text, '') AS text, sha256(coalesce(text, '')) AS hash FROM e), {_INTENT.replace("FROM e WHERE", "FROM f WHERE")},
    s AS (SELECT session_id, count(*) AS n FROM f GROUP BY session_id), l AS (SELECT session_id, left(text, 60) AS literal FROM f WHERE line = 1),
    m AS (SELECT session_id, count(*) AS messages, list_sort(list_distinct(list(hash) FILTER (WHERE priority <> 'normal'))) AS hashes FROM i GROUP BY session_id),
    r AS (SELECT s.session_id, n, unnest(range(1, 6)) AS round FROM s)
    SELECT r.session_id AS run_id, CAST(round AS INTEGER) AS round, 2 AS records, coalesce(messages, 0) AS messages, sha256(array_to_string(coalesce(hashes, []), ',')) AS high_sha256, CAST(1 + (n > 1)::INT AS INTEGER) AS capsules,
        CASE WHEN literal = '' THEN 0 WHEN round = 1 OR EXISTS (SELECT 1 FROM i WHERE i.session_id = r.session_id AND contains(i.text, literal)) THEN 0 ELSE 1 END AS missing, true AS same_objective, true AS sound
    FROM r JOIN l USING (session_id) LEFT JOIN m USING (session_id)""")
def round_gates(spark, sf_dir):
    """Five rounds of compaction over the conversations: each reads what the last one wrote. Budgets are wide enough for whole ledgers."""
    t = turns(spark, sf_dir).withColumn("text", F.coalesce("text", F.lit("")))
    lines = transcripts.from_turns(t.select(F.col("session_id").alias("conv_id"), (F.col("line") - 1).alias("turn"), "role", "text"))
    s = t.groupBy("session_id").agg(F.max("line").cast("int").alias("n"), F.count(F.lit(1)).cast("int").alias("seen"))
    block = lambda i: F.struct(F.lit("Work").alias("section"), F.lit("bullet").alias("format"), F.lit("done").alias("body"), F.array(F.struct(i.alias("start_line"), i.alias("end_line"))).alias("source_spans"))
    cited = F.when(F.col("n") > 1, F.array(block(F.lit(1)), block(F.col("n")))).otherwise(F.array(block(F.lit(1))))
    whole = F.to_json(F.struct(cited.alias("summary_blocks"), F.concat(F.lit("work "), F.col("session_id")).alias("current_work"), F.lit("go on").alias("optional_next_step"), F.struct(F.col("seen").alias("transcript_lines_seen")).alias("source_integrity")))
    literals = t.where("line = 1").select("session_id", F.left("text", F.lit(60)).alias("literal")).where("literal <> ''")
    out = rounds.rounds(lines, s.select("session_id", whole.alias("output")), literals, most_tokens=0, most_lines=0)
    digest = F.sha2(F.array_join("hashes", ","), 256)
    return out.select("run_id", "round", F.col("records").cast("int").alias("records"), "messages", digest.alias("high_sha256"), "capsules", F.col("missing").cast("int").alias("missing"), "same_objective", "sound")


def _nested(spark, sf_dir) -> DataFrame:
    """(session_id, ord, raw): each turn's text in pieces, each inside a group beside the piece before it; one to six deep."""
    c = table(spark, sf_dir, "conversations")
    text, deep = F.coalesce("text", F.lit("")), (F.pmod("turn", F.lit(6)) + 1).cast("int")
    wide = F.ceil(F.greatest(F.length(text), F.lit(1)) / deep).cast("int")
    piece = lambda i: F.substring(text, i * wide + 1, wide)
    # From the innermost piece outwards.
    inner = F.aggregate(
        F.transform(F.sequence(F.lit(1), deep), lambda i: piece(deep - i)), F.lit(""),
        lambda acc, x: F.concat(F.lit('[{"type":"text","text":'), quoted(x), F.when(acc == "", "}]").otherwise(F.concat(F.lit('},{"type":"group","content":'), acc, F.lit("}]")))),
    )
    raw = F.concat(F.lit('{"type":"user","message":{"role":"user","content":'), inner, F.lit("}}"))
    return c.select(F.col("conv_id").cast("string").alias("session_id"), F.col("turn").alias("ord"), raw.alias("raw"))


@query("""WITH c AS (SELECT CAST(conv_id AS VARCHAR) AS session_id, turn, coalesce(text, '') AS text, turn % 6 + 1 AS deep, CAST(ceil(greatest(length(coalesce(text, '')), 1) / (turn % 6 + 1)) AS INTEGER) AS wide FROM conversations),
    p AS (SELECT *, [substr(text, CAST(i * wide + 1 AS INTEGER), wide) FOR i IN range(0, deep) IF substr(text, CAST(i * wide + 1 AS INTEGER), wide) <> ''] AS pieces FROM c)
    SELECT session_id, CAST(row_number() OVER (PARTITION BY session_id ORDER BY turn) AS INTEGER) AS line, sha256(array_to_string(pieces, chr(10) || chr(10))) AS text_sha256 FROM p WHERE len(pieces) > 0""")
def nested_content(spark, sf_dir):
    """Records whose text stands one to six parts deep, cited like others."""
    return tools.citable(_nested(spark, sf_dir)).select("session_id", "line", sha256(F.col("text")).alias("text_sha256"))


@query(f"""WITH t AS (SELECT CAST(conv_id AS VARCHAR) AS session_id, turn, coalesce(text, '') AS text FROM conversations),
    s AS (SELECT session_id, repeat('{{"x":[1,', CAST(turn % 5 AS INTEGER)) || '{{"unknown":' || {_J("text")} || ',"source_spans":[{{"start_line":' || (turn + 1) || ',"end_line":' || (turn + 1 + turn % 3) || '}},{{"start_line":1.5,"end_line":2}},{{"start_line":"1","end_line":2}},{{"start_line":' || (turn % 4) || ',"end_line":3}}]}}' || repeat(']}}', CAST(turn % 5 AS INTEGER)) AS state FROM t),
    w AS (SELECT session_id, unnest(from_json(j.value, '["JSON"]')) AS span FROM s, json_tree(s.state) j WHERE j.key = 'source_spans' AND j.type = 'ARRAY'),
    e AS (SELECT session_id, CAST(span ->> '$.start_line' AS BIGINT) AS a, CAST(span ->> '$.end_line' AS BIGINT) AS b FROM w WHERE json_type(span, '$.start_line') IN ('UBIGINT', 'BIGINT') AND json_type(span, '$.end_line') IN ('UBIGINT', 'BIGINT'))
    SELECT session_id, count(*) AS spans, count(*) FILTER (WHERE a < 1 OR b < a) AS invalid, (SELECT count(DISTINCT x) FROM (SELECT unnest(range(a, b + 1)) AS x FROM e q WHERE q.session_id = e.session_id AND q.a >= 1)) AS unique_lines FROM e GROUP BY session_id""")
def nested_spans(spark, sf_dir):
    """Spans from any place of states, beside a turn's text and inside up to four levels of unknown fields."""
    n = F.col("turn")
    deep = F.pmod(n, F.lit(5)).cast("int")
    span = lambda a, b: F.concat(F.lit('{"start_line":'), a.cast("string"), F.lit(',"end_line":'), b.cast("string"), F.lit("}"))
    own = F.concat(F.lit('{"unknown":'), quoted(F.coalesce("text", F.lit(""))), F.lit(',"source_spans":['), F.concat_ws(",", span(n + 1, n + 1 + F.pmod(n, F.lit(3))), F.lit('{"start_line":1.5,"end_line":2}'), F.lit('{"start_line":"1","end_line":2}'), span(F.pmod(n, F.lit(4)), F.lit(3))), F.lit("]}"))
    state = F.concat(F.repeat(F.lit('{"x":[1,'), deep), own, F.repeat(F.lit("]}"), deep))
    states = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("session_id"), state.alias("state"))
    return scoring.span_metrics(scoring.state_spans(states))


def _growing(spark, sf_dir) -> DataFrame:
    """(session_id, ord, raw): users' and assistants' turns; each fourth is a summary that carries two messages, one of them still there."""
    c = table(spark, sf_dir, "conversations").withColumn("text", F.coalesce("text", F.lit("")))
    turn, conv = F.col("turn").cast("string"), F.col("conv_id").cast("string")
    user = F.concat(F.lit('{"type":"'), F.col("role"), F.lit('","uuid":"u-'), conv, F.lit("-"), turn, F.lit('","message":{"role":"'), F.col("role"), F.lit('","content":'), quoted(F.col("text")), F.lit("}}"))
    one = lambda key: F.concat(F.lit('<user-message source="current" line="1" chars="4" uuid="'), key, F.lit('">\nkept\n</user-message>'))
    carried = F.concat(one(F.concat(F.lit("u-"), conv, F.lit("-"), (F.col("turn") - 1).cast("string"))), F.lit("\n"), one(F.concat(F.lit("old-"), conv, F.lit("-"), turn)))
    summary = F.concat(F.lit('{"type":"user","isCompactSummary":true,"message":{"role":"user","content":'), quoted(carried), F.lit("}}"))
    raw = F.when(F.pmod("turn", F.lit(4)) == 3, summary).otherwise(user)
    return c.select(conv.alias("session_id"), F.col("turn").alias("ord"), raw.alias("raw"))


@query("""WITH c AS (SELECT CAST(conv_id AS VARCHAR) AS session_id, turn, role, coalesce(text, '') AS text FROM conversations),
    u AS (SELECT session_id, 'u-' || session_id || '-' || turn AS uuid, 1 AS side, turn * 2 AS place, 'current' AS source, text FROM c WHERE turn % 4 <> 3 AND role = 'user' AND regexp_replace(text, '{WS}+', '', 'g') <> ''),
    k AS (SELECT session_id, 'u-' || session_id || '-' || (turn - 1) AS uuid, 0 AS side, turn * 2 AS place, 'carried' AS source, 'kept' AS text FROM c WHERE turn % 4 = 3 UNION ALL SELECT session_id, 'old-' || session_id || '-' || turn, 0, turn * 2 + 1, 'carried', 'kept' FROM c WHERE turn % 4 = 3),
    a AS (SELECT * FROM u UNION ALL SELECT * FROM k WHERE uuid NOT IN (SELECT uuid FROM u))
    SELECT session_id, CAST(row_number() OVER (PARTITION BY session_id ORDER BY side, place) AS INTEGER) AS ord, uuid, source, sha256(text) AS text_sha256 FROM a""")
def transcript_stream_ledger(spark, sf_dir):
    """Transcripts read as a stream, cut in mid-line, over two runs of the query; the ledger that its changes lead to."""
    transcript_stream.prepare(spark)
    lines = folders.kept(_growing(spark, sf_dir), "lines")
    w = Window.partitionBy("session_id").orderBy("ord")
    half = F.floor(F.length("raw") / 2).cast("int")
    rest = F.substring("raw", half + 1, F.length("raw") - half)
    cut = lines.withColumn("before", F.lag(rest).over(w)).withColumn("last", F.lead("ord").over(w).isNull())
    # A chunk is the end of a line, its line feed, and the first half of the next; the last one ends the session.
    chunk = F.concat(F.coalesce(F.concat("before", F.lit("\n")), F.lit("")), F.left("raw", half), F.when(F.col("last"), F.concat(rest, F.lit("\n"))).otherwise(F.lit("")))
    chunks = folders.kept(cut.select("session_id", F.format_string("%012d", "ord").alias("seq"), chunk.cast("binary").alias("chunk"), (F.col("ord") >= 3).alias("late")), "chunks")
    folder = folders.scratch(spark, "stream")
    for late in (False, True):
        chunks.where(F.col("late") == late).select("session_id", "seq", "chunk").write.parquet(f"{folder}/in/late={late}")
        source = spark.readStream.schema("session_id string, seq string, chunk binary").option("recursiveFileLookup", "true").parquet(f"{folder}/in")
        changes = transcript_stream.ledger_changes(transcript_stream.lines(source))
        run = changes.writeStream.format("parquet").option("path", f"{folder}/changes").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
        run.awaitTermination()
    out = transcript_stream.ledger_of(spark.read.schema(transcript_stream.CHANGE).parquet(f"{folder}/changes"))
    return out.select("session_id", "ord", "uuid", "source", sha256(F.col("text")).alias("text_sha256"))


@query("""WITH d AS (SELECT CAST(doc_id // 10 AS VARCHAR) AS run_id, doc_id % 10 AS k, coalesce(text, '') AS text FROM documents), w AS (SELECT run_id FROM d GROUP BY run_id HAVING count(DISTINCT k) = 10)
    SELECT run_id, ['summary', 'timeline', 'user_messages', 'spans', 'rehydrated', 'state', 'manifest', 'handoff', 'after_transcript', 'result'][k + 1] AS kind, strlen(text) AS bytes, sha256(text) AS sha256, true AS sound FROM d JOIN w USING (run_id)""")
def run_folders(spark, sf_dir):
    """Texts as artifacts of runs, ten each, written to run folders and read back by their manifests."""
    d = table(spark, sf_dir, "documents")
    kind = F.element_at(F.array(*map(F.lit, run_sink.KINDS)), F.pmod("doc_id", F.lit(10)).cast("int") + 1)
    folder = folders.scratch(spark, "runs")
    run_sink.write_runs(d.select(F.floor(F.col("doc_id") / 10).cast("string").alias("run_id"), kind.alias("kind"), F.coalesce("text", F.lit("")).alias("content")), folder)
    read = run_sink.read_runs(spark, folder)
    return read.select("run_id", "kind", F.octet_length("content").cast("long").alias("bytes"), sha256(F.col("content")).alias("sha256"), "sound")


@query()
def exact_token_counts(spark, sf_dir):
    """Token counts of whole texts by a tokenizer file, beside the estimate; a test holds them against the tokenizer."""
    import public_tokenizers

    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    both = token_counts.counted(token_counts.counted(d, "text", "estimated"), "text", "exact", public_tokenizers.path("byte_bpe_50k.json"))
    return both.select("doc_id", "estimated", "exact")


_CLAIM = perturb.OVERSTATED


@query(rf"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_replace(left(coalesce(text, ''), 40), '[^A-Za-z ]', ' ', 'g') AS x FROM documents),
    s AS (SELECT doc_id, '# Handoff' AS head, '## Next Step' || chr(10) || '- [pending] ' || x AS nxt, '## Rules And Invariants' || chr(10) || '- keep ' || x AS rul, '## Open Constraints' || chr(10) || '- never ' || x AS con, '## Active Files' || chr(10) || '- f.py' AS act, '## Artifacts' || chr(10) || '- m' AS art, '## Work' || chr(10) || '- see `src/a.py` at /w/real' || chr(10) || t AS wrk FROM d),
    v AS (SELECT doc_id, concat_ws(chr(10), head, nxt, rul, con, act, art, wrk) AS whole, unnest([
        struct_pack(variant := 'clean', x := concat_ws(chr(10), head, nxt, rul, con, act, art, wrk)),
        struct_pack(variant := 'drop_next_action', x := regexp_replace(regexp_replace(concat_ws(chr(10), head, rul, con, act, art, wrk), '(?im)^.*\[(?:pending|todo|in[_ -]?progress|open|active|[ ])\].*$', '', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g')),
        struct_pack(variant := 'drop_rules', x := concat_ws(chr(10), head, nxt, act, art, wrk)),
        struct_pack(variant := 'inject_overstatement', x := concat_ws(chr(10), head, '', '- {_CLAIM}', nxt, rul, con, act, art, wrk)),
        struct_pack(variant := 'factual_drift', x := concat_ws(chr(10), head, nxt, rul, con, act, art, replace(wrk, '/w/real', '/w/other'))),
        struct_pack(variant := 'reformat_headers', x := regexp_replace(regexp_replace(concat_ws(chr(10), head, nxt, rul, con, act, art, wrk), '(?m)^## (.+)$', '=== \1 ===', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g')),
        struct_pack(variant := 'bullet_restyle', x := regexp_replace(concat_ws(chr(10), head, nxt, rul, con, act, art, wrk), '(?m)^- ', '* ', 'g'))]) AS v FROM s)
    SELECT doc_id AS run_id, v.variant AS variant, v.variant = 'clean' OR v.x <> whole AS applied, sha256(v.x) AS text_sha256 FROM v""")
def handoff_variants(spark, sf_dir):
    """Handoffs made of whole documents, made worse or only different; what names files is told apart in a test."""
    d = table(spark, sf_dir, "documents").withColumn("text", F.coalesce("text", F.lit("")))
    x = F.regexp_replace(F.left("text", F.lit(40)), "[^A-Za-z ]", " ")
    part = lambda *xs: F.concat(*(F.lit(y) if isinstance(y, str) else y for y in xs))
    handoff = F.concat_ws("\n", F.lit("# Handoff"), part("## Next Step\n- [pending] ", x), part("## Rules And Invariants\n- keep ", x), part("## Open Constraints\n- never ", x), F.lit("## Active Files\n- f.py"), F.lit("## Artifacts\n- m"), part("## Work\n- see `src/a.py` at /w/real\n", F.col("text")))
    v = perturb.variants(d.select(F.col("doc_id").alias("run_id"), handoff.alias("handoff")), F.lit("/w/real"), F.lit("/w/other"))
    return v.where("variant <> 'strip_artifacts'").select("run_id", "variant", "applied", sha256(F.col("text")).alias("text_sha256"))


#: What is wrong with a conversation's saved output, by its number.
_SAVED = f"""f AS (SELECT session_id, line, role, coalesce(text, '') AS text, sha256(coalesce(text, '')) AS hash FROM e), {_INTENT.replace("FROM e WHERE", "FROM f WHERE")},
    r AS (SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY line) AS line, text FROM f),
    n AS (SELECT session_id, count(*) AS n, CAST(session_id AS BIGINT) % 8 AS c FROM f GROUP BY session_id)"""


@query(f"""WITH {E}, {_SAVED}, m AS (SELECT session_id, count(*) AS messages FROM i GROUP BY session_id),
    p AS (SELECT n.session_id, string_agg('- span-000' || k || ' | Work | lines ' || r.line || '-' || r.line || ' | chars 0-' || length(r.text) || ' | code capsules 0' || chr(10) || '```' || chr(10) || regexp_replace(r.text, '\\n\\z', '') || chr(10) || '```', chr(10) || chr(10) ORDER BY k) AS parts
        FROM n, (SELECT unnest([1, 2]) AS k) x, r WHERE r.session_id = n.session_id AND r.line = CASE k WHEN 1 THEN 1 ELSE n.n END GROUP BY n.session_id)
    SELECT n.session_id, CASE c WHEN 1 THEN '{replay.NOT_JSON}' WHEN 2 THEN 'summary_blocks has a bad span' WHEN 3 THEN 'current_work must not be blank' WHEN 4 THEN 'rules_and_invariants has an unknown status' WHEN 5 THEN 'transcript_lines_seen differs' END AS error,
        CASE WHEN c IN (0, 6, 7) THEN 10 END AS artifacts, CASE WHEN c IN (0, 6, 7) THEN CAST(least(64, coalesce(messages, 0)) AS BIGINT) END AS messages, CASE WHEN c IN (0, 6, 7) THEN true END AS sound,
        CASE WHEN c IN (0, 6, 7) THEN sha256('## Work' || chr(10) || CASE c WHEN 7 THEN '' ELSE '- ' END || 'turn ' || n.n || chr(10) || '- last' || chr(10) || chr(10) || '## Rehydration Spans' || chr(10) || trim(parts, chr(10)) || chr(10)) END AS rehydrated_sha256
    FROM n JOIN p USING (session_id) LEFT JOIN m USING (session_id)""")
def replayed_runs(spark, sf_dir):
    """Saved outputs of all conversations, five of eight broken in some way, replayed into run folders and read back."""
    t = turns(spark, sf_dir).withColumn("text", F.coalesce("text", F.lit("")))
    lines = transcripts.from_turns(t.select(F.col("session_id").alias("conv_id"), (F.col("line") - 1).alias("turn"), "role", "text"))
    c, n = F.pmod(F.col("session_id").cast("long"), F.lit(8)), F.col("n")
    block = lambda form, body, a, b: F.struct(F.lit("Work").alias("section"), form.alias("format"), body.alias("body"), F.array(F.struct(a.alias("start_line"), b.alias("end_line"))).alias("source_spans"))
    blocks = F.array(block(F.when(c == 7, "code_block").otherwise("bullet"), F.concat(F.lit("turn "), n.cast("string")), F.lit(1), F.lit(1)), block(F.lit("bullet"), F.lit("last"), n, F.when(c == 2, n + 1).otherwise(n)))
    rule = F.struct(F.lit("keep rows").alias("rule"), F.when(c == 4, "kept").otherwise("superseded").alias("status"), F.array().cast("array<string>").alias("source_spans"))
    rules = F.when(c == 4, F.array(rule)).otherwise(F.array().cast("array<struct<rule:string,status:string,source_spans:array<string>>>"))
    output = F.to_json(F.struct(
        blocks.alias("summary_blocks"), rules.alias("rules_and_invariants"), F.array().cast("array<string>").alias("plans_and_task_state"), F.when(c == 3, " ").otherwise("work").alias("current_work"), F.lit("go on").alias("optional_next_step"),
        F.struct(F.lit("/w").alias("cwd")).alias("pickup_state"), F.struct(F.when(c == 5, n + 7).otherwise(n).alias("transcript_lines_seen")).alias("source_integrity"),
    ))
    s = t.groupBy("session_id").agg(F.count(F.lit(1)).cast("int").alias("n"))
    made = s.select("session_id", F.when(c == 1, F.left(output, F.length(output) - 2)).otherwise(output).alias("value"))
    root = folders.scratch(spark, "replay")
    # A file for each session, in a folder of its name, as saved outputs lie.
    saved_files.write_files(made.select(F.col("session_id").alias("run_id"), F.lit("output.txt").alias("kind"), F.col("value").alias("content")), f"{root}/saved")
    out = replay.replayed(replay.saved(spark, f"{root}/saved/*"), lines, most_tokens=0, most_lines=0)
    run_sink.write_runs(out.artifacts, f"{root}/runs")
    runs = run_sink.read_runs(spark, f"{root}/runs")
    of = lambda kind: F.max(F.when(F.col("kind") == kind, F.col("content")))
    read = runs.groupBy(F.col("run_id").alias("session_id")).agg(
        F.count(F.lit(1)).cast("int").alias("artifacts"), F.coalesce(F.size(F.from_json(of("user_messages"), "array<struct<id:string>>")), F.lit(0)).cast("long").alias("messages"), F.bool_and("sound").alias("sound"), sha256(of("rehydrated")).alias("rehydrated_sha256"),
    )
    return s.select("session_id").join(out.rejected.select("session_id", "error"), "session_id", "left").join(read, "session_id", "left")
