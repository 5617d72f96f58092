"""Named queries over the standard tables, each with SQL that gives the same rows.

The tables hold no tool records or summaries, so operators are bound to stand-ins: conversations are
transcripts, documents are tool output, spans are derived from turn numbers.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import intents, literals
from tessera.functions.text import sha256, tokens
from tessera.operators import compress, diff, dspc, judging, ledger, ranking, render, scoring, spans, stats, summary
from tessera.plans import compact
from tessera.sources import sse, transcripts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

WS = r"[\t-\r \x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql.replace("{WS}", WS)
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transcripts.numbered(transcripts.from_turns(table(spark, sf_dir, "conversations")))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns with the columns of entries, without the way through JSON."""
    c = table(spark, sf_dir, "conversations")
    return c.select(F.col("conv_id").cast("string").alias("session_id"), (F.col("turn") + 1).alias("line"), "role", "text", sha256(F.col("text")).alias("hash"))


#: Conversations as entries: line, role, text, hash by session.
E = "e AS (SELECT CAST(conv_id AS VARCHAR) AS session_id, turn + 1 AS line, role, text, sha256(text) AS hash FROM conversations)"


@query(f"""WITH {E} SELECT session_id, CAST(row_number() OVER (PARTITION BY session_id ORDER BY line) AS INTEGER) AS line, text,
    'type=' || role || ' | role=' || role || CASE WHEN text <> '' THEN ' | text=' || left(regexp_replace(text, '{{WS}}+', ' ', 'g'), 160) ELSE '' END AS preview FROM e""".replace("{{WS}}", "{WS}"))
def entry_preview(spark, sf_dir):
    return entries(spark, sf_dir).select("session_id", "line", "text", "preview")


@query(f"WITH {E} SELECT session_id, line, hash, length(text) AS chars, strlen(text) AS bytes, CAST(ceil(length(text) / 4.0) AS BIGINT) AS tokens FROM e")
def entries_numbered(spark, sf_dir):
    t = turns(spark, sf_dir)
    number = F.row_number().over(Window.partitionBy("session_id").orderBy("line")).cast("long")
    return t.select("session_id", number.alias("line"), "hash", F.length("text").cast("long").alias("chars"), F.octet_length("text").cast("long").alias("bytes"), tokens(F.length("text")).alias("tokens"))


@query(f"""WITH {E}, k AS (SELECT *, CASE role WHEN 'user' THEN 'user_message' WHEN 'assistant' THEN 'assistant_message' ELSE 'system' END AS kind FROM e)
    SELECT kind, count(*) AS records, CAST(sum(length(text)) AS BIGINT) AS chars, max(length(text)) AS longest FROM k GROUP BY kind""")
def record_kind_counts(spark, sf_dir):
    e = entries(spark, sf_dir).withColumn("kind", transcripts.kind(F.col("record")))
    return e.groupBy("kind").agg(F.count(F.lit(1)).alias("records"), F.sum(F.length("text")).cast("long").alias("chars"), F.max(F.length("text")).cast("long").alias("longest"))


@query(f"""WITH {E}, f AS (SELECT *, CAST(line AS VARCHAR) || '|' || role || chr(10) || text AS r FROM e),
    g0 AS (SELECT 'role' AS grouping, role AS key, * FROM f UNION ALL SELECT 'session_id', session_id, * FROM f), g AS (SELECT *, max(length(r)) OVER (PARTITION BY grouping, key) AS most FROM g0)
    SELECT grouping, key, count(*) AS records, CAST(sum(strlen(text)) AS BIGINT) AS raw_bytes, CAST(sum(length(text)) AS BIGINT) AS raw_chars, CAST(sum(length(text)) AS BIGINT) AS prompt_chars,
           CAST(sum(length(r)) AS BIGINT) AS rendered_chars, CAST(sum(strlen(r)) AS BIGINT) AS rendered_bytes, max(length(r)) AS max_rendered_chars, min(line) FILTER (WHERE length(r) = most) AS max_line FROM g GROUP BY grouping, key""")
def render_stats_grouping_sets(spark, sf_dir):
    t = turns(spark, sf_dir).withColumn("r", F.concat(F.col("line").cast("string"), F.lit("|"), F.col("role"), F.lit("\n"), F.col("text")))
    return stats.by_each(stats.measured(t, "text", "text", "r"), ["session_id", "role"])


@query(f"""WITH {E} SELECT session_id, line, strlen(text) AS rendered_bytes FROM e ORDER BY strlen(text) DESC, session_id, line LIMIT 15""")
def top_rendered_records(spark, sf_dir):
    t = turns(spark, sf_dir).withColumn("rendered_bytes", F.octet_length("text").cast("long"))
    return stats.top(t, "rendered_bytes").select("session_id", "line", "rendered_bytes")


@query(f"WITH {E} SELECT session_id, line, line <= count(*) OVER (PARTITION BY session_id) - 3 AS old FROM e")
def recency_old_flag(spark, sf_dir):
    return render.with_old(turns(spark, sf_dir), after=3).select("session_id", "line", "old")


_HT = """h AS (SELECT doc_id, text, length(text) AS n, sha256(text) AS d, regexp_replace(left(text, 900), '\\n\\z', '') AS a,
    regexp_replace(regexp_replace(substr(text, greatest(length(text) - 500, 900) + 1), '\\A\\n', ''), '\\n\\z', '') AS b FROM documents)"""


@query(f"""WITH {_HT} SELECT doc_id, n > 2400 AS compressed, CASE WHEN n > 2400 THEN n END AS original_chars, CASE WHEN n > 2400 THEN greatest(n - length(a) - length(b), 0) END AS omitted_chars,
    sha256(CASE WHEN n > 2400 THEN a || chr(10) || chr(10) || '[tool output compressed: original_chars=' || n || ' omitted_chars=' || greatest(n - length(a) - length(b), 0) || ' line=' || doc_id || ' body_sha256=' || d || ' record_sha256=' || d || ']' || chr(10) || chr(10) || b ELSE text END) AS body_sha256 FROM h""")
def headtail_documents(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    c = compress.headtail(F.col("text"), F.col("doc_id"), sha256(F.col("text")))
    return d.select("doc_id", c.alias("c")).select("doc_id", "c.compressed", "c.original_chars", "c.omitted_chars", sha256(F.col("c.body")).alias("body_sha256"))


@query("""SELECT doc_id, length(text) > 2400 AS compressed, sha256(CASE WHEN length(text) > 2400 THEN '[tool output masked: strategy=mask original_chars=' || length(text) || ' original_lines=' || (length(text) - length(replace(text, chr(10), '')) + 1)
    || ' omitted_chars=' || length(text) || ' line=' || doc_id || ' body_sha256=' || sha256(text) || ' record_sha256=' || sha256(text) || ']' ELSE text END) AS body_sha256 FROM documents""")
def mask_documents(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    c = compress.mask(F.col("text"), F.col("doc_id"), sha256(F.col("text")))
    return d.select("doc_id", c.alias("c")).select("doc_id", "c.compressed", sha256(F.col("c.body")).alias("body_sha256"))


@query("""SELECT doc_id, sha256(CASE WHEN length(text) > 2000 THEN left(text, 1100) || chr(10) || '[... omitted ' || (length(text) - 2000) || ' chars ...]' || chr(10) || substr(text, greatest(length(text) - 900, 1100) + 1) ELSE text END) AS body_sha256 FROM documents""")
def judge_truncate(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", sha256(compress.truncated(F.col("text"), 2000)).alias("body_sha256"))


def _collapse_sql(least: int, head: int, tail: int, source: str, key: str) -> str:
    return f"""WITH h AS (SELECT {key}, text, length(text) AS n, regexp_replace(left(text, {head}), '\\n\\z', '') AS a, regexp_replace(regexp_replace(substr(text, greatest(length(text) - {tail}, {head}) + 1), '\\A\\n', ''), '\\n\\z', '') AS b FROM {source})
    SELECT {key}, n > {least} AS compressed, sha256(CASE WHEN n > {least} THEN a || chr(10) || chr(10) || '[... omitted ' || greatest(n - length(a) - length(b), 0) || ' chars ...]' || chr(10) || chr(10) || b ELSE text END) AS body_sha256 FROM h"""


@query(_collapse_sql(2400, 1200, 800, "documents", "doc_id"))
def tail_collapse(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", compress.collapsed_tail(F.col("text")).alias("c"))
    return d.select("doc_id", "c.compressed", sha256(F.col("c.body")).alias("body_sha256"))


@query(_collapse_sql(300, 120, 100, "conversations", "conv_id, turn"))
def user_collapse(spark, sf_dir):
    d = table(spark, sf_dir, "conversations").select("conv_id", "turn", compress.collapsed_message(F.col("text"), 300, 120, 100).alias("c"))
    return d.select("conv_id", "turn", "c.compressed", sha256(F.col("c.body")).alias("body_sha256"))


_SPLICE = "replace(text, '. ', '.' || chr(10) || repeat('=', 24) || chr(10) || chr(10) || chr(10) || chr(10) || '  ' || chr(10))"


@query(f"""WITH s AS (SELECT doc_id, coalesce({_SPLICE}, '') AS t FROM documents),
    l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS x, generate_subscripts(string_split(t, chr(10)), 1) AS i FROM s),
    k AS (SELECT *, NOT regexp_full_match(x, '{{WS}}*') AS solid FROM l WHERE NOT regexp_full_match(regexp_replace(regexp_replace(x, '^{{WS}}+', ''), '{{WS}}+$', ''), '[=_*-]{{20,}}')),
    g AS (SELECT *, count(*) FILTER (WHERE solid) OVER (PARTITION BY doc_id ORDER BY i) AS grp FROM k),
    r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, grp, solid ORDER BY i) AS run FROM g)
    SELECT doc_id, sha256(string_agg(CASE WHEN solid THEN x ELSE '' END, chr(10) ORDER BY i)) AS clean_sha256 FROM r WHERE solid OR run <= 2 GROUP BY doc_id""".replace("{{WS}}", "{WS}"))
def separators_and_blank_runs(spark, sf_dir):
    gap = ".\n" + "=" * 24 + "\n\n\n\n  \n"
    d = table(spark, sf_dir, "documents").select("doc_id", F.coalesce(F.replace("text", F.lit(". "), F.lit(gap)), F.lit("")).alias("t"))
    return render.with_clean_lines(d, "t").select("doc_id", sha256(F.col("clean")).alias("clean_sha256"))


_BODY = "trim(text, ' ' || chr(10) || chr(9) || chr(13))"


@query(f"""WITH {E} SELECT session_id, line, sha256(line || '|' || role || chr(10) || {_BODY}) AS rendered_sha256 FROM e""")
def render_onto(spark, sf_dir):
    return render.rendered(entries(spark, sf_dir), "onto").select("session_id", F.col("line").cast("long").alias("line"), sha256(F.col("rendered")).alias("rendered_sha256"))


@query(f"""WITH {E} SELECT session_id, line, sha256('@@RECORD line=' || lpad(line::VARCHAR, 6, '0') || ' type=' || role || ' role=' || role || ' chars=' || length({_BODY}) || chr(10) || {_BODY} || chr(10) || '@@END_RECORD line=' || lpad(line::VARCHAR, 6, '0')) AS rendered_sha256 FROM e""")
def render_sentinel(spark, sf_dir):
    return render.rendered(entries(spark, sf_dir), "sentinel").select("session_id", F.col("line").cast("long").alias("line"), sha256(F.col("rendered")).alias("rendered_sha256"))


@query(f"""WITH {E} SELECT session_id, sha256(string_agg('<record line="' || lpad(line::VARCHAR, 6, '0') || '" type="' || role || '" role="' || role || '">' || chr(10) || {_BODY} || chr(10) || '</record>', chr(10) ORDER BY line)) AS transcript_sha256 FROM e GROUP BY session_id""")
def render_stripped(spark, sf_dir):
    return render.wrapped(render.rendered(entries(spark, sf_dir), "stripped"), "stripped").select("session_id", sha256(F.col("transcript")).alias("transcript_sha256"))


#: Sentences of documents, with their tokens and terms; scores are rounded before they are compared.
_SEG = """l AS (SELECT doc_id AS key, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS li FROM documents WHERE length(text) > 2400),
    p AS (SELECT key, li, unnest(string_split(regexp_replace(x, '([.!?]){WS}+', '\\1' || chr(1), 'g'), chr(1))) AS s, generate_subscripts(string_split(regexp_replace(x, '([.!?]){WS}+', '\\1' || chr(1), 'g'), chr(1)), 1) AS si FROM l),
    seg AS (SELECT key, row_number() OVER (PARTITION BY key ORDER BY li, si) - 1 AS seg, s FROM p WHERE NOT regexp_full_match(s, '{WS}*')),
    tok AS (SELECT key, seg, unnest(regexp_extract_all(lower(s), '[a-z0-9_]+')) AS term FROM seg),
    n AS (SELECT key, count(*) AS n FROM seg GROUP BY key),
    st AS (SELECT key, term, count(*) AS tf, count(DISTINCT seg) AS df, any_value(n) AS n FROM tok JOIN n USING (key) GROUP BY key, term),
    q AS (SELECT *, ln(n / df) AS idf, row_number() OVER (PARTITION BY key ORDER BY round(tf * ln(n / df), 9) DESC, term) AS rank FROM st),
    a AS (SELECT t.key, t.seg, count(*) AS size, sum(CASE WHEN q.rank <= 12 THEN idf ELSE 0 END) AS asked, sum(tf * idf) AS salient, sum(idf) AS told FROM tok t JOIN q ON q.key = t.key AND q.term = t.term GROUP BY t.key, t.seg),
    sc AS (SELECT seg.key, seg.seg, s, n, round(coalesce(asked / sqrt(size), 0), 9) AS stage1, round(coalesce(salient / size, 0), 9) AS attention, round(coalesce(told / size, 0), 9) AS info
           FROM seg JOIN n ON n.key = seg.key LEFT JOIN a ON a.key = seg.key AND a.seg = seg.seg),
    al AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY stage1 DESC, seg) AS rank1, CAST(greatest(1, floor(0.7::DOUBLE * n)) AS INTEGER) AS kept1,
           round(0.6 * coalesce(attention / nullif(max(attention) OVER (PARTITION BY key), 0), 0) + 0.3 * coalesce(info / nullif(max(info) OVER (PARTITION BY key), 0), 0)
               + 0.1 * (1 + exp(-pow(seg - n / 2, 2) / (2 * pow(greatest(n * 0.25::DOUBLE, 1), 2)))), 9) AS alpha FROM sc)"""


#: The same, with white space as the queries' SQL writes it, for other sources of texts.
SENTENCES = _SEG.replace("{WS}", WS)


def _long(spark, sf_dir):
    return table(spark, sf_dir, "documents").where(F.length("text") > 2400).select(F.col("doc_id").alias("key"), "text")


@query(f"WITH {_SEG} SELECT key, term, tf, df, n, round(idf, 9) AS idf FROM q")
def dspc_tokens_df_idf(spark, sf_dir):
    return dspc.terms(dspc.segments(_long(spark, sf_dir))).select("key", "term", "tf", "df", F.col("n").cast("long").alias("n"), F.round("idf", 9).alias("idf"))


@query(f"""WITH {_SEG} SELECT key, term, CAST(rank AS INTEGER) AS rank FROM q WHERE rank <= 12""")
def dspc_query_terms(spark, sf_dir):
    return dspc.query_terms(dspc.segments(_long(spark, sf_dir))).select("key", "term", "rank")


@query(f"""WITH {_SEG} SELECT key, seg, round(stage1, 6) AS stage1, round(attention, 6) AS attention, round(info, 6) AS info, round(alpha, 6) AS alpha FROM al""")
def dspc_stage1(spark, sf_dir):
    # Outer: a filter for what is empty would work scores out again, for each sentence.
    s = dspc.scored(dspc.segments(_long(spark, sf_dir))).select("key", F.inline_outer("scores")).where("seg IS NOT NULL")
    return s.select("key", F.col("seg").cast("long").alias("seg"), *(F.round(c, 6).alias(c) for c in ("stage1", "attention", "info", "alpha")))


@query(f"""WITH RECURSIVE {_SEG}, r AS (SELECT key, seg, s, n, kept1, length(s) + 1 AS cost, row_number() OVER (PARTITION BY key ORDER BY alpha DESC, seg) AS k FROM al WHERE rank1 <= kept1 AND n > 1),
    w AS (SELECT key, seg, s, n, kept1, k, cost AS used, true AS take FROM r WHERE k = 1
          UNION ALL SELECT r.key, r.seg, r.s, r.n, r.kept1, r.k, CASE WHEN w.used + r.cost <= 1400 THEN w.used + r.cost ELSE w.used END, w.used + r.cost <= 1400 FROM w JOIN r ON r.key = w.key AND r.k = w.k + 1),
    g AS (SELECT *, coalesce(lag(seg) OVER (PARTITION BY key ORDER BY seg), -1) AS before FROM w WHERE take),
    kept AS (SELECT key, any_value(n) AS n, any_value(kept1) AS kept1, count(*) AS many, string_agg(CASE WHEN seg > before + 1 THEN '[...]' || chr(10) ELSE '' END || s, chr(10) ORDER BY seg) || CASE WHEN max(seg) < any_value(n) - 1 THEN chr(10) || '[...]' ELSE '' END AS t FROM g GROUP BY key),
    d AS (SELECT doc_id, text, sha256(text) AS h, length(text) AS c FROM documents WHERE length(text) > 2400)
    SELECT key, length(t) AS kept_chars, sha256('[tool output compressed: strategy=dspc original_chars=' || c || ' omitted_chars=' || greatest(c - length(t), 0) || ' line=' || key || ' body_sha256=' || h || ' record_sha256=' || h
        || ' stage1_kept=' || kept1 || '/' || n || ' stage2_kept=' || many || ']' || chr(10) || chr(10) || t) AS body_sha256 FROM kept JOIN d ON d.doc_id = kept.key""")
def dspc_selected(spark, sf_dir):
    rows = _long(spark, sf_dir).select("key", "text", F.col("key").alias("line"), sha256(F.col("text")).alias("hash"))
    marked = F.regexp_replace("c.body", r"\A[^\n]*\n\n", "")
    return dspc.compressed(rows).select("key", F.length(marked).cast("long").alias("kept_chars"), sha256(F.col("c.body")).alias("body_sha256"))


_KIND = """CASE WHEN regexp_matches(lower(text), '\\b(do not|don''t|never|must|always|required|require|preserve|keep|avoid|only)\\b') THEN 'constraint'
    WHEN regexp_matches(lower(text), '\\b(secret|credential|token|key|password|safety|security|private)\\b') THEN 'safety'
    WHEN regexp_matches(lower(text), '\\b(actually|correction|instead|scratch that|not that|supersede)\\b') THEN 'correction'
    WHEN regexp_matches(lower(text), '\\b(prefer|preference|style|tone|format)\\b') THEN 'preference' ELSE 'request' END"""
_INTENT = f"""k AS (SELECT *, {_KIND} AS kind FROM e WHERE role = 'user' AND trim(text) <> ''),
    i AS (SELECT *, CASE WHEN kind = 'safety' THEN 'must_keep' WHEN regexp_matches(lower(text), '\\b(do not|don''t|never|must|required|preserve|keep)\\b') OR kind IN ('correction', 'constraint') THEN 'high' ELSE 'normal' END AS priority FROM k)"""


@query(f"WITH {E}, {_INTENT} SELECT session_id, line, hash AS sha256, length(text) AS char_count, kind, priority FROM i")
def user_messages(spark, sf_dir):
    m = ledger.with_priority(ledger.messages(entries(spark, sf_dir)))
    return m.select("session_id", F.col("line").cast("long").alias("line"), "sha256", "char_count", "kind", "priority")


@query("""SELECT doc_id, kind, CASE WHEN kind = 'safety' THEN 'must_keep' WHEN strong OR kind IN ('correction', 'constraint') THEN 'high' ELSE 'normal' END AS priority FROM
    (SELECT doc_id, """ + _KIND + """ AS kind, regexp_matches(lower(text), '\\b(do not|don''t|never|must|required|preserve|keep)\\b') AS strong FROM documents)""")
def intent_of_documents(spark, sf_dir):
    d = table(spark, sf_dir, "documents").withColumn("kind", intents.kind(F.col("text")))
    return d.select("doc_id", "kind", intents.priority(F.col("kind"), F.col("text")).alias("priority"))


#: Messages of plain transcripts as XML; the record's hash is that of its JSON.
_MESSAGE = """x AS (SELECT *, '<user-message source="current" line="' || line || '" original_line="' || line || '" chars="' || length(text) || '" sha256="' || hash || '" record_sha256="' || sha256('{"type":"user","message":{"role":"user","content":' || CAST(to_json(text) AS VARCHAR) || '}}') || '">' || chr(10) || trim(text, ' ') || chr(10) || '</user-message>' AS xml FROM i)"""


@query(f"""WITH RECURSIVE {E}, {_INTENT}, {_MESSAGE}, r AS (SELECT session_id, line, CAST(ceil(length(xml) / 4.0) AS BIGINT) AS t, row_number() OVER (PARTITION BY session_id ORDER BY CASE priority WHEN 'must_keep' THEN 0 WHEN 'high' THEN 1 ELSE 2 END, line DESC) AS k FROM x),
    w AS (SELECT session_id, line, k, t AS used, 1 AS many, true AS take FROM r WHERE k = 1
          UNION ALL SELECT r.session_id, r.line, r.k, CASE WHEN w.used + r.t <= 260 AND w.many < 3 THEN w.used + r.t ELSE w.used END, CASE WHEN w.used + r.t <= 260 AND w.many < 3 THEN w.many + 1 ELSE w.many END, w.used + r.t <= 260 AND w.many < 3 FROM w JOIN r ON r.session_id = w.session_id AND r.k = w.k + 1)
    SELECT session_id, CAST(line AS BIGINT) AS line FROM w WHERE take""")
def ledger_selection(spark, sf_dir):
    """The greedy selection with small budgets; a message costs the tokens of its XML."""
    m = ledger.messages(entries(spark, sf_dir)).withColumn("ord", F.col("line"))
    return ledger.selected(m, most=3, most_tokens=260, most_lines=0).select("session_id", F.col("line").cast("long").alias("line"))


@query(f"""WITH {E}, r AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY line DESC) AS k FROM e) SELECT session_id, line, hash, role FROM r WHERE k <= 3""")
def latest_tail(spark, sf_dir):
    return stats.latest(turns(spark, sf_dir), 3).select("session_id", "line", "hash", "role")


@query(f"""WITH {E}, r AS (SELECT session_id, line, row_number() OVER (PARTITION BY session_id ORDER BY line DESC) AS k, left(sha256(session_id || ':tail:' || line), 32) AS new_uuid FROM e)
    SELECT session_id, CAST(line AS INTEGER) AS line, new_uuid, coalesce(lag(new_uuid) OVER (PARTITION BY session_id ORDER BY line), left(sha256(session_id || ':summary:0'), 32)) AS parent FROM r WHERE k <= 3""")
def preserved_tail_chain(spark, sf_dir):
    return compact.preserved_tail(entries(spark, sf_dir), 3).select("session_id", "line", "new_uuid", "parent")


def _spans(spark, sf_dir) -> DataFrame:
    """A span from each second line to one or two lines on, within the session."""
    t = turns(spark, sf_dir).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("session_id")))
    own = t.where("line % 2 = 1").select("session_id", F.col("line").alias("anchor"), F.array(F.struct(F.col("line").cast("int").alias("start_line"), F.least(F.col("n"), F.col("line") + 1 + F.col("line") % 3).cast("int").alias("end_line"))).alias("spans"))
    return own.withColumn("kind", F.when(F.col("anchor") % 4 == 1, "promises").otherwise("blocks"))


_SP = f"""{E}, n AS (SELECT *, count(*) OVER (PARTITION BY session_id) AS n FROM e),
    sp AS (SELECT session_id, line AS anchor, line AS s, least(n, line + 1 + line % 3) AS t, 'span-' || lpad(CAST(row_number() OVER (PARTITION BY session_id ORDER BY line) AS VARCHAR), 4, '0') AS span_id FROM n WHERE line % 2 = 1)"""


@query(f"""WITH {_SP} SELECT sp.session_id, span_id, CAST(s AS INTEGER) AS start_line, CAST(t AS INTEGER) AS end_line, min_by(hash, line) AS start_hash, max_by(hash, line) AS end_hash,
    sha256(string_agg(text, chr(10) || chr(10) ORDER BY line)) AS extracted_text_sha256, sha256(string_agg(hash, chr(10) ORDER BY line)) AS raw_slice_sha256
    FROM sp JOIN e ON e.session_id = sp.session_id AND e.line BETWEEN s AND t GROUP BY ALL""")
def spans_rehydrated(spark, sf_dir):
    out = spans.rehydrated(spans.numbered(_spans(spark, sf_dir)), turns(spark, sf_dir))
    return out.drop("segments", "extracted_text")


@query(f"""WITH {_SP} SELECT session_id, count(*) AS evidence_capsules, (SELECT count(DISTINCT x) FROM (SELECT unnest([s, t]) AS x FROM sp q WHERE q.session_id = sp.session_id)) AS cited_unique_lines,
    count(*) FILTER (WHERE anchor % 4 = 1) AS promises FROM sp GROUP BY session_id""")
def density_counts(spark, sf_dir):
    return scoring.density_counts(_spans(spark, sf_dir))


@query(f"""WITH {_SP} SELECT session_id, count(*) AS spans, CAST(0 AS BIGINT) AS invalid, (SELECT count(DISTINCT x) FROM (SELECT unnest(range(s, t + 1)) AS x FROM sp q WHERE q.session_id = sp.session_id)) AS unique_lines FROM sp GROUP BY session_id""")
def span_metrics(spark, sf_dir):
    return scoring.span_metrics(spans.numbered(_spans(spark, sf_dir)))


@query("""SELECT CAST(doc_id AS VARCHAR) AS run_id, b.text AS literal FROM documents d, (SELECT DISTINCT text FROM benchmark) b WHERE contains(d.text, b.text)""")
def literal_recovery(spark, sf_dir):
    lits = table(spark, sf_dir, "benchmark").select(F.col("text").alias("literal")).distinct()
    return scoring.literal_hits(lits, table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("run_id"), "text"))


def _runs(spark, sf_dir) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    long = lambda x: F.sum(x).cast("long")
    agg = d.groupBy(F.concat_ws("/", "lang", "source").alias("run_id")).agg(
        F.count(F.lit(1)).alias("capsules"), long(F.col("n_chars") % 7).alias("unique_lines"), F.count_if(F.col("doc_id") % 10 == 0).alias("intents"), F.count_if(F.col("doc_id") % 5 == 0).alias("found"), long("n_chars").alias("after_bytes"))
    lit = F.lit
    return agg.withColumns({"ok": F.col("capsules") > 3, "bad_hashes": F.col("capsules") % 2, "hashes_passed": lit(False), "bad_capsules": lit(0), "min_capsules": lit(30), "min_lines": lit(60), "empty_segments": lit(0), "invalid_spans": lit(0), "min_intents": lit(8), "objective": lit(True), "next_step": lit(True), "rules": F.col("capsules") % 3, "plans": lit(1), "promises": lit(1), "required": lit(10), "unsupported": lit(0), "after_tokens": F.col("after_bytes"), "echo": lit(True), "need_echo": lit(True)})


_R = """r AS (SELECT lang || '/' || source AS run_id, count(*) AS c, sum(n_chars % 7) AS l, count(*) FILTER (WHERE doc_id % 10 = 0) AS i, count(*) FILTER (WHERE doc_id % 5 = 0) AS f FROM documents GROUP BY 1),
    s AS (SELECT run_id, c, f, (CASE WHEN c > 3 THEN 8 ELSE 0 END + CASE WHEN c % 2 = 0 THEN 13 ELSE 0 END + 4) AS integrity, floor(least(1, c / 30) * 8 + 0.5) + floor(least(1, l / 60) * 3 + 0.5) + 4 AS grounding,
    floor(least(1, i / 8) * 6 + 0.5) + 8 + CASE WHEN c % 3 > 0 THEN 2 ELSE 0 END + 4 AS continuity, floor(least(1, f / 10) * 20 + 0.5) AS literals FROM r)"""


@query(f"""WITH {_R} SELECT run_id, CAST(integrity AS BIGINT) AS integrity, CAST(grounding AS BIGINT) AS grounding, CAST(continuity AS BIGINT) AS continuity, CAST(literals AS BIGINT) AS literals, CAST(integrity + grounding + continuity + literals + 20 AS BIGINT) AS score,
    c > 3 AND c % 2 = 0 AND f >= 10 AND integrity + grounding + continuity + literals + 20 >= 85 AS gate_pass FROM s""")
def deterministic_score(spark, sf_dir):
    return scoring.deterministic(_runs(spark, sf_dir)).select("run_id", "integrity", "grounding", "continuity", "literals", "score", "gate_pass")


def _verdicts(spark, sf_dir) -> DataFrame:
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    level = F.when((F.col("quality") == 1) & (F.col("toxic") == 0), "clear").when(F.col("quality") == 1, "partial").otherwise("absent")
    return d.select(F.col("source").alias("run_id"), F.col("lang").alias("criterion"), F.col("doc_id").alias("trial"), level.alias("level"), F.col("doc_id").cast("string").alias("quote"), F.array(F.concat(F.lit("ev-"), (F.col("doc_id") % 3).cast("string"))).alias("refs"))


_V = """v AS (SELECT source AS run_id, lang AS criterion, d.doc_id AS trial, CASE WHEN quality = 1 AND toxic = 0 THEN 2 WHEN quality = 1 THEN 1 ELSE 0 END AS value FROM documents d JOIN labels l ON d.doc_id = l.doc_id),
    m AS (SELECT run_id, criterion, CAST(quantile_disc(value, 0.5) AS INTEGER) AS value, count(*) AS trials, list_sort(list(DISTINCT 'ev-' || trial % 3)) AS refs FROM v GROUP BY ALL)"""


@query(f"WITH {_V} SELECT m.*, CAST((SELECT min(trial) FROM v WHERE v.run_id = m.run_id AND v.criterion = m.criterion AND v.value = m.value) AS VARCHAR) AS quote FROM m")
def judge_median(spark, sf_dir):
    return judging.medians(_verdicts(spark, sf_dir))


@query(f"WITH {_V} SELECT run_id, CAST(sum(value) AS BIGINT) AS total, count(*) FILTER (WHERE value = 0) AS absent, count(*) AS criteria, count(*) FILTER (WHERE value = 0) = 0 AND sum(value) >= 8 AS pass FROM m GROUP BY run_id")
def judge_outcome(spark, sf_dir):
    return judging.outcome(judging.medians(_verdicts(spark, sf_dir)))


@query("""WITH a AS (SELECT 'lane-' || user_id AS lane_id, CAST(count(*) AS DOUBLE) AS det, CAST(count(*) % 11 AS DOUBLE) AS judge, count(*) % 3 > 0 AS gate, round(CAST(sum(CAST(round(value * 100) AS BIGINT)) AS DOUBLE) / 100, 2) AS wall FROM events GROUP BY user_id),
    q AS (SELECT *, floor((0.65 * det + 0.35 * 10 * judge) * CASE WHEN gate = false THEN 0.88 ELSE 1.0 END * 10 + 0.5) / 10 AS quality, CASE WHEN wall > 0 THEN floor(least(100.0, 1500.0 / wall) * 10 + 0.5) / 10 END AS speed FROM a),
    c AS (SELECT *, floor((0.6 * quality + 0.4 * speed) * 10 + 0.5) / 10 AS combined FROM q)
    SELECT lane_id, quality, speed, combined, CASE WHEN combined IS NOT NULL THEN CAST(row_number() OVER (PARTITION BY combined IS NULL ORDER BY combined DESC, quality DESC, wall, lane_id) AS INTEGER) END AS rank FROM c""")
def lane_ranking(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    n = F.count(F.lit(1))
    lanes = e.groupBy(F.concat(F.lit("lane-"), F.col("user_id").cast("string")).alias("lane_id")).agg(n.cast("double").alias("deterministic_score"), (n % 11).cast("double").alias("judge_score"), (n % 3 > 0).alias("gate_pass"), F.round(F.sum(F.round(F.col("value") * 100).cast("long")).cast("double") / 100, 2).alias("wall_seconds"))
    return ranking.ranked(lanes).select("lane_id", "quality", "speed", "combined", "rank")


#: The library's patterns without looking around, which the SQL's expressions lack: word borders stand for it, and separators
#: that end one path and begin the next are doubled first.
_DOUBLED = r"""regexp_replace(coalesce(html, ''), '([\s\v"''`])', '\1\1', 'g')"""
_PATH = r"""(?:^|[\s\v("''`])((?:/[A-Za-z0-9._~+@:%-]+)+|(?:[A-Za-z0-9_.-]+/)+[A-Za-z0-9_.@:%+-]+)(?:$|[\s\v)"''`,;:])"""
_GROUPS = [
    ("html", r"(?m)^-\s+`((?:\\`|[^`]){2,220})`", 1), ("html", r"""(?:\b(?:uv run|uv sync|python3?)|\B\.venv/bin/python)[^\n`"]{0,140}""", 0), ("html", r"\b[A-Z][A-Z0-9_]{2,}\b", 0),
    ("html", r"\b[a-z]+/[a-z0-9.+-]*(?:[a-z0-9]\b|[.+-]\B)", 0), ("html", r"(?m)^@@file ([^\n]+)$", 1), ("doubled", _PATH, 1), ("html", r"`([^`\n]{2,180})`", 1), ("html", r"\b[a-z][a-z0-9_-]{5,}(?:[a-z0-9_]\b|-\B)", 0),
]
_FIRST = lambda x: f"list_filter({x}, lambda v, i: list_position({x}, v) = i)"
_SQUEEZED = "trim(regexp_replace({}, '{WS}+', ' ', 'g'), ' ')"


@query(f"""WITH f AS (SELECT page_id, regexp_extract_all({_DOUBLED}, '{_PATH}', 1) AS l FROM pages), d AS (SELECT page_id, {_FIRST("l")}[1:20] AS p FROM f) SELECT page_id, CAST(len(p) AS BIGINT) AS n_paths, p FROM d""")
def path_literals(spark, sf_dir):
    """Paths of whole pages."""
    p = table(spark, sf_dir, "pages").select("page_id", literals.paths(F.col("html")).alias("p"))
    return p.select("page_id", F.size("p").cast("long").alias("n_paths"), "p")


@query(f"""WITH t AS (SELECT page_id, coalesce(html, '') AS html, {_DOUBLED} AS doubled FROM pages),
    f AS (SELECT page_id, {", ".join(f"regexp_extract_all({text}, '{pattern}', {group}) AS r{i}" for i, (text, pattern, group) in enumerate(_GROUPS))} FROM t),
    n AS (SELECT page_id, {", ".join(f"list_filter(list_transform(r{i}, lambda x: trim(left({_SQUEEZED.replace('{}', 'x')}, 180), ' ')), lambda x: length(x) >= 2) AS n{i}" for i in range(8))} FROM f),
    d AS (SELECT page_id, {", ".join(f"{_FIRST(f'n{i}')} AS d{i}" for i in range(8))} FROM n),
    o AS (SELECT * REPLACE (list_transform(list_sort(list_transform(d5, lambda x: struct_pack(a := NOT starts_with(x, '/'), b := -length(x), t := x))), lambda s: s.t) AS d5) FROM d),
    w AS (SELECT page_id, list_concat({", ".join(f"d{i}[1:{cap}]" for i, (_, _, cap) in enumerate(literals.EVIDENCE))}) AS l FROM o)
    SELECT page_id, {_FIRST("l")}[1:128] AS literals FROM w""")
def evidence_quota(spark, sf_dir):
    """Literals of whole pages, all eight groups within their caps."""
    return table(spark, sf_dir, "pages").select("page_id", literals.evidence(F.col("html")).alias("literals"))


@query(rf"""WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
    f AS (SELECT doc_id, list_concat(regexp_extract_all(text, '`([^`\n]{{2,80}})`', 1), list_filter(regexp_extract_all(text, '\b[A-Za-z][A-Za-z0-9_.:/-]+[A-Za-z0-9_]\b'), lambda x: lower(x) NOT IN ({", ".join(f"'{w}'" for w in literals.STOP)}) AND (regexp_matches(x, '[A-Z0-9_./:-]') OR length(x) >= 10))) AS l FROM t),
    n AS (SELECT doc_id, list_filter(list_transform(l, lambda x: {_SQUEEZED.replace("{}", "x")}), lambda x: x <> '') AS n FROM f)
    SELECT doc_id, {_FIRST("n")}[1:16] AS concepts FROM n""")
def concepts(spark, sf_dir):
    """Backticked spans and names of whole documents."""
    return table(spark, sf_dir, "documents").select("doc_id", literals.concepts(F.col("text")).alias("concepts"))


_CUT = "regexp_replace({}, '^{WS}+|{WS}+$', '', 'g')"
_IN_QUOTES = r"""'(?s)\A(?:`.*`|".*"|''.*''|\(.*\))\z'"""
_SCRIPT = rf"(?:\.{{0,2}}/|[A-Za-z0-9_.-]+/)[A-Za-z0-9_./:@%+-]+\.(?:{literals.ENDINGS})\b"
_PICKUP = literals.PICKUP_PATH.replace("(?=$", "(?:$").replace(r"[\s", r"[\s\v").replace("'", "''")


def _cleaned(x: str) -> str:
    """SQL for a command or path without the marks around it."""
    cut = lambda y: _CUT.replace("{}", y)
    inner = f"CASE WHEN regexp_matches({cut(x)}, {_IN_QUOTES}) AND length({cut(x)}) > 1 THEN {cut(f'substr({cut(x)}, 2, length({cut(x)}) - 2)')} ELSE {cut(x)} END"
    return cut(rf"regexp_replace({inner}, '[.。][\s\v]*\z', '')")


@query(rf"""WITH t AS (SELECT page_id, coalesce(html, '') AS html, {_DOUBLED} AS doubled FROM pages),
    f AS (SELECT page_id, list_concat(regexp_extract_all(html, '`([^`\n]{{2,400}})`', 1), CASE WHEN contains(html, ':') THEN [substr(html, instr(html, ':') + 1)] ELSE [] END, regexp_extract_all(html, '\b(?:{literals.TOOLS})[\s\v]+[^\n;]{{1,360}}', 0)[1:1], regexp_extract_all(html, '(?:^|[\s\v:`])({_SCRIPT}[^\n;]{{0,320}})', 1)[1:1]) AS offered,
        regexp_extract_all(doubled, '{_PICKUP}', 1) AS found, regexp_extract_all(html, '(?i)\b(?:{literals.RUNNERS})[\s\v]+[^\n.;]*(?:test|check|lint|verify|gate|pytest|vitest|jest|cargo test)[^\n.;]*', 0) AS run FROM t),
    c AS (SELECT page_id, list_transform(offered, lambda x: {_cleaned("x")}) AS offered, list_transform(found, lambda x: struct_pack(x := x, c := {_cleaned("x")})) AS found, list_transform(run, lambda x: {_SQUEEZED.replace("{}", "x")}) AS run FROM f),
    k AS (SELECT page_id, list_filter(offered, lambda x: x <> '' AND length(x) <= 400 AND NOT regexp_matches(x, '^[^\s\v]+:[\s\v]+') AND (regexp_matches(x, '^(?:{literals.TOOLS})\b') OR regexp_matches(x, '^{_SCRIPT}'))) AS commands,
        list_transform(list_filter(found, lambda p: p.c <> '' AND length(p.c) <= 240 AND NOT regexp_matches(p.c, '^https?://') AND (regexp_matches(p.c, '^(?:/|\.{{1,2}}/)') OR regexp_matches(p.c, '^(?:{literals.FOLDERS})/') OR regexp_matches(p.c, '/[^/\s\v]+\.[A-Za-z0-9]{{1,8}}$'))), lambda p: p.x) AS files, list_filter(run, lambda x: x <> '') AS run FROM c)
    SELECT page_id, coalesce(commands[1], '') AS command, {_FIRST("files")}[1:12] AS files, {_FIRST("run")}[1:12] AS tests FROM k""")
def pickup_of_pages(spark, sf_dir):
    """What whole pages offer to go on with: a command, files, commands that test."""
    none, t = F.array().cast("array<string>"), F.array(F.coalesce("html", F.lit("")))
    return table(spark, sf_dir, "pages").select("page_id", literals.next_command(t, F.lit("")).alias("command"), literals.pickup_files(t, none).alias("files"), literals.test_commands(t, none).alias("tests"))


def _stream(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events")
    block = F.concat(F.lit("event: "), F.col("event_type"), F.lit("\r\ndata: "), F.to_json(F.struct(F.col("event_type").alias("type"), F.concat(F.col("event_id").cast("string"), F.lit(";")).alias("delta"))))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("event_id", block.alias("b")))), lambda s: s["b"])
    return e.groupBy(F.col("user_id").cast("string").alias("stream_id")).agg(F.concat(F.array_join(ordered, "\r\n\r\n"), F.lit("\n\ndata: [DONE]\n\ndata: {bad")).alias("raw"))


@query("""WITH o AS (SELECT CAST(user_id AS VARCHAR) AS stream_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS n, event_type AS event, event_type AS type, true AS ok FROM events),
    c AS (SELECT stream_id, count(*) AS n FROM o GROUP BY stream_id)
    SELECT stream_id, CAST(n AS INTEGER) AS n, event, type, ok FROM o UNION ALL SELECT stream_id, CAST(n AS INTEGER), NULL, 'done_sentinel', true FROM c UNION ALL SELECT stream_id, CAST(n + 1 AS INTEGER), NULL, 'unparsed', false FROM c""")
def sse_parse(spark, sf_dir):
    return sse.events(_stream(spark, sf_dir)).drop("data")


@query("""SELECT CAST(user_id AS VARCHAR) AS stream_id, sha256(string_agg(CAST(event_id AS VARCHAR) || ';', '' ORDER BY event_id)) AS text_sha256 FROM events GROUP BY user_id""")
def sse_text(spark, sf_dir):
    return sse.outcome(sse.events(_stream(spark, sf_dir)), "responses").select("stream_id", sha256(F.col("text")).alias("text_sha256"))


@query(f"""WITH {E} SELECT session_id, line AS ord, CASE WHEN line % 5 = 0 THEN 'sha256 differs' ELSE 'char_count differs' END AS error FROM e WHERE line % 5 = 0 OR line % 3 = 0""")
def validation_rejects(spark, sf_dir):
    t = turns(spark, sf_dir)
    digest = F.when(F.col("line") % 5 == 0, sha256(F.lit("other"))).otherwise(F.col("hash"))
    m = t.select("session_id", F.col("line").alias("ord"), "line", digest.alias("sha256"), (F.length("text") + F.when(F.col("line") % 3 == 0, 1).otherwise(0)).alias("char_count"), "text")
    return summary.message_errors(m)


@query()
def line_diff(spark, sf_dir):
    t = turns(spark, sf_dir)
    after = F.lead("text").over(Window.partitionBy("session_id").orderBy("line"))
    cut = lambda x: F.regexp_replace(x, r"\. ", ".\n")
    pairs = t.withColumn("next", after).where("next IS NOT NULL").withColumn("pairs", diff.line_diff(cut(F.col("text")), cut(F.col("next"))))
    return pairs.select("session_id", "line", diff.counted(F.col("pairs"), "add").alias("added"), diff.counted(F.col("pairs"), "remove").alias("removed"), sha256(diff.diff_body(F.col("pairs"), F.lit("turn.txt"))).alias("body_sha256"))


@query("""WITH l AS (SELECT doc_id, text, string_split(coalesce(text, ''), chr(10)) AS s FROM documents) SELECT doc_id, len(s) AS n_lines, len(s) > 50 AS shortened FROM l""")
def write_block(spark, sf_dir):
    d = table(spark, sf_dir, "documents").withColumn("b", diff.write_block(F.lit("Write"), F.lit("a.txt"), F.col("text")))
    return d.select("doc_id", F.regexp_extract("b", r"stats: lines=(\d+) \| input_sha256=[0-9a-f]{64}\z", 1).cast("long").alias("n_lines"), F.col("b").rlike(r"\n\[\.\.\. \d+ lines omitted \.\.\.\]\n").alias("shortened"))


@query(f"""WITH {E}, n AS (SELECT session_id, count(*) AS n FROM e GROUP BY session_id) SELECT session_id, n AS before_records, least(n, 4) + 2 AS after_records FROM n""")
def compact_end_to_end(spark, sf_dir):
    e = entries(spark, sf_dir)
    s = e.groupBy("session_id").agg(F.format_string("%d records", F.count(F.lit(1))).alias("summary"))
    return compact.results(e, compact.compacted(e, s, 4)).select("session_id", "before_records", "after_records")
