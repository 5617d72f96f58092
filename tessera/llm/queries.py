"""The queries of this subpackage: thin callers of its operators with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import byte_repeats, decontaminate, frames, infill, jaccard, mixing, packing, secret_scan, sketch, substrings, token_files, toxicity, url_lists, whitening

#: Fixed values of the token contract.
TOKENIZER, END_ID = "byte_bpe_50k.json", 2
#: Fixed values of the packing contract.
PACKED_TOKENIZER, CAPACITY = "word_bpe_49k.json", 4096
#: Fixed values of the fill-in-the-middle contract.
SEED, FORMED_OF_100, SUFFIX_FIRST_OF_100 = 7, 100, 50
#: Fixed value of the toxicity contract.
TOXIC = 0.3


#: Rows of an Arrow batch between the JVM and Python: texts of some kilobytes make some megabytes, which both sides hold several times.
BATCH_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = frames.scratch(spark, "tokens")
    token_files.write_tokens(table(spark, sf_dir, "documents"), folder, tokenizer_path(), END_ID)
    return token_files.read_tokens(spark, folder, digest=True)


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.concat_ws(",", "items"), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256"), decontaminate.contaminated().alias("contaminated"))


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_groups(table(spark, sf_dir, "documents"), n=4, percent=85)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= TOXIC).cast("int").alias("predicted"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    third = F.pmod(F.xxhash64("doc_id"), F.lit(3))
    kept = substrings.remove_repeats([docs.where(third == i) for i in range(3)], fanout=2)
    return kept.withColumnRenamed("kept", "kept_sha256")


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = secret_scan.scan(docs, secret_scan.fit([*secret_scan.made_findings(), *secret_scan.labelled(docs)]))
    return found.withColumn("is_secret", F.col("probability") >= 0.5)


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables have no dates: fetch days and list entries are derived from page_id and hosts by rule."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    day = lambda n: F.date_add(F.lit("2024-01-01").cast("date"), n)
    captures = pages.withColumn("fetched", day(((F.col("page_id") * 37) % 730).cast("int")))
    hosts = pages.select(url_lists.host_of(F.col("url")).alias("host")).where("host IS NOT NULL").distinct()
    names = hosts.union(hosts.select(F.regexp_extract("host", r"([^.]+\.[^.]+)$", 1))).distinct()
    digit = lambda i, n: F.conv(F.substring(F.sha2("host", 256), i, n), 16, 10).cast("int")
    named = names.where("host <> ''").select("host", digit(1, 1).alias("a"), (digit(2, 3) % 365).alias("b"), (digit(5, 3) % 300).alias("c"))
    entries = named.where("a < 8").select("host", F.lit("block").alias("action"), day(F.col("b")).alias("listed"))
    entries = entries.union(named.where("a < 5").select("host", F.lit("allow"), day(F.col("b") + F.col("c") + 1)))
    return url_lists.judged(captures, entries).drop("url")


def op8_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_repeats.remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mixed(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "source", "copy", "shuffle_key", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sketch.fingerprints(table(spark, sf_dir, "documents"))
    like = lambda other: F.coalesce(sketch.resemblance(F.col("sketch"), F.col(other)), F.lit(0.0))
    return out.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
        sketch.as_text(F.col("sketch")).alias("fingerprint"), sketch.as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        like("edited_sketch").alias("near_edited"), like("next_sketch").alias("near_next"),
    )


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), frames.scratch(spark, "packed"), tokenizer_path(PACKED_TOKENIZER), END_ID, CAPACITY)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings")).withColumn("deviation", F.expr("try_cast(deviation AS bigint)"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = infill.fill_in_middle(table(spark, sf_dir, "documents"), SEED, FORMED_OF_100, SUFFIX_FIRST_OF_100)
    digest = F.sha2(infill.restored(F.col("output"), F.col("form")), 256)
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), digest.alias("restored_sha256"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_files": op1_token_files,
    "op2_decontaminate": op2_decontaminate,
    "op3_secret_scan": op3_secret_scan,
    "op4_url_filter": op4_url_filter,
    "op5_ngram_jaccard": op5_ngram_jaccard,
    "op6_toxicity": op6_toxicity,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_suffix_array_dedup": op8_suffix_array_dedup,
    "op9_mix_sources": op9_mix_sources,
    "op10_fingerprints": op10_fingerprints,
    "op11_packing": op11_packing,
    "op12_whitening": op12_whitening,
    "op13_fill_in_middle": op13_fill_in_middle,
    "pipeline": pipeline,
}

ORACLES: dict[str, str] = {
    "op2_decontaminate": r"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
        bs AS (SELECT item_id, w, least(len(w), 13) AS n, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0),
        bw AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM bs),
        ds AS (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n),
        dw AS (SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS g FROM ds),
        hit AS (SELECT r, i, dw.n AS n, item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.g = bw.g),
        covered AS (SELECT r, count(*) AS n_hit FROM (SELECT DISTINCT r, unnest(range(i, i + n)) AS p FROM hit) GROUP BY r),
        items AS (SELECT r, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS id FROM hit) GROUP BY r)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
               sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
        FROM d LEFT JOIN covered USING (r) LEFT JOIN items USING (r)""",
    "op4_url_filter": r"""
        WITH p AS (SELECT page_id, nullif(rtrim(regexp_extract(lower(url), '^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1), '.'), '') AS host,
                          DATE '2024-01-01' + CAST((page_id * 37) % 730 AS INTEGER) AS fetched FROM pages),
        h AS (SELECT DISTINCT host FROM p WHERE host IS NOT NULL UNION SELECT DISTINCT regexp_extract(host, '([^.]+\.[^.]+)$', 1) FROM p WHERE host IS NOT NULL),
        n AS (SELECT host, CAST('0x' || substr(sha256(host), 1, 1) AS INTEGER) AS a, CAST('0x' || substr(sha256(host), 2, 3) AS INTEGER) % 365 AS b, CAST('0x' || substr(sha256(host), 5, 3) AS INTEGER) % 300 AS c FROM h WHERE host <> ''),
        e AS (SELECT host, 'block' AS action, DATE '2024-01-01' + b AS listed FROM n WHERE a < 8 UNION ALL SELECT host, 'allow', DATE '2024-01-01' + b + c + 1 FROM n WHERE a < 5),
        i AS (SELECT host AS matched, action, listed AS valid_from, lead(listed) OVER (PARTITION BY host ORDER BY listed) AS valid_to FROM e),
        m AS (SELECT p.page_id, i.*, row_number() OVER (PARTITION BY p.page_id ORDER BY length(i.matched) DESC) AS r
              FROM p JOIN i ON (p.host = i.matched OR ends_with(p.host, '.' || i.matched)) AND p.fetched >= i.valid_from AND (i.valid_to IS NULL OR p.fetched < i.valid_to))
        SELECT p.page_id, p.fetched, p.host, m.action, m.matched, m.valid_from FROM p LEFT JOIN m ON p.page_id = m.page_id AND m.r = 1""",
    "op9_mix_sources": r"""
        WITH c AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
        r AS (SELECT source, (SELECT sum(n) FROM c) * pow(n, 0.7) / (SELECT sum(pow(n, 0.7)) FROM c) / n AS mean FROM c),
        k AS (SELECT source, j, sum(exp(-mean + j * ln(mean) - lgamma(j + 1))) OVER (PARTITION BY source ORDER BY j) AS cut FROM r, (SELECT unnest(range(0, 60)) AS j)),
        d AS (SELECT doc_id, source, text, CAST('0x' || substr(sha256('mix:' || doc_id), 1, 13) AS BIGINT) / 4503599627370496.0 AS u FROM documents),
        n AS (SELECT doc_id, any_value(d.source) AS source, any_value(text) AS text, count(*) FILTER (WHERE cut <= u) AS copies FROM d JOIN k ON d.source IS NOT DISTINCT FROM k.source GROUP BY doc_id),
        x AS (SELECT *, unnest(range(1, copies + 1)) AS copy FROM n)
        SELECT doc_id, source, CAST(copy AS INTEGER) AS copy, sha256('mix:' || doc_id || ':' || copy) AS shuffle_key, sha256(coalesce(text, '')) AS text_sha256 FROM x""",
    "op13_fill_in_middle": r"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u, sha256('7:' || doc_id) AS h FROM documents),
        k AS (SELECT *, len(u) AS n, CAST('0x' || substr(h, 1, 8) AS BIGINT) % (len(u) + 1) AS a, CAST('0x' || substr(h, 9, 8) AS BIGINT) % (len(u) + 1) AS b,
              CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR CAST('0x' || substr(h, 17, 8) AS BIGINT) % 100 >= 100 THEN 'plain'
                   WHEN CAST('0x' || substr(h, 25, 8) AS BIGINT) % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM d),
        p AS (SELECT *, array_to_string(u[1:least(a, b)], '') AS x, array_to_string(u[least(a, b) + 1:greatest(a, b)], '') AS m, array_to_string(u[greatest(a, b) + 1:], '') AS s FROM k)
        SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(x) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
               sha256(CASE form WHEN 'psm' THEN '<P>' || x || '<S>' || s || '<M>' || m WHEN 'spm' THEN '<S>' || s || '<P>' || x || '<M>' || m ELSE t END) AS output_sha256, sha256(t) AS restored_sha256 FROM p""",
}
