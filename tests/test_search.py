"""Literals found by automata, token counts, and greedy folds, against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.functions import token_counts
from tessera.operators import dspc, greedy, ledger, scoring, search, spans


def texts_and_literals(n, seed=1):
    r = random.Random(seed)
    draw = lambda k: "".join(r.choice("abcé 中\n.x") for _ in range(k))
    texts = [draw(r.randrange(200)) for _ in range(60)] + ["", None, "a" * 500]
    literals = {"", None, "a", "aa", "abc"} if n > 10 else set()
    while len(literals) < n:
        t = r.choice(texts)
        if t and r.random() < 0.5:
            i = r.randrange(len(t))
            literals.add(t[i : i + r.randrange(1, 30)])
        else:
            literals.add(draw(r.randrange(1, 14)))
    return texts, literals


@pytest.mark.parametrize(("n", "part"), [(1, search.PART), (1000, search.PART), (1001, search.PART), (1001, 900), (100_000, search.PART)])
def test_literals_by_one_method(spark, n, part):
    texts, literals = texts_and_literals(n)
    rows = [(str(i % 50), t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "run_id string, text string").repartition(4)
    got = search.hits(spark.createDataFrame([(x,) for x in literals], "literal string"), df, "run_id", part).collect()
    pieces = {(i, t[a:b]) for i, t in rows if t for a in range(len(t)) for b in range(a + 1, min(len(t), a + 40) + 1)}
    assert sorted((r.run_id, r.literal) for r in got) == sorted((i, x) for i, x in pieces if x in literals)


def test_literals_in_empty_tables(spark):
    none, texts = spark.createDataFrame([], "literal string"), spark.createDataFrame([("r", "x")], "run_id string, text string")
    assert scoring.literal_hits(none, texts).collect() == []
    assert scoring.literal_hits(spark.createDataFrame([("x",)], "literal string"), texts.where("false")).collect() == []
    assert [tuple(r) for r in scoring.literal_hits(spark.createDataFrame([("x",), ("y",)], "literal string"), texts).collect()] == [("r", "x")]


def test_token_counts_equal_the_tokenizers(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    more = spark.createDataFrame([(-1, None), (-2, ""), (-3, "<|endoftext|> é中😀 \n\t x")], docs.schema)
    got = token_counts.counted(docs.union(more), "text", "n", path).collect()
    own = Tokenizer.from_file(path)
    own.encode_special_tokens = True
    assert all(r.n == (None if r.text is None else len(own.encode(r.text, add_special_tokens=False).ids)) for r in got) and len(got) == docs.count() + 3
    assert {r.doc_id: r.n for r in token_counts.counted(more, "text", "n").collect()} == {-1: None, -2: 0, -3: 6}


def test_ledger_budget_in_exact_tokens(spark):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = [("s", i, i, f"u{i}", None, None, None, "current", "h", None, len(t), t) for i, t in enumerate(["never " * 60, "one two", "three four", "x" * 300], 1)]
    schema = "session_id string, ord int, line int, uuid string, original_uuid string, parent_uuid string, timestamp string, source string, sha256 string, record_sha256 string, char_count int, text string"
    out = ledger.selected(spark.createDataFrame(rows, schema), most_tokens=170, tokenizer=path).collect()
    made = token_counts.tokenizer(path)
    assert {r.ord for r in out} and all(r.rendered_tokens == len(made.encode(r.rendered, add_special_tokens=False)) for r in out)
    assert sum(r.rendered_tokens for r in out) <= 170 and len(out) >= 2


def brute(rows, budget, most):
    out, now = [], {}
    for key, _, place, cost in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        taken, used = now.get(key, (0, 0))
        if taken < most and (not taken or used + cost <= budget):
            now[key] = taken + 1, used + cost
            out.append((key, place))
    return sorted(out)


def test_greedy_fold_over_a_long_queue(spark):
    """One key holds most rows: the fold keeps its budgets only, and no plan gathers a queue."""
    rows = spark.range(200_000).select(F.when(F.col("id") % 10 < 9, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 97).cast("string"))).alias("key"), F.pmod(F.xxhash64("id"), F.lit(1000)).alias("rank"), F.col("id").alias("place"), (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(50)) + 1).alias("cost"))
    kept = greedy.within(rows, "key", [F.col("rank"), F.col("place")], {"cost": 2000}, 500)
    assert sorted((r.key, r.place) for r in kept.collect()) == brute([tuple(r) for r in rows.collect()], 2000, 500)
    assert "collect_list" not in kept._jdf.queryExecution().toString()


def test_no_plan_of_a_selection_gathers_a_queue(spark):
    schema = "session_id string, ord int, line int, uuid string, original_uuid string, parent_uuid string, timestamp string, source string, sha256 string, record_sha256 string, char_count int, text string"
    assert "collect_list" not in ledger.selected(spark.createDataFrame([], schema))._jdf.queryExecution().toString()
    assert dspc.chosen(spark.createDataFrame([(1, "One two three. Four five six. Seven eight!")], "key int, text string"), 20).first().segs


def test_segments_are_found_by_halving(spark):
    ends = [(0, 0), (2, 5), (7, 7), (9, 30), (32, 33)]
    rows = [(i, [(line, [a, b]) for line, (a, b) in enumerate(ends[:n], 1)]) for i, n in enumerate([0, 1, 2, 5])]
    df = spark.createDataFrame(rows, "i int, segments array<struct<line:int,char_range:array<int>>>").withColumn("at", F.explode(F.sequence(F.lit(-1), F.lit(35))))
    for r in df.withColumn("got", spans.source_line(F.col("segments"), F.col("at"))).collect():
        assert r.got == next((s.line for s in r.segments if s.char_range[0] <= r.at <= s.char_range[1]), None)
    many = spark.range(1).select(F.transform(F.sequence(F.lit(0), F.lit(99_999)), lambda i: F.struct(i.alias("line"), F.array(i * 12, i * 12 + 10).alias("char_range"))).alias("segments"))
    asked = many.select("segments", F.explode(F.transform(F.sequence(F.lit(0), F.lit(1_200_000), F.lit(997)), lambda x: x)).alias("at"))
    got = asked.select("at", spans.source_line(F.col("segments"), F.col("at")).alias("line")).collect()
    assert all(r.line == (r.at // 12 if r.at % 12 <= 10 and r.at < 1_200_000 else None) for r in got) and len(got) > 1000
