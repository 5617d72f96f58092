"""The pipeline's stages on a small folder of tables."""

import random

import numpy as np
import pytest

from tessera.llm import queries, toxicity


@pytest.mark.parametrize(("score", "kept"), [(0.29, 1), (0.31, 0), (0.4, 0)])
def test_pipeline_rejects_what_op6_calls_toxic(spark, tmp_path, monkeypatch, score, kept):
    import corpus_pipeline

    model = toxicity.Model(np.zeros(toxicity.BUCKETS, np.float32), float(np.log(score / (1 - score))))
    monkeypatch.setattr(toxicity, "train", lambda docs, labels: model)
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.createDataFrame([(1, "some words")], "doc_id long, text string")
    assert corpus_pipeline.drop_toxic(spark, docs, str(tmp_path)).count() == kept


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    r = random.Random(4)
    vocabulary = ["".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(400)]
    prose = lambda k: " ".join(r.choice(vocabulary) for _ in range(k))
    passage = prose(40)
    rows = [(i, prose(60), "en", f"src{i % 3}", 0) for i in range(200)]
    rows += [(200 + i, f"{prose(20)} grumblock snarfwit {prose(10)} grumblock", "en", "src0", 0) for i in range(60)]
    rows += [(300, rows[3][1], "en", "src1", 0), (301, f"{passage} {prose(20)}", "en", "src2", 0), (302, None, "en", "src2", 0)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(200 <= i < 260)) for i, *_ in rows], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = queries.table(spark, str(tmp_path), "documents")
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/out-{name}")
        docs = spark.read.parquet(f"{tmp_path}/out-{name}")
        seen[name] = {x.doc_id for x in docs.collect()}
    assert len(seen["toxicity"] & set(range(200, 260))) <= 5 and len(seen["toxicity"] & set(range(200))) >= 195
    assert 300 not in seen["ngram_jaccard"] and 3 in seen["ngram_jaccard"]
    assert seen["ngram_jaccard"] - seen["decontamination"] == {301}
    assert seen["mixing"] <= seen["decontamination"]
    last = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    assert len(last) == docs.count()
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(last)


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, label int, score double, hash long, bucket int, shard int"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Labels and a benchmark for small tables of documents."""
    folder = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, " ".join(f"word{i}" for i in range(20))), (None, "a b c"), (2, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def row(i, text, source="s"):
    return (i, text, "en", source, 0, "k", 1, 0.5, 7, 3, 2)


@pytest.mark.parametrize("rows", [[], [row(None, None, None), row(None, "", None), row(None, "no id at all"), row(7, None), row(7, None), row(8, "x " * 30_000), row(8, "eight")]])
def test_stages_on_empty_tables_nulls_repeats_and_clashing_names(spark, tables, rows):
    """Every stage keeps columns of any name and clean rows of any kind; the last gives a place for each."""
    import corpus_pipeline

    clean = [row(i, f"plain words of document {i} and nothing else {i * i}") for i in range(60)] if rows else []
    docs = spark.createDataFrame(rows + clean, SCHEMA)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, tables)
        assert out.columns == docs.columns
        kept = out.collect()
        if name in ("toxicity", "decontamination"):
            assert sum(r.doc_id is None for r in kept) == sum(r[0] is None for r in rows)
        if name == "ngram_jaccard":
            assert sum(r.doc_id is None for r in kept) == sum(r[0] is None for r in rows)  # rows without an id all stay
        assert bool(kept) == bool(rows)
        docs = spark.createDataFrame(kept, SCHEMA)
    last = corpus_pipeline.STAGES[-1][1](spark, docs, tables).collect()
    assert len(last) == docs.count() and sorted(r.start for r in last)[:1] == ([0] if rows else [])


def test_decontamination_stage_drops_the_passage_and_nothing_else(spark, tables):
    import corpus_pipeline

    passage = " ".join(f"Word{i}" for i in range(3, 18))
    docs = spark.createDataFrame([row(1, passage), row(2, f"{passage} {'other ' * 40}"), row(3, f"{passage} " + " ".join(f"far{i}" for i in range(400))), row(4, " ".join(f"word{i}" for i in range(8)))], SCHEMA)
    assert sorted(r.doc_id for r in dict(corpus_pipeline.STAGES)["decontamination"](spark, docs, tables).collect()) == [3, 4]
