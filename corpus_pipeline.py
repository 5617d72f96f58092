"""A training corpus from raw documents, stage by stage.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept, and gives rows with
the columns of ``documents``; the last gives the token index. ``run`` writes each stage's rows to the
shared folder and reads them again for the next.

Defined cases, of all stages: an empty table gives no rows; columns of any name stay; null and empty texts
count as texts without words or bytes. Each stage says what it does with null doc_ids and repeated rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontaminate, frames, jaccard, mixing, queries, token_files, toxicity

#: Documents with at least this score go: all that op6 calls toxic.
REJECT = queries.TOXIC


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go, by text alone: null doc_ids and repeated rows are judged like others.

    Without labels of both classes all rows have one score: the share of toxic labels.
    """
    return toxicity.drop_toxic(docs, toxicity.train(docs, queries.table(spark, sf_dir, "labels")), REJECT)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one with the least doc_id.

    Rows with null doc_id, and those without words, all stay; of rows with one doc_id the one of least text does.
    """
    return jaccard.representatives(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with benchmark passages go, by the contamination rule; null doc_ids and repeated rows are judged like others.

    Benchmark rows with null item_id or without words forbid nothing.
    """
    return decontaminate.drop_contaminated(docs, queries.table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated to tempered source weights, in a global random order.

    Null is a source of its own; rows with one doc_id, or with none, have equally many copies within their source.
    """
    return mixing.mixed(docs).select(*docs.columns)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of what is left, in ascending doc_id order; gives each document's place in them.

    Copies stand side by side, ordered by their ids; null doc_ids come first; no rows give no file.
    """
    folder = frames.scratch(spark, "tokens")
    token_files.write_tokens(docs, folder, queries.tokenizer_path(), queries.END_ID)
    return token_files.read_tokens(spark, folder, digest=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard", drop_near_copies),
    ("decontamination", drop_benchmark),
    ("mixing", mix_sources),
    ("token_files", tokenize),
]

#: Training, components and tokenizing can't be told in SQL; tests compare stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = queries.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = frames.written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
