"""Many literals sought in many texts: one automaton for all literals, one pass over each text.

Literals are dealt into parts of a bounded size. A part becomes an Aho-Corasick automaton, which tasks build once from
its broadcast literals; each text is read once for each part, however many literals it holds. Most fixtures are one part. What
several parts find is written part by part, so the driver and the tasks never hold more than one.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.sources import folders

#: Characters of literals in one part at most: an automaton needs some hundred bytes for each.
PART = 1 << 20

_BUILT: dict[int, object] = {}


def automaton(literals: Broadcast):
    """This process's automaton of broadcast literals; of several only the last is kept."""
    number = id(literals.value)
    if number not in _BUILT:
        import ahocorasick

        built = ahocorasick.Automaton()
        for i, x in enumerate(literals.value):
            built.add_word(x, i)
        built.make_automaton()
        _BUILT.clear()
        _BUILT[number] = built
    return _BUILT[number]


def _find(literals: Broadcast, key: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = automaton(literals)
        for batch in batches:
            row, hit = [], []
            for i, text in enumerate(batch.column(batch.schema.get_field_index("text"))):
                mine = {k for _, k in found.iter(text.as_py() or "")}
                row += [i] * len(mine)
                hit += sorted(mine)
            keys = batch.column(batch.schema.get_field_index(key)).take(pa.array(row, pa.int64()))
            yield pa.RecordBatch.from_arrays([keys, pa.array([literals.value[k] for k in hit], pa.string())], names=[key, "literal"])

    return run


def hits(literals: DataFrame, texts: DataFrame, key: str, part: int = PART) -> DataFrame:
    """Distinct (key, literal) pairs where a text of the key holds the literal; empty and null literals are found nowhere.

    literals: (literal, ...); texts: (key, text, ...).
    """
    spark = texts.sparkSession
    wanted = folders.kept(literals.where("literal <> ''").select(F.col("literal").cast("string").alias("literal")).distinct(), "literals")
    size = wanted.agg(F.sum(F.length("literal"))).first()[0] or 0
    parts = -(-size // part)
    rows = texts.select(F.col(key), F.col("text").cast("string").alias("text"))
    schema = f"{key} {dict(rows.dtypes)[key]}, literal string"
    out = spark.createDataFrame([], schema)
    for i in range(parts):
        mine = wanted if parts == 1 else wanted.where(F.pmod(F.xxhash64("literal"), F.lit(parts)) == i)
        held = spark.sparkContext.broadcast([r.literal for r in mine.collect()])  # about PART characters
        made = rows.mapInArrow(_find(held, key), schema)
        if parts > 1:
            made = folders.kept(made, "hits")
            held.destroy()
        out = out.union(made)
    return out.distinct()
