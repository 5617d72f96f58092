"""Exact token counts by a tokenizer file, with a token for each four characters where there is none."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import tokens

#: Characters that a process gives its tokenizer at once, about.
AT_ONCE = 1 << 20

_TOKENIZERS: dict[str, object] = {}


def tokenizer(path: str):
    """This process's tokenizer of a file; strings of special tokens count as ordinary text."""
    if path not in _TOKENIZERS:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        made = Tokenizer.from_file(path)
        made.encode_special_tokens = True
        _TOKENIZERS.clear()
        _TOKENIZERS[path] = made
    return _TOKENIZERS[path]


def _count(path: str, text: str, out: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = tokenizer(path)
        for batch in batches:
            texts, counts = batch.column(batch.schema.get_field_index(text)), []
            held, size = [], 0
            for x in [*texts, None]:  # the last one asks for what is held
                if x is not None:
                    held.append(x.as_py() or "")
                    size += len(held[-1])
                if size >= AT_ONCE or x is None and held:
                    counts += [len(e) for e in made.encode_batch_fast(held, add_special_tokens=False)]
                    held, size = [], 0
            counts = pa.array(counts, pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.compute.if_else(texts.is_valid(), counts, None)], names=[*batch.schema.names, out])

    return run


def counted(df: DataFrame, text: str, out: str, path: str | None = None) -> DataFrame:
    """df with the number of tokens of a text column: the tokenizer's own where ``path`` names its file, else estimated. Null texts have none."""
    if path is None:
        return df.withColumn(out, tokens(F.length(text)))
    ordered = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInArrow(_count(path, text, out), f"{ordered}, `{out}` bigint")
