"""Greedy selection by key: rows in order while budgets last, as a fold over sorted partitions.

A key's rows stand in one partition, in order; the fold holds what is used of the budgets and nothing else, so a key of
any number of rows needs no more memory than one of a few. What doesn't fit is passed over; the first row of a key always stays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _fold(key: str, costs: dict[str, int | None], most: int | None):
    limits = [(name, limit) for name, limit in costs.items() if limit is not None]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: object = run  # no key is that
        taken, used = 0, [0] * len(limits)
        for batch in batches:
            take = np.zeros(batch.num_rows, bool)
            column = lambda name: batch.column(batch.schema.get_field_index(name)).to_pylist()  # noqa: B023, E731
            for i, (k, *cost) in enumerate(zip(column(key), *(column(name) for name, _ in limits), strict=True)):
                if k != now:
                    now, taken, used = k, 0, [0] * len(limits)
                if most is not None and taken >= most:
                    continue
                after = [u + c for u, c in zip(used, cost, strict=True)]
                if not taken or all(a <= limit for a, (_, limit) in zip(after, limits, strict=True)):
                    taken, used, take[i] = taken + 1, after, True
            yield batch.filter(pa.array(take))

    return run


def within(rows: DataFrame, key: str, order: list[Column], costs: dict[str, int | None], most: int | None = None) -> DataFrame:
    """The rows of each key that fit: in ``order``, each at its costs (column: budget, None for no limit), at most ``most``.

    Give it keys, places and sizes, and join what is chosen with the texts afterwards.
    """
    ordered = rows.repartition(key).sortWithinPartitions(key, *order)
    return ordered.mapInArrow(_fold(key, costs, most), rows.schema)
