"""Incremental reading of event streams: chunks in, complete events out, the rest kept as state."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessera.sources import sse


#: Characters of an unfinished block at most; a block beyond is not an event stream.
LONGEST = 16 << 20


def _blocks(quiet: int | None, key: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    rest, n = state.get if state.exists else ("", 0)
    ended, rows = quiet is not None and state.hasTimedOut, []
    for frame in chunks:
        for chunk in frame.sort_values("seq")["chunk"]:
            if chunk is None:
                ended = True
                continue
            rest += chunk
            pieces = rest.replace("\r\n", "\n").split("\n\n")
            rest = pieces.pop()
            rows += [p for p in pieces if p.strip()]
            if len(rest) > LONGEST:
                raise ValueError(f"stream {key[0]}: a block of more than {LONGEST} characters")
    if ended and rest.strip():
        rows.append(rest)
    if ended:
        state.remove()
    else:
        state.update((rest, n + len(rows)))
        if quiet is not None:
            state.setTimeoutDuration(quiet)
    yield pd.DataFrame({"stream_id": [key[0]] * len(rows), "n": range(n, n + len(rows)), "block": rows})


def blocks(chunks: DataFrame, quiet: int | None = None) -> DataFrame:
    """Blocks of a stream of (stream_id, seq, chunk); state is a stream's unfinished text and its count.

    Chunks of one stream must come in order of seq over micro-batches. A null chunk ends a stream: what is
    unfinished then is its last block. So do ``quiet`` milliseconds without a chunk, if given.
    """
    timeout = GroupStateTimeout.NoTimeout if quiet is None else GroupStateTimeout.ProcessingTimeTimeout
    return chunks.groupBy("stream_id").applyInPandasWithState(partial(_blocks, quiet), "stream_id string, n long, block string", "rest string, n long", "append", timeout)


def events(chunks: DataFrame, quiet: int | None = None) -> DataFrame:
    """Parsed events of complete blocks; the batch form is sources.sse.events."""
    return blocks(chunks, quiet).withColumn("e", sse.block_event(F.col("block"))).where("e IS NOT NULL").select("stream_id", "n", "e.*")


#: Fixed value: columns of an events file.
EVENT = "stream_id string, n long, event string, data string, type string, ok boolean"


def side_files(chunks: DataFrame, folder: str) -> list:
    """Starts the files of a run, which grow by what each micro-batch brings: raw chunks, and events. Gives the queries."""
    named = (("raw", chunks), ("events", events(chunks)))
    return [df.writeStream.format("json").option("path", f"{folder}/{name}").option("checkpointLocation", f"{folder}/_{name}").trigger(availableNow=True).start() for name, df in named]


def texts_so_far(spark: SparkSession, folder: str, family: str) -> DataFrame:
    """(stream_id, text): what the events on file say, put together when it is asked for."""
    return sse.outcome(spark.read.schema(EVENT).json(f"{folder}/events"), family).select("stream_id", "text")
