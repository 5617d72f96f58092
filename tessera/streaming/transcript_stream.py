"""Transcripts that grow while they are read: chunks in, entries and the ledger's changes out.

Three steps keep state by session in a state store that a checkpoint restores: ``lines`` holds the bytes of
an unfinished line and the next line's number, ``citable`` the number of records that can be cited, and
``ledger_changes`` which messages are current, which are carried over from an earlier round, and which of
those a current one replaced. No state holds a session's texts, and no step gives a row again that it gave
before. What comes out over all micro-batches equals the batch form over the whole files.

A session's chunks must come in order of seq over micro-batches; within one they may come in any order. A null
chunk ends a session: what is unfinished then is its last line.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tessera.operators import ledger
from tessera.sources import transcripts

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Fixed value: characters of a blank line, as the batch form has them.
BLANK = "\t\n\x0b\x0c\r                  　﻿"
#: Bytes of an unfinished line at most; a line beyond is no record.
LONGEST = 256 << 20

#: Fixed value: columns of files read whole.
FILE = "path string, modificationTime timestamp, length long, content binary"
LINE = "session_id string, ord long, raw string"
CITED = f"{LINE}, line long"
CHANGE = "session_id string, version long, key string, side int, ord long, dropped boolean, message string"


def prepare(spark: SparkSession) -> None:
    """States of several variables need a store that has them."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)


def read_chunks(spark: SparkSession, pattern: str) -> DataFrame:
    """(session_id, seq, chunk): files that are added below a folder for each session, in order of their names."""
    prepare(spark)
    files = spark.readStream.format("binaryFile").schema(FILE).option("recursiveFileLookup", "true").load(pattern)
    parts = F.split("path", "/")
    return files.select(F.element_at(parts, -2).alias("session_id"), F.element_at(parts, -1).alias("seq"), F.col("content").alias("chunk"))


class Lines(StatefulProcessor):
    """Whole lines of a session's chunks, blank ones left out and the rest numbered from 0."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.next, self.rest = handle.getValueState("next", "ord long"), handle.getValueState("rest", "bytes binary")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        n = self.next.get()[0] if self.next.exists() else 0
        rest = bytes(self.rest.get()[0]) if self.rest.exists() else b""
        for row in sorted(rows, key=lambda r: r.seq):
            ended = row.chunk is None
            *whole, rest = ((rest + b"\n") if ended and rest else rest + bytes(row.chunk or b"")).split(b"\n")
            if len(rest) > LONGEST:
                raise ValueError(f"session {key[0]}: a line of more than {LONGEST} bytes")
            for line in whole:
                text = line.decode("utf-8", "replace").removesuffix("\r")
                if text.strip(BLANK):
                    yield Row(session_id=key[0], ord=n, raw=text)
                    n += 1
        self.next.update((n,))
        self.rest.update((rest,))

    def close(self) -> None:
        pass


def lines(chunks: DataFrame) -> DataFrame:
    """(session_id, ord, raw) of a stream of (session_id, seq, chunk); the batch form is sources.transcripts.read_lines."""
    chunks = chunks.select("session_id", "seq", F.col("chunk").cast("binary").alias("chunk"))
    return chunks.groupBy("session_id").transformWithState(Lines(), LINE, "Append", "None")


class Citable(StatefulProcessor):
    """Numbers a session's records that can be cited, from 1."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.count = handle.getValueState("count", "n long")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        n = self.count.get()[0] if self.count.exists() else 0
        for row in sorted(rows, key=lambda r: r.ord):
            n += 1
            yield Row(session_id=key[0], ord=row.ord, raw=row.raw, line=n)
        self.count.update((n,))

    def close(self) -> None:
        pass


def citable(stream: DataFrame) -> DataFrame:
    """lines that can be cited, with their number among them (line); the batch form is transcripts.numbered(citable=True)."""
    own = transcripts.parsed(stream).where(transcripts.evidence_text(F.col("record")) != "")
    return own.select("session_id", "ord", "raw").groupBy("session_id").transformWithState(Citable(), CITED, "Append", "None")


def entries(stream: DataFrame) -> DataFrame:
    """lines as entries: what transcripts.numbered gives for whole files, without a window."""
    out = transcripts.parsed(stream).withColumn("line", F.col("ord") + 1)
    return transcripts.described(out)


class Ledger(StatefulProcessor):
    """Puts and drops messages by key: current ones replace carried ones of the same key, whichever came first."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.version = handle.getValueState("version", "n long")
        self.carried = handle.getMapState("carried", "key string", "ord long")
        self.named = handle.getMapState("named", "key string", "ord long")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        n = self.version.get()[0] if self.version.exists() else 0
        for row in sorted(rows, key=lambda r: (r.ord, r.at)):
            if row.side:
                for name in row.names:
                    self.named.updateValue((name,), (row.ord,))
                    if self.carried.containsKey((name,)):
                        at = self.carried.getValue((name,))[0]
                        self.carried.removeKey((name,))
                        n += 1
                        yield Row(session_id=key[0], version=n, key=name, side=0, ord=at, dropped=True, message=None)
                at = row.ord
            elif self.named.containsKey((row.key,)):
                continue
            else:
                at = self.carried.getValue((row.key,))[0] if self.carried.containsKey((row.key,)) else ledger.carried_place(row.ord, row.at)
                self.carried.updateValue((row.key,), (at,))
            n += 1
            yield Row(session_id=key[0], version=n, key=row.key, side=row.side, ord=at, dropped=False, message=row.message)
        self.version.update((n,))

    def close(self) -> None:
        pass


MESSAGE = "line long, uuid string, original_uuid string, parent_uuid string, timestamp string, source string, sha256 string, record_sha256 string, char_count long, text string"
_NAMES = [x.split()[0] for x in MESSAGE.split(", ")]


def ledger_changes(stream: DataFrame) -> DataFrame:
    """(session_id, version, key, side, ord, dropped, message): what each micro-batch changes in the ledgers of its sessions.

    stream: lines. ``ledger_of`` gives the ledger that changes lead to.
    """
    own = entries(stream)
    r = F.col("record")
    current = ledger.message_struct(r, F.col("line"), F.col("hash"))
    one = F.when(transcripts.is_user_message(r), F.array(F.struct(F.lit(1).alias("side"), F.lit(0).alias("at"), current.alias("m"))))
    earlier = F.transform(ledger.summary_messages(r), lambda m, i: F.struct(F.lit(0).alias("side"), i.cast("int").alias("at"), m.alias("m")))
    flat = own.select("session_id", "ord", F.explode(F.concat(F.coalesce(one, F.array().cast(f"array<struct<side:int,at:int,m:{ledger.MESSAGE_TYPE}>>")), earlier)).alias("x"))
    rows = flat.select("session_id", "ord", "x.side", "x.at", "x.m.*")
    rows = rows.select("session_id", "ord", "side", "at", ledger.identity().alias("key"), ledger.names().alias("names"), F.to_json(F.struct(*_NAMES)).alias("message"))
    return rows.groupBy("session_id").transformWithState(Ledger(), CHANGE, "Append", "None")


def ledger_of(changes: DataFrame) -> DataFrame:
    """The ledger by session after all changes: messages with ord, carried ones first; the batch form is ledger.of_entries."""
    last = F.max_by(F.struct("side", "ord", "dropped", "message"), F.col("version"))
    kept = changes.groupBy("session_id", "key").agg(last.alias("c")).where("NOT c.dropped")
    number = F.row_number().over(Window.partitionBy("session_id").orderBy("c.side", "c.ord"))
    return kept.select("session_id", number.alias("ord"), F.from_json("c.message", MESSAGE).alias("m")).select("session_id", "ord", "m.*")
