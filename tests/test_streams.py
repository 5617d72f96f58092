"""Streams with state: the same rows as whole files give, over triggers and restarts."""

import json
import os
import random
import time

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from tessera.operators import ledger
from tessera.sources import transcripts
from tessera.streaming import progress, sse_stream, transcript_stream

MESSAGE = '<user-message source="current" line="{0}" chars="3" uuid="{1}">\nold {0}\n</user-message>'


def transcript(session, n=40):
    r = random.Random(session)
    out = []
    for i in range(n):
        kind = r.randrange(6)
        if kind < 2:
            out.append(json.dumps({"type": "user", "uuid": f"u{r.randrange(25)}", "message": {"role": "user", "content": f"wish {i} é中 {session}"}}, ensure_ascii=False))
        elif kind == 2:
            out.append(json.dumps({"type": "assistant", "message": {"role": "assistant", "content": [{"type": "text", "text": f"done {i}"}]}}))
        elif kind == 3:
            carried = "\n".join(MESSAGE.format(k, f"u{k}") for k in r.sample(range(40), 5))
            out.append(json.dumps({"type": "user", "isCompactSummary": True, "message": {"role": "user", "content": carried}}))
        elif kind == 4:
            out.append(r.choice(["{broken", "", " \t　 ", json.dumps({"type": "system"})]))
        else:
            out.append(json.dumps({"type": "user", "isMeta": True, "message": {"role": "user", "content": "hidden"}}))
    return ("\r\n" if session % 2 else "\n").join(out)


def run(stream, folder, name):
    q = stream.writeStream.format("parquet").option("path", f"{folder}/{name}").option("checkpointLocation", f"{folder}/_{name}").trigger(availableNow=True).start()
    q.awaitTermination(120)
    if q.exception():
        raise q.exception()


def cells(df, *columns):
    return sorted(str(tuple(r)) for r in df.select(*columns).collect())


@pytest.fixture(scope="module")
def streamed(spark, tmp_path_factory):
    """Three sessions, cut anywhere (inside characters too), read over three runs of each query."""
    folder = str(tmp_path_factory.mktemp("streams"))
    r, whole = random.Random(5), {f"s{i}": transcript(i).encode() for i in range(3)}
    cuts = {s: sorted(r.sample(range(1, len(t)), 5)) for s, t in whole.items()}
    for step in range(3):
        for s, t in whole.items():
            at = [0, *cuts[s], len(t)]
            os.makedirs(f"{folder}/in/{s}", exist_ok=True)
            for k in (2 * step, 2 * step + 1):
                with open(f"{folder}/in/{s}/{k:06d}", "wb") as f:
                    f.write(t[at[k] : at[k + 1]])
        if step == 2:
            whole["s0"] += b"\n"  # this session's last line is ended; those of the others wait
            open(f"{folder}/in/s0/999999", "wb").write(b"\n")
        lines = transcript_stream.lines(transcript_stream.read_chunks(spark, f"{folder}/in"))
        run(lines, folder, "lines")
        run(transcript_stream.citable(lines), folder, "citable")
        run(transcript_stream.ledger_changes(lines), folder, "changes")
    os.makedirs(f"{folder}/whole")
    for s, t in whole.items():
        with open(f"{folder}/whole/{s}", "wb") as f:
            f.write(t if s == "s0" else t[: t.rindex(b"\n") + 1])
    batch = transcripts.read_lines(spark, f"{folder}/whole", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)).cache()
    return folder, batch


def test_stream_gives_the_lines_of_whole_files(spark, streamed):
    folder, batch = streamed
    got = spark.read.schema(transcript_stream.LINE).parquet(f"{folder}/lines")
    assert cells(got, "session_id", "ord", "raw") == cells(batch, "session_id", "ord", "raw") and batch.count() > 90
    columns = ["session_id", "line", "hash", "preview", "text"]
    assert cells(transcript_stream.entries(got), *columns) == cells(transcripts.numbered(batch), *columns)


def test_stream_numbers_citable_records(spark, streamed):
    folder, batch = streamed
    got = spark.read.schema(transcript_stream.CITED).parquet(f"{folder}/citable")
    assert cells(got, "session_id", "line", "raw") == cells(transcripts.numbered(batch, citable=True), "session_id", "line", "raw")


def test_stream_leads_to_the_ledger_of_whole_files(spark, streamed):
    folder, batch = streamed
    changes = spark.read.schema(transcript_stream.CHANGE).parquet(f"{folder}/changes")
    columns = ["session_id", "ord", "line", "uuid", "source", "sha256", "char_count", "text"]
    want = ledger.of_entries(transcripts.numbered(batch))
    assert cells(transcript_stream.ledger_of(changes), *columns) == cells(want, *columns)
    assert {r.source for r in want.collect()} == {"carried", "current"} and changes.where("dropped").count() > 0


def test_a_null_chunk_ends_a_session(spark, tmp_path):
    transcript_stream.prepare(spark)
    spark.createDataFrame([("a", "1", b'{"x":1}\r\n\n{"y"'), ("a", "2", b":2}"), ("b", "1", b"open")], "session_id string, seq string, chunk binary").write.parquet(f"{tmp_path}/in/1")
    spark.createDataFrame([("a", "3", None)], "session_id string, seq string, chunk binary").write.parquet(f"{tmp_path}/in/2")
    chunks = spark.readStream.schema("session_id string, seq string, chunk binary").option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    run(transcript_stream.lines(chunks), tmp_path, "out")
    got = spark.read.schema(transcript_stream.LINE).parquet(f"{tmp_path}/out")
    assert cells(got, "session_id", "ord", "raw") == ["('a', 0, '{\"x\":1}')", "('a', 1, '{\"y\":2}')"]


class Cell:
    """A value of a state store, by hand."""

    def __init__(self):
        self.value = None

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def clear(self):
        self.value = None


class Clock:
    """A clock that moves when it is told to, with timers."""

    def __init__(self):
        self.now, self.timers, self.cell = 0, set(), Cell()

    def getValueState(self, name, schema):
        return self.cell

    def registerTimer(self, at):
        assert at > self.now
        self.timers.add(at)

    def deleteTimer(self, at):
        self.timers.remove(at)

    def getCurrentProcessingTimeInMs(self):
        return self.now


def played(script, until):
    """Snapshots of one stream: script gives its events (at, delta, completed) in ms; timers come when they are due."""
    clock, n, out = Clock(), 0, []
    p = progress.Progress()
    p.init(clock)
    for clock.now in range(1, until):
        for at in [t for t in clock.timers if t <= clock.now]:
            clock.timers.remove(at)
            out += p.handleExpiredTimer(("s",), clock, None)
        mine = [(d, c) for at, d, c in script if at == clock.now]
        if mine:
            out += p.handleInputRows(("s",), iter([Row(n=n + i, delta=d, completed=c) for i, (d, c) in enumerate(mine)]), clock)
            n += len(mine)
    return out, clock


def test_snapshots_come_a_second_apart_at_most():
    script = [(at, "ab", False) for at in range(5, 5000, 50)] + [(5200, None, True)]
    out, clock = played(script, 40_000)
    times = [r.updated_at for r in out]
    assert all(b - a >= 1000 for a, b in zip(times[:-1], times[1:-1], strict=False)) and 5 <= len(out) <= 7
    assert out[-1].status == "completed" and (out[-1].events, out[-1].delta_events, out[-1].output_chars) == (101, 100, 200)
    assert not clock.timers and clock.cell.value is None  # an ended stream leaves nothing behind


def test_what_the_throttle_held_back_comes_when_the_second_is_over():
    out, _ = played([(2000, "a", False), (2100, "b", False), (2200, "c", False)], 10_000)
    assert [(r.updated_at, r.output_tail, r.status) for r in out] == [(2000, "a", "streaming"), (3000, "abc", "streaming")]


def test_silence_brings_one_heartbeat_each_fifteen_seconds():
    out, _ = played([(10, "x", False), (20_000, None, False), (70_000, "y" * 5000, False)], 90_000)
    assert [(r.updated_at, r.events) for r in out] == [(1000, 1), (16_000, 1), (35_000, 2), (50_000, 2), (65_000, 2), (70_000, 3), (85_000, 3)]
    assert len(out[-1].output_tail) == 4000


def test_progress_of_a_real_stream(spark, tmp_path):
    """Chunks are framed, then counted; a restart goes on from the checkpoint, and a timer tells of silence."""
    transcript_stream.prepare(spark)
    data = lambda t: "data: " + json.dumps({"choices": [{"delta": {"content": t}}]}) + "\n\n"
    schema = "stream_id string, seq long, chunk string"
    (tmp_path / "in").mkdir()
    feed = lambda name, rows: (tmp_path / "in" / name).write_text("\n".join(json.dumps(dict(zip(("stream_id", "seq", "chunk"), r, strict=True))) for r in rows))
    events = sse_stream.events(spark.readStream.schema(schema).json(str(tmp_path / "in")))
    feed("1", [("a", 1, data("one ")), ("a", 2, data("two ")[:9]), ("b", 1, data("x"))])
    run(events, tmp_path, "events")
    feed("2", [("a", 3, data("two ")[9:] + "data: [DONE]\n\n")])
    run(events, tmp_path, "events")
    told = spark.readStream.schema(sse_stream.EVENT).parquet(str(tmp_path / "events"))
    q = progress.snapshots(told, "chat", every=200, silence=1500).writeStream.format("parquet").option("path", f"{tmp_path}/told").option("checkpointLocation", f"{tmp_path}/_told").trigger(processingTime="300 milliseconds").start()
    got = spark.createDataFrame([], progress.SNAPSHOT)
    for _ in range(60):
        time.sleep(1)
        if q.exception():
            raise q.exception()
        if os.path.isdir(f"{tmp_path}/told/_spark_metadata"):
            got = spark.read.schema(progress.SNAPSHOT).parquet(f"{tmp_path}/told").withColumn("live", progress.live()).collect()
            if sum(r.stream_id == "b" for r in got) > 1 and any(r.status == "completed" for r in got):
                break
    q.stop()
    done = [r for r in got if r.status == "completed"]
    assert [(r.stream_id, r.delta_events, r.output_tail) for r in done] == [("a", 2, "one two ")] and "- output chars: 8\n" in done[0].live
    b = sorted(r.updated_at for r in got if r.stream_id == "b")
    assert len(b) > 1 and all(y - x >= 1500 for x, y in zip(b, b[1:], strict=False))
