"""Progress of event streams: a snapshot a second at most while text comes, a heartbeat in silence, one at the end.

State by stream is its counts, the end of its text, and when it was last told of; what a second's throttle held
back comes out when its timer is due, also if nothing more arrives.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tessera.sources import sse
from tessera.streaming import transcript_stream

#: Milliseconds between snapshots, of silence before a heartbeat, and characters of the tail.
EVERY, SILENCE, TAIL = 1_000, 15_000, 4_000

SNAPSHOT = "stream_id string, status string, events long, delta_events long, output_chars long, output_tail string, updated_at long"
_STATE = "events long, deltas long, chars long, tail string, told long, heard long, held boolean, due long"


class Progress(StatefulProcessor):
    """Snapshots of one stream's counts."""

    def __init__(self, every: int = EVERY, silence: int = SILENCE):
        self.every, self.silence = every, silence

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("progress", _STATE)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        now = timerValues.getCurrentProcessingTimeInMs()
        s = self._load(now)
        ended = False
        for row in sorted(rows, key=lambda r: r.n):
            s["events"] += 1
            if row.delta:
                s["deltas"] += 1
                s["chars"] += len(row.delta)
                s["tail"] = (s["tail"] + row.delta)[-TAIL:]
                s["held"] = True
            ended |= bool(row.completed)
        s["heard"] = now
        if ended:
            yield self._snapshot(key, s, now, "completed")
            self._wait(s, 0)
            self.state.clear()
            return
        if s["held"] and now - s["told"] >= self.every:
            yield self._told(key, s, now)
        self._keep(s)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        now = timerValues.getCurrentProcessingTimeInMs()
        s = self._load(now)
        s["due"] = 0  # a timer that is due is gone
        if s["held"] and now - s["told"] >= self.every or now - max(s["told"], s["heard"]) >= self.silence:
            yield self._told(key, s, now)
        self._keep(s)

    def close(self) -> None:
        pass

    def _load(self, now: int) -> dict:
        if not self.state.exists():
            return {"events": 0, "deltas": 0, "chars": 0, "tail": "", "told": 0, "heard": now, "held": False, "due": 0}
        return dict(zip((x.split()[0] for x in _STATE.split(", ")), self.state.get(), strict=True))

    def _told(self, key: Any, s: dict, now: int) -> Row:
        s["told"], s["held"] = now, False
        return self._snapshot(key, s, now, "streaming")

    def _snapshot(self, key: Any, s: dict, now: int, status: str) -> Row:
        return Row(stream_id=key[0], status=status, events=s["events"], delta_events=s["deltas"], output_chars=s["chars"], output_tail=s["tail"], updated_at=now)

    def _keep(self, s: dict) -> None:
        """The next timer: the second's end if something is held back, else the end of the silence."""
        self._wait(s, s["told"] + self.every if s["held"] else max(s["told"], s["heard"]) + self.silence)
        self.state.update(tuple(s.values()))

    def _wait(self, s: dict, until: int) -> None:
        if s["due"] and s["due"] != until:
            self.handle.deleteTimer(s["due"])
        if until and s["due"] != until:
            self.handle.registerTimer(until)
        s["due"] = until


def snapshots(events: DataFrame, family: str, every: int = EVERY, silence: int = SILENCE) -> DataFrame:
    """Snapshots of a stream of events (stream_id, n, event, data), as sse_stream.events gives them."""
    transcript_stream.prepare(events.sparkSession)
    told = events.select("stream_id", "n", *(x.alias(n) for n, x in zip(("delta", "completed"), sse.signs(family), strict=True)))
    return told.groupBy("stream_id").transformWithState(Progress(every, silence), SNAPSHOT, "Append", "ProcessingTime")


def live() -> Column:
    """The document that shows a snapshot."""
    named = [("status", "status"), ("events", "events"), ("delta events", "delta_events"), ("output chars", "output_chars")]
    lines = [F.concat(F.lit(f"- {title}: "), F.col(c).cast("string")) for title, c in named]
    return F.concat_ws("\n", F.lit("# Compaction Stream\n"), *lines, F.lit("\n## Partial JSON Tail\n\n```json"), F.col("output_tail"), F.lit("```\n"))
