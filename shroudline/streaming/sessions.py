"""Session correlation on a live stream, and line reassembly, as keyed state."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUTPUT = "session_id string, row_id string, us bigint, escalated boolean"


def _carry() -> None:
    """Send the processors along by value: the process that sets state up on the driver's side does not
    see files shipped to the workers."""
    cloudpickle.register_pickle_by_value(sys.modules[__name__])


class Correlator(StatefulProcessor):
    """Labels per session under a sliding time-to-live.

    Rows of a micro-batch are taken in time order.  A row older than the last one adds its labels and
    leaves the last time alone.  No row is dropped for being late.  With ``idle_secs``, state goes when a session got
    no row for so long by the clock.
    """

    def __init__(self, ttl_secs: int, threshold: int, idle_secs: int | None = None):
        self.ttl_us = ttl_secs * 1_000_000
        self.idle_secs = idle_secs
        self.threshold = threshold

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("session", "labels array<string>, last bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(rows).sort_values(["us", "row_id"])
        labels, last = set(), None
        if self.state.exists():
            held = self.state.get()
            labels, last = set(held[0]), held[1]
        flags = []
        for us, found in zip(batch["us"], batch["labels"]):
            if last is not None and us - last > self.ttl_us:
                labels = set()
            last = us if last is None else max(last, us)
            labels.update(found)
            flags.append(len(labels) >= self.threshold)
        self.state.update((sorted(labels), int(last)))
        _restart(self, timerValues)
        yield pd.DataFrame({"session_id": key[0], "row_id": batch["row_id"], "us": batch["us"], "escalated": flags})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        return iter(())

    def close(self) -> None:
        pass


def correlate_stream(events: DataFrame, ttl_secs: int, threshold: int, idle_secs: int | None = None) -> DataFrame:
    """Flag each row (session_id, row_id, ts, us, labels) of a stream, late ones too.

    A job that runs on without end gives ``idle_secs``, at least the TTL and the lateness to expect, so that state of
    idle sessions goes; timers by the clock keep a job that stops at the end of its input from stopping.

    A micro-batch of one session is sorted in one task; the rate limit of the source bounds it.
    """
    _carry()
    return (
        events.groupBy("session_id")
        .transformWithStateInPandas(Correlator(ttl_secs, threshold, idle_secs), outputStructType=OUTPUT, outputMode="Append", timeMode=_mode(idle_secs))
    )


def _mode(idle_secs: int | None) -> str:
    return "None" if idle_secs is None else "ProcessingTime"


def _restart(job, timerValues) -> None:
    """Start the idle time of a key anew."""
    if job.idle_secs is not None:
        for timer in list(job.handle.listTimers()):
            job.handle.deleteTimer(timer)
        job.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + job.idle_secs * 1000)


LINE_OUTPUT = "stream_id string, line_no bigint, line string"


class Reassembler(StatefulProcessor):
    """Whole lines of a stream of chunks numbered from 0; the unfinished rest waits in state.

    A chunk that comes before its turn waits for it, across micro-batches, and one that comes twice is taken once.  The chunk
    marked ``last`` ends its stream in its turn: what is left is given out as a line of its own.  With ``idle_secs``, a stream that
    got no chunk for so long is ended with what is there; chunks after the end are ignored until the mark of the end
    goes, as long after it.
    """

    def __init__(self, idle_secs: int | None = None):
        self.idle_secs = idle_secs

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("rest", "rest binary, lines bigint, next bigint, done boolean")
        self.waiting = handle.getMapState("waiting", "seq bigint", "chunk binary, last boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = self.state.exists()
        rest, number, turn, done = self.state.get() if known else (b"", 0, 0, False)
        # chunks in their turn never pass through state, each access of which is a round trip
        came = {}
        for batch in rows:
            for seq, chunk, last in zip(batch["seq"], batch["chunk"], batch["last"]):
                if not done and seq >= turn:
                    came[int(seq)] = (bytes(chunk or b""), bool(last))
        waits = known and bool(came)
        taken = [bytes(rest)]
        while not done:
            if waits and self.waiting.containsKey((turn,)):
                held = self.waiting.getValue((turn,))
                self.waiting.removeKey((turn,))
            elif turn in came:
                held = None
            else:
                break
            chunk, done = came.pop(turn, held)
            taken.append(bytes(chunk))
            turn += 1
        for seq in () if done else sorted(came):
            self.waiting.updateValue((seq,), came[seq])
        lines = self._given(key, taken, number, done)
        _restart(self, timerValues)
        self.state.update((self.left, number + len(lines), turn, bool(done)))
        yield lines

    def _given(self, key, taken: list[bytes], number: int, done: bool) -> pd.DataFrame:
        *whole, self.left = b"".join(taken).split(b"\n")
        if done:
            whole, self.left = whole + ([self.left] if self.left else []), b""
        return pd.DataFrame({
            "stream_id": key[0], "line_no": range(number, number + len(whole)), "line": [line.decode("utf-8", "replace") for line in whole],
        })

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        rest, number, _, done = self.state.get() if self.state.exists() else (b"", 0, 0, True)
        if done:
            self.state.clear()
            self.waiting.clear()
            return
        held = sorted((k[0], bytes(v[0])) for k, v in self.waiting.iterator())
        lines = self._given(key, [bytes(rest), *(chunk for _, chunk in held)], number, True)
        self.waiting.clear()
        self.state.update((b"", number + len(lines), 0, True))
        _restart(self, timerValues)
        yield lines

    def close(self) -> None:
        pass


def reassemble_stream(chunks: DataFrame, idle_secs: int | None = None) -> DataFrame:
    """Lines of a live stream of chunks (stream_id, seq, chunk, last), whatever the order they come in.

    ``idle_secs`` is for jobs that run on without end, as with :func:`correlate_stream`.
    """
    _carry()
    return chunks.groupBy("stream_id").transformWithStateInPandas(
        Reassembler(idle_secs), outputStructType=LINE_OUTPUT, outputMode="Append", timeMode=_mode(idle_secs)
    )
