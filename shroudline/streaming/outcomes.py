"""One outcome per live event stream, when its end mark has come or it fell silent."""

from __future__ import annotations

import heapq
import json
import sys
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from shroudline.functions import ranks
from shroudline.functions.ranks import ACTIONS
from shroudline.operators import audits
from shroudline.streaming import sessions
from shroudline.streaming.sessions import _mode, _restart

OUTPUT = "stream_id string, decision string, source string, reason string, labels array<string>, n_findings bigint, n_lines bigint, us bigint, ended boolean"
BUILTIN = "builtin"
# Neighbouring places of a stream whose runs are one entry of state.
BLOCK = 256
RANKS = {name: i for i, name in enumerate(ACTIONS)}

# What a run of lines does to an outcome depends on little of the outcome before it: its rank, whether its source is the
# built-in one and whether it has a reason.  A run is kept as what it makes of each of these.
CLASSES = [(rank, builtin, silent) for rank in range(len(RANKS)) for builtin in (0, 1) for silent in (0, 1)]


def step(state: tuple, line: tuple) -> tuple:
    """(rank, source, reason, touched) after one line (rank, source, reason)."""
    rank, source, reason, touched = state
    taken = line[0] > rank or (line[0] == rank and source == BUILTIN and line[1] != BUILTIN) or (reason is None and line[2] is not None)
    return (max(rank, line[0]), line[1], line[2], True) if taken else (rank, source, reason, touched)


def table_of(lines: list[tuple]) -> list[tuple]:
    """What a run of lines makes of each class; what it leaves alone is not touched."""
    out = []
    busy = [line for line in lines if line != (0, BUILTIN, None)]
    for rank, builtin, silent in CLASSES:
        state = (rank, BUILTIN if builtin else "?", None if silent else "?", False)
        for line in busy:
            state = step(state, line)
        out.append(state)
    return out


def through(state: tuple, table: list) -> tuple:
    end = table[CLASSES.index((state[0], int(state[1] == BUILTIN), int(state[2] is None)))]
    return (end[0], end[1], end[2], True) if end[3] else (end[0], state[1], state[2], state[3])


class Runs:
    """Runs of neighbouring lines as (start, end, table, findings, lines, labels, us).

    Tables and label sets are few: they are numbered, and what two of them make together is worked out once, so a run is seven numbers.
    """

    def __init__(self):
        self.numbers: dict[tuple, int] = {}
        self.values: list[tuple] = []
        self.pairs: dict[tuple[int, int], int] = {}

    def number(self, value: tuple) -> int:
        at = self.numbers.setdefault(value, len(self.values))
        if at == len(self.values):
            self.values.append(value)
        return at

    def _pair(self, first: int, second: int, make) -> int:
        at = self.pairs.get((first, second))
        if at is None:
            at = self.pairs[first, second] = self.number(make(self.values[first], self.values[second]))
        return at

    def joined(self, first: tuple, second: tuple) -> tuple:
        """Two runs, one behind the other, as one."""
        table = self._pair(first[2], second[2], lambda a, b: tuple(through(state, b) for state in a))
        labels = first[5] if first[5] == second[5] else self._pair(first[5], second[5], lambda a, b: tuple(sorted({*a, *b})))
        return first[0], second[1], table, first[3] + second[3], first[4] + second[4], labels, max(first[6], second[6])

    def packed(self, runs: list[tuple]) -> str:
        local: dict[int, int] = {}
        rows = [[*run[:2], local.setdefault(run[2], len(local)), *run[3:5], local.setdefault(run[5], len(local)), run[6]] for run in runs]
        return json.dumps([[self.values[n] for n in local], rows], separators=(",", ":"))

    def unpacked(self, text: str) -> list[tuple]:
        values, rows = json.loads(text)
        numbers = [self.number(tuple(tuple(v) if isinstance(v, list) else v for v in value)) for value in values]
        return [(start, end, numbers[table], found, lines, numbers[labels], us) for start, end, table, found, lines, labels, us in rows]

    def read(self, batches: Iterator[pd.DataFrame]) -> tuple[np.ndarray, int | None]:
        """Lines by place, each once, as columns of (seq, table, findings, labels, us), and how many a stream has if a mark says so."""
        parts, size, tables = [], None, {}
        for rows in batches:
            said = []
            for decision, source, reason in zip(rows["decision"], rows["source"], rows["reason"]):
                line = (RANKS[decision], source, reason if isinstance(reason, str) else None)
                if line not in tables:
                    tables[line] = self.number(tuple(table_of([line])))
                said.append(tables[line])
            labels = [self.number(tuple(sorted(set(found)))) for found in rows["labels"]]
            seq = rows["seq"].to_numpy(np.int64)
            parts.append(np.array([seq, said, rows["n_findings"].to_numpy(np.int64), labels, rows["us"].to_numpy(np.int64)], np.int64))
            marked = seq[rows["last"].to_numpy(bool)]
            if len(marked):
                size = max(size or 0, int(marked.max()) + 1)
        lines = np.concatenate(parts, axis=1)
        return lines[:, np.unique(lines[0], return_index=True)[1]], size


class Folder(StatefulProcessor):
    """Runs of neighbouring lines per stream, joined when the lines between them come.

    Lines may come in any order, over any number of micro-batches; one that comes twice counts once.  State is one run for each gap still
    open, the runs that start in BLOCK neighbouring places as one entry.  Lines of a micro-batch are held as five numbers each.  The line marked
    ``last`` says how many there are: when none is missing, the outcome goes out.  With ``idle_secs`` a
    stream that got no line for so long gives the outcome of what is there, marked as not ended; state then goes as long after.
    """

    def __init__(self, idle_secs: int | None = None):
        self.idle_secs = idle_secs

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.runs = handle.getMapState("blocks", "start bigint", "runs string")
        self.mark = handle.getValueState("mark", "size bigint, done boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        size, done = self.mark.get() if self.mark.exists() else (None, False)
        if done:
            _restart(self, timerValues)
            return
        runs = Runs()
        held = [run for _, text in sorted((int(k[0]), v[0]) for k, v in self.runs.iterator()) for run in runs.unpacked(text)]
        lines, marked = runs.read(rows)
        size = size if marked is None else marked
        if held:
            spans = np.array([run[:2] for run in held], np.int64)
            before = np.searchsorted(spans[:, 0], lines[0], "right") - 1
            lines = lines[:, (before < 0) | (spans[before, 1] <= lines[0])]  # the others are known already
        new = ((seq, seq + 1, table, found, 1, labels, us) for seq, table, found, labels, us in zip(*(column.tolist() for column in lines)))
        merged: list[tuple] = []
        for run in heapq.merge(held, new):
            if merged and merged[-1][1] == run[0]:
                merged[-1] = runs.joined(merged[-1], run)
            else:
                merged.append(run)
        whole = size is not None and merged[0][0] == 0 and merged[0][1] >= size
        self.runs.clear()
        for _, some in groupby([] if whole else merged, lambda run: run[0] // BLOCK):
            near = list(some)
            self.runs.updateValue((near[0][0],), (runs.packed(near),))
        self.mark.update((size, whole))
        _restart(self, timerValues)
        if whole:
            yield self._outcome(key, runs, merged[:1], True)

    def _outcome(self, key, runs: Runs, some: list[tuple], ended: bool) -> pd.DataFrame:
        state, total = (0, BUILTIN, None, False), some[0]
        for i, run in enumerate(some):
            state = through(state, runs.values[run[2]])
            total = runs.joined(total, run) if i else run
        return pd.DataFrame([{
            "stream_id": key[0], "decision": ACTIONS[state[0]], "source": state[1], "reason": state[2], "labels": list(runs.values[total[5]]),
            "n_findings": total[3], "n_lines": total[4], "us": total[6], "ended": ended,
        }])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        size, done = self.mark.get() if self.mark.exists() else (None, True)
        runs = Runs()
        held = [run for _, text in sorted((int(k[0]), v[0]) for k, v in self.runs.iterator()) for run in runs.unpacked(text)]
        self.runs.clear()
        if done or not held:
            self.mark.clear()
            return
        self.mark.update((size, True))
        _restart(self, timerValues)
        yield self._outcome(key, runs, held, False)

    def close(self) -> None:
        pass


def outcome_stream(lines: DataFrame, idle_secs: int | None = None) -> DataFrame:
    """Outcomes of live streams from judged lines (stream_id, seq from 0, us, decision, source, reason, labels, n_findings, last).

    ``idle_secs`` is for jobs that run on without end: timers by the clock keep a job that stops at the end of its input from stopping.
    """
    for module in (sessions, sys.modules[__name__]):
        cloudpickle.register_pickle_by_value(module)
    return lines.groupBy("stream_id").transformWithStateInPandas(Folder(idle_secs), outputStructType=OUTPUT, outputMode="Append", timeMode=_mode(idle_secs))


def judged_lines(redacted: DataFrame, seq: Column, us: Column, last: Column) -> DataFrame:
    """Rewritten lines in the shape :func:`outcome_stream` takes."""
    return redacted.select(
        F.col("stream_id").cast("string").alias("stream_id"), seq.cast("bigint").alias("seq"), us.alias("us"), "decision", "source", "reason",
        F.array_distinct(F.transform("resolved", lambda f: f["label"])).alias("labels"), F.size("resolved").cast("bigint").alias("n_findings"), last.alias("last"),
    )


def outcome_audit(outcomes: DataFrame) -> DataFrame:
    """The audit record of each stream's outcome; a stream that was given up says so in its error stage."""
    none = F.lit(None).cast("string")
    return outcomes.select(
        F.timestamp_micros("us").alias("ts"), F.col("stream_id").alias("request_id"), none.alias("principal"), none.alias("tenant_id"), F.lit("response").alias("direction"),
        none.alias("path"), "decision", F.col("source").alias("policy_source"), F.col("reason").alias("decision_reason"), F.col("labels").alias("matched_labels"),
        F.array().cast("array<string>").alias("matched_rules"), F.array().cast(audits.build_type()).alias("findings"), none.alias("session_id"),
        F.lit(False).alias("session_escalated"), ranks.decision_status(F.col("decision")).alias("status_code"),
        F.when(~F.col("ended"), "stream_idle").alias("error_stage"), none.alias("error_kind"),
    )
