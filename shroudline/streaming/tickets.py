"""Approval tickets of a live stream as keyed state: what a batch costs follows its rows, not the tickets there have been."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from shroudline.operators.sessions import micros
from shroudline.streaming import sessions
from shroudline.streaming.sessions import _mode, _restart

OUTPUT = "fingerprint string, request_id string, us bigint"


class TicketBook(StatefulProcessor):
    """The latest ticket per fingerprint, whether it is resolved, and resolutions that came before their request.

    A request opens a ticket if none is pending at its time; requests up to the latest ticket open nothing.  A ticket is pending
    until its first resolution that is not before it.  A resolution waits for its request no longer than until a later
    ticket has opened, since an earlier request can then open none.  With ``idle_secs`` a fingerprint without rows for
    so long is forgotten.
    """

    def __init__(self, idle_secs: int | None = None):
        self.idle_secs = idle_secs

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.ticket = handle.getValueState("ticket", "id string, us bigint, done bigint")
        self.early = handle.getMapState("early", "id string, at bigint", "seen boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self.ticket.get() if self.ticket.exists() else None
        ticket = None if held is None else (held[0], int(held[1]), None if held[2] is None else int(held[2]))
        waiting: dict[str, set[int]] = {}
        for name, at in (k for k, _ in self.early.iterator()):
            waiting.setdefault(name, set()).add(int(at))
        asked: dict[str, int] = {}
        for name, us, resolves in pd.concat(rows)[["id", "us", "resolves"]].itertuples(index=False):
            if resolves:
                waiting.setdefault(name, set()).add(int(us))
            else:
                asked[name] = min(int(us), asked.get(name, int(us)))

        def done(name: str, us: int) -> int | None:
            return min((at for at in waiting.get(name, ()) if at >= us), default=None)

        if ticket is not None and ticket[2] is None:
            ticket = (ticket[0], ticket[1], done(ticket[0], ticket[1]))
        opened = []
        for us, name in sorted((us, name) for name, us in asked.items()):
            late = ticket is not None and (us, name) <= (ticket[1], ticket[0])
            if not late and (ticket is None or (ticket[2] is not None and us >= ticket[2])):
                ticket = (name, us, done(name, us))
                opened.append((key[0], name, us))
        if ticket is not None:
            self.ticket.update(ticket)
        self.early.clear()
        for name, times in waiting.items():
            for at in times:
                if ticket is None or (at >= ticket[1] and name != ticket[0]):
                    self.early.updateValue((name, at), (True,))
        _restart(self, timerValues)
        yield pd.DataFrame(opened, columns=["fingerprint", "request_id", "us"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.ticket.clear()
        self.early.clear()
        return iter(())

    def close(self) -> None:
        pass


def ticket_stream(candidates: DataFrame, resolutions: DataFrame, idle_secs: int | None = None) -> DataFrame:
    """Requests (fingerprint, request_id, ts) that open a ticket, given the stream of (fingerprint, ticket_id, resolved_at).

    A ticket goes by its request's id, and a resolution names the fingerprint that it has from the ticket.  A micro-batch of one fingerprint is
    sorted in one task; the rate limit of the source bounds it.
    """
    for module in (sessions, sys.modules[__name__]):
        cloudpickle.register_pickle_by_value(module)
    asked = candidates.select("fingerprint", F.col("request_id").cast("string").alias("id"), micros(F.col("ts")).alias("us"), F.lit(False).alias("resolves"))
    closed = resolutions.select("fingerprint", F.col("ticket_id").cast("string").alias("id"), micros(F.col("resolved_at")).alias("us"), F.lit(True).alias("resolves"))
    both = asked.unionByName(closed).where("fingerprint IS NOT NULL AND id IS NOT NULL AND us IS NOT NULL")
    return both.groupBy("fingerprint").transformWithStateInPandas(TicketBook(idle_secs), outputStructType=OUTPUT, outputMode="Append", timeMode=_mode(idle_secs))
