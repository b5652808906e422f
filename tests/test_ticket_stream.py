"""Tickets from keyed state beside a plain walk over all that is known at each batch."""

import random

import pandas as pd
import pytest

from shroudline.streaming import tickets as TB
from tests.test_outcomes import Clock, Handle


def book(idle=None):
    job = TB.TicketBook(idle)
    job.init(Handle())
    return job


def feed(job, rows, clock=None):
    out = pd.concat(list(job.handleInputRows(("f",), iter([pd.DataFrame(rows, columns=["id", "us", "resolves"])]), clock)))
    return list(out["request_id"])


def plain(batches):
    known, ticket, out = [], None, []
    for batch in batches:
        known += [(name, us) for name, us, resolves in batch if resolves]
        asked = {}
        for name, us, resolves in batch:
            if not resolves:
                asked[name] = min(us, asked.get(name, us))
        for us, name in sorted((us, name) for name, us in asked.items()):
            if ticket is not None:
                done = min((at for n, at in known if n == ticket[1] and at >= ticket[0]), default=None)
                if (us, name) <= ticket or done is None or us < done:
                    continue
            ticket = (us, name)
            out.append(name)
    return out


@pytest.mark.parametrize("seed", range(60))
def test_equals_the_plain_walk(seed):
    r = random.Random(seed)
    rows = []
    for i in range(r.randint(1, 40)):
        us = r.randint(0, 60)
        rows.append((f"t{i:02}", us, False))
        if r.random() < 0.7:
            rows.append((f"t{i:02}", us + r.randint(-5, 20), True))
    rows.sort(key=lambda row: row[1] + r.randint(0, 15))
    batches = []
    while rows:
        n = r.randint(1, 8)
        batches.append(rows[:n])
        rows = rows[n:]
    job = book()
    assert [name for batch in batches for name in feed(job, batch)] == plain(batches)


def test_state_does_not_grow_with_the_history():
    job, sizes = book(), []
    for i in range(300):
        assert feed(job, [(f"t{i:04}", 10 * i, False), (f"t{i:04}", 10 * i + 5, True)]) == [f"t{i:04}"]
        sizes.append(len(job.early.held))
    assert max(sizes) == 0


def test_forgotten_when_idle():
    job = book(idle=5)
    assert feed(job, [("a", 1, False)], Clock()) == ["a"] and job.handle.timers == [6000]
    list(job.handleExpiredTimer(("f",), Clock(), None))
    assert not job.ticket.exists() and feed(job, [("b", 2, False)], Clock()) == ["b"]
