"""Live outcomes of event streams beside a plain fold: any order, batches, repeats, gaps, silence."""

import random
import tracemalloc

import pandas as pd
import pytest

from shroudline.functions import ranks
from shroudline.streaming import outcomes as O


class Value:
    def __init__(self):
        self.held = None

    def exists(self):
        return self.held is not None

    def get(self):
        return self.held

    def update(self, value):
        self.held = value

    def clear(self):
        self.held = None


class Map:
    def __init__(self):
        self.held = {}

    def iterator(self):
        return iter(list(self.held.items()))

    def updateValue(self, key, value):
        self.held[key] = value

    def clear(self):
        self.held = {}


class Handle:
    def __init__(self):
        self.timers = []

    def getValueState(self, *_):
        return Value()

    def getMapState(self, *_):
        return Map()

    def listTimers(self):
        return iter(self.timers)

    def deleteTimer(self, timer):
        self.timers.remove(timer)

    def registerTimer(self, timer):
        self.timers.append(timer)


class Clock:
    def getCurrentProcessingTimeInMs(self):
        return 1000


def lines(r, n):
    out = []
    for seq in range(n):
        quiet = r.random() < 0.5
        out.append({
            "seq": seq, "us": seq * 10, "decision": "allow" if quiet else r.choice(ranks.ACTIONS), "source": "builtin" if quiet else r.choice(["builtin", "opa", "rules"]),
            "reason": None if quiet or r.random() < 0.5 else f"why {seq}", "labels": [] if quiet else [r.choice("abc")], "n_findings": 0 if quiet else 2, "last": seq == n - 1,
        })
    return out


def plain(rows):
    state = (0, "builtin", None, False)
    for row in rows:
        state = O.step(state, (O.RANKS[row["decision"]], row["source"], row["reason"]))
    return ranks.ACTIONS[state[0]], state[1], state[2], sorted({x for row in rows for x in row["labels"]}), sum(row["n_findings"] for row in rows), len(rows)


def folder(idle=None):
    job = O.Folder(idle)
    job.init(Handle())
    return job


def given(frames):
    return [tuple(r) for f in frames for r in f[["decision", "source", "reason", "labels", "n_findings", "n_lines"]].itertuples(index=False)]


@pytest.mark.parametrize("seed", range(40))
def test_any_order_gives_the_plain_fold(seed):
    r = random.Random(seed)
    rows = lines(r, r.randint(1, 60))
    dealt = rows + r.choices(rows, k=r.randint(0, 20))
    r.shuffle(dealt)
    job, out = folder(), []
    while dealt:
        some = dealt[: r.randint(1, 9)]
        dealt = dealt[len(some):]
        out += list(job.handleInputRows(("s",), iter([pd.DataFrame(some)]), None))
    assert given(out) == [plain(rows)] and bool(out[0]["ended"][0])
    assert not job.runs.held
    assert not list(job.handleInputRows(("s",), iter([pd.DataFrame(rows[:1])]), None))  # after the end


def test_state_is_one_run_per_gap():
    rows = lines(random.Random(1), 1000)
    job = folder()
    for at in (0, 2, 1, 4):
        assert not list(job.handleInputRows(("s",), iter([pd.DataFrame(rows[at * 100 : at * 100 + 100])]), None))
    assert sorted(k[0] for k in job.runs.held) == [0, 400]


def test_silence_gives_what_is_there_and_then_lets_go():
    rows = lines(random.Random(2), 30)
    job = folder(idle=5)
    assert not list(job.handleInputRows(("s",), iter([pd.DataFrame(rows[:10] + rows[20:29])]), Clock()))
    assert job.handle.timers == [6000]
    out = list(job.handleExpiredTimer(("s",), Clock(), None))
    assert given(out) == [plain(rows[:10] + rows[20:29])] and not bool(out[0]["ended"][0])
    assert not list(job.handleInputRows(("s",), iter([pd.DataFrame(rows[10:20])]), Clock()))
    assert not list(job.handleExpiredTimer(("s",), Clock(), None)) and not job.mark.exists()


def test_audit_record(spark):
    df = spark.createDataFrame(
        [("s", "block", "opa", "why", ["a"], 2, 9, 1_700_000_000_000_000, True), ("t", "allow", "builtin", None, [], 0, 1, 1_700_000_000_000_000, False)], O.OUTPUT)
    rows = {r.request_id: r for r in O.outcome_audit(df).collect()}
    assert (rows["s"].decision, rows["s"].policy_source, rows["s"].decision_reason, rows["s"].matched_labels, rows["s"].error_stage) == ("block", "opa", "why", ["a"], None)
    assert rows["t"].error_stage == "stream_idle" and rows["s"].status_code == 403


def test_many_open_gaps_take_little_state():
    rows = [{**row, "reason": "why"} for row in lines(random.Random(3), 20_000)]
    job = folder()
    tracemalloc.start()
    assert not list(job.handleInputRows(("s",), iter([pd.DataFrame(rows[at : at + 2000 : 2]) for at in range(0, 20_000, 2000)]), None))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(len(v[0]) for v in job.runs.held.values()) < 100 * 10_000 and peak < 1000 * 10_000
    out = list(job.handleInputRows(("s",), iter([pd.DataFrame(rows[1::2])]), None))
    assert given(out) == [plain(rows)]
