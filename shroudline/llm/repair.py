"""Repair of conversation structure: the cheapest edits that give turns a legal order of roles.

A legal conversation is empty, or an optional system turn followed by pairs of user and assistant.  Edits form a lattice: a node is
(rows read, state), the state being what came last: nothing, system, user or assistant.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shroudline.llm.work import ASCII_SPACE, fresh

# Costs of the edits; a truncated row that is not deleted adds TRUNCATED.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
START, SYSTEM, USER, ASSISTANT = range(4)
# The state that a user or assistant turn leads to, and the states that come before each.
NEXT = (USER, USER, ASSISTANT, USER)
BEFORE = ((), (), (START, SYSTEM, ASSISTANT), (USER,))
# By initial of a role: the state that keeping such a row leads to.
KEPT = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
ROLES = {USER: "user", ASSISTANT: "assistant"}
LEGAL = {"su", "ua", "au"}

# Conversations of equal row kinds have equal edits; so many answers are remembered, of at most so many rows.
REMEMBERED, SHORT = 100_000, 64
# Repaired conversations go on when so many, or so many characters, have gathered.
GATHERED, GATHERED_CHARS = 1000, 4_000_000

NAMES = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired"]
SHAPE = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired array<struct<role string, text string>>"


def edges(kinds: str, node: tuple[int, int]) -> list[tuple[str, int, tuple[int, int]]]:
    """(letter, cost, next node) of every edit from ``node``."""
    i, state = node
    out = [("I", INSERT, (i, NEXT[state]))]
    if i < len(kinds):
        kind = kinds[i]
        out.append(("D", DELETE, (i + 1, state)))
        if kind != "-":
            extra = TRUNCATED if kind.isupper() else 0
            out.append(("R", REROLE + extra, (i + 1, NEXT[state])))
            kept = KEPT.get(kind.lower())
            if (kept == SYSTEM and state == START) or (kept in ROLES and kept == NEXT[state]):
                out.append(("K", KEEP + extra, (i + 1, kept)))
    return out


def edges_back(kinds: str, node: tuple[int, int]) -> list[tuple[int, tuple[int, int]]]:
    """(cost, node before) of every edit into ``node``."""
    i, state = node
    out = [(INSERT, (i, before)) for before in BEFORE[state]]
    if i:
        kind = kinds[i - 1]
        out.append((DELETE, (i - 1, state)))
        if kind != "-":
            extra = TRUNCATED if kind.isupper() else 0
            out += [(REROLE + extra, (i - 1, before)) for before in BEFORE[state]]
            if KEPT.get(kind.lower()) == state:
                out += [(KEEP + extra, (i - 1, before)) for before in (BEFORE[state] or (START,))]
    return out


def cheapest(kinds: str) -> tuple[int, str]:
    """Least cost and, of the edits that cost so much, the ASCII-least string of initials.

    ``kinds`` has a character per row: the initial of its role (``x`` for any other than s, u, a), upper case if truncated, and
    ``-`` if it must go.  Dijkstra from both ends: heaps take turns until their least keys together exceed the best meeting, so all
    crossings of that cost are settled.  The least string is read off forwards over what lies on some cheapest way.
    """
    n = len(kinds)
    ahead: dict[tuple[int, int], int] = {(0, START): 0}
    back: dict[tuple[int, int], int] = {(n, START): 0, (n, ASSISTANT): 0}
    heap_ahead, heap_back = [(0, (0, START))], [(0, node) for node in back]
    done_ahead: dict[tuple[int, int], int] = {}
    done_back: dict[tuple[int, int], int] = dict(back)
    best = 0 if n == 0 else DELETE * n
    while heap_ahead and heap_back and heap_ahead[0][0] + heap_back[0][0] <= best:
        if heap_ahead[0][0] <= heap_back[0][0]:
            cost, node = heapq.heappop(heap_ahead)
            if node in done_ahead:
                continue
            done_ahead[node] = cost
            for _, w, to in edges(kinds, node):
                if cost + w < ahead.get(to, cost + w + 1):
                    ahead[to] = cost + w
                    heapq.heappush(heap_ahead, (cost + w, to))
                if to in back:
                    best = min(best, cost + w + back[to])
        else:
            cost, node = heapq.heappop(heap_back)
            if cost > back[node]:
                continue
            done_back[node] = cost
            for w, to in edges_back(kinds, node):
                if cost + w < back.get(to, cost + w + 1):
                    back[to] = cost + w
                    heapq.heappush(heap_back, (cost + w, to))
                if to in ahead:
                    best = min(best, cost + w + ahead[to])
    good: set[tuple[int, int]] = set()

    def leads(cost: int, w: int, to: tuple[int, int]) -> bool:
        return cost + w + done_back.get(to, best + 1) == best or (to in good and cost + w == done_ahead[to])

    for node in sorted(done_ahead, key=lambda x: (-done_ahead[x], -x[0])):
        if any(leads(done_ahead[node], w, to) for _, w, to in edges(kinds, node)):
            good.add(node)
    node, cost, letters = (0, START), 0, []
    while not (node[0] == n and node[1] in (START, ASSISTANT) and cost == best):
        letter, w, node = min(e for e in edges(kinds, node) if leads(cost, e[1], e[2]))
        cost += w
        letters.append(letter)
    return best, "".join(letters)


def replayed(audit: str, rows: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """The repaired (role, text) rows."""
    out, at, state = [], 0, START
    for letter in audit:
        if letter != "D":
            state = KEPT[rows[at][0][0]] if letter == "K" else NEXT[state]
            out.append((rows[at][0] if letter == "K" else ROLES[state], "" if letter == "I" else rows[at][1]))
        at += letter != "I"
    return out


def repair(convs: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", gone: Column | None = None) -> DataFrame:
    """Per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired (an array of role and text).

    Rows go by turn, null first, then by role and text; each row's first fault counts: blank, duplicate (role and text seen before),
    truncated (the last character that is no white space is none of ``.!?``).  Blank and duplicate rows must be deleted.
    illegal counts neighbours whose roles' initials may not follow each other; gaps the turn numbers missing between the least and the greatest.
    audit names the cheapest edits in order: Keep, Rerole, Delete, Insert; of equally cheap ones the ASCII-least.

    Null role or text counts as one space; rows without conversation id belong to no conversation and are left out.  Rows for which
    ``gone`` holds only name their conversation; one without other rows has zeros, an empty audit and nothing repaired.
    Repeated rows are duplicates.  An empty table gives an empty result.  Texts move once, to their conversation, which one
    task holds while it is judged: its audit and repaired rows are values of one row anyway.  Texts of any length are read whole.
    """
    body = F.coalesce(F.col(text), F.lit(" "))
    end = F.right(F.rtrim(body, F.lit(ASCII_SPACE)), F.lit(1))
    lost = F.coalesce(gone, F.lit(False)) if gone is not None else F.lit(False)
    rows = convs.filter(F.col(conv_id).isNotNull()).select(
        F.col(conv_id).alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role), F.lit(" ")).alias("role"), body.alias("text"),
        F.when(end == "", "b").when(end.isin(".", "!", "?"), "f").otherwise("t").alias("end"), lost.alias("gone"),
    )
    order = ("conv_id", F.col("turn").asc_nulls_first(), "role", "text")
    kind = rows.schema["conv_id"].dataType.simpleString()
    return rows.repartition("conv_id").sortWithinPartitions(*order).mapInArrow(judged, f"conv_id {kind}, {SHAPE}")


def judge(rows: list[tuple[int | None, str, str, str]], known: dict[str, tuple[int, str]]) -> tuple:
    """Faults, edits and repaired rows of one conversation, given as (turn, role, text, end) in order."""
    faults, seen, kinds = {"b": 0, "d": 0, "t": 0}, set(), []
    for _, role, text, end in rows:
        initial = role[:1] if role[:1] in KEPT else "x"
        fault = "b" if end == "b" else "d" if (role, text) in seen else end
        seen.add((role, text))
        if fault != "f":
            faults[fault] += 1
        kinds.append("-" if fault in "bd" else initial.upper() if fault == "t" else initial)
    turns = [t for t, *_ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    initials = [role[:1] for _, role, _, _ in rows]
    illegal = sum(a + b not in LEGAL for a, b in zip(initials, initials[1:], strict=False))
    key = "".join(kinds)
    found = known.get(key)
    if found is None:
        found = cheapest(key)
        if len(key) <= SHORT and len(known) < REMEMBERED:
            known[key] = found
    cost, audit = found
    return gaps, faults["b"], faults["d"], faults["t"], illegal, cost, audit, replayed(audit, [(role, text) for _, role, text, _ in rows])


def judged(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[str, tuple[int, str]] = {}
    names: list = []
    results: list[tuple] = []
    chars, name, rows, kind = 0, None, [], None

    def gathered() -> pa.RecordBatch:
        columns = list(zip(*results, strict=True))
        flat = [row for repaired in columns[7] for row in repaired]
        ends = [0]
        for repaired in columns[7]:
            ends.append(ends[-1] + len(repaired))
        pairs = pa.StructArray.from_arrays([pa.array([row[j] for row in flat], pa.string()) for j in range(2)], ["role", "text"])
        arrays = [pa.array(names, kind), *(pa.array(c, pa.int64()) for c in columns[:6]), pa.array(columns[6], pa.string()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs)]
        return pa.RecordBatch.from_arrays(arrays, NAMES)

    for batch in batches:
        kind = batch.column("conv_id").type
        columns = (batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "end", "gone"))
        for conv, turn, role, text, end, gone in zip(*columns, strict=True):
            if conv != name:
                if name is not None:
                    names.append(name)
                    results.append(judge(rows, known))
                    if len(names) >= GATHERED or chars >= GATHERED_CHARS:
                        yield gathered()
                        names, results, chars = [], [], 0
                name, rows = conv, []
            if not gone:
                rows.append((turn, role, text, end))
                chars += len(text)
    if name is not None:
        names.append(name)
        results.append(judge(rows, known))
        yield gathered()


def joined(repaired: str = "repaired") -> Column:
    """Repaired rows as ``role:text`` lines."""
    return F.array_join(F.transform(repaired, lambda row: F.concat(row["role"], F.lit(":"), row["text"])), "\n")


def damage(convs: DataFrame) -> tuple[DataFrame, str]:
    """Conversations with faults put in by crc32 of ``conv_id:turn`` modulo 20, and the column that marks rows dropped.

    0 drops a row, 1 empties its text, 2 removes ``.!?``, 3 repeats it, 4 makes its role user.  Null turn, role or text becomes one space.
    """
    code, gone, copy = fresh(convs, "code", "gone", "copy")
    key = F.concat(F.col("conv_id").cast("string"), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    text = F.coalesce("text", F.lit(" "))
    coded = convs.withColumn(code, F.crc32(key.cast("binary")) % 20)
    out = coded.select(
        "conv_id", "turn", F.when(F.col(code) == 4, "user").otherwise(F.coalesce("role", F.lit(" "))).alias("role"),
        F.when(F.col(code).isin(0, 1), "").when(F.col(code) == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        (F.col(code) == 0).alias(gone), F.explode(F.when(F.col(code) == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias(copy),
    )
    return out.drop(copy), gone
