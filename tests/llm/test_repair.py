"""Conversation repair beside a plain search over all edits: ties, nulls, repeats, dropped and long conversations."""

import itertools
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("shroudline.llm")

from shroudline.llm import repair  # noqa: E402

SHAPE = "conv_id long, turn long, role string, text string, gone boolean, end int, code string"
GOOD = re.compile(r"(s?(ua)+)?\Z")


def plain(kinds):
    """Least (cost, audit) by trying every string of edits, cheapest first, over (rows read, roles so far)."""
    labels = [{} for _ in range(len(kinds) + 1)]
    # the roles so far matter by their last and whether there are any
    labels[0] = {"": (0, "")}
    for i in range(len(kinds) + 1):
        for _ in range(3):  # two inserts in a row are the most that help
            for last, (cost, audit) in list(labels[i].items()):
                to = "a" if last == "u" else "u"
                new = (cost + 2, audit + "I")
                labels[i][to] = min(new, labels[i].get(to, new))
        if i == len(kinds):
            break
        kind = kinds[i]
        extra = 1 if kind.isupper() else 0
        for last, (cost, audit) in labels[i].items():
            ways = [(3, "D", last)]
            if kind != "-":
                to = "a" if last == "u" else "u"
                ways.append((2 + extra, "R", to))
                if kind.lower() == to or (kind.lower() == "s" and last == ""):
                    ways.append((extra, "K", kind.lower()))
            for w, letter, to in ways:
                new = (cost + w, audit + letter)
                labels[i + 1][to] = min(new, labels[i + 1].get(to, new))
    return min(labels[-1][last] for last in ("", "a") if last in labels[-1])


def test_cheapest_exhaustive():
    for n in range(5):
        for kinds in itertools.product("suaxSUA-", repeat=n):
            assert repair.cheapest("".join(kinds)) == plain(kinds), kinds


def test_cheapest_random():
    r = np.random.default_rng(4)
    for _ in range(1500):
        kinds = "".join(r.choice(list("suaxSUAX-"), int(r.integers(5, 40)), p=[0.1, 0.25, 0.25, 0.05, 0.05, 0.1, 0.1, 0.05, 0.05]))
        cost, audit = repair.cheapest(kinds)
        assert (cost, audit) == plain(kinds), kinds


def test_long_conversation():
    kinds = "s" + "uaUa-uu" * 3000
    cost, audit = repair.cheapest(kinds)
    assert len(audit.replace("I", "")) == len(kinds)
    out = repair.replayed(audit, [({"s": "system", "u": "user", "a": "assistant"}.get(k.lower(), "x"), "t") for k in kinds])
    assert GOOD.match("".join(role[0] for role, _ in out))


def test_legal_is_kept():
    assert repair.cheapest("suauaua"[:7]) == (0, "KKKKKKK")
    assert repair.cheapest("") == (0, "")
    assert repair.cheapest("s") == (3, "D")
    assert repair.cheapest("u") == (2, "KI")


@pytest.fixture(scope="module")
def rows():
    r = np.random.default_rng(5)
    out = []
    for c in range(-5, 60):
        for turn in range(int(r.integers(1, 12))):
            role = str(r.choice(["user", "assistant", "system", "tool", "", "u"]))
            text = str(r.choice(["Fine.", "cut off", " \t\n", "", "Why?  ", "dup!", "é…"]))
            out.append((c, None if r.random() < 0.1 else int(turn * r.integers(1, 3)), None if r.random() < 0.05 else role, None if r.random() < 0.05 else text, bool(r.random() < 0.1)))
    out += [(900, 0, "user", "only", True), (901, 0, "user", "Twice.", False), (901, 0, "user", "Twice.", False), (902, None, "user", "Hm.", None), (None, 1, "user", "lost", False)]
    out += [(903, i, "user" if i % 2 == 0 else "assistant", f"turn {i}.", False) for i in range(400)]
    out.append((904, 1, "user", "x" * 2_000_000 + ".", False))
    return out


def frame(spark, rows):
    return spark.createDataFrame([(*r, None, None) for r in rows], SHAPE)


def expected(rows):
    out = {}
    for c in {r[0] for r in rows} - {None}:
        mine = sorted(((t is not None, t or 0, " " if role is None else role, " " if text is None else text) for k, t, role, text, gone in rows if k == c and not gone))
        seen, kinds, faults, pairs = set(), "", [0, 0, 0], [(role, text) for _, _, role, text in mine]
        for role, text in pairs:
            last = text.rstrip(" \t\n\x0b\x0c\r")[-1:]
            first = role[:1] if role[:1] in ("s", "u", "a") else "x"
            if not last:
                faults[0] += 1
                kinds += "-"
            elif (role, text) in seen:
                faults[1] += 1
                kinds += "-"
            elif last not in ".!?":
                faults[2] += 1
                kinds += first.upper()
            else:
                kinds += first
            seen.add((role, text))
        turns = [t for known, t, _, _ in mine if known]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(pairs, pairs[1:], strict=False))
        cost, audit = plain(kinds)
        fixed, at = [], 0
        for letter in audit:
            if letter == "K":
                fixed.append(pairs[at])
            elif letter in "RI":
                role = "assistant" if fixed and fixed[-1][0][:1] == "u" else "user"
                fixed.append((role, "" if letter == "I" else pairs[at][1]))
            at += letter != "I"
        assert GOOD.match("".join(role[:1] for role, _ in fixed))
        out[c] = (gaps, *faults, illegal, cost, audit, fixed)
    return out


def test_repair(spark, rows):
    got = repair.repair(frame(spark, rows).repartition(6), gone=F.col("gone")).collect()
    assert len(got) == len({r["conv_id"] for r in got})
    have = {r["conv_id"]: (*r[1:-1], [(x["role"], x["text"]) for x in r["repaired"]]) for r in got}
    assert have == expected(rows)
    assert have[900] == (0, 0, 0, 0, 0, 0, "", [])


def test_empty(spark):
    assert repair.repair(frame(spark, [])).count() == 0


def test_damage(spark):
    import zlib

    rows = [(c, t, "system", "One. Two! Three? end", None) for c in range(60) for t in range(3)] + [(7, None, None, None, None)]
    damaged, gone = repair.damage(frame(spark, rows))
    assert gone == "_gone"
    have = sorted((tuple(r) for r in damaged.select("conv_id", "turn", "role", "text", gone).collect()), key=repr)
    want = []
    for c, t, role, text, _ in rows:
        code = zlib.crc32(f"{c}:{' ' if t is None else t}".encode()) % 20
        text, role = " " if text is None else text, " " if role is None else role
        text = "" if code in (0, 1) else text.translate({ord(x): None for x in ".!?"}) if code == 2 else text
        want += [(c, t, "user" if code == 4 else role, text, code == 0)] * (2 if code == 3 else 1)
    assert have == sorted(want, key=repr)
