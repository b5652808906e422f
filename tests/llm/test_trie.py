"""The prefix trie beside plain code: shared prefixes, copies, deep and empty conversations, nulls, ties, negative ids."""

import hashlib
from collections import defaultdict

import numpy as np
import pytest

pytest.importorskip("shroudline.llm")

from shroudline.llm import queries, trie  # noqa: E402

SHAPE = "conv_id long, turn long, role string, text string, position string, size int, k1 int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, None, None, None) for r in rows], SHAPE)


def plain(convs):
    """Nodes of {conversation: list of (role, text)}."""
    at = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            at[tuple(turns[:d])].append(c)
    out = set()
    for node, members in at.items():
        below = [n for n in at if n[: len(node)] == node]
        leaf = [n for n in below if not any(len(m) == len(n) + 1 and m[: len(n)] == n for m in below)]
        saved = sum((len(at[n]) - 1) * len(n[-1][1].encode()) for n in below if n)
        ends = sorted(c for c in members if len(convs[c]) == len(node))
        children = sum(1 for m in at if len(m) == len(node) + 1 and m[: len(node)] == node)
        parent = min(at[node[:-1]]) if node else None
        sha = hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()
        out.add((min(members), len(node), parent, len(members), children, len(leaf), saved, sha))
    return out


def plain_turns(rows):
    by = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            by[c].append(((turn is not None, turn or 0), role or "", text or ""))
    return {c: [(r, t) for _, r, t in sorted(v)] for c, v in by.items()}


@pytest.fixture(scope="module")
def rows():
    r = np.random.default_rng(2)
    words = ["yes", "no", "é long answer", ""]
    out = []
    for c in range(-23, 130):
        for turn in range(int(r.integers(1, 9))):
            out.append((c, turn, "user" if turn % 2 == 0 else "assistant", words[int(r.choice(4, p=[0.6, 0.2, 0.1, 0.1]))]))
    for c in range(1000, 1060):  # copies, longer than any
        out += [(c, t, "user", f"same {t}") for t in range(12)]
    out += [(2000, t, "user", f"deep {t % 7}") for t in range(300)]
    out += [(3000, None, None, None), (3000, 5, "user", None), (3001, 4, None, "x"), (None, 0, "user", "lost")]
    return out


def result(df):
    got = df.collect()
    assert len({tuple(r) for r in got}) == len(got)
    return {tuple(r) for r in got}


@pytest.mark.parametrize("most", [4096, 7, 1])
def test_trie(spark, rows, most):
    turns = trie.keyed_turns(frame(spark, rows).repartition(5))
    assert result(trie.trie_of(turns, shard_conversations=most)) == plain(plain_turns(rows))


def test_whole_operator(spark, rows):
    some = [r for r in rows if r[0] is None or r[0] < 60]
    assert result(trie.prefix_trie(frame(spark, some))) == plain(plain_turns(some))


def test_rebuilt(spark, rows):
    import zlib

    turns = plain_turns([r for r in rows if r[0] is None or r[0] != 5])  # a base that is absent
    new = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        new[c] = turns.get(c - int(np.fmod(c, 5)), [])[:h] + own[h:]
    assert any(not v for v in new.values())
    keyed = trie.keyed_turns(frame(spark, [r for r in rows if r[0] is None or r[0] != 5])).checkpoint()
    assert result(trie.trie_of(queries.rebuilt(keyed))) == plain(new)


def test_ties_and_repeats(spark):
    rows = [(1, 0, "user", "b"), (1, 0, "user", "b"), (1, 0, "assistant", "a"), (2, 0, "assistant", "a"), (2, 1, "user", "b")]
    assert result(trie.prefix_trie(frame(spark, rows))) == plain(plain_turns(rows))


def test_long_text(spark):
    rows = [(1, 0, "user", "x" * 3_000_000), (2, 0, "user", "x" * 3_000_000), (2, 1, "assistant", "")]
    assert result(trie.prefix_trie(frame(spark, rows))) == plain(plain_turns(rows))


def test_empty(spark):
    assert trie.prefix_trie(frame(spark, [])).count() == 0
    assert trie.prefix_trie(frame(spark, [(None, 1, "user", "x")])).count() == 0
