"""Near duplicates: parity bitmaps never rule a link out, and planted pairs close to the threshold are found."""

import numpy as np
import pytest

pytest.importorskip("shroudline.llm")

from shroudline.llm import near  # noqa: E402


def test_parity_never_exceeds_the_difference():
    r = np.random.default_rng(1)
    for _ in range(300):
        common = r.integers(0, 2**63, int(r.integers(0, 900)), dtype=np.uint64)
        left, right = (np.unique(np.r_[common, r.integers(0, 2**63, int(r.integers(0, 60)), dtype=np.uint64)]) for _ in range(2))
        differ = len(np.setxor1d(left, right))
        for bits in (128, 512, near.PARITY_BITS):
            odd = np.bitwise_count(near.parity_bits(left, bits).view(np.uint64) ^ near.parity_bits(right, bits).view(np.uint64)).sum()
            assert odd <= differ


def shingle_set(text, width):
    w = text.split()
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))}


@pytest.mark.parametrize("width", [4, 5])
def test_planted_pairs_near_the_threshold(spark, width):
    r = np.random.default_rng(width)
    rows, pairs = [], []
    while len(pairs) < 400:
        words = [f"w{x}" for x in r.integers(0, 100_000, int(r.integers(60, 300)))]
        other = list(words)
        for at in r.choice(len(words), max(1, round(len(words) * float(r.uniform(0.08, 0.12)) / width)), replace=False):
            other[int(at)] = "changed"
        a, b = shingle_set(" ".join(words), width), shingle_set(" ".join(other), width)
        share = len(a & b) / len(a | b)
        if 0.78 <= share <= 0.86:
            rows += [(2 * len(pairs), " ".join(words)), (2 * len(pairs) + 1, " ".join(other))]
            pairs.append(100 * len(a & b) >= 80 * len(a | b))
    assert 100 < sum(pairs) < 400
    got = {r["doc_id"]: r["component_id"] for r in near.find_near(spark.createDataFrame(rows, "doc_id long, text string"), width=width).collect()}
    assert [got[2 * i] == got[2 * i + 1] for i in range(len(pairs))] == pairs


def test_one_group_around_the_threshold(spark):
    """Copies of one text, most of them between 0.6 and 0.95 similar: components equal those of all pairs."""
    r = np.random.default_rng(9)
    base = [f"w{x}" for x in r.integers(0, 100_000, 120)]
    rows = []
    for i in range(160):
        mine = list(base)
        for at in r.choice(120, int(r.integers(0, 9)), replace=False):
            mine[int(at)] = f"x{int(r.integers(0, 40))}"
        rows.append((i, " ".join(mine)))
    rows.append((3, "another text under a known id " * 3))
    sets = [(i, shingle_set(t, 4)) for i, t in rows]
    root = {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for x, (i, a) in enumerate(sets):
        for j, b in sets[:x]:
            if 100 * len(a & b) >= 80 * len(a | b):
                lo, hi = sorted((find(i), find(j)))
                root[hi] = lo
    want = {i: find(i) for i, _ in rows}
    assert len(set(want.values())) > 5
    got = {r["doc_id"]: r["component_id"] for r in near.find_near(spark.createDataFrame(rows, "doc_id long, text string").repartition(6), width=4).collect()}
    assert got == want
