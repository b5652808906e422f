"""Shard sizes over a whole table, and repeated runs of unmarked pages beside a plain search over all token windows."""

import os
from collections import Counter, defaultdict

import numpy as np
import pytest

pytest.importorskip("shroudline.llm")

from shroudline.llm import pages, shards  # noqa: E402


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="driver tables are not here")
def test_shards_are_near_equal_in_bytes(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = shards.assign_shards(docs, 8).select("doc_id", "size", "shard", "slot").collect()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    total, group, where = Counter(), Counter(), defaultdict(set)
    for r in rows:
        assert r["size"] == len((texts[r["doc_id"]] or "").encode()) + 1
        total[r["shard"]] += r["size"]
        group[texts[r["doc_id"]]] += r["size"]
        where[texts[r["doc_id"]]].add(r["shard"])
    assert all(len(s) == 1 for s in where.values()) and len(total) == 8
    assert max(total.values()) - min(total.values()) <= max(max(group.values()), sum(total.values()) // 8 // 50)
    for shard in total:
        assert sorted(r["slot"] for r in rows if r["shard"] == shard) == list(range(sum(r["shard"] == shard for r in rows)))


def plain_text(page, others, n):
    """What is left of a page's blocks when every run that enough pages have is struck out by looking at each place of every page."""
    def tokens(blocks):
        return [t for b in blocks for t in [*b.split(" "), "\n"]]

    def has_run(stream, run):
        return any(stream[i : i + len(run)] == run for i in range(len(stream) - len(run) + 1))

    streams = [tokens(b) for b in others]
    mine, out, at = tokens(page), [], 0
    covered = [False] * len(mine)
    for i in range(len(mine) - pages.PREFIX + 1):
        run = mine[i : i + pages.PREFIX]
        if sum(has_run(s, run) for s in streams) >= max(pages.LEAST_PAGES, -(-n // pages.SHARE)):
            covered[i : i + pages.PREFIX] = [True] * pages.PREFIX
    for block in page:
        size = len(block.split(" ")) + 1
        whole = size < pages.PREFIX and sum(block in b for b in others) >= max(pages.LEAST_PAGES, -(-n // pages.SHORT_SHARE))
        if not whole and 2 * sum(covered[at : at + size]) < size:
            out.append(block)
        at += size
    return "\n".join(out)


def test_runs_of_unmarked_pages_beside_a_plain_search(spark):
    r = np.random.default_rng(5)
    vocabulary = [f"w{i}" for i in range(400)]

    def some(n):
        return " ".join(r.choice(vocabulary, n))

    notice, menu, rare = some(40), "Home About Contact", some(30)
    rows, blocks = [], []
    for i in range(24):
        own = [some(int(r.integers(5, 60))) for _ in range(int(r.integers(1, 5)))]
        page = [menu, *own]
        if i % 2 == 0:
            page.append(f"{some(int(r.integers(0, 6)))} {notice}".strip())
        if i % 12 == 0:
            page.append(rare)
        if i % 5 == 0:
            page.append(f"{some(20)} {notice[:60].rsplit(' ', 1)[0]} {some(20)}")
        blocks.append(page)
        rows.append((i, f"http://host/{i}", "".join(f"<p>{b}</p>" for b in page)))
    rows.append((100, "http://host/again", rows[3][2]))
    got = {x["page_id"]: x["text"] for x in pages.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)).collect()}
    want = {i: plain_text(page, blocks, len(blocks)) for i, page in enumerate(blocks)}
    assert {i: got[i] for i in want} == want and got[100] == want[3]
    assert not any(menu in text.split("\n") for text in want.values()) and any(rare in text for text in want.values())
