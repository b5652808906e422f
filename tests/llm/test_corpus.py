"""The corpus operators beside plain code, on small tables with nulls, empties, ties, repeats and clashing columns."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

public_tokenizers = pytest.importorskip("public_tokenizers")
pytest.importorskip("shroudline.llm")

from shroudline.llm import contamination, exact, lines, near, packing, pages, secrets, shards, token_files, tokens, toxicity, work  # noqa: E402

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
BYTE, WORD = (public_tokenizers.path(f) for f in ("byte_bpe_50k.json", "word_bpe_49k.json"))
# Columns whose names the operators use inside.
SHAPE = "doc_id long, text string, size long, bucket string, row long, start int, n_lines string, node int"


def frame(spark, rows, shape=SHAPE):
    width = len(T._parse_datatype_string(shape).fields)
    return spark.createDataFrame([(*r, *[None] * (width - len(r))) for r in rows], shape)


@pytest.fixture(scope="module")
def texts():
    r = np.random.default_rng(3)
    words = ["".join(r.choice(list("abcdeé"), r.integers(1, 7))) for _ in range(300)]
    base = [" ".join(r.choice(words, r.integers(1, 120))) for _ in range(60)]
    out = list(base)
    for t in base[:25]:
        w = t.split(" ")
        for _ in range(2):
            x = list(w)
            x[int(r.integers(len(x)))] = "changed"
            out.append(" ".join(x))
    passage = " ".join(r.choice(words, 60))
    out += [f"{base[i]} {passage} {base[i + 30]}" for i in range(12)]
    out += [base[0]] * 40 + [None, "", "   \n\t", "\n", "One two", "one TWO", " ".join(r.choice(words, 9000))]
    line = "A line that is shared by many documents"
    out += [f"{base[i]}\n  {line.upper()}\x0b\n{line}\nshort" for i in range(6)]
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    return frame(spark, list(enumerate(texts))).repartition(7)


def test_empty_tables(spark):
    none = frame(spark, [])
    assert exact.find_copies(none).count() == 0
    assert lines.drop_lines(none).count() == 0
    assert shards.assign_shards(none, 8).count() == 0
    assert packing.pack_documents(none, BYTE).count() == 0
    assert near.find_near(none).count() == 0
    assert secrets.find_secrets(none).count() == 0
    assert contamination.find_contamination(none, frame(spark, [(1, "a b c")], "item_id long, text string")).count() == 0
    assert pages.extract_text(frame(spark, [], "page_id long, url string, html string")).count() == 0
    assert toxicity.score_documents(none, frame(spark, [], "doc_id long, toxic int")).count() == 0


def test_null_ids_and_repeated_rows(spark):
    rows = [(None, "same words in this text"), (None, "same words in this text"), (5, "same words in this text"), (5, "same words in this text"), (7, None)]
    odd = frame(spark, rows)
    copies = exact.find_copies(odd).collect()
    assert sum(r["kept"] for r in copies) == 2 and {r["group_size"] for r in copies} == {4, 1}
    assert lines.drop_lines(odd).count() == 5
    assert sorted(r["slot"] for r in shards.assign_shards(odd, 1).collect()) == [0, 1, 2, 3, 4]
    assert packing.pack_documents(odd, BYTE).count() == 5
    found = near.find_near(odd).collect()
    assert len(found) == 5 and all(r["kept"] for r in found) and {r["component_id"] for r in found} == {None, 5, 7}
    assert secrets.find_secrets(odd).count() == 5
    bench = frame(spark, [(1, "same words in this text"), (None, "a"), (2, None)], "item_id long, text string")
    assert [r["n_hit"] for r in contamination.find_contamination(odd, bench).orderBy("n_hit").collect()] == [0, 5, 5, 5, 5]
    scored = toxicity.score_documents(odd, frame(spark, [(5, None), (None, 1)], "doc_id long, toxic int")).collect()
    assert [r["score"] for r in scored] == [0.0] * 5 and {r["held_out"] for r in scored if r["doc_id"] is None} == {False}


def test_copies(docs, texts):
    groups = defaultdict(list)
    for i, t in enumerate(texts):
        groups[t or ""].append(i)
    got = {r["doc_id"]: r for r in exact.find_copies(docs).collect()}
    assert len(got) == len(texts)
    for text, ids in groups.items():
        for i in ids:
            r = got[i]
            assert (r["keep_id"], r["group_size"], r["kept"]) == (max(ids), len(ids), i == max(ids))
            assert r["text_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    assert exact.drop_copies(docs).count() == len(groups)


def test_copies_over_partition_ends(spark):
    rows = [(i, "x" * 40 + str(i % 3)) for i in range(600)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        got = exact.find_copies(frame(spark, rows)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert {(r["keep_id"], r["group_size"]) for r in got} == {(597, 200), (598, 200), (599, 200)} and sum(r["kept"] for r in got) == 3


def test_lines(docs, texts):
    space = " \t\n\x0b\x0c\r"
    keys = [[x.strip(space).translate(LOWER) for x in (t or "").split("\n")] for t in texts]
    holders = defaultdict(set)
    for i, row in enumerate(keys):
        for k in row:
            if len(k) >= 20:
                holders[k].add(i)
    got = {r["doc_id"]: r for r in lines.drop_lines(docs).collect()}
    dropped = 0
    for i, t in enumerate(texts):
        parts = (t or "").split("\n")
        stay = [x for x, k in zip(parts, keys[i], strict=True) if len(holders[k]) < 3 or i == max(holders[k])]
        dropped += len(parts) - len(stay)
        assert got[i]["text"] == "\n".join(stay) and got[i]["_n_lines"] == len(parts) and got[i]["n_dropped"] == len(parts) - len(stay)
    assert dropped >= 10


def test_hot_keys_take_another_way(docs, texts, monkeypatch):
    plain = {r["doc_id"]: r["text"] for r in lines.drop_lines(docs).collect()}
    sizes = {(r["doc_id"], r["size"]) for r in shards.assign_shards(docs, 4).collect()}
    parts = {(r["doc_id"], r["component_id"]) for r in near.find_near(docs).collect()}
    monkeypatch.setattr(work, "HOT_ROWS", 1)
    assert plain == {r["doc_id"]: r["text"] for r in lines.drop_lines(docs).collect()}
    assert sizes == {(r["doc_id"], r["size"]) for r in shards.assign_shards(docs, 4).collect()}
    assert parts == {(r["doc_id"], r["component_id"]) for r in near.find_near(docs).collect()}


def test_shards(docs, texts):
    got = shards.assign_shards(docs, 4).collect()
    assert sorted(r["doc_id"] for r in got) == list(range(len(texts)))
    size, slots, homes = Counter(), defaultdict(list), defaultdict(set)
    for r in got:
        raw = (texts[r["doc_id"]] or "").encode()
        assert r["size"] == len(raw) + 1 and r["text_crc32"] == zlib.crc32(raw)
        size[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
        homes[raw].add(r["shard"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and all(len(h) == 1 for h in homes.values())


def test_best_fit_decreasing_beside_plain_search():
    r = np.random.default_rng(1)
    for _ in range(30):
        sizes, capacity = r.integers(1, 60, 80), 100
        rooms, want = [], []
        for i in np.argsort(-sizes, kind="stable"):
            fit = min((k for k, room in enumerate(rooms) if room >= sizes[i]), key=lambda k: (rooms[k], k), default=None)
            if fit is None:
                rooms.append(capacity)
                fit = len(rooms) - 1
            rooms[fit] -= sizes[i]
            want.append((i, fit))
        got = shards.best_fit_decreasing(sizes, capacity)
        assert [(i, int(got[i])) for i, _ in want] == [(i, int(k)) for i, k in want]
        level = np.bincount(shards.level(sizes, 8), sizes, 8)
        assert level.max() - level.min() <= sizes.max()
    hot = shards.level(np.array([1000, *[1] * 700]), 8)
    assert sorted(np.bincount(hot, [1000, *[1] * 700])) == [100] * 7 + [1000]


ODD_TEXTS = [
    "", " ", "a", " a  b", "it's we'll  x\n\ny \n z", "tab\tand\r\nmore ", "<|endoftext|> end <|endoftext|>", "x\x1cy \x85z\xa0w", "naïve ÉCOLE ½ ²x x_y__z 12,5", "日本語 テスト", "Σίσυφος ΟΔΟΣ",
    "İstanbul ŉ ǅ", "é combined", "'s 't're don'T", "emoji 👍🏽 ok", "a" * 300, "1234567 89", "<|startoftext|>hi", "a b 　c", "x 's y", "\n", "end \n", "_ _a a_", "¹²³ ª º",
]


def test_token_ids_are_the_librarys(texts):
    from tokenizers import Tokenizer

    r = np.random.default_rng(4)
    letters = list("abAB' \n\t.,_12é½²<| ß")
    made = ["".join(r.choice(letters, r.integers(1, 60))) for _ in range(1500)]
    for path, kind in ((BYTE, "byte"), (WORD, "word")):
        library, own = Tokenizer.from_file(path), tokens.encoder(path, kind)
        every = [*ODD_TEXTS, *made, *(t for t in texts if t)]
        want = [library.encode(t, add_special_tokens=False).ids for t in every]
        for t, ids in zip(every, want, strict=True):
            assert np.frombuffer(own.encode(t), "<u4").tolist() == ids, repr(t)
        # a memory that forgets all the time, slices of a few texts, texts in parts
        small = {"byte": tokens.ByteLevel, "word": tokens.WordLevel}[kind](path, most=3, slice_=50)
        for t, ids, got in zip(every, want, small.each(pa.array(every).slice(0), b"\7\0\0\0"), strict=True):
            assert got.tolist() == [*ids, 7], repr(t)
        assert [x.tolist() for x in own.each(pa.array(every).slice(3, 40))] == want[3:43]


def test_very_long_text():
    from tokenizers import Tokenizer

    text = " ".join(["One long text, of many words.\nAnd lines  with gaps"] * 400_000)
    for path, kind in ((BYTE, "byte"), (WORD, "word")):
        step = Tokenizer.from_file(path).encode(text[:51 * 200] + "", add_special_tokens=False).ids
        got = np.frombuffer(tokens.encoder(path, kind).encode(text), "<u4")
        assert len(text) > 2 * tokens.SLICE and got[: len(step) - 5].tolist() == step[:-5]
        one = next(k for k in range(5, 60) if (got[: 40 * k].reshape(40, k)[1:] == got[k : 2 * k]).all())
        body = got[one : one * 400_000].reshape(-1, one)
        assert (body == body[0]).all()


def test_packing(spark, texts):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(BYTE)
    rows = list(enumerate([*texts, *ODD_TEXTS]))
    got = packing.pack_documents(frame(spark, rows), BYTE, capacity=256, with_ids=True).collect()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    for i, t in rows:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        mine = sorted(pieces[i], key=lambda r: r["piece"])
        assert [x for r in mine for x in r["ids"]] == ids and len(mine) == -(-len(ids) // 256)
        assert all(r["length"] == 256 for r in mine[1:]) and [r["start"] for r in mine] == [sum(q["length"] for q in mine[:k]) for k in range(len(mine))]
        assert all(zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] for r in mine)
    for rows_ in sequences.values():
        at = 0
        for r in sorted(rows_, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 256
    counts = np.bincount([r["length"] for r in got], minlength=257)
    assert len(sequences) <= 1.02 * sum(k for _, k in packing.best_fit(counts, 256)) + 1


def test_plan_uses_every_piece_once():
    r = np.random.default_rng(2)
    for n in (0, 1, 50, 20_000):
        counts = np.bincount(np.minimum(r.geometric(0.004, n), 2048), minlength=2049)
        used = np.zeros(2049, np.int64)
        sequences = 0
        for pattern, k in packing.plan(counts, 2048):
            assert sum(pattern) <= 2048 and k > 0
            sequences += k
            np.add.at(used, list(pattern), k)
        assert (used == counts).all()
        assert sequences <= 1.01 * (counts * np.arange(2049)).sum() / 2048 + 2


def test_blocks_round_trip():
    r = np.random.default_rng(0)
    for n in (0, 1, 511, 512, 513, 5000):
        for top in (1, 2, 300, 49_408, 2**32 - 1):
            ids = r.integers(0, top, n, dtype=np.uint32)
            ids[r.random(n) < 0.02] = top
            blob = token_files.pack(ids)
            assert (token_files.unpack(blob) == ids).all()
            if n > 512:
                assert (token_files.unpack(blob, 1, 2) == ids[512:1024]).all()


def test_token_files(spark, texts, tmp_path, monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(token_files, "SEGMENT", 500)
    library, rows = Tokenizer.from_file(WORD), list(enumerate([*texts, *ODD_TEXTS]))
    path = str(tmp_path / "ids")
    token_files.write_tokens(frame(spark, rows).repartition(5), path, WORD)
    got = {r["doc_id"]: r for r in token_files.read_tokens(spark, path, with_ids=True).collect()}
    at = 0
    for i, t in rows:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        assert got[i]["ids"] == ids and got[i]["start"] == at and got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        at += len(ids)


def plain_components(texts, width, percent=80):
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        sets.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} or ({tuple(w)} if w else set()))
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return [len(s) for s in sets], [find(i) for i in range(len(texts))]


@pytest.mark.parametrize("width", [4, 5])
def test_near(docs, texts, width):
    sizes, roots = plain_components(texts, width)
    got = {r["doc_id"]: r for r in near.find_near(docs, width=width).collect()}
    assert [(got[i]["n_shingles"], got[i]["component_id"], got[i]["kept"]) for i in range(len(texts))] == [(n, c, c == i) for i, (n, c) in enumerate(zip(sizes, roots, strict=True))]
    assert near.drop_near(docs, width=width).count() == len(set(roots))


def test_chains_link_through_neighbours(spark):
    r = np.random.default_rng(9)
    words = [f"w{i}" for i in range(2000)]
    doc = list(r.choice(words, 60))
    chain = []
    for _ in range(30):
        chain.append(" ".join(doc))
        doc[int(r.integers(60))] = str(r.choice(words))
    order = r.permutation(30).tolist()
    _, roots = plain_components([chain[i] for i in order], 4)
    got = {x["doc_id"]: x["component_id"] for x in near.find_near(frame(spark, list(enumerate(chain[i] for i in order))), width=4).collect()}
    assert [got[i] for i in range(30)] == roots


def test_chunk_keys_reach_the_promised_distance():
    r = np.random.default_rng(8)
    for _ in range(300):
        a = r.integers(0, 1 << 16, near.WIDTH).astype(np.uint64)
        b = a.copy()
        at = r.choice(near.WIDTH, 2 * near.CHUNKS - 1, replace=False)
        b[at] = (b[at] + np.uint64(1)) % np.uint64(1 << 16)
        assert set(near.keys(a)) & set(near.keys(b))


def test_secrets(spark):
    rows = [
        (0, "x é password = 'abcdefgh1234' AKIAABCDEFGHIJKLMN and 0123456789abcdef01"), (1, None), (2, "token=short deadbeef secret:secret = abcdefghijklmno"),
        (3, "username: bob key wJalrXUtnFEMIK7MDENGbPxRfiCYEXAMPLEKEY at https://api.example/v1"), (4, "alone wJalrXUtnFEMIK7MDENGbPxRfiCYEXAMPLEKEY"),
        (5, "username: bob " + "z " * 200 + "wJalrXUtnFEMIK7MDENGbPxRfiCYEXAMPLEKEY"), (6, "see https://api.example/v1 only"), (7, "AKIA" + "A" * 13 + " AKIAXAKIA" + "B" * 14),
        (8, "0123456789abcdef " * 3000),
    ]
    got = {r["doc_id"]: r for r in secrets.find_secrets(frame(spark, rows)).collect()}
    kinds = [("assign", re.compile(secrets.BASE["assign"][0]), 2, 12), ("access", re.compile("AKIA[A-Z0-9]+"), 0, 18), ("hex", re.compile("[0-9a-f]+"), 0, 16)]
    for i, t in rows:
        want = sorted((m.start(), k, m.end()) for k, (_, p, g, n) in enumerate(kinds) for m in p.finditer(t or "") if len(m[g]) >= n)
        assert [(s["start"], s["rank"], s["end"]) for s in got[i]["base"]] == want, i
    extra = {i: [s["kind"] for s in r["spans"] if s["rank"] > 2] for i, r in got.items()}
    assert extra[3] == ["ident", "key", "endpoint"] and not any(extra[i] for i in (1, 2, 4, 5, 6, 7, 8))


def test_secrets_plan_has_no_python(docs):
    plan = secrets.find_secrets(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def plain_contamination(texts, items, width):
    def words(t):
        return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").translate(LOWER))

    windows = defaultdict(set)
    for i, t in items:
        w = words(t)
        for j in range(max(1, len(w) - width + 1)) if w else ():
            windows[tuple(w[j : j + width])].add(str(i))
    out = []
    for t in texts:
        w, hit, found = words(t), set(), set()
        for n in {len(k) for k in windows}:
            for j in range(len(w) - n + 1):
                if (ids := windows.get(tuple(w[j : j + n]))) is not None:
                    hit.update(range(j, j + n))
                    found |= ids
        out.append((len(w), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(w)))
    return out


@pytest.mark.parametrize("most", [1_000_000, 0])
def test_contamination(spark, docs, texts, monkeypatch, most):
    monkeypatch.setattr(contamination, "MOST_TERMS", most)
    monkeypatch.setattr(contamination, "MOST_WINDOWS", most)
    items = [(1, texts[3]), (10, texts[3]), (2, "Changed"), (3, None), (4, "..."), (5, texts[70] and " ".join(texts[70].split()[:20])), (6, "never seen words")]
    bench = frame(spark, items, "item_id long, text string, number string")
    got = {r["doc_id"]: r for r in contamination.find_contamination(docs, bench).collect()}
    want = plain_contamination(texts, items, 13)
    assert [(got[i]["n_words"], got[i]["n_hit"], got[i]["items"], got[i]["contaminated"]) for i in range(len(texts))] == want
    assert any(w[3] for w in want) and not all(w[3] for w in want)


def test_proximity(spark):
    one = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu"
    rows = [(0, one), (1, one.replace("beta", "beta extra words")), (2, "alpha " + "x " * 40 + "beta"), (3, None)]
    found = contamination.Matches(frame(spark, rows), frame(spark, [(1, one)], "item_id long, text string"), proximity=True)
    names = {r["row"]: r["doc_id"] for r in found.index.select("row", "doc_id").collect()}
    assert {names[r["row"]] for r in found.phrases().collect()} == {0}
    assert {names[r["row"]] for r in found.proximities().collect()} == {0, 1}


PAGE = (
    "<html><head><title>T</title><style>p{}</style></head><body><nav><a href=x>Home</a></nav><!-- <article>no</article> --><header>Site</header>"
    "<div class='cookie-notice'>We use cookies</div><article class=post><h1>A &amp; B</h1><p>One <b>two<br>three<p>Four&nbsp;five\n six<script>var x='</p>'</script>"
    "<ul><li>x<li>y</ul><div class=\"share\">Tweet</div><form>Name</form><section id=comments><article>Nice</article></section></article><aside>Side</aside><footer>End</footer>"
)


def test_pages(spark):
    unique = {i: " ".join(f"w{i}x{j}" for j in range(40)) for i in range(20)}
    same = "All rights reserved by the example company of the world and nothing may be copied without leave"
    rows = [(i, f"http://h.example/{i}", f"<div>Home Products About</div><div>{unique[i]}</div><p>{same}</p>") for i in range(20)]
    rows += [(50, None, None), (51, "::", ""), (52, "http://a.example", PAGE), (53, "http://a.example", PAGE), (54, "http://b.example/1", f"<p>{same}"), (55, "x", "<article></article><p>left over")]
    got = {r["page_id"]: r["text"] for r in pages.extract_text(frame(spark, rows, "page_id long, url string, html string, k1 int, runs int")).collect()}
    assert all(got[i] == unique[i] for i in range(20)) and got[50] == got[51] == "" and got[54] == same and got[55] == "left over"
    assert got[52] == got[53] == "A & B\nOne two three\nFour five six\nx\ny"


def test_toxicity_learns_words_and_characters(spark):
    r = np.random.default_rng(1)
    words = ["".join(r.choice(list("bcdfaeio"), 5)) for _ in range(400)]

    def text(bad):
        w = list(r.choice(words, r.integers(5, 150)))
        if bad:
            w.insert(int(r.integers(len(w))), r.choice(["vile", "zzur" + str(r.choice(words))]))
        return " ".join(w)

    rows = [(i, text(i % 4 == 0)) for i in range(1200)]
    labels = frame(spark, [(i, int(i % 4 == 0)) for i in range(1200)], "doc_id long, toxic int")
    got = toxicity.score_documents(frame(spark, [*rows, (5000, None)]).repartition(4), labels).collect()
    assert len(got) == 1201 and all(0 <= x["score"] <= 1 and x["predicted"] == int(x["score"] >= 0.3) for x in got)
    assert all(x["held_out"] == (zlib.crc32(str(x["doc_id"]).encode()) % 4 == 2) for x in got)
    held = [x for x in got if x["held_out"] and x["doc_id"] < 5000]
    right = sum(x["predicted"] == int(x["doc_id"] % 4 == 0) for x in held)
    assert right >= 0.9 * len(held)


def test_windows_cover_every_word():
    counts = np.array([0, 1, 31, 32, 33, 56, 57, 1000])
    doc, start, end = toxicity.spans(counts)
    first = np.r_[0, np.cumsum(counts)[:-1]]
    for d, n in enumerate(counts):
        seen = set()
        for a, b in zip(start[doc == d], end[doc == d], strict=True):
            seen.update(range(a, b))
        assert seen == set(range(first[d], first[d] + n)) and (doc == d).sum() >= 1


def test_gradients_agree_with_differences():
    net = toxicity.Network({"a": 1, "b": 2})
    r = np.random.default_rng(0)
    x = r.standard_normal((toxicity.WINDOW, 3, toxicity.WORD_SIZE + toxicity.CHAR_SIZE)).astype(np.float64)
    there = np.ones((toxicity.WINDOW, 3), bool)
    there[20:, 1] = False
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    slope = np.array([1.0, -2.0, 0.5])
    _, kept = net.forward(x, there)
    grad, dx = net.backward(x, kept, slope)
    for name in ("Wf", "Ub", "v", "u", "bf"):
        flat = net.p[name].reshape(-1)
        i = int(r.integers(len(flat)))
        old = flat[i]
        flat[i] = old + 1e-5
        up = net.forward(x, there)[0] @ slope
        flat[i] = old - 1e-5
        down = net.forward(x, there)[0] @ slope
        flat[i] = old
        assert abs((up - down) / 2e-5 - grad[name].reshape(-1)[i]) < 1e-4 * max(1, abs(grad[name]).max())


def test_components(spark):
    from shroudline.llm.components import components

    edges = [(i, i + 1) for i in range(50)] + [(100, j) for j in range(101, 160)] + [(200, 200)]
    got = {r["id"]: r["root"] for r in components(frame(spark, edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(51)} | {i: 100 for i in range(100, 160)}


def test_ranks_have_no_gaps(spark):
    rows = work.settle(spark.range(5000).select(F.col("id"), (F.col("id") % 3 == 0).alias("g")), "ranks")
    got = work.dense_ranks(rows, ["g"], ["id"], "rank", bucket_rows=100).collect()
    for g in (True, False):
        assert sorted(r["rank"] for r in got if r["g"] == g) == list(range(sum(r["g"] == g for r in got)))


def unmarked(spark, pages_of):
    rows = [(i, f"http://h.example/{i}", "".join(f"<p>{b}</p>" for b in blocks)) for i, blocks in enumerate(pages_of)]
    got = pages.extract_text(frame(spark, rows, "page_id long, url string, html string")).collect()
    return {r["page_id"]: r["text"].split("\n") for r in got}


def words(name, n):
    return " ".join(f"{name}{j}" for j in range(n))


def test_pages_keep_what_few_pages_repeat(spark):
    """Short sentences and long passages on some pages of a host stay; a frame on all pages goes."""
    frame_of, quote = words("frame", 30), words("quote", 30)
    made = [[frame_of, words(f"own{i}x", 40), *(["See the table below"] if i % 3 == 0 else []), *([quote] if i < 2 else [])] for i in range(60)]
    got = unmarked(spark, made)
    assert got == {i: blocks[1:] for i, blocks in enumerate(made)}


def test_pages_published_twice_keep_their_text(spark):
    """Pages without article under several urls are one page; so their text is no run, and a frame is still found."""
    frame_of = words("frame", 30)
    made = [[frame_of, words(f"own{i // 4}x", 40), "Short line", f"Of {i // 4} only"] for i in range(24)]
    got = unmarked(spark, made)
    assert got == {i: [blocks[1], blocks[3]] for i, blocks in enumerate(made)}
    assert unmarked(spark, [[words("own", 40), "Short line"]] * 5) == dict.fromkeys(range(5), [words("own", 40), "Short line"])


def test_pages_find_every_repeated_run(spark):
    """A repeated block goes also when its first word differs on each page, whatever its words are."""
    made = [[f"on day{i} {words(f'notice{k}x', 18)}" for k in range(30)] + [words(f"own{i}x", 40)] for i in range(4)]
    got = unmarked(spark, made)
    assert got == {i: blocks[-1:] for i, blocks in enumerate(made)}


def test_stages_judge_each_row_by_its_own_text(spark):
    """Rows without id and with an id of others: what is rejected goes, what is clean stays."""
    def texts_of(df):
        return sorted(r["text"] for r in df.collect())

    passage, clean = words("bench", 20), words("clean", 20)
    rows = [(None, passage), (None, clean), (1, passage), (1, clean), (2, passage + " x")]
    items = frame(spark, [(1, passage)], "item_id long, text string")
    assert texts_of(contamination.drop_contaminated(frame(spark, rows), items)) == [clean, clean]

    rows = [(1, words("one", 60)), (2, words("one", 60) + " x"), (2, words("two", 60)), (3, words("two", 60)), (None, words("three", 60))]
    assert texts_of(near.drop_near(frame(spark, rows).repartition(3))) == sorted([words("one", 60), words("two", 60), words("three", 60)])

    r = np.random.default_rng(1)
    vocabulary = ["".join(r.choice(list("bcdfaeio"), 5)) for _ in range(200)]
    learn = [(i, " ".join([*r.choice(vocabulary, 20), *["vile"] * (4 * (i % 4 == 0))])) for i in range(600)]
    bad, good = " ".join(["vile"] * 4 + vocabulary[:20]), " ".join(vocabulary[:20])
    labels = frame(spark, [(i, int(i % 4 == 0)) for i in range(600)], "doc_id long, toxic int")
    kept = [x["text"] for x in toxicity.drop_toxic(frame(spark, [*learn, (None, bad), (None, good), (7000, bad), (7000, good)]), labels).collect()]
    assert kept.count(good) == 2 and bad not in kept


def test_several_texts_of_an_id_have_no_one_size(spark):
    import zstandard

    made = [(1, words("a", 12)), (1, words("b", 104)), (2, words("c", 14))]
    rows = [(n, len(t.split(" ")) - 4, bytearray(zstandard.compress(t.encode()))) for n, t in made]
    got = near.lonely(spark.createDataFrame(rows, "node long, n_shingles long, words binary"), 5).collect()
    assert {r["node"]: r["n"] for r in got} == {1: None, 2: 10}


def test_drop_copies_by_row(spark):
    """Null and repeated ids: every distinct text stays once, with the largest id that has it."""
    rows = [(None, "a"), (None, "a"), (1, "a"), (1, "b"), (1, "b"), (2, None), (None, ""), (3, "c"), (None, "only"), (3, "b")]
    left = exact.drop_copies(frame(spark, rows)).select("doc_id", "text").collect()
    assert sorted((r["doc_id"], r["text"] or "") for r in left if r["doc_id"] is not None) == [(1, "a"), (2, ""), (3, "b"), (3, "c")]
    assert [(r["doc_id"], r["text"]) for r in left if r["doc_id"] is None] == [(None, "only")]
