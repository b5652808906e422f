"""Quality of whole texts: a generalised additive model with pairwise interactions over counts taken from the text.

Each feature has a lookup table over its bins, each chosen pair of features a table over both; a score is their sum.  Tables
are learned by cyclic boosting: in every round each feature in turn gets a shallow tree on what the sum leaves unexplained.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shroudline.llm.work import body, held, sliced

# The bounded sample that the model is fitted on: labelled documents of each label, chosen by hash of the id.
SAMPLE = 10_000
BINS, PAIR_BINS, PAIRS = 48, 12, 8
BAGS, ROUNDS, PAIR_ROUNDS, PATIENCE = 4, 160, 60, 12
RATE, LEAVES, LEAST, RIDGE = 0.15, 4, 4, 1.0
THRESHOLD = 0.3

FEATURES = (
    "chars", "words", "lines", "letters", "capitals", "digits", "spaces", "stops", "commas", "symbols", "word_length", "long_words", "bare_words", "symbol_words", "capital_words",
    "distinct_words", "top_word", "echoed_words", "distinct_triples", "distinct_lines", "line_words", "stopped_lines", "sentence_words",
)

# Characters measured at a time.
GROUP = 1_000_000
LETTER, UPPER, DIGIT, SPACE, STOP, COMMA, SYMBOL = (1 << i for i in range(7))
WORD = np.uint64


def character_kinds() -> np.ndarray:
    """The kind of every character of the basic plane; others count as symbols or, above, letters of rare scripts."""
    out = np.zeros(1 << 16, np.uint8)
    for code in range(1 << 16):
        char = chr(code)
        group = unicodedata.category(char)
        if char.isspace() or group == "Cc":
            out[code] = SPACE
        elif char in ".!?…。！？":
            out[code] = STOP
        elif char in ",;:'\"-()’“”«»¿¡–—":
            out[code] = COMMA
        elif group[0] in "LM":
            out[code] = LETTER | (UPPER if group in ("Lu", "Lt") else 0)
        elif group[0] == "N":
            out[code] = DIGIT
        else:
            out[code] = SYMBOL
    return out


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> WORD(32))) * WORD(0xD6E8FEB86659FD93)
    return (h ^ (h >> WORD(29))) * WORD(0xA0761D6478BD642F)


def runs(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every run of true values."""
    edge = np.diff(np.r_[0, inside.astype(np.int8), 0])
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def share(part: np.ndarray, whole: np.ndarray, empty: float = 0.0) -> np.ndarray:
    return np.where(whole > 0, part / np.maximum(whole, 1), empty)


def distinct(doc: np.ndarray, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """By document: how many different hashes, and how often the most frequent one occurs."""
    order = np.lexsort((hashes, doc))
    d, h = doc[order], hashes[order]
    first = np.flatnonzero(np.r_[True, (d[1:] != d[:-1]) | (h[1:] != h[:-1])]) if len(d) else np.zeros(0, np.int64)
    often = np.diff(np.r_[first, len(d)])
    top = np.zeros(n, np.int64)
    np.maximum.at(top, d[first], often)
    return np.bincount(d[first], minlength=n), top


def features(texts: list[str], kinds: np.ndarray) -> np.ndarray:
    """(text, feature).  Counts and shares over whole texts, so many characters at a time; a longer text is a group of its own."""
    out, group, held_chars = [np.zeros((0, len(FEATURES)))], [], 0
    for text in texts:
        if group and held_chars + len(text) > GROUP:
            out.append(features_of(group, kinds))
            group, held_chars = [], 0
        group.append(text)
        held_chars += len(text)
    if group:
        out.append(features_of(group, kinds))
    return np.concatenate(out)


def word_names(codes: np.ndarray, solid: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A hash of each word from its characters and their places, GROUP characters or one word at a time."""
    out = np.zeros(len(at), WORD)
    ends = np.r_[at[1:], len(codes)] if len(at) else at
    lo = 0
    while lo < len(at):
        hi = max(lo + 1, int(np.searchsorted(ends, at[lo] + GROUP, side="right")))
        a, b = int(at[lo]), int(ends[hi - 1])
        place = np.arange(a, b) - np.repeat(at[lo:hi], ends[lo:hi] - at[lo:hi])
        hashed = mixed(codes[a:b].astype(WORD) * WORD(0x9E3779B97F4A7C15) + place.astype(WORD) * WORD(0xC2B2AE3D27D4EB4F))
        hashed[~solid[a:b]] = 0
        out[lo:hi] = mixed(np.add.reduceat(hashed, at[lo:hi] - a))
        lo = hi
    return out


def features_of(texts: list[str], kinds: np.ndarray) -> np.ndarray:
    """Texts are laid end to end, a line break behind each."""
    n = len(texts)
    codes = np.frombuffer("".join(f"{t}\n" for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    kind = kinds[np.minimum(codes, len(kinds) - 1)]
    far = np.flatnonzero(codes >= len(kinds))
    kind[far] = np.where(codes[far] < 0x20000, SYMBOL, LETTER)
    inside = (kind & SPACE) == 0

    def counted(flag: int, at: np.ndarray) -> np.ndarray:
        return np.add.reduceat((kind & flag) > 0, at, dtype=np.int64) if len(at) else np.zeros(0, np.int64)

    letters, capitals, digits, spaces, stops, commas, symbols = (counted(f, starts) for f in (LETTER, UPPER, DIGIT, SPACE, STOP, COMMA, SYMBOL))
    spaces = spaces - 1  # the break behind the text
    solid = lengths - spaces
    at, to = runs(inside)
    doc = np.searchsorted(ends, at, side="right")
    words = np.bincount(doc, minlength=n)
    size = to - at
    name = word_names(codes, inside, at)

    def worded(flag: int) -> np.ndarray:
        return counted(flag, at)

    of_letters = worded(LETTER)
    many, top = distinct(doc, name, n)
    near = doc[1:] == doc[:-1]
    echoed = np.bincount(doc[1:][near & (name[1:] == name[:-1])], minlength=n)
    same = doc[2:] == doc[:-2]
    triple = mixed(mixed(name[:-2] + mixed(name[1:-1] + WORD(1))) + name[2:] * WORD(3))[same] if len(name) > 2 else np.zeros(0, WORD)
    triples, _ = distinct(doc[2:][same], triple, n)

    breaks = np.flatnonzero(codes == 10)
    line_of = np.searchsorted(breaks, at, side="right")
    full, first = np.unique(line_of, return_index=True)
    last = np.r_[first[1:], len(at)] - 1
    line_doc = doc[first] if len(full) else np.zeros(0, np.int64)
    folded = np.r_[WORD(0), np.cumsum(mixed(name + (np.arange(len(name)) - np.repeat(first, last - first + 1)).astype(WORD) * WORD(0x9E3779B97F4A7C15)), dtype=WORD)] if len(name) else np.zeros(1, WORD)
    lines = np.bincount(line_doc, minlength=n)
    line_kinds, _ = distinct(line_doc, folded[last + 1] - folded[first], n) if len(full) else (np.zeros(n, np.int64), None)
    stopped = np.bincount(line_doc[(kind[to[last] - 1] & STOP) > 0], minlength=n) if len(full) else np.zeros(n)

    out = {
        "chars": np.log1p(lengths), "words": np.log1p(words), "lines": np.log1p(lines), "letters": share(letters, solid, 1.0), "capitals": share(capitals, letters),
        "digits": share(digits, solid), "spaces": share(spaces, lengths), "stops": share(stops, words), "commas": share(commas, words), "symbols": share(symbols, solid),
        "word_length": share(solid, words), "long_words": share(np.bincount(doc, size > 20, minlength=n), words), "bare_words": share(np.bincount(doc, of_letters == 0, minlength=n), words),
        "symbol_words": share(np.bincount(doc, worded(SYMBOL) > 0, minlength=n), words), "capital_words": share(np.bincount(doc, (worded(UPPER) == of_letters) & (of_letters > 1), minlength=n), words),
        "distinct_words": share(many, np.sqrt(words)), "top_word": share(top, words), "echoed_words": share(echoed, words), "distinct_triples": share(triples, np.maximum(words - 2, 0), 1.0),
        "distinct_lines": share(line_kinds, lines, 1.0), "line_words": np.log1p(share(words, lines)), "stopped_lines": share(stopped, lines), "sentence_words": np.log1p(share(words, stops, 1e4)),
    }
    return np.stack([np.asarray(out[f], np.float64) for f in FEATURES], axis=1)


@dataclass
class Model:
    """Bin edges of each feature, its table, and the tables of pairs over coarser bins; ``shift`` puts the cut at THRESHOLD."""

    edges: list[np.ndarray]
    coarse: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int]]
    pair_tables: list[np.ndarray]
    shift: float
    constant: float | None = None

    def logits(self, x: np.ndarray) -> np.ndarray:
        """Sums of table entries, a column of bins at a time."""
        out = np.zeros(len(x))
        for j, edges in enumerate(self.edges):
            out += self.tables[j][np.searchsorted(edges, x[:, j], side="right")]
        for (a, b), table in zip(self.pairs, self.pair_tables, strict=True):
            out += table[np.searchsorted(self.coarse[a], x[:, a], side="right"), np.searchsorted(self.coarse[b], x[:, b], side="right")]
        return out

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.logits(x) - self.shift + np.log(THRESHOLD / (1 - THRESHOLD)), -60, 60)))


def edges_of(column: np.ndarray, bins: int) -> np.ndarray:
    """Cuts between neighbouring values, about equally many rows between two of them."""
    values = np.unique(column)
    if len(values) > bins:
        values = np.unique(np.quantile(column, np.linspace(0, 1, bins), method="nearest"))
    return (values[1:] + values[:-1]) / 2


def gain(slope: np.ndarray, weight: np.ndarray) -> np.ndarray:
    return slope * slope / (weight + RIDGE)


def tree(slope: np.ndarray, weight: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Leaf values over the bins of one feature: the best cut, again and again, until LEAVES intervals; Newton steps."""
    leaves = [(0, len(slope))]
    s, w, n = (np.r_[0, np.cumsum(v)] for v in (slope, weight, rows))

    def best(lo: int, hi: int) -> tuple[float, int]:
        if hi - lo < 2:
            return 0.0, 0
        cut = np.arange(lo + 1, hi)
        won = gain(s[cut] - s[lo], w[cut] - w[lo]) + gain(s[hi] - s[cut], w[hi] - w[cut]) - gain(s[hi] - s[lo], w[hi] - w[lo])
        won[(n[cut] - n[lo] < LEAST) | (n[hi] - n[cut] < LEAST)] = 0
        i = int(np.argmax(won))
        return float(won[i]), int(cut[i])

    while len(leaves) < LEAVES:
        found = [best(*leaf) for leaf in leaves]
        i = max(range(len(leaves)), key=lambda j: found[j][0])
        if found[i][0] <= 1e-9:
            break
        lo, hi = leaves[i]
        leaves[i : i + 1] = [(lo, found[i][1]), (found[i][1], hi)]
    out = np.zeros(len(slope))
    for lo, hi in leaves:
        out[lo:hi] = (s[hi] - s[lo]) / (w[hi] - w[lo] + RIDGE)
    return out


def quadrants(slope: np.ndarray, weight: np.ndarray, rows: np.ndarray) -> tuple[float, np.ndarray]:
    """The best tree of one cut on the first feature and one on the second: its gain, and its values over the grid."""
    def corners(v: np.ndarray) -> np.ndarray:
        c = np.cumsum(np.cumsum(v, axis=0), axis=1)[:-1, :-1]
        a, b = v.sum(axis=1).cumsum()[:-1, None], v.sum(axis=0).cumsum()[None, :-1]
        return np.stack([c, a - c, b - c, v.sum() - a - b + c])

    if min(slope.shape) < 2:
        return 0.0, np.zeros(slope.shape)
    s, w, n = corners(slope), corners(weight), corners(rows)
    # what the cuts explain together beyond one cut alone
    won = gain(s, w).sum(axis=0) - np.maximum(gain(s[0] + s[1], w[0] + w[1]) + gain(s[2] + s[3], w[2] + w[3]), gain(s[0] + s[2], w[0] + w[2]) + gain(s[1] + s[3], w[1] + w[3]))
    won[(n.min(axis=0) == 0)] = 0
    i, j = np.unravel_index(int(np.argmax(won)), won.shape)
    out = np.zeros(slope.shape)
    value = s[:, i, j] / (w[:, i, j] + RIDGE)
    out[: i + 1, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = value
    return float(won[i, j]), out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def loss(z: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    return float((weight * np.logaddexp(0, np.where(y > 0, -z, z))).sum() / weight.sum())


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """Tables from the sample, averaged over BAGS; each bag stops when its own held fold has stopped getting better.

    The cut is set on logits of rows that a bag held back.  With one label only the score is that label, with none 0.5.
    """
    m = x.shape[1]
    if not len(y) or y.min() == y.max():
        return Model([], [], [], [], [], 0.0, float(y[0]) if len(y) else 0.5)
    edges, coarse = [edges_of(x[:, j], BINS) for j in range(m)], [edges_of(x[:, j], PAIR_BINS) for j in range(m)]
    fine = np.stack([np.searchsorted(edges[j], x[:, j], side="right") for j in range(m)])
    rough = np.stack([np.searchsorted(coarse[j], x[:, j], side="right") for j in range(m)])
    balance = np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    fold = np.empty(len(y), np.int64)
    for label in (0, 1):  # both labels in every fold, where there are enough
        mine = np.flatnonzero(y == label)
        fold[np.random.default_rng(label).permutation(mine)] = np.arange(len(mine)) % BAGS
    tables = [np.zeros(len(e) + 1) for e in edges]
    chosen: dict[tuple[int, int], np.ndarray] = {}
    held_logits = np.zeros(len(y))
    for bag in range(BAGS):
        used, kept = np.flatnonzero(fold != bag), np.flatnonzero(fold == bag)
        if not len(kept) or len(set(y[used])) < 2:
            used = kept = np.arange(len(y))
        own, grids = boosted(fine, rough, y, balance, used, kept, [len(e) + 1 for e in edges], [len(e) + 1 for e in coarse])
        for j in range(m):
            tables[j] += own[j] / BAGS
            held_logits[kept] += own[j][fine[j, kept]]
        for (a, b), grid in grids.items():
            chosen[a, b] = chosen.get((a, b), 0) + grid / BAGS
            held_logits[kept] += grid[rough[a, kept], rough[b, kept]]
    pairs = sorted(chosen)
    return Model(edges, coarse, tables, pairs, [chosen[p] for p in pairs], cut_of(held_logits, y, balance))


def boosted(fine, rough, y, balance, used, kept, sizes, rough_sizes) -> tuple[list[np.ndarray], dict[tuple[int, int], np.ndarray]]:
    """One bag: tables of features, then of the pairs that explain most of what is left."""
    m, z = len(fine), np.zeros(len(y))
    tables = [np.zeros(k) for k in sizes]
    grids: dict[tuple[int, int], np.ndarray] = {}

    def pull(bins: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        p = sigmoid(z[used])
        at, w = bins[used], balance[used]
        return np.bincount(at, w * (y[used] - p), size), np.bincount(at, w * p * (1 - p), size), np.bincount(at, minlength=size)

    def on_grid(a: int, b: int) -> tuple[float, np.ndarray]:
        shape = (rough_sizes[a], rough_sizes[b])
        return quadrants(*(v.reshape(shape) for v in pull(rough[a] * shape[1] + rough[b], shape[0] * shape[1])))

    def stopped(rounds: int, once) -> None:
        nonlocal z
        best, waited, saved = loss(z[kept], y[kept], balance[kept]), 0, ([t.copy() for t in tables], {k: g.copy() for k, g in grids.items()}, z.copy())
        for _ in range(rounds):
            once()
            now = loss(z[kept], y[kept], balance[kept])
            waited = 0 if now < best - 1e-5 else waited + 1
            if now < best - 1e-5:
                best, saved = now, ([t.copy() for t in tables], {k: g.copy() for k, g in grids.items()}, z.copy())
            if waited >= PATIENCE:
                break
        tables[:], z = saved[0], saved[2]
        grids.update(saved[1])

    def features_once() -> None:
        for j in range(m):
            step = RATE * tree(*pull(fine[j], sizes[j]))
            tables[j] += step
            z[:] += step[fine[j]]

    def pairs_once() -> None:
        for a, b in grids:
            step = RATE * on_grid(a, b)[1]
            grids[a, b] += step
            z[:] += step[rough[a], rough[b]]

    stopped(ROUNDS, features_once)
    strength = sorted(((on_grid(a, b)[0], a, b) for a in range(m) for b in range(a + 1, m)), reverse=True)
    grids |= {(a, b): np.zeros((rough_sizes[a], rough_sizes[b])) for won, a, b in strength[:PAIRS] if won > 0}
    if grids:
        stopped(PAIR_ROUNDS, pairs_once)
    return tables, grids


def cut_of(logits: np.ndarray, y: np.ndarray, balance: np.ndarray) -> float:
    """The logit with the least weighted error; the middle of the widest gap among equals."""
    order = np.argsort(logits, kind="stable")
    z, w = logits[order], balance[order]
    below = np.r_[0, np.cumsum(np.where(y[order] > 0, w, 0))] + np.r_[np.cumsum(np.where(y[order] > 0, 0, w)[::-1])[::-1], 0]
    gap = np.r_[0, np.diff(z), 0]
    gap[0] = gap[-1] = -1  # a cut outside all rows only where nothing else is as good
    best = max(range(len(below)), key=lambda i: (-round(float(below[i]), 9), gap[i]))
    if best in (0, len(z)):
        return float(z[0] - 1 if best == 0 else z[-1] + 1)
    return float(z[best - 1] + z[best]) / 2


def held_out(doc_id: str) -> Column:
    """Rows never learned from: crc32 of the id as text divides by 5."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def measured(keep: list[str]):
    """Rows with their features beside the columns of ``keep``."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = held("character kinds", character_kinds)
        for batch in sliced(batches):
            x = features(batch.column("body").to_pylist(), kinds)
            flat = pa.array(x.reshape(-1), pa.float64())
            found = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * len(FEATURES), pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), found], [*keep, "x"])

    return run


def sample(rows: DataFrame, labels: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels to learn from: the lowest hashes of the labelled ids of each label, ``most`` of each."""
    usable = labels.filter("doc_id is not null and quality in (0, 1)").filter(~held_out("doc_id"))
    usable = usable.groupBy("doc_id").agg(F.max("quality").alias("quality")).withColumn("order", F.xxhash64("doc_id"))
    chosen = [usable.filter(F.col("quality") == y).orderBy("order").limit(most).select(F.col("doc_id").alias("id"), "quality") for y in (0, 1)]
    spark = rows.sparkSession
    ids = spark.createDataFrame(chosen[0].unionByName(chosen[1]).collect(), "id long, quality int")  # 2 * most numbers at most
    mine = rows.join(F.broadcast(ids), F.col("doc_id") == F.col("id")).dropDuplicates(["doc_id"]).select("id", "quality", "body")
    got = mine.mapInArrow(measured(["id", "quality"]), "id long, quality int, x array<double>").orderBy("id").collect()
    return np.array([r["x"] for r in got], np.float64).reshape(len(got), len(FEATURES)), np.array([r["quality"] for r in got], np.float64)


def score_documents(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", most: int = SAMPLE) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted (1 from THRESHOLD on).

    The model learns from a bounded sample of labelled rows that are not held out; every whole text is measured and scored
    where it lies.  Inputs are counts over the text only.

    Null or empty text has no words and is scored like others.  Rows without id are scored like others and never learned from; of rows with
    the same id one is learned from.  Where the sample has one label only every score is that label, without any label 0.5.
    An empty table gives an empty result.  A very long text is measured whole, at some 30 bytes a character.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), body(text).alias("body"))
    model = trained(rows, labels, most)
    kind = rows.schema["doc_id"].dataType.simpleString()
    scored = rows.select("doc_id", held_out("doc_id").alias("held_out"), "body").mapInArrow(scoring(model), f"doc_id {kind}, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def trained(rows: DataFrame, labels: DataFrame, most: int = SAMPLE) -> Broadcast:
    """The model, a few thousand numbers, for the tasks."""
    labels = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    return rows.sparkSession.sparkContext.broadcast(fit(*sample(rows, labels, most)))


def scoring(model: Broadcast):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = held("character kinds", character_kinds)
        for batch in sliced(batches):
            scores = model.value.scores(features(batch.column("body").to_pylist(), kinds))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(scores, pa.float64())], ["doc_id", "held_out", "score"])

    return run
