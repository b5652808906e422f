"""Toxicity of whole texts: a bidirectional gated recurrent network with attention, trained and run in numpy."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shroudline.llm.work import body, fresh, held, sliced

# The bounded sample that the network is fitted on: documents of each label, of at most so many characters each.
SAMPLE_TOXIC, SAMPLE_CLEAN, SAMPLE_CHARS = 800, 1600, 20_000
# Windows of words; neighbours overlap by WINDOW - STRIDE words.
WINDOW, STRIDE = 32, 24
WORD_SIZE, CHAR_SIZE, HIDDEN = 8, 8, 8
GRAMS = 1 << 15
GRAM_SIZES = (3, 4, 5, 6)
# A word of the sample has a vector of its own if it occurs this often; all words have those of their character grams.
OFTEN = 3
STEPS, BATCH, RATE, DECAY = 320, 40, 0.02, 0.05
THRESHOLD = 0.3
# Words whose input products a worker remembers; others are computed for the batch at hand.
REMEMBERED = 100_000
PUNCTUATION = ".,;:!?\"'()[]{}<>*&%$#|/\\-_~`+="


def words_of(text: str) -> list[str]:
    return text.lower().split()


def bare(chunk: str) -> str:
    return chunk.strip(PUNCTUATION) or chunk


def grams_of(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the gram table, and the word that each belongs to; ``<`` and ``>`` mark a word's ends."""
    codes = np.frombuffer("".join(f"<{w}>" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    sizes = np.array([len(w) + 2 for w in words])
    owner = np.repeat(np.arange(len(words)), sizes)
    h, rows, owners = np.zeros(len(codes), np.uint64), [], []
    for j in range(max(GRAM_SIZES)):
        h = (h[: len(codes) - j] ^ codes[j:]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(31)
        if j + 1 in GRAM_SIZES:
            inside = owner[: len(h)] == owner[j:]
            rows.append(h[inside] % np.uint64(GRAMS))
            owners.append(owner[: len(h)][inside])
    return np.concatenate(rows).astype(np.int64), np.concatenate(owners)


def spans(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For documents of so many words: document, first word and end of every window over the flat list of words."""
    many = np.maximum(1, -(-(counts - (WINDOW - STRIDE)) // STRIDE))
    doc = np.repeat(np.arange(len(counts)), many)
    first = np.r_[0, np.cumsum(counts)[:-1]]
    inner = np.arange(len(doc)) - np.repeat(np.r_[0, np.cumsum(many)[:-1]], many)
    start = first[doc] + inner * STRIDE
    return doc, start, np.minimum(start + WINDOW, first[doc] + counts[doc])


def placed(flat: np.ndarray, start: np.ndarray, end: np.ndarray, pad: int) -> np.ndarray:
    """(window, place) of word rows; ``pad`` behind the last word."""
    at = start[:, None] + np.arange(WINDOW)
    padded = np.r_[flat, np.full(WINDOW, pad, flat.dtype)]
    return np.where(at < end[:, None], padded[np.minimum(at, len(padded) - 1)], pad)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * x)


class Network:
    """Parameters, and the forward and backward pass over windows of word vectors."""

    def __init__(self, vocabulary: dict[str, int]) -> None:
        r = np.random.default_rng(5)
        self.vocabulary = vocabulary
        inputs = WORD_SIZE + CHAR_SIZE

        def small(*shape: int) -> np.ndarray:
            return (r.standard_normal(shape) * 0.3).astype(np.float32)

        self.p = {"word": small(len(vocabulary) + 1, WORD_SIZE), "gram": small(GRAMS, CHAR_SIZE), "v": small(2 * HIDDEN), "u": small(2 * HIDDEN), "c": np.zeros(1, np.float32)}
        for d in "fb":
            self.p |= {f"W{d}": small(inputs, 3 * HIDDEN), f"U{d}": small(HIDDEN, 3 * HIDDEN), f"b{d}": np.zeros(3 * HIDDEN, np.float32)}
        self.shift, self.constant = 0.0, False

    def vectors(self, words: list[str]) -> np.ndarray:
        rows, owner = grams_of(words)
        chars = scattered(owner, self.p["gram"][rows], len(words)) / np.sqrt(np.bincount(owner, minlength=len(words)))[:, None]
        own = self.p["word"][[self.vocabulary.get(w, 0) for w in words]]
        return np.concatenate([own, chars], axis=1).astype(np.float32)

    def products(self, words: list[str]) -> np.ndarray:
        """Input products of both directions, a row for each word: all that a word needs at inference."""
        x = self.vectors(words)
        return np.concatenate([x @ self.p[f"W{d}"] + self.p[f"b{d}"] for d in "fb"], axis=1).astype(np.float32)

    def window_logits(self, table: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Logit of each window of word rows; row 0 of ``table`` is the padding."""
        out = np.empty(len(rows), np.float32)
        size, p, h3 = 2048, self.p, 3 * HIDDEN
        for at in range(0, len(rows), size):
            part = np.ascontiguousarray(rows[at : at + size].T)
            n = part.shape[1]
            score, value = np.zeros((WINDOW, n), np.float32), np.zeros((WINDOW, n), np.float32)
            for k, d in enumerate("fb"):
                h, half = np.zeros((n, HIDDEN), np.float32), slice(k * HIDDEN, (k + 1) * HIDDEN)
                for t in range(WINDOW) if d == "f" else range(WINDOW - 1, -1, -1):
                    x, g = table[part[t], k * h3 : (k + 1) * h3], h @ p[f"U{d}"]
                    gates = sigmoid(x[:, : 2 * HIDDEN] + g[:, : 2 * HIDDEN])
                    z = gates[:, :HIDDEN]
                    new = np.tanh(x[:, 2 * HIDDEN :] + gates[:, HIDDEN:] * g[:, 2 * HIDDEN :])
                    h = new + z * (h - new)
                    score[t] += h @ p["v"][half]
                    value[t] += h @ p["u"][half]
            there = part > 0
            weight = np.exp(score - score.max(axis=0)) * there
            total = weight.sum(axis=0)
            out[at : at + n] = (weight * value).sum(axis=0) / np.where(total > 0, total, 1) + p["c"][0]
        return out

    def forward(self, x: np.ndarray, there: np.ndarray):
        """x: (place, window, input).  Logits, and what the backward pass needs."""
        p, states, kept = self.p, [], {}
        for d in "fb":
            pre = x @ p[f"W{d}"] + p[f"b{d}"]
            h, steps = np.zeros((x.shape[1], HIDDEN), x.dtype), {}
            hs = np.zeros((*x.shape[:2], HIDDEN), x.dtype)
            for t in range(WINDOW) if d == "f" else range(WINDOW - 1, -1, -1):
                g = h @ p[f"U{d}"]
                gates = sigmoid(pre[t, :, : 2 * HIDDEN] + g[:, : 2 * HIDDEN])
                z, r, last = gates[:, :HIDDEN], gates[:, HIDDEN:], g[:, 2 * HIDDEN :]
                new = np.tanh(pre[t, :, 2 * HIDDEN :] + r * last)
                steps[t] = (h, z, r, new, last)
                h = new + z * (h - new)
                hs[t] = h
            states.append(hs)
            kept[d] = steps
        hidden = np.concatenate(states, axis=2)
        score = np.where(there, hidden @ p["v"], -1e9)
        weight = np.exp(score - score.max(axis=0)) * there
        weight /= np.maximum(weight.sum(axis=0), 1e-9)
        value = hidden @ p["u"]
        return (weight * value).sum(axis=0) + p["c"][0], (hidden, weight, value, kept)

    def backward(self, x: np.ndarray, kept, slope: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        hidden, weight, value, steps = kept
        p, grad, dx = self.p, {}, np.zeros_like(x)
        dvalue = weight * slope
        dscore = weight * (value - (weight * value).sum(axis=0)) * slope
        grad["u"], grad["v"] = np.einsum("tn,tnh->h", dvalue, hidden), np.einsum("tn,tnh->h", dscore, hidden)
        grad["c"] = slope.sum(keepdims=True)
        dhidden = dvalue[:, :, None] * p["u"] + dscore[:, :, None] * p["v"]
        for k, d in enumerate("fb"):
            dU, dh = np.zeros_like(p[f"U{d}"]), np.zeros((x.shape[1], HIDDEN), x.dtype)
            dpre = np.zeros((*x.shape[:2], 3 * HIDDEN), x.dtype)
            for t in range(WINDOW - 1, -1, -1) if d == "f" else range(WINDOW):
                h, z, r, new, last = steps[d][t]
                dh = dh + dhidden[t, :, k * HIDDEN : (k + 1) * HIDDEN]
                dnew = dh * (1 - z) * (1 - new * new)
                dz, dr = dh * (h - new) * z * (1 - z), dnew * last * r * (1 - r)
                inner = np.concatenate([dz, dr, dnew * r], axis=1)
                dpre[t] = np.concatenate([dz, dr, dnew], axis=1)
                dU += h.T @ inner
                dh = dh * z + inner @ p[f"U{d}"].T
            flat = dpre.reshape(-1, 3 * HIDDEN)
            grad[f"U{d}"], grad[f"W{d}"], grad[f"b{d}"] = dU, x.reshape(-1, x.shape[2]).T @ flat, flat.sum(axis=0)
            dx += dpre @ p[f"W{d}"].T
        return grad, dx


def scattered(rows: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    return np.stack([np.bincount(rows, values[:, j], size) for j in range(values.shape[1])], axis=1).astype(np.float32)


def train(texts: list[str], labels: list[int]) -> Network:
    """Documents are bags of windows: the more toxic a window looks, the more it counts for its document."""
    docs = [[bare(c) for c in words_of(t)] for t in texts]
    often = Counter(w for d in docs for w in d)
    vocabulary = {w: i + 1 for i, w in enumerate(sorted(w for w, n in often.items() if n >= OFTEN))}
    net = Network(vocabulary)
    y = np.array(labels, np.float32)
    if not len(y) or y.min() == y.max():
        net.constant = True
        return net
    r = np.random.default_rng(6)
    order = r.permutation(len(docs))
    held, used = order[: len(docs) // 5], order[len(docs) // 5 :]
    if len(set(y[held])) < 2:
        held = order
    balance = np.where(y > 0, 0.5 / max(y.mean(), 1e-6), 0.5 / max(1 - y.mean(), 1e-6))
    first, second = ({k: np.zeros_like(v) for k, v in net.p.items()} for _ in range(2))
    step = 0
    epochs = min(20, -(-STEPS * BATCH // len(used)))
    for epoch in range(epochs):
        for at in range(0, len(used), BATCH):
            mine = r.permutation(used)[:BATCH] if at + BATCH > len(used) else used[at : at + BATCH]
            chosen = [docs[i] for i in mine]
            known = {w: i for i, w in enumerate(dict.fromkeys(w for d in chosen for w in d), 1)}
            counts = np.array([len(d) for d in chosen])
            doc, start, end = spans(counts)
            rows = placed(np.array([known[w] for d in chosen for w in d], np.int64), start, end, 0).T
            words = list(known)
            table = np.zeros((len(words) + 1, WORD_SIZE + CHAR_SIZE), np.float32)
            if words:
                table[1:] = net.vectors(words)
            x = table[rows]
            logits, kept = net.forward(x, rows > 0)
            sharp = np.exp((1 + 2 * epoch / epochs) * (logits - logits.max()))
            share = sharp / np.bincount(doc, sharp, len(mine))[doc]
            whole = np.bincount(doc, share * logits, len(mine))
            error = (sigmoid(whole) - y[mine]) * balance[mine] / len(mine)
            grad, dx = net.backward(x, kept, (share * error[doc]).astype(np.float32))
            if words:
                dtable = scattered(rows.reshape(-1), dx.reshape(-1, dx.shape[2]), len(words) + 1)[1:]
                grams, owner = grams_of(words)
                size = np.sqrt(np.bincount(owner, minlength=len(words)))
                grad["word"] = scattered(np.array([vocabulary.get(w, 0) for w in words]), dtable[:, :WORD_SIZE], len(vocabulary) + 1)
                grad["gram"] = scattered(grams, (dtable[:, WORD_SIZE:] / size[:, None])[owner], GRAMS)
            step += 1
            for k, g in grad.items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g * g
                net.p[k] *= 1 - RATE * DECAY
                net.p[k] -= RATE * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-6)
        r.shuffle(used)
    net.shift = cut_of(Scorer(net).logits([texts[i] for i in held]), y[held])
    return net


def cut_of(logits: np.ndarray, y: np.ndarray) -> float:
    """The logit that separates the labels best, a clean document lost counting more than a toxic one missed (F with
    beta 0.5); the middle of the widest gap among equals."""
    order = np.argsort(-logits)
    hits = np.cumsum(y[order])
    fit = 1.25 * hits / (np.arange(1, len(y) + 1) + 0.25 * y.sum())
    gap = np.r_[logits[order][:-1] - logits[order][1:], 1.0]
    best = max(range(len(y)), key=lambda i: (round(float(fit[i]), 6), gap[i]))
    return float(logits[order][best] - gap[best] / 2)


class Scorer:
    """A network beside the input products of the words met so far; one per worker process."""

    def __init__(self, net: Network) -> None:
        self.net = net
        self.rows: dict[str, int] = {}
        self.table = np.zeros((1, 6 * HIDDEN), np.float32)
        self.table[0] = np.concatenate([net.p["bf"], net.p["bb"]])

    def lookup(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        out = list(map(self.rows.get, chunks))
        extra: dict[str, int] = {}
        if None in out:
            base = len(self.table)
            for i, row in enumerate(out):
                if row is None:
                    out[i] = extra.setdefault(chunks[i], base + len(extra))
        if not extra:
            return np.array(out, np.int64), self.table
        table = np.concatenate([self.table, self.net.products([bare(c) for c in extra])])
        if len(table) <= REMEMBERED:
            self.rows.update(extra)
            self.table = table
        return np.array(out, np.int64), table

    def logits(self, texts: list[str]) -> np.ndarray:
        """The highest window logit of each text; a text without words is one empty window."""
        out = []
        for at in range(0, len(texts), 2000):
            chunks = [words_of(t) for t in texts[at : at + 2000]]
            flat, table = self.lookup([c for doc in chunks for c in doc])
            doc, start, end = spans(np.array([len(c) for c in chunks]))
            first = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
            found = np.concatenate([self.net.window_logits(table, placed(flat, start[i : i + 8192], end[i : i + 8192], 0)) for i in range(0, len(doc), 8192)])
            out.append(np.maximum.reduceat(found, first))
        return np.concatenate(out) if out else np.zeros(0, np.float32)

    def scores(self, texts: list[str]) -> np.ndarray:
        if self.net.constant:
            return np.zeros(len(texts))
        x = self.logits(texts).astype(np.float64) - self.net.shift + np.log(THRESHOLD / (1 - THRESHOLD))
        return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def held_out(doc_id: str) -> Column:
    """Rows never learned from: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame) -> tuple[list[str], list[int]]:
    """Texts and labels to learn from: the lowest hashes of the labelled ids of each class, a bounded number."""
    usable = labels.filter("doc_id is not null and toxic in (0, 1)").filter(~held_out("doc_id"))
    usable = usable.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).withColumn("order", F.xxhash64("doc_id"))
    chosen = [usable.filter(F.col("toxic") == y).orderBy("order").limit(n) for y, n in ((1, SAMPLE_TOXIC), (0, SAMPLE_CLEAN))]
    ids = chosen[0].unionByName(chosen[1]).select(F.col("doc_id").alias("id"), "toxic")
    spark = docs.sparkSession
    ids = spark.createDataFrame(ids.collect(), "id long, toxic int")  # a few thousand numbers
    got = docs.join(F.broadcast(ids), F.col("doc_id") == F.col("id")).filter(F.length("body") <= SAMPLE_CHARS)
    got = got.dropDuplicates(["doc_id"]).orderBy("doc_id").select("body", "toxic").collect()
    return [r["body"] for r in got], [r["toxic"] for r in got]


def score_documents(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, held_out, score, predicted (1 from THRESHOLD on).

    The network learns from a bounded sample of labelled rows that are not held out, and all overlapping windows of every
    whole text are scored where the text lies; the highest window is the document's score, moved so that THRESHOLD
    separates best on a fifth of the sample.  Inputs are words and their characters only.

    Null or empty text is one empty window.  Rows without id are scored like others.  Where the sample has only one label,
    or none, every score is 0.  An empty table gives an empty result.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), body(text).alias("body"))
    net = trained(rows, labels)
    kind = rows.schema["doc_id"].dataType.simpleString()
    scored = rows.select("doc_id", held_out("doc_id").alias("held_out"), "body").mapInArrow(scoring(net), f"doc_id {kind}, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def trained(rows: DataFrame, labels: DataFrame) -> Broadcast:
    return rows.sparkSession.sparkContext.broadcast(train(*sample(rows, labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")))))


def scoring(net: Broadcast):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            scores = held(("scorer", id(net.value)), lambda: Scorer(net.value)).scores(batch.column("body").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(scores, pa.float64())], ["doc_id", "held_out", "score"])

    return run


def drop_toxic(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without those predicted toxic.  Each row goes by its own text, also without id or with an id that others have."""
    net = trained(docs.select(F.col(doc_id).alias("doc_id"), body(text).alias("body")), labels)
    (said,) = fresh(docs, "body")
    return docs.withColumn(said, body(text)).mapInArrow(clean(net, said, docs.columns), docs.schema)


def clean(net: Broadcast, text: str, columns: list[str]):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            scores = held(("scorer", id(net.value)), lambda: Scorer(net.value)).scores(batch.column(text).to_pylist())
            kept = batch.filter(pa.array(np.asarray(scores) < THRESHOLD))
            yield pa.RecordBatch.from_arrays([kept.column(c) for c in columns], columns)

    return run
