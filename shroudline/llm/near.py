"""Near duplicates: b-bit minhash signatures, a multi-index Hamming join, and confirmation on full shingle sets."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shroudline.llm.components import components
from shroudline.llm.work import body, fresh, held, lookup, settle, sliced
from shroudline.operators import skew

# A signature: CHUNKS chunks of SYMBOLS minima, 16 bits of each.  Two signatures that differ in at most
# 2 * CHUNKS - 1 places agree in some chunk but for one symbol at most, so the keys "chunk without symbol i" of both meet.
# A pair of similarity 0.8 has no such chunk once in 600,000 times, one of 0.85 once in 60 million.
CHUNKS, SYMBOLS = 10, 5
WIDTH = CHUNKS * SYMBOLS
# Candidates further apart than this are not confirmed; similarity 0.8 exceeds it once in 2 million times.
DISTANCE = 25
# Longest parity bitmap; sets of more shingles are told apart less well by it, and none is lost.
PARITY_BITS = 1 << 14
# Pairs of one node that one task gets with its text.
PAIRS_PER_TASK = 10_000

SPACES = np.zeros(256, bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True


def odd_numbers(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


MULTIPLIERS = odd_numbers(WIDTH, 11)
PLACES = odd_numbers(16, 12)
KEY_SALT = odd_numbers(WIDTH, 13)


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def normal(text: str) -> bytes:
    """A-Z lower-cased, words split at ASCII white space, joined by one space."""
    return b" ".join(text.encode("utf-8", "surrogatepass").lower().split())


class WordHashes:
    """64-bit hashes of words, remembered up to a bound."""

    def __init__(self, most: int = 200_000) -> None:
        self.known: dict[bytes, int] = {}
        self.most = most

    def __call__(self, words: list[bytes]) -> np.ndarray:
        out = list(map(self.known.get, words))
        if None in out:
            for i, h in enumerate(out):
                if h is None:
                    out[i] = h = xxhash.xxh3_64_intdigest(words[i])
                    if len(self.known) < self.most:
                        self.known[words[i]] = h
        return np.array(out, np.uint64)


def shingles(words: list[bytes], width: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of ``width`` consecutive words; of all words if there are fewer."""
    h = hashes(words)
    width = min(width, len(h))
    n = len(h) - width + 1
    total = np.zeros(n, np.uint64)
    for j in range(width):
        total += mix(h[j : j + n] * PLACES[j % 16] + np.uint64(j))
    return np.unique(mix(total))


def signature(hashed: np.ndarray) -> np.ndarray:
    low = np.full(WIDTH, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashed), 8192):
        np.minimum(low, (hashed[at : at + 8192, None] * MULTIPLIERS).min(axis=0), out=low)
    return ((low >> np.uint64(20)) & np.uint64(0xFFFF)).astype(np.uint64)


def keys(symbols: np.ndarray) -> np.ndarray:
    """One key for each chunk and symbol left out of it."""
    chunks = symbols.reshape(CHUNKS, SYMBOLS)
    out = np.zeros((CHUNKS, SYMBOLS), np.uint64)
    for left_out in range(SYMBOLS):
        for j in (j for j in range(SYMBOLS) if j != left_out):
            out[:, left_out] = (out[:, left_out] << np.uint64(16)) | chunks[:, j]
    return mix(out.reshape(-1) ^ KEY_SALT).view(np.int64)


def word_hashes() -> WordHashes:
    return held("word hashes", WordHashes)


def signed(width: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze, hashes = zstandard.ZstdCompressor(level=1).compress, word_hashes()
        for batch in sliced(batches):
            columns: list[list] = [[], [], [], [], [], []]
            for text in batch.column("body").to_pylist():
                clean = normal(text)
                if not clean:
                    values = (0, None, None, None, None, None)
                else:
                    hashed = shingles(clean.split(b" "), width, hashes)
                    symbols = signature(hashed)
                    digest = np.frombuffer(xxhash.xxh3_128_digest(hashed.tobytes()), np.int64)
                    values = (len(hashed), int(digest[0]), int(digest[1]), symbols.astype("<u2").tobytes(), keys(symbols), squeeze(clean))
                for column, value in zip(columns, values, strict=True):
                    column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.binary())
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            names = ["doc_id", "n_shingles", "s1", "s2", "signature", "keys", "words"]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *arrays], names)

    return run


def find_near(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id, kept.

    Documents whose sets of ``width``-word shingles have a similarity of at least ``percent`` hundredths are linked;
    component_id is the smallest id reachable, and that document is kept.  Documents with equal sets are one node,
    so copies cost one row each.  Nodes meet in the buckets of their keys.  A bucket is never expanded into all its pairs: first
    each node meets the smallest node of any of its buckets, then the smallest of each bucket, and only nodes of one bucket
    that still belong to different components meet each other.  A link between nodes that are connected already changes
    nothing, so no component loses by this.  Of the last, those cannot be similar enough that have too many shingles
    which no other node left has, or whose parity bitmaps differ in more places than so similar sets differ in shingles; such
    pairs are not made.  Candidates within DISTANCE are confirmed on their full word sets.

    Ids are whole numbers.  Null, empty or blank text has no shingles and no links, and is its own component; an empty table gives an
    empty result.  A very long text is one row of its compressed words and is shingled whole, at some 50 bytes a word.  Rows with the same id are one
    document with several texts.  Rows without id link with nothing: component_id is null and they are kept.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), body(text).alias("body"))
    shape = "doc_id long, n_shingles long, s1 long, s2 long, signature binary, keys array<long>, words binary"
    found = settle(rows.mapInArrow(signed(width), shape), "signatures")
    linked = found.filter("s1 is not null and doc_id is not null")
    sets = settle(linked.groupBy("s1", "s2").agg(F.min("doc_id").alias("node"), F.count("*").alias("n")), "sets")
    named = sets.select(F.col("node").alias("doc_id"), "s1", "s2")
    nodes = linked.join(named, ["doc_id", "s1", "s2"]).dropDuplicates(["doc_id", "s1", "s2"])
    keyed = nodes.select(F.col("doc_id").alias("node"), F.posexplode("keys").alias("place", "key"))
    shared = keyed.groupBy("key").agg(F.min("node").alias("lead"), F.max("node").alias("top")).filter("lead < top").select("key", "lead")
    members = settle(keyed.join(shared, "key").select("key", "place", "node", "lead"), "members")
    wanted = members.select(F.col("node").alias("doc_id")).distinct()
    texts = settle(linked.join(wanted, "doc_id", "left_semi").select(F.col("doc_id").alias("node"), "n_shingles", "signature", "words"), "texts")

    first = members.filter("node > lead").groupBy("node").agg(F.min("lead").alias("lead")).select(F.col("lead").alias("a"), F.col("node").alias("b"))
    edges = settle(confirmed(first, texts, width, percent), "links")
    roots = settle(components(edges), "roots")
    led = members.filter("node > lead").select(F.col("lead").alias("a"), F.col("node").alias("b")).distinct()
    edges = settle(edges.unionByName(confirmed(apart(led.join(first, ["a", "b"], "left_anti"), roots), texts, width, percent)), "links")
    roots = settle(components(edges), "roots")
    placed = with_root(members, "node", roots, "root")
    mixed = placed.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high").select("key")
    placed = settle(placed.join(mixed, "key").select("key", "place", "node", "root", "lead"), "mixed")
    left = settle(texts.join(placed.select("node").distinct(), "node", "left_semi"), "left")
    bits = left.filter(F.col("n_shingles").isNotNull()).select("node", "words").mapInArrow(parities(width), "node long, parity array<long>, half array<long>, keys array<long>")
    # a node with several texts has no one bitmap
    bits = bits.groupBy("node").agg(F.count("*").alias("texts"), F.first("parity").alias("parity"), F.first("half").alias("half"), F.first("keys").alias("keys")).filter("texts = 1").drop("texts")
    known = settle(lonely(left, width).join(bits, "node", "left"), "known")
    able = placed.join(known.filter(F.col("n").isNull() | (100 * (F.col("n") - F.col("own")) >= percent * F.col("n"))), "node")
    other = able.select("key", F.col("node").alias("b"), F.col("root").alias("other"), F.col("n").alias("n_b"), F.col("own").alias("own_b"), F.col("parity").alias("parity_b"), F.col("half").alias("half_b"), F.col("keys").alias("keys_b"))
    # common shingles at most; least() passes over nulls, but the sum of sizes below is null if one is
    most = F.least(F.col("n") - F.col("own"), F.col("n_b") - F.col("own_b"))
    possible = (100 + percent) * most >= percent * (F.col("n") + F.col("n_b"))
    # a place in which parities differ holds a shingle that only one of the two sets has
    apart_in = F.when(F.size("parity") == F.size("parity_b"), unequal("parity", "parity_b")).when(
        F.size("parity") > F.size("parity_b"), unequal("half", "parity_b")).otherwise(unequal("parity", "half_b"))
    alike = (100 + percent) * apart_in <= (100 - percent) * (F.col("n") + F.col("n_b"))
    # nodes that share several keys meet at the first; all of them are mixed, as the nodes' components differ
    first_met = F.array_position(F.zip_with("keys", "keys_b", lambda x, y: x == y), True) == F.col("place") + 1
    meets = F.when(F.coalesce(possible, F.lit(True)), F.when(F.coalesce(alike, F.lit(True)), F.coalesce(first_met, F.lit(True))))
    met = able.join(other, "key").filter("node < b and root <> other and node <> lead").filter(F.coalesce(meets, F.lit(False)))
    across = met.select(F.col("node").alias("a"), "b").distinct()
    edges = edges.unionByName(confirmed(across, texts, width, percent))
    roots = settle(components(edges), "roots")

    final = with_root(sets, "node", roots, "component_id").select("s1", "s2", "n", "component_id")
    final = settle(final, "components")
    narrow = found.select("doc_id", "n_shingles", "s1", "s2")
    alone = narrow.filter("s1 is null or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    named = lookup(narrow.filter("s1 is not null and doc_id is not null"), final, ["s1", "s2"], "n", "inner")
    out = named.select("doc_id", "n_shingles", "component_id").unionByName(alone)
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def drop_near(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each group of near duplicates: the one of the smallest id.

    Rows are numbered in order of their ids, so those with one id are judged each by its own text.  Rows without id are kept.
    """
    (number,) = fresh(docs, "number")
    order = (F.col(doc_id).cast("long"), F.xxhash64(body(text)))
    ordered = docs.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = settle(ordered.withColumn(number, F.when(F.col(doc_id).isNotNull(), F.monotonically_increasing_id())), "ordered")
    gone = find_near(rows, number, text, width, percent).filter(~F.col("kept")).select(F.col("doc_id").alias(number))
    return rows.join(gone, number, "left_anti").select(*docs.columns)


def with_root(rows: DataFrame, node: str, roots: DataFrame, name: str) -> DataFrame:
    """Nodes without links are their own root."""
    named = roots.select(F.col("id").alias(node), F.col("root").alias("found_root"))
    return rows.join(named, node, "left").withColumn(name, F.coalesce("found_root", node)).drop("found_root")


def apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """Pairs whose nodes are not in one component yet."""
    return with_root(with_root(pairs, "a", roots, "ra"), "b", roots, "rb").filter("ra <> rb").select("a", "b")


def lonely(texts: DataFrame, width: int) -> DataFrame:
    """(node, n, own): shingles of each node, and how many of them no other node of ``texts`` has.

    Equal hashes of different shingles can only lower ``own``.  A node with several texts has no one size:
    its ``n`` is null, and no pair of it is ruled out.
    """
    each = texts.select("node", "words").mapInArrow(exploded(width), "node long, shingle long")
    alone = each.groupBy("shingle").agg(F.min("node").alias("node"), F.max("node").alias("top")).filter("node = top")
    alone = alone.groupBy("node").agg(F.count("*").alias("alone"))
    sizes = texts.groupBy("node").agg(F.max("n_shingles").alias("n"), F.count("*").alias("texts"))
    return sizes.join(alone, "node", "left").select("node", F.when(F.col("texts") == 1, F.col("n")).alias("n"), F.coalesce("alone", F.lit(0)).alias("own"))


def parity_bits(hashed: np.ndarray, bits: int) -> np.ndarray:
    """Bit i is odd where an odd number of hashes falls on i, as 64-bit words."""
    odd = np.bincount((hashed & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def parities(width: int):
    """Per text: its parity bitmap, four to eight bits a shingle up to PARITY_BITS, the one half as long, and its keys.

    Sets similar enough to be linked have sizes within a factor of two, so one of the two lengths fits the other's.
    """
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read, hashes = zstandard.ZstdDecompressor().decompress, word_hashes()
        for batch in sliced(batches):
            whole, half, key = [], [], []
            for words in batch.column("words").to_pylist():
                hashed = shingles(read(words).split(b" "), width, hashes)
                bits = min(PARITY_BITS, max(128, 1 << (4 * len(hashed) - 1).bit_length()))
                whole.append(parity_bits(hashed, bits))
                half.append(parity_bits(hashed, bits // 2))
                key.append(keys(signature(hashed)))
            kind = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("node"), *(pa.array(x, kind) for x in (whole, half, key))], ["node", "parity", "half", "keys"])

    return run


def unequal(a: str, b: str) -> Column:
    """In how many bits two bitmaps of one length differ."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda total, n: total + n)


def exploded(width: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read, hashes = zstandard.ZstdDecompressor().decompress, word_hashes()
        for batch in batches:
            for node, words in zip(batch.column("node").to_pylist(), batch.column("words").to_pylist(), strict=True):
                found = shingles(read(words).split(b" "), width, hashes).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), node)), pa.array(found)], ["node", "shingle"])

    return run


def confirmed(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose signatures are near and whose full sets are similar enough.

    A node of very many pairs is dealt over tasks, its text repeated once in each.
    """
    def side(name: str, *columns: str) -> DataFrame:
        return texts.select(F.col("node").alias(name), *(F.col(c).alias(f"{c}_{name}") for c in columns))

    def with_a(rows: DataFrame, *columns: str) -> DataFrame:
        return skew.lookup(rows, side("a", *columns), ["a"], "b", "inner", counts=many, target=PAIRS_PER_TASK)

    pairs = settle(pairs, "pairs")
    many = pairs.groupBy("a").agg(F.count("*").alias("n")).filter(F.col("n") > PAIRS_PER_TASK)
    sized = with_a(pairs.join(side("b", "n_shingles", "signature"), "b"), "n_shingles", "signature")
    fair = 100 * F.least("n_shingles_a", "n_shingles_b") >= percent * F.greatest("n_shingles_a", "n_shingles_b")
    near = settle(sized.filter(fair).filter(differing("signature_a", "signature_b") <= DISTANCE).select("a", "b").distinct(), "near")
    full = with_a(near.join(side("b", "words"), "b"), "words").select("a", "b", "words_a", "words_b")
    return full.mapInArrow(similar(width, percent), "a long, b long").distinct()


@F.pandas_udf(T.IntegerType())
def differing(a: pd.Series, b: pd.Series) -> pd.Series:
    left, right = (np.frombuffer(b"".join(x), "<u2").reshape(-1, WIDTH) for x in (a, b))
    return pd.Series((left != right).sum(axis=1).astype(np.int32))


def word_sets(width: int):
    read = zstandard.ZstdDecompressor().decompress

    @lru_cache(maxsize=64)
    def of(squeezed: bytes) -> frozenset:
        words = read(squeezed).split(b" ")
        return frozenset(zip(*(words[j:] for j in range(min(width, len(words)))), strict=False))

    return of


def similar(width: int, percent: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = word_sets(width)
        for batch in batches:
            good = []
            for a, b in zip(batch.column("words_a").to_pylist(), batch.column("words_b").to_pylist(), strict=True):
                left, right = of(a), of(b)
                common = len(left & right)
                good.append(100 * common >= percent * (len(left) + len(right) - common))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(good, pa.bool_()))

    return run
