"""Lines that many documents share."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shroudline.llm.work import ASCII_SPACE, body, fresh, lookup, settle

UPPER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def line_key(line: str, shortest: int) -> bytes | None:
    """128-bit hash of the stripped, lower-cased line; nothing for keys below ``shortest`` code points."""
    key = line.strip(ASCII_SPACE)
    if len(key) < shortest:
        return None
    return xxhash.xxh3_128_digest(key.translate(UPPER).encode("utf-8", "surrogatepass"))


def drop_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shortest: int = 20, documents: int = 3) -> DataFrame:
    """``docs`` with shared lines taken out of ``text``, plus n_lines and n_dropped.

    A line whose key has at least ``shortest`` code points and lies in at least ``documents`` documents
    stays only in the largest id that holds it; there all its lines stay.  Lines are exploded as hashes, counted once
    per document with partial aggregation, and documents are put together by the position of their lines.
    A very common line is looked up by broadcast, so no key gathers in one task.

    Null or empty text is one empty line.  Rows with the same id count as one document, rows without an id
    as another, smaller than all.  Added columns step aside (``_n_lines``) for columns of the same name.
    """
    hashes = docs.select(F.col(doc_id).alias("id"), body(text).alias("body"))
    kind = hashes.schema["id"].dataType.simpleString()
    held = settle(hashes.mapInArrow(keys_of(shortest), f"id {kind}, key binary").distinct(), "lines")
    shared = held.groupBy("key").agg(F.count("*").alias("n"), F.max("id").alias("last")).filter(F.col("n") >= documents)
    shared = settle(shared, "shared")
    hits = lookup(held, shared, ["key"], "n", "inner").filter(~F.col("id").eqNullSafe(F.col("last")))
    hits = hits.groupBy("id").agg(F.collect_set("key").alias("keys"))
    id_, keys, got = fresh(docs, "hit_id", "hit_keys", "hit_out")
    n_lines, n_dropped = fresh(docs, "n_lines", "n_dropped")
    hits = hits.select(F.col("id").alias(id_), F.col("keys").alias(keys))
    both = docs.join(hits, docs[doc_id].eqNullSafe(hits[id_]), "left")
    cut = without(shortest)(body(docs[text]), both[keys])
    both = both.withColumn(got, cut)
    plain = [F.col(f"{got}.text").alias(c) if c == text else docs[c] for c in docs.columns]
    return both.select(*plain, F.col(f"{got}.n_lines").alias(n_lines), F.col(f"{got}.n_dropped").alias(n_dropped))


def keys_of(shortest: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, keys = [], []
            for i, text in enumerate(batch.column("body").to_pylist()):
                found = {k for line in text.split("\n") if (k := line_key(line, shortest)) is not None}
                at.extend([i] * len(found))
                keys.extend(found)
            ids = batch.column("id").take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array(keys, pa.binary())], ["id", "key"])

    return run


OUT = T.StructType([T.StructField("text", T.StringType()), T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])


def without(shortest: int):
    @F.pandas_udf(OUT)
    def cut(texts: pd.Series, hits: pd.Series) -> pd.DataFrame:
        out = []
        for text, keys in zip(texts, hits, strict=True):
            lines = text.split("\n")
            if keys is None or not len(keys):
                out.append((text, len(lines), 0))
                continue
            gone = {bytes(k) for k in keys}
            stay = [line for line in lines if line_key(line, shortest) not in gone]
            out.append(("\n".join(stay), len(lines), len(lines) - len(stay)))
        return pd.DataFrame(out, columns=["text", "n_lines", "n_dropped"])

    return cut


