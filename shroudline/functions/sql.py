"""Functions callable from SQL text."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from shroudline.config import Detection
from shroudline.operators import detect as D


def register(spark: SparkSession, config: Detection, name: str = "find_pii") -> None:
    """``find_pii(text)``: spans as an array, for ``LATERAL VIEW inline(find_pii(text))``."""
    patterns = tuple(rule.pattern for rule in config.rules)
    labels = [rule.label for rule in config.scored]
    entropy = config.high_entropy
    min_length, min_entropy = (entropy.min_length, entropy.min_entropy) if entropy else (None, 0.0)
    kind = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("matched", pa.string())]))

    def find(texts: pa.Array) -> pa.Array:
        spans = D.scan_batch(texts, patterns, min_length, min_entropy)
        rows = [[{"label": labels[s["rule"]], "start": s["start"], "end": s["end"], "matched": s["matched"]} for s in row] for row in spans.to_pylist()]
        return pa.array(rows, kind)

    spark.udf.register(name, F.arrow_udf(find, "array<struct<label:string,start:int,end:int,matched:string>>"))
