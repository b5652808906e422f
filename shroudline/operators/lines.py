"""Event streams in batch: lines put together from chunks, and one outcome per stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shroudline.operators import policy as P, skew

ONE_BYTE = "ISO-8859-1"


def reassemble_lines(chunks: DataFrame, key: str = "stream_id", seq: str = "seq", chunk: str = "chunk") -> DataFrame:
    """(stream, line_no, line, terminated) from arbitrary byte chunks in ``seq`` order.

    Line breaks before a chunk number its pieces; pieces of one line then meet by (stream, line
    number), so a task holds a line and never a stream.  Bytes are decoded only once a line is whole,
    as a character may be split over two chunks.
    """
    bytes_ = F.decode(F.col(chunk), ONE_BYTE)
    pieces = chunks.select(key, F.col(seq).cast("bigint").alias(seq), F.split(bytes_, "\n", -1).alias("_pieces"))
    numbered = skew.prefix_sum(pieces, key, seq, (F.size("_pieces") - 1).cast("bigint"), "breaks")
    parts = numbered.select(key, seq, "breaks", (F.size("_pieces") - 1).alias("_last"), F.posexplode("_pieces").alias("_i", "_piece"))
    lines = parts.groupBy(key, (F.col("breaks") + F.col("_i")).alias("line_no")).agg(
        F.array_sort(F.collect_list(F.struct(seq, "_piece"))).alias("_parts"), F.bool_or(F.col("_i") < F.col("_last")).alias("terminated")
    )
    raw = F.encode(F.array_join(F.transform("_parts", lambda p: p["_piece"]), ""), ONE_BYTE)
    return lines.select(key, "line_no", F.make_valid_utf8(raw.cast("string")).alias("line"), "terminated").where(
        F.col("terminated") | (F.col("line") != "")
    )


def stream_outcome(redacted: DataFrame, key: str = "stream_id", seq: str = "seq") -> DataFrame:
    """One outcome per stream from its rewritten lines, with its lines and findings counted."""
    return P.merge_outcomes(redacted, key, seq, sums={"n_findings": F.size("resolved"), "n_lines": F.lit(1)})
