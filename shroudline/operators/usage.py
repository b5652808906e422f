"""Model and token metering from JSON bodies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shroudline.operators import skew


def _with_tree(body: Column, read) -> Column:
    """``read`` applied to the parsed body, which is parsed once however often it is looked into."""
    return F.element_at(F.transform(F.array(F.try_parse_json(body)), read), 1)


def _string_at(tree: Column, path: str) -> Column:
    """The value at a path if it is a JSON string."""
    is_string = F.schema_of_variant(F.try_variant_get(tree, path, "variant")) == "STRING"
    return F.when(is_string, F.try_variant_get(tree, path, "string"))


def model_of(body: Column) -> Column:
    return _with_tree(body, lambda tree: _string_at(tree, "$.model"))


def usage_of(body: Column) -> Column:
    """``struct<model,prompt_tokens,completion_tokens>``; NULL without usage or with zero tokens.

    The first key present of a pair decides; a value that is no whole number counts as zero.
    """

    def count(tree: Column, first: str, second: str) -> Column:
        def number(key: str) -> Column:
            value = F.try_variant_get(tree, f"$.usage.{key}", "variant")
            whole = F.schema_of_variant(value) == "BIGINT"
            n = F.coalesce(F.when(whole, F.try_variant_get(tree, f"$.usage.{key}", "bigint")), F.lit(0))
            return F.when(value.isNotNull(), F.greatest(n, F.lit(0)))

        return F.coalesce(number(first), number(second), F.lit(0))

    def read(tree: Column) -> Column:
        return F.struct(
            _string_at(tree, "$.model").alias("model"),
            count(tree, "prompt_tokens", "input_tokens").alias("prompt_tokens"),
            count(tree, "completion_tokens", "output_tokens").alias("completion_tokens"),
        )

    used = F.filter(F.array(_with_tree(body, read)), lambda u: (u["prompt_tokens"] > 0) | (u["completion_tokens"] > 0))
    return F.get(used, F.lit(0))


def usages(df: DataFrame, *keep: str, body: str = "body") -> DataFrame:
    """Rows that carry usage, with its fields."""
    return df.select(*keep, skew.bound(usage_of(F.col(body))).alias("_u")).where("_u is not null").select(*keep, "_u.*")


def first_usage(lines: DataFrame, payload: str = "payload", stream: str = "stream_id", seq: str = "seq") -> DataFrame:
    """The first usage event of each stream; later ones are not counted again."""
    rows = lines.withColumn("_usage", skew.bound(usage_of(F.col(payload)))).where("_usage is not null")
    return rows.groupBy(stream).agg(F.min_by("_usage", seq).alias("u")).select(stream, "u.*")


def meter(usages: DataFrame) -> DataFrame:
    """Tokens by (model, kind); a missing model is ``unknown``."""
    kinds = F.array(
        F.struct(F.lit("prompt").alias("kind"), F.col("prompt_tokens").alias("tokens")),
        F.struct(F.lit("completion").alias("kind"), F.col("completion_tokens").alias("tokens")),
    )
    rows = usages.select(F.coalesce("model", F.lit("unknown")).alias("model"), F.explode(kinds).alias("k"))
    return rows.groupBy("model", "k.kind").agg(F.sum("k.tokens").alias("tokens"))
