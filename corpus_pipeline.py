"""From documents to packed sequences: each stage works on what the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shroudline.llm import contamination, lines, near, packing, toxicity, work
from shroudline.llm.queries import table, vocabulary
from shroudline.session import ship_package

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def screen_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go.  Each row by its own text: null and empty texts are one empty window, rows without id or with an id that
    others have stay or go like all, an empty table gives an empty one."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels")).select(*COLUMNS)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that at least three documents share go; n_chars follows the text.  A null text comes out empty; a document stays also if it loses
    all its lines; of documents that share a line the one with the largest id keeps it; rows with one id are one document."""
    return lines.drop_lines(docs).selectExpr("doc_id", "text", "lang", "source", "cast(length(text) as bigint) as n_chars")


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, the one with the least id: five words, similarity 0.8.  Rows without words, and
    rows without id, all stay; repeated rows are copies."""
    return near.drop_near(docs).select(*COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a twentieth or more of their words in benchmark passages go.  Documents without words stay; an empty benchmark removes
    none."""
    return contamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left, cut and packed into sequences.  A document without text is one piece of the end id alone; an empty table gives
    no piece."""
    return packing.pack_documents(docs, vocabulary("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", screen_toxic), ("line dedup", dedup_lines), ("MinHash near-dedup", dedup_near),
    ("benchmark decontamination", decontaminate), ("best-fit packing", pack),
]

# A trained score and the ids of a byte-pair encoder are no SQL: checked stage by stage against plain code.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again."""
    ship_package(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = work.settle(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
