"""The corpus pipeline: five stages, each on all that the one before it kept.

language ID -> SimHash near-dedup -> benchmark decontamination -> PII -> best-fit packing
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbitquery.llm import decontam, langid, neardup, packing, pii
from orbitquery.llm.common import Table, free_name, scratch

#: A document goes if no language is the likelier half of what its text may be, or it has no letter.
SURE = 0.5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose language is recognised, whatever their label says.

    Null and empty texts and texts without a letter go, since they are in no language.  Null
    doc_ids and repeated rows are judged like any other row.  Without any label there is
    nothing to learn and all rows go; an empty table stays empty.
    """
    names = (free_name(docs, "lang"), free_name(docs, "sure"))
    judged = langid.identify(docs, langid.train(docs), names=names)
    return judged.where((F.col(names[0]) != langid.UNDECIDED) & (F.col(names[1]) >= SURE)).select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest doc_id of each group of exact and near copies.

    Texts without words are copies of each other.  Rows with a null doc_id all stay; rows
    that repeat a doc_id are one document, whose first text stays; an empty table stays empty.
    """
    return neardup.keep_first(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item.

    A document is its doc_id: if one of several rows holds an item, all go.  Rows with a null
    doc_id are documents of their own and judged by their texts.  Null and empty texts hold
    nothing and stay; an empty table or an empty benchmark drops nothing.
    """
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    gone = free_name(docs, "leaked")

    def leaked(rows: DataFrame) -> DataFrame:
        return Table(decontam.contaminated(rows, items).select(F.col("doc_id").alias(gone)).distinct(), "leaked").df

    kept = docs.join(leaked(docs.where("doc_id is not null")), F.col("doc_id").cast("long") == F.col(gone), "left_anti")
    if docs.where("doc_id is null").isEmpty():
        return kept
    # A row without an id goes by its text's digest, beside the ids of the others.
    by_text = F.when(F.col("doc_id").isNull(), F.xxhash64(F.col("text").cast("string")))
    return kept.join(leaked(docs.where("doc_id is null").select(by_text.alias("doc_id"), "text")), by_text == F.col(gone), "left_anti")


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data in texts; n_chars follows the new text.

    Null and empty texts, null doc_ids and repeated rows come through as they are; an empty
    table stays empty, and a table without n_chars gets none.
    """
    masked = pii.mask_personal(docs)
    if "n_chars" in docs.columns:
        masked = masked.withColumn("n_chars", F.coalesce(F.length("text"), F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return masked


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, placed in sequences of at most 4096 tokens.

    A null or empty text is one piece, its end id; null doc_ids and repeated rows are packed
    like any other row, other columns are ignored, and an empty table gives no pieces.
    """
    return packing.pack_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("pii", mask_personal_data),
    ("packing", pack),
]
#: Byte contexts, fingerprints and packing are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to `documents`, each result written and read again."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        with scratch():  # what a stage wrote on the way goes once its result is written
            written = Table(stage(spark, docs, sf_dir), name, keep=True)
        if before is not None:
            before.drop()
        docs, before = written.df, written
    return STAGES[-1][1](spark, docs, sf_dir)
