"""The library's tables in the shape that the operators take."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.sources.tables import table

DIM = 64


def papers(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "papers")


def chunks(spark: SparkSession, folder: str, where: str | Column | None = None, *, valid: bool = False) -> DataFrame:
    """Chunks that meet ``where``, a repeated row counted once. Only the columns that a
    plan uses are read. Repeated rows are equal, so the filters stand below the
    deduplication and reach the scan, and only rows that are left are shuffled for it."""
    raw = table(spark, folder, "paper_chunks")
    if valid:
        raw = raw.where("is_valid")
    c = raw.select(
        "id", "paper_id", "chunk_index", F.col("text_content").alias("text"), F.col("embedding_vector").alias("vec"),
        F.col("section_name").alias("section"), "chunk_type", F.col("importance_score").alias("importance"),
        F.coalesce("is_valid", F.lit(False)).alias("valid"), "chunk_hash", "content_version", "created_at", "model_name",
    )
    return (c if where is None else c.where(where)).dropDuplicates(["id"])


def asking(c: DataFrame) -> DataFrame:
    """The stated query set of searches: every valid row whose id is divisible by 100."""
    return c.where("id % 100 = 0 and valid").select(F.col("id").alias("qid"), F.col("text").alias("question"), "vec")


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", "text")


def notes(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "notes")


def cache(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "llm_cache").dropDuplicates(["id"])


def paper_texts(spark: SparkSession, folder: str) -> DataFrame:
    """(id, text): a first page for each paper, as its fields would be printed."""
    p = papers(spark, folder)
    gap = F.lit("\n\n")
    return p.select("id", F.concat(
        F.col("title"), F.lit("\n"), F.coalesce("authors", F.lit("")), gap, F.lit("Abstract: "), F.coalesce("abstract", F.lit("")), gap,
        F.coalesce(F.concat(F.lit("doi "), "doi"), F.lit("")), F.lit(" "), F.coalesce(F.concat(F.lit("arXiv:"), "arxiv_id"), F.lit("")),
        F.lit(" published "), F.coalesce(F.col("year").cast("string"), F.lit("")),
    ).alias("text"))
