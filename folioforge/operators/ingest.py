"""From files to a searchable library: what becomes of each file of a run, chunks cut
anew and merged with those that live, versions, citations, encoding by an injected model."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F

from folioforge.operators.maintain import merge_chunks

#: Characters that a text needs to be embedded, and that a new chunk keeps.
LEAST_TEXT, MOST_CHUNK = 100, 1000


def _bare(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", "")


def process(files: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(id, path, file_hash, text, outcome, stage, error) for files (id, path, file_hash,
    text): of equal contents the first path is kept, the others and those in ``known``
    (file_hash) are duplicates; a file without text has failed, one with little is
    stored, others are embedded. No file stops the run.

    Only hashes and paths are shuffled to find the first; texts stay where they are
    until the join by hash.
    """
    first = files.groupBy("file_hash").agg(F.min(F.struct("path", "id")).alias("f")).select(F.col("file_hash").alias("h"), F.col("f.id").alias("keeper"))
    if known is not None:
        first = first.join(known.select(F.col("file_hash").alias("h")).distinct(), "h", "left_anti")
    both = files.join(first, F.col("file_hash").eqNullSafe(F.col("h")), "left")
    length = F.length(_bare(F.col("text")))
    again = F.col("keeper").isNull() | (F.col("keeper") != F.col("id"))
    step = F.when(again, F.struct(F.lit("duplicate"), F.lit("dedup"), F.lit(None).cast("string")))
    step = step.when(length == 0, F.struct(F.lit("failed"), F.lit("extract"), F.lit("no text"))).when(length < LEAST_TEXT, F.struct(F.lit("stored"), F.lit("insert"), F.lit(None).cast("string")))
    s = step.otherwise(F.struct(F.lit("embedded"), F.lit("embed"), F.lit(None).cast("string")))
    return both.withColumn("s", s).select("id", "path", "file_hash", "text", F.col("s.col1").alias("outcome"), F.col("s.col2").alias("stage"), F.col("s.col3").alias("error"))


def run_totals(processed: DataFrame) -> DataFrame:
    o = F.col("outcome")
    return processed.agg(
        F.count("*").alias("files"), F.count_if(o.isin("stored", "embedded")).alias("success"), F.count_if(o == "duplicate").alias("duplicate"),
        F.count_if(o == "failed").alias("failed"), F.count_if(o == "embedded").alias("embedded"),
    )


def merge_chunks_in_full(live: DataFrame, fresh: DataFrame, papers: DataFrame) -> DataFrame:
    """(paper_id, chunk_index, chunk_hash, state, text, vec, valid, version) of the papers
    cut anew: live (paper_id, chunk_index, chunk_hash, text, vec), fresh (paper_id,
    chunk_index, text). A reused chunk keeps its text and vector under its new index, a
    new one has its text cut and no vector yet, an orphan stays, no longer valid, in the
    version it had.

    States are found on hashes alone; texts and vectors come in by one join a side.
    """
    hashed = fresh.withColumn("chunk_hash", F.sha2("text", 256))
    number = lambda d: d.withColumn("o", F.row_number().over(W.partitionBy("paper_id", "chunk_hash").orderBy("chunk_index")))
    a = number(live.where("chunk_hash is not null")).select("paper_id", "chunk_hash", "o", F.col("chunk_index").alias("was"), F.col("text").alias("kept"), "vec")
    b = number(hashed).select("paper_id", "chunk_hash", "o", F.col("chunk_index").alias("at"), F.substring("text", 1, MOST_CHUNK).alias("cut"))
    touched = fresh.select("paper_id").distinct()
    both = b.join(a.join(touched, "paper_id", "left_semi"), ["paper_id", "chunk_hash", "o"], "full_outer")
    state = F.when(F.col("at").isNull(), "orphaned").when(F.col("was").isNull(), "new").otherwise("reused")
    both = both.withColumn("state", state).join(papers.select(F.col("id").alias("paper_id"), F.col("content_version").alias("v")), "paper_id", "left")
    valid = F.col("state") != "orphaned"
    return both.select(
        "paper_id", F.coalesce("at", "was").alias("chunk_index"), "chunk_hash", "state", F.when(F.col("state") == "new", F.col("cut")).otherwise(F.col("kept")).alias("text"),
        "vec", valid.alias("valid"), (F.coalesce("v", F.lit(1)) + valid.cast("int")).cast("int").alias("version"),
    )


def reuse_totals(merged: DataFrame) -> DataFrame:
    s = F.col("state")
    counts = merged.agg(F.count_if(s == "reused").alias("reused"), F.count_if(s == "new").alias("new"), F.count_if(s == "orphaned").alias("orphaned"))
    return counts.withColumn("reuse_pct", F.round(F.try_divide(F.lit(100.0) * F.col("reused"), F.col("reused") + F.col("new")), 2))


def next_versions(papers: DataFrame, changed: DataFrame) -> DataFrame:
    """Papers with the version of those changed (id) one up."""
    hit = changed.select("id").distinct().withColumn("_hit", F.lit(1))
    version = (F.coalesce("content_version", F.lit(1)) + F.coalesce("_hit", F.lit(0))).cast("int")
    both = papers.join(hit, "id", "left")
    return both.withColumn("content_version", version).drop("_hit")


def citations(found: DataFrame) -> DataFrame:
    """Rows for the citations table from (paper_id, title, authors, year, context)."""
    return found.select("paper_id", "title", "authors", "year", "context", F.lit(1.0).alias("confidence"))


def insert_new(rows: DataFrame, table: DataFrame, key: str = "file_hash") -> DataFrame:
    """The table with those rows whose key it does not have; of equal keys the first by id."""
    first = rows.groupBy(key).agg(F.min("id").alias("id"))
    fresh = rows.join(first, ["id", key], "left_semi").join(table.select(key), key, "left_anti")
    return table.unionByName(fresh.select(*table.columns))


def encode(rows: DataFrame, model: Callable[[], Callable[[list[str]], list[list[float]]]], text: str = "text", batch: int = 32) -> DataFrame:
    """``rows`` with array<float> ``vec``: the injected model, made once for each task, over
    batches of texts. A null text, and a batch that the model fails on, have no vector."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        f = model()
        for pdf in frames:
            out: list = [None] * len(pdf)
            at = [i for i, t in enumerate(pdf[text]) if isinstance(t, str)]
            for s in range(0, len(at), batch):
                part = at[s : s + batch]
                try:
                    for i, v in zip(part, f([pdf[text].iloc[i] for i in part]), strict=True):
                        out[i] = v
                except Exception:  # noqa: BLE001 - one bad batch does not stop the run
                    continue
            yield pdf.assign(vec=out)

    kept = [c for c in rows.columns if c != "vec"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*kept).schema.fields) + ", vec array<float>"
    return rows.select(*kept).mapInPandas(run, schema)


def save_index(chunks: DataFrame, folder: str) -> None:
    """The vectors with their keys, as one table; there is no second file to disagree with."""
    chunks.select("paper_id", "chunk_index", "id", "vec").where("vec is not null").write.mode("overwrite").parquet(folder)


def load_index(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(folder)


def index_state(index: DataFrame, dim: int) -> DataFrame:
    """(size, misfits, repeated): rows, rows of another length and keys met more than once."""
    keys = index.groupBy("paper_id", "chunk_index").agg(F.count("*").alias("n"), F.count_if(F.size("vec") != dim).alias("m"))
    return keys.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("size"), F.coalesce(F.sum("m"), F.lit(0)).alias("misfits"), F.count_if(F.col("n") > 1).alias("repeated"))


__all__ = ["citations", "encode", "index_state", "insert_new", "load_index", "merge_chunks", "merge_chunks_in_full", "next_versions", "process", "reuse_totals", "run_totals", "save_index"]
