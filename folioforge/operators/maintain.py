"""Keeping a library: what changed, what to reuse, what to drop; caches and logs.

All are functions from tables to tables: the new state is written beside the old.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F


def new_files(scanned: DataFrame, papers: DataFrame) -> DataFrame:
    """Scanned files whose content is not in the library yet, one path of each."""
    first = scanned.groupBy("file_hash").agg(F.min("path").alias("path"))
    return first.join(papers.select("file_hash"), "file_hash", "left_anti")


def duplicate_groups(files: DataFrame) -> DataFrame:
    """(file_hash, n, first_path): contents that stand in several files."""
    return files.where("file_hash is not null").groupBy("file_hash").agg(F.count("*").alias("n"), F.min("path").alias("first_path")).where("n > 1")


def missing_files(papers: DataFrame, files: DataFrame) -> DataFrame:
    return papers.join(files.select(F.col("path").alias("file_path")), "file_path", "left_anti")


def needs_embedding(force: bool = False) -> Column:
    return F.lit(True) if force else F.col("embedding_status").isNull() | F.col("embedding_status").isin("pending", "failed")


def needs_update() -> Column:
    return needs_embedding() | F.col("last_embedded_version").isNull() | (F.col("content_version") > F.col("last_embedded_version"))


def change_class(stored: Column, fresh: Column, known: Column, same_model: Column, force: Column) -> Column:
    return (
        F.when(force, "force").when(~F.coalesce(known, F.lit(False)), "new").when(stored.isNull() | (stored != fresh), "changed")
        .when(~same_model, "model_upgrade").otherwise("no_change")
    )


def merge_chunks(live: DataFrame, fresh: DataFrame) -> DataFrame:
    """(paper_id, chunk_index, chunk_hash, state) for papers cut anew: live and fresh are
    (paper_id, chunk_index, chunk_hash). A fresh chunk whose text is live is reused, the
    others are new; live ones without a fresh partner are orphaned. Equal texts of one
    paper are paired in order."""
    def numbered(d: DataFrame) -> DataFrame:
        return d.withColumn("o", F.row_number().over(W.partitionBy("paper_id", "chunk_hash").orderBy("chunk_index")))

    a, b = numbered(live.where("chunk_hash is not null")), numbered(fresh)
    key = ["paper_id", "chunk_hash", "o"]
    touched = fresh.select("paper_id").distinct()
    both = b.select(*key, F.col("chunk_index").alias("at")).join(a.join(touched, "paper_id", "left_semi").select(*key, F.col("chunk_index").alias("was")), key, "full_outer")
    state = F.when(F.col("at").isNull(), "orphaned").when(F.col("was").isNull(), "new").otherwise("reused")
    return both.select("paper_id", F.coalesce("at", "was").alias("chunk_index"), "chunk_hash", state.alias("state"))


def live_cache(entries: DataFrame, now: Column) -> DataFrame:
    return entries.where(F.col("expires_at").isNull() | (F.col("expires_at") >= now))


def latest(entries: DataFrame, key: list[str], by: list[str]) -> DataFrame:
    """Of the entries of each key the one that is last in ``by``: an upsert."""
    order = W.partitionBy(*key).orderBy(*[F.desc(c) for c in by])
    return entries.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def delete_with_children(ids: DataFrame, parent: DataFrame, **children: DataFrame) -> dict[str, DataFrame]:
    """The tables without the rows (id) and without what refers to them (paper_id)."""
    left = {"parent": parent.join(ids.select("id"), "id", "left_anti")}
    gone = ids.select(F.col("id").alias("paper_id"))
    return left | {name: t.join(gone, "paper_id", "left_anti") for name, t in children.items()}


def unique_targets(plans: DataFrame) -> DataFrame:
    """(id, target) with _1, _2, ... before the suffix where targets collide, by id."""
    n = F.row_number().over(W.partitionBy("target").orderBy("id")) - 1
    return plans.withColumn("_n", n).select(
        "id", F.when(F.col("_n") == 0, F.col("target")).otherwise(F.regexp_replace("target", r"(\.[^.]*)?$", F.lit(""))).alias("_t"),
        "target", "_n",
    ).select("id", F.when(F.col("_n") == 0, F.col("target")).otherwise(F.concat(F.regexp_extract("target", r"^(.*?)(\.[^.]*)?$", 1), F.lit("_"), F.col("_n"), F.regexp_extract("target", r"^(.*?)(\.[^.]*)?$", 2))).alias("target"))


def coverage(papers: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row: papers by embedding status, chunks by validity, and the share embedded
    in per cent, null without papers."""
    e = F.col("embedding_status")
    p = papers.agg(
        F.count("*").alias("papers"), F.count_if(e == "completed").alias("completed"), F.count_if((e == "pending") | e.isNull()).alias("pending"),
        F.count_if(e == "failed").alias("failed"), F.count_if(F.col("content_version") > F.col("last_embedded_version")).alias("outdated"),
    )
    c = chunks.agg(F.count("*").alias("chunks"), F.count_if("valid").alias("valid_chunks"), F.count_if(~F.col("valid")).alias("invalid_chunks"))
    share = F.round(F.try_divide(F.lit(100.0) * F.col("completed"), "papers"), 2)
    return p.withColumn("coverage_pct", share).join(F.broadcast(c))  # two frames of one row


def page(papers: DataFrame, by: str, limit: int, offset: int = 0) -> DataFrame:
    """A page of papers by indexed_at or year, latest first, or by title; ties by id."""
    from folioforge.functions.checks import LIMIT, between, positive, sort_by

    between("limit", limit, LIMIT), positive("offset", offset, 0)
    order = F.asc_nulls_first(by) if sort_by(by) == "title" else F.desc_nulls_last(by)
    return papers.orderBy(order, "id").offset(offset).limit(limit)


def update(rows: DataFrame, fresh: DataFrame, key: str = "id") -> DataFrame:
    """``rows`` with the fields of ``fresh`` set by key; null fields there leave what is."""
    given = [c for c in fresh.columns if c != key]
    new = fresh.select(key, *[F.col(c).alias(f"_new_{c}") for c in given])
    both = rows.join(new, key, "left")
    return both.select(*[F.coalesce(f"_new_{c}", c).alias(c) if c in given else F.col(c) for c in rows.columns])


def not_in_library(external: DataFrame, papers: DataFrame) -> DataFrame:
    """Records (arxiv_id, doi, ...) of which the library holds neither identifier; empty
    identifiers match nothing."""
    from folioforge.functions.extract import normal_arxiv

    keys = {"_arxiv": F.nullif(normal_arxiv(F.col("arxiv_id")), F.lit("")), "_doi": F.nullif(F.lower(F.trim("doi")), F.lit(""))}
    out = external.withColumns(keys)
    for k, e in keys.items():
        out = out.join(papers.select(e.alias(k)).where(F.col(k).isNotNull()).distinct(), k, "left_anti")
    return out.drop(*keys)


def undoable(log: DataFrame, since: Column) -> DataFrame:
    """Log rows (created_at, can, undone) that can be undone, latest first."""
    return log.where(F.col("can") & ~F.coalesce("undone", F.lit(False)) & (F.col("created_at") >= since)).orderBy(F.desc("created_at"), "id")
