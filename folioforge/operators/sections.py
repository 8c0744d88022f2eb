"""Context by sections: structured extracts, aligned sections, sections in common."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from folioforge.functions.text import SECTION_BUDGETS, section_budget, section_key, token_estimate, tokens
from folioforge.operators.lexical import K1, B

#: Chunks that stand in for a section without a label, and parts in which a hot paper's are ranked first.
STAND_INS, PARTS = 5, 32


def section_names(chunks: DataFrame) -> DataFrame:
    """(paper_id, section, first): the distinct non-empty names of valid chunks and
    where each first stands."""
    return chunks.where("valid and length(section) > 0").groupBy("paper_id", "section").agg(F.min("chunk_index").alias("first"))


def _ordered_text(size: int | Column) -> Column:
    """The group's texts by (importance desc, chunk_index, id), joined by blanks."""
    one = F.struct((-F.col("importance")).alias("o"), "chunk_index", "id", "text")
    return F.array_join(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["text"]), " ")


def structured_extract(chunks: DataFrame, budget: int = 2000) -> DataFrame:
    """(paper_id, rank, section_key, excerpt): for each paper its sections in order of
    priority, each cut to its own budget, as long as all so far fit ``budget`` tokens.

    A section keeps no more text than its budget, so the chunks of a section are
    limited by a running length before they are gathered: hot papers gather little.
    """
    c = chunks.where("valid and length(text) > 0").withColumn("key", section_key(F.col("section"), F.col("chunk_type")))
    c = c.withColumn("importance", F.coalesce("importance", F.lit(0.0)))
    most = section_budget(F.col("key")) * 4
    before = W.partitionBy("paper_id", "key").orderBy(F.desc("importance"), "chunk_index", "id").rowsBetween(W.unboundedPreceding, -1)
    c = c.withColumn("above", F.coalesce(F.sum(F.length("text") + 1).over(before), F.lit(0))).where(F.col("above") < most)
    s = c.groupBy("paper_id", "key").agg(_ordered_text(0).alias("joined")).withColumn("excerpt", F.substr("joined", F.lit(1), section_budget(F.col("key")) * 4))
    order = F.array(*map(F.lit, SECTION_BUDGETS))
    s = s.withColumn("rank", F.array_position(order, F.col("key")).cast("int")).withColumn("cost", token_estimate(F.col("excerpt")) + 5)
    run = W.partitionBy("paper_id").orderBy("rank").rowsBetween(W.unboundedPreceding, 0)
    return s.withColumn("used", F.sum("cost").over(run)).where(F.col("used") <= budget).select("paper_id", "rank", F.col("key").alias("section_key"), "excerpt")


def _stand_ins(chunks: DataFrame, name: str, size: int) -> DataFrame:
    """(paper_id, excerpt): for each paper the five of its chunks that score best by
    BM25 for the section's name, of those that hold one of its words, cut to ``size``.

    Scores use the statistics of the one paper; ties go by chunk_index and id. Texts
    are fetched for the chosen only, and the best are taken in parts first, so that a
    hot paper is spread.
    """
    terms = re.sub(r"[^\w\s]", "", name.lower()).split()
    if not terms:
        return chunks.select("paper_id", F.lit("").alias("excerpt")).where("false")
    tf = [f"tf{i}" for i in range(len(terms))]
    c = chunks.select("paper_id", "id", "chunk_index", tokens(F.col("text")).alias("t")).select(
        "paper_id", "id", "chunk_index", F.size("t").alias("len"),
        *((F.size("t") - F.size(F.array_remove("t", w))).alias(f) for f, w in zip(tf, terms, strict=True)),
    )
    stats = c.groupBy("paper_id").agg(F.count("*").alias("n"), F.avg("len").alias("mean"), *(F.count_if(F.col(f) > 0).alias(f"d{f}") for f in tf))
    hits = c.where(F.greatest(*tf, F.lit(0)) > 0).join(stats, "paper_id")
    score = F.lit(0.0)
    for f in tf:
        idf = F.log((F.col("n") - F.col(f"d{f}") + 0.5) / (F.col(f"d{f}") + 0.5) + 1)
        score = score + idf * (F.col(f) * (K1 + 1) / (F.col(f) + K1 * (1 - B + B * F.col("len") / F.col("mean"))))
    hits = hits.select("paper_id", "id", "chunk_index", score.alias("score"))
    for keys in (["paper_id", F.pmod(F.xxhash64("id"), F.lit(PARTS))], ["paper_id"]):
        best = W.partitionBy(*keys).orderBy(F.desc("score"), "chunk_index", "id")
        hits = hits.withColumn("place", F.row_number().over(best)).where(F.col("place") <= STAND_INS)
    texts = hits.select("paper_id", "id", "place").join(chunks.select("id", "text"), "id")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "text"))), lambda x: x["text"]), " ")
    return texts.groupBy("paper_id").agg(joined.alias("joined")).select("paper_id", F.substring(F.regexp_replace("joined", r"^\s+|\s+$", ""), 1, size).alias("excerpt"))


def aligned_section(chunks: DataFrame, papers: DataFrame, name: str, budget: int = 600) -> DataFrame:
    """(paper_id, excerpt): side by side, the text of the section of that name for each
    of papers (paper_id), or of its chunks that score best for the name if none carries
    it, or a note that it was not found."""
    usable = chunks.where("valid and length(text) > 0")
    c = usable.where(F.contains(F.lower("section"), F.lit(name.lower())))
    c = c.withColumn("importance", F.coalesce("importance", F.lit(0.0)))
    before = W.partitionBy("paper_id").orderBy(F.desc("importance"), "chunk_index", "id").rowsBetween(W.unboundedPreceding, -1)
    c = c.withColumn("above", F.coalesce(F.sum(F.length("text") + 1).over(before), F.lit(0))).where(F.col("above") < budget * 4)
    s = c.groupBy("paper_id").agg(_ordered_text(0).alias("joined")).select("paper_id", F.substring("joined", 1, budget * 4).alias("excerpt"))
    s = s.unionByName(_stand_ins(usable.join(c.select("paper_id").distinct(), "paper_id", "left_anti"), name, budget * 4))
    return papers.select("paper_id").distinct().join(s, "paper_id", "left").select("paper_id", F.coalesce("excerpt", F.lit(f"[Section '{name}' not found]")).alias("excerpt"))


#: What a section of each usual name may be called.
SECTION_WORDS = {
    "abstract": ("abstract", "summary"), "introduction": ("introduction", "intro", "background"),
    "methodology": ("method", "methodology", "approach", "technique"), "results": ("result", "finding", "outcome", "observation"),
    "discussion": ("discussion", "analysis", "interpretation"), "conclusion": ("conclusion", "summary", "final"),
}


def likeness(wanted: Column, section: Column) -> Column:
    """0 where one of two lower-case names holds the other, 1 where the section holds a
    word that stands for the wanted name, else null."""
    words = F.array(wanted)
    for name, known in SECTION_WORDS.items():
        words = F.when(wanted == name, F.array(*map(F.lit, known))).otherwise(words)
    inside = F.contains(section, wanted) | F.contains(wanted, section)
    return F.when(inside, 0).when(F.exists(words, lambda w: F.contains(section, w)), 1)


def fuzzy_sections(names: DataFrame, wanted: list[str]) -> DataFrame:
    """(paper_id, name, section): for each paper and each name wanted the section meant
    by it, from (paper_id, section, first): by inclusion before words, in text order."""
    each = names.withColumn("name", F.explode(F.array(*map(F.lit, wanted))))
    each = each.withColumn("rank", likeness(F.col("name"), F.lower("section"))).where("rank is not null")
    return each.groupBy("paper_id", "name").agg(F.min_by("section", F.struct("rank", "first", "section")).alias("section"))


def common_sections(names: DataFrame, lists: DataFrame) -> DataFrame:
    """(note, section, first): for lists (note, papers) the sections of the first paper
    that each other paper of the list has too, by inclusion or usual words. Sections
    meet only within a list."""
    l = lists.where(F.size("papers") > 0).select("note", F.element_at("papers", 1).alias("lead"), F.array_distinct("papers").alias("papers"))
    l = l.withColumn("rest", F.filter("papers", lambda p: p != F.col("lead")))
    mine = l.select("note", F.col("lead").alias("paper_id"), F.size("rest").alias("need")).join(names, "paper_id").drop("paper_id")
    others = l.select("note", F.explode("rest").alias("paper_id")).join(names.select("paper_id", F.lower("section").alias("s")).distinct(), "paper_id")
    met = mine.select("note", "section").join(others, "note").where(likeness(F.lower("section"), F.col("s")).isNotNull())
    n = met.groupBy("note", "section").agg(F.count_distinct("paper_id").alias("n"))
    return mine.join(n, ["note", "section"], "left").where(F.coalesce("n", F.lit(0)) == F.col("need")).select("note", "section", "first")
