"""What a model is given to read: budgets, pinned papers, blocks with a legend,
stand-ins for abstracts, digests and lists of papers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioforge.functions.extract import cut_with_dots

#: Context windows of known models in tokens, and the shares of a window.
WINDOWS = {"meta-llama/llama-4-scout-17b-16e-instruct": 128_000, "openai/gpt-oss-120b": 128_000, "compound-beta": 8_192, "compound-beta-mini": 8_192}
DEFAULT_WINDOW, INPUT_SHARE, RESPONSE_SHARE = 4_096, 0.60, 0.30
#: Chunk types that may open a pinned paper, and the score it comes in with.
OPENINGS, PINNED_SCORE = ("abstract", "introduction", "paragraph"), 0.05
NO_ABSTRACT = "Abstract not available."


def budget(model: Column, share: float = INPUT_SHARE) -> Column:
    """Tokens of a model's window that the share comes to."""
    window = F.lit(DEFAULT_WINDOW)
    for name, size in WINDOWS.items():
        window = F.when(model == name, size).otherwise(window)
    return F.floor(window * F.lit(share)).cast("int")


def _best(*order: Column) -> Column:
    return F.struct(*order)


def pinned(present: DataFrame, pins: DataFrame, chunks: DataFrame) -> DataFrame:
    """(qid, paper_id, id, section, text): for each pinned paper (qid, paper_id) that is
    not present (qid, paper_id) its most important opening chunk. The best chunk is an
    aggregate with partial sums, so that a hot paper gathers nothing."""
    opening = chunks.where(F.col("chunk_type").isin(*OPENINGS) & F.col("text").isNotNull())
    one = F.min_by(F.struct("id", "section", "text"), _best(F.coalesce(-F.col("importance"), F.lit(1e9)), F.col("id")))
    best = opening.groupBy("paper_id").agg(one.alias("x")).select("paper_id", "x.*")
    absent = pins.select("qid", "paper_id").distinct().join(present.select("qid", "paper_id").distinct(), ["qid", "paper_id"], "left_anti")
    return absent.join(best, "paper_id").select("qid", "paper_id", "id", "section", "text")


def titled(excerpts: DataFrame, papers: DataFrame) -> DataFrame:
    """``excerpts`` (paper_id, ...) with title, authors and year; a paper that is not
    known is called by its id, missing fields of a known one are filled."""
    fill = lambda c, v: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(v)).alias(c)
    p = papers.select(F.col("id").alias("paper_id"), fill("title", "Untitled"), fill("authors", ""), F.coalesce(F.col("year").cast("string"), F.lit("")).alias("year"))
    both = excerpts.join(p, "paper_id", "left")
    return both.withColumn("title", F.coalesce("title", F.concat(F.lit("Paper "), F.col("paper_id").cast("string"))))


def context_blocks(kept: DataFrame, papers: DataFrame) -> DataFrame:
    """(qid, context, papers): for each question what was kept (qid, place, score,
    paper_id, section, excerpt) as labelled blocks, best first, after a legend of the
    papers by id. A question has no more blocks than its packer kept."""
    t = titled(kept, papers)
    short = F.when(F.length("title") > 55, F.concat(F.substring("title", 1, 55), F.lit("…"))).otherwise(F.col("title"))
    number = F.col("paper_id").cast("string")
    block = F.concat(F.lit("[Paper "), number, F.lit(" | "), short, F.lit(" | "), F.coalesce("section", F.lit("Content")), F.lit("]\n"), "excerpt")
    line = F.concat(F.lit("  Paper "), number, F.lit(": [id "), number, F.lit("] "), "title", F.lit(" — "), F.coalesce("authors", F.lit("")), F.lit(", "), F.coalesce("year", F.lit("")))
    g = t.groupBy("qid").agg(
        F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("o"), "place", block.alias("b")))).alias("blocks"),
        F.array_sort(F.collect_set(F.struct("paper_id", line.alias("l")))).alias("legend"),
    )
    joined = lambda c, f, by: F.array_join(F.transform(c, lambda x: x[f]), by)
    context = F.concat(F.lit("Papers in context:\n"), joined("legend", "l", "\n"), F.lit("\n\n"), joined("blocks", "b", "\n\n"))
    return g.select("qid", context.alias("context"), F.size("legend").alias("papers"))


def reading_text(abstract: Column, full: Column) -> Column:
    """An abstract of more than 100 characters, else the beginning of the text."""
    return F.when(F.length(abstract) > 100, abstract).otherwise(F.coalesce(F.nullif(F.substring(full, 1, 2000), F.lit("")), F.lit("(No text available.)")))


def abstracts(papers: DataFrame, chunks: DataFrame, most: int = 1200) -> DataFrame:
    """(paper_id, abstract): the abstract, else the two most important abstract or
    introduction chunks joined and cut, else a note. The two are kept by maps of two
    rows each, which merge before the shuffle."""
    opening = chunks.where(F.col("valid") & F.col("chunk_type").isin("abstract", "introduction") & F.col("text").isNotNull())
    key = F.struct(F.coalesce(-F.col("importance"), F.lit(1e9)).alias("o"), F.col("id").alias("id"))
    first = opening.groupBy("paper_id").agg(F.min(key).alias("k")).select("paper_id", F.col("k.id").alias("id"))
    rest = opening.join(first, ["paper_id", "id"], "left_anti")
    second = rest.groupBy("paper_id").agg(F.min(key).alias("k")).select("paper_id", F.col("k.id").alias("id"))
    two = opening.select("paper_id", "id", "text")
    two = two.join(first.withColumn("n", F.lit(1)).union(second.withColumn("n", F.lit(2))), ["paper_id", "id"])
    joined = two.groupBy("paper_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "text"))), lambda x: x["text"]), " ").alias("t"))
    own = F.nullif(F.regexp_replace("abstract", r"^\s+|\s+$", ""), F.lit(""))
    p = papers.select(F.col("id").alias("paper_id"), own.alias("own"))
    return p.join(joined, "paper_id", "left").select("paper_id", F.coalesce("own", F.substring("t", 1, most), F.lit(NO_ABSTRACT)).alias("abstract"))


def digest_line(section: Column, summary: Column, most: int = 150) -> Column:
    return F.concat(F.lit("- "), section, F.lit(": "), cut_with_dots(summary, most))


def summary_entry(number: Column, title: Column, authors: Column, year: Column, summary: Column) -> Column:
    return F.concat(F.lit("[Paper "), number.cast("string"), F.lit("] "), title, F.lit(" — "), authors, F.lit(" ("), year.cast("string"), F.lit(")\n"), summary)


def candidate_line(p: dict[str, Column]) -> Column:
    """A line for a paper of the library that may answer a search."""
    known = lambda c: F.coalesce(F.nullif(c, F.lit("")), F.lit("N/A"))
    return F.concat(F.lit("- Library id "), p["id"].cast("string"), F.lit(": "), p["title"], F.lit(" ("), p["year"].cast("string"), F.lit(") | authors: "), p["authors"], F.lit(" | doi: "), known(p["doi"]), F.lit(" | arxiv: "), known(p["arxiv_id"]))
