"""Hybrid retrieval: vector and keyword ranks fused, capped, cut to the sentences that
matter and packed into a budget of tokens. All questions are answered in one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from folioforge.functions.text import keywords, token_estimate
from folioforge.operators.context import PINNED_SCORE, pinned
from folioforge.operators.lexical import relevant_sentences, words_in
from folioforge.operators.vectors import knn
from folioforge.plans.lineage import cut

RRF, CAP, OVERHEAD = 60, 3, 15  # fixed values
#: Parts in which the chunks of one word are ranked before they meet.
PARTS = 32


def keyword_ranks(questions: DataFrame, chunks: DataFrame, n: int) -> DataFrame:
    """(qid, id, rank): valid chunks that hold a keyword of the question, by importance."""
    asked = questions.select("qid", F.slice(keywords(F.col("question")), 1, 8).alias("words"))
    # distinct words are looked up once for all questions; the pairs come back by join
    words = asked.select("qid", F.explode(F.array_distinct("words")).alias("w"))
    # the order is by importance alone, so no more than a word's n best can be among a question's
    first = [F.desc_nulls_last("importance"), F.col("id")]
    hits = words_in(chunks.select("id", "text"), words.select("w").distinct()).join(chunks.select("id", "importance"), "id")
    hits = hits.withColumn("p", F.pmod(F.xxhash64("id"), F.lit(PARTS)))  # a frequent word's chunks are ranked in parts first
    for keys in (["w", "p"], ["w"]):
        hits = hits.withColumn("r", F.row_number().over(W.partitionBy(*keys).orderBy(*first))).where(F.col("r") <= n)
    found = hits.join(words, "w").select("qid", "id", "importance").distinct()
    order = W.partitionBy("qid").orderBy(*first)
    return found.withColumn("rank", F.row_number().over(order) - 1).where(F.col("rank") < n).select("qid", "id", "rank")


def fuse(dense: DataFrame, sparse: DataFrame) -> DataFrame:
    """(qid, id, rrf): reciprocal ranks summed; a missing rank is twice the list's size."""
    sides = {}
    for name, d in (("d", dense), ("k", sparse)):
        size = F.count("*").over(W.partitionBy("qid"))
        sides[name] = d.select("qid", "id", F.col("rank").alias(f"r{name}"), size.alias(f"n{name}"))
    sizes = [d.groupBy("qid").agg(F.count("*").alias(f"z{n}")) for n, d in (("d", dense), ("k", sparse))]
    both = sides["d"].join(sides["k"], ["qid", "id"], "full_outer").join(sizes[0], "qid", "left").join(sizes[1], "qid", "left")
    part = lambda s: 1 / (RRF + F.coalesce(f"r{s}", 2 * F.coalesce(f"z{s}", F.lit(0))))
    return both.select("qid", "id", F.round(part("d") + part("k"), 9).alias("rrf"))


def capped(fused: DataFrame, chunks: DataFrame, top: int) -> DataFrame:
    """The ``top`` best chunks of each question, at most CAP of one paper."""
    known = fused.join(chunks.where("length(text) > 0").select("id", "paper_id", "chunk_index", "text", "section", "importance"), "id")
    order = [F.desc("rrf"), "paper_id", "chunk_index", "id"]
    within = known.withColumn("p", F.row_number().over(W.partitionBy("qid", "paper_id").orderBy(*order))).where(F.col("p") <= CAP)
    return within.withColumn("place", F.row_number().over(W.partitionBy("qid").orderBy(*order))).where(F.col("place") <= top).drop("p")


def greedy(items: Column, cost: str, budget: Column) -> Column:
    """Of an array of structs in order, those that still fit the budget; one that does
    not fit is passed over, later ones may fit."""
    start = F.struct(F.lit(0).alias("used"), F.filter(items, lambda x: F.lit(False)).alias("kept"))
    step = lambda a, x: F.when(
        a["used"] + x[cost] <= budget, F.struct((a["used"] + x[cost]).alias("used"), F.concat(a["kept"], F.array(x)).alias("kept"))
    ).otherwise(a)
    return F.aggregate(items, start, step)["kept"]


def retrieve(questions: DataFrame, chunks: DataFrame, top: int = 8, budget: int = 2457, dim: int = 64, pins: DataFrame | None = None) -> DataFrame:
    """(qid, place, id, paper_id, section, score, excerpt) of the context for each of
    questions (qid, question, vec), from chunks (id, paper_id, chunk_index, chunk_type,
    text, vec, section, importance, valid). Papers pinned (qid, paper_id) that are not
    among the best come in with their best opening chunk at a low score.

    A group that the packer folds holds at most ``top`` rows and the pinned ones.
    """
    valid = chunks.where("valid")
    dense = knn(questions, valid, 3 * top, dim).select("qid", "id", "rank")
    weight = F.when(F.coalesce("importance", F.lit(0.0)) == 0, 0.5).otherwise(F.col("importance"))
    kept = capped(fuse(dense, keyword_ranks(questions, valid, 3 * top)), valid, top)
    kept = kept.select("qid", "place", "id", "paper_id", "section", "text", F.round(F.col("rrf") * weight, 9).alias("score"))
    if pins is not None:
        kept = cut(kept)  # read twice: by what is missing and by what is given
        more = pinned(kept.select("qid", "paper_id"), pins, valid)
        kept = kept.unionByName(more.select("qid", (top + F.row_number().over(W.partitionBy("qid").orderBy("paper_id"))).alias("place"), "id", "paper_id", "section", "text", F.lit(PINNED_SCORE).alias("score")))
    asked = questions.select("qid", F.array_distinct(keywords(F.col("question"))).alias("words"))
    read = kept.join(asked, "qid").withColumn("excerpt", F.regexp_replace(relevant_sentences(F.col("text"), F.col("words")), r"^\s+|\s+$", ""))
    read = read.where("excerpt <> ''").withColumn("cost", token_estimate(F.col("excerpt")) + OVERHEAD)
    one = F.struct((-F.col("score")).alias("o"), "place", "cost", "id", "paper_id", "section", "score", "excerpt")
    packed = read.groupBy("qid").agg(F.array_sort(F.collect_list(one)).alias("items"))
    return packed.select("qid", F.explode(greedy(F.col("items"), "cost", F.lit(budget))).alias("x")).select(
        "qid", "x.place", "x.id", "x.paper_id", "x.section", "x.score", "x.excerpt"
    )


__all__ = ["capped", "fuse", "greedy", "keyword_ranks", "retrieve"]
