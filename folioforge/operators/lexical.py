"""Keyword search, BM25 and the sentences of a text that answer a question."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from folioforge.functions.text import keywords, sentences, tokens

K1, B = 1.5, 0.75  # fixed values


def keyword_match(text: Column, words: Column, most: int = 8) -> Column:
    """Whether the text holds one of the first ``most`` words, in any case."""
    return F.exists(F.slice(words, 1, most), lambda w: F.contains(F.lower(text), w))


#: Words that are looked for in one pass over the texts; a bound on what is sent out.
BLOCK = 50_000


def _inside(batches: Iterator[pa.RecordBatch], words: list[str]) -> Iterator[pa.RecordBatch]:
    automaton = ahocorasick.Automaton()
    for w in words:
        automaton.add_word(w, w)
    automaton.make_automaton()
    for b in batches:
        ids, found = [], []
        for i, text in zip(b.column("id").to_pylist(), b.column("text").to_pylist(), strict=True):
            hit = {w for _, w in automaton.iter(text.lower())}
            ids += [i] * len(hit)
            found += sorted(hit)
        if ids:
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(found)], names=["id", "w"])


def words_in(rows: DataFrame, words: DataFrame) -> DataFrame:
    """(id, w): which of the words (w, lower case) stand anywhere in which rows (id,
    text), in one pass over the texts for each block of words."""
    rows = rows.select("id", "text").where("id is not null and text is not null")
    words = words.select("w").where("w <> ''").distinct()
    blocks = max(1, -(-words.count() // BLOCK))
    out = None
    for b in range(blocks):
        mine = sorted(r[0] for r in words.where(F.pmod(F.xxhash64("w"), F.lit(blocks)) == b).collect())
        if mine:
            part = rows.mapInArrow(lambda it, mine=mine: _inside(it, mine), "id bigint, w string")
            out = part if out is None else out.union(part)
    return rows.sparkSession.createDataFrame([], "id bigint, w string") if out is None else out


def bm25(queries: DataFrame, documents: DataFrame, n: int) -> DataFrame:
    """(qid, id, score): the n documents (id, text) that score best for each query
    (qid, question), ties by id. Terms asked repeatedly count repeatedly.

    Only the postings of the terms asked are kept: the index is filtered by the terms
    before it is grouped, and term counts are partly summed before the shuffle.
    """
    asked = queries.select("qid", F.explode(keywords(F.col("question"))).alias("term")).groupBy("qid", "term").agg(F.count("*").alias("m"))
    words = documents.select("id", tokens(F.col("text")).alias("t"))
    stats = documents.select(F.size(tokens(F.col("text"))).alias("len")).agg(F.count("*").alias("n"), F.avg("len").alias("mean"))
    flat = words.select("id", F.size("t").alias("len"), F.explode("t").alias("term"))
    postings = flat.join(asked.select("term").distinct(), "term", "left_semi").groupBy("term", "id").agg(F.count("*").alias("tf"), F.max("len").alias("len"))
    df = postings.groupBy("term").agg(F.count("*").alias("df"))
    hits = postings.join(df, "term").join(asked, "term").join(F.broadcast(stats))  # stats is one row
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    gain = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("mean")))
    scored = hits.groupBy("qid", "id").agg(F.round(F.sum(F.col("m") * idf * gain), 6).alias("score"))
    order = W.partitionBy("qid").orderBy(F.desc("score"), "id")
    return scored.withColumn("r", F.row_number().over(order)).where(F.col("r") <= n).drop("r")


def relevant_sentences(text: Column, words: Column, best: int = 3, around: int = 1) -> Column:
    """The ``best`` sentences with most of the words, with their neighbours, in order;
    the text as it is if it has few sentences or nothing is asked."""
    parts = F.transform(sentences(text), lambda s, i: F.struct(i.alias("i"), s.alias("s"), F.size(F.array_intersect(F.array_distinct(words), tokens(s))).alias("n")))
    ranked = F.slice(F.array_sort(F.transform(parts, lambda p: F.struct((-p["n"]).alias("n"), p["i"].alias("i")))), 1, best)
    near = F.filter(parts, lambda p: F.exists(ranked, lambda r: F.abs(r["i"] - p["i"]) <= around))
    short = F.size(parts) <= best + 2 * around
    return F.when(short | (F.size(words) == 0), text).otherwise(F.array_join(F.transform(near, lambda p: p["s"]), " "))
