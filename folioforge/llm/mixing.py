"""Problem 9: mixing sources to target weights.

Method: weighted fair queueing. Each source's documents stand in shuffled order, pass
after pass; a document's virtual finish time is its source's tokens up to and including
it, divided by the source's weight. All documents are range-sorted by that time and the
order is truncated at the total budget, at which each source has given its weight's
share to within one document. Into the room so left one later document of the source,
the largest that fits, is taken.

The budget, where none is given, is the largest that every source can meet within its
``max_repeats``: the least of max_repeats x tokens / weight.

Scale: texts are tokenised once; the cumulative sums run over (source, pass, shuffle
key, id, tokens) as range partitions (``running_total``), so a source with a third of
all documents spans many tasks. Only the budget, one number, comes to the driver.
Sources are joined to documents by a join whose side the planner may broadcast after
measuring it; passes beyond those needed are not made.

Defined results: documents of unlisted or null sources, and with null ids, take no
part. Targets with a null source, no positive weight or no positive max_repeats are
void, and of several targets for one source the weights add up and the largest
max_repeats holds. Weights are scaled to sum 1 over targets that have tokens; a target
without tokens has share 0. A null max_repeats means 1. Repeated rows count once. No
targets or no documents give an empty mix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.llm.tokens import VOCABULARY, with_tokens
from folioforge.plans.lineage import cut
from folioforge.plans.running import running_total
from folioforge.sources.tables import table


def _targets(targets: DataFrame) -> DataFrame:
    t = targets.select("source", "weight", F.coalesce("max_repeats", F.lit(1)).alias("max_repeats"))
    t = t.where("source is not null and weight > 0 and max_repeats > 0 and not isnan(weight)").distinct()
    return t.groupBy("source").agg(F.sum("weight").alias("weight"), F.max("max_repeats").alias("max_repeats"))


def mix(documents: DataFrame, targets: DataFrame, budget: int | None = None, *, seed: int = 17, vocabulary: str = VOCABULARY) -> tuple[DataFrame, DataFrame]:
    """(mixed, shares) for documents (id, source, text) and targets (source, weight,
    max_repeats). mixed: (id, source, pass, tokens, finish), in the order of finish;
    shares: a row for each target: (source, weight, docs, most_used, tokens, share)."""
    t = _targets(targets)
    docs = documents.select("id", "source", "text").where("id is not null").join(t.select("source"), "source", "left_semi")
    sized = with_tokens(docs.select("id", "source", "text"), vocabulary)
    sized = cut(sized.groupBy("id", "source").agg(F.max("tokens").alias("tokens")))
    have = sized.groupBy("source").agg(F.sum("tokens").alias("held")).where("held > 0")
    t = cut(t.join(have, "source", "left"))
    whole = t.where("held > 0").agg(F.sum("weight")).first()[0] or 1.0
    t = t.withColumn("w", F.col("weight") / F.lit(whole))
    reach = t.where("held > 0").agg(F.min(F.col("max_repeats") * F.col("held") / F.col("w"))).first()[0] or 0.0
    total = reach if budget is None else min(float(budget), reach)
    plan = t.where("held > 0").select("source", "w", F.least("max_repeats", F.ceil(F.col("w") * total / F.col("held"))).cast("int").alias("passes"))
    queue = sized.join(plan, "source").withColumn("pass", F.explode(F.expr("sequence(1, greatest(1, passes))")))
    queue = queue.select("id", "source", "pass", "tokens", "w", F.xxhash64(F.lit(seed), "pass", "id").alias("shuffle"))
    queue = running_total(queue, ["source"], ["pass", "shuffle", "id"], "tokens", "upto")
    queue = queue.withColumn("finish", F.col("upto") / F.col("w"))
    queue = cut(queue.select("id", "source", "pass", "tokens", "finish", "w"))
    head = queue.where(F.col("finish") <= total * (1 + 1e-12))
    # the document that straddles the budget leaves room; the largest later one that fits takes it
    room = plan.select("source", "w").join(head.groupBy("source").agg(F.sum("tokens").alias("used")), "source", "left")
    room = room.select("source", (F.col("w") * total - F.coalesce("used", F.lit(0))).alias("room"))
    later = queue.where(F.col("finish") > total * (1 + 1e-12)).join(room, "source").where("tokens > 0 and tokens <= room")
    later = later.groupBy("source").agg(F.max(F.struct("tokens", -F.col("id"), "pass")).alias("x"))
    extra = later.select((-F.col("x.col2")).alias("id"), "source", "x.pass", "x.tokens", F.lit(float(total)).alias("finish"))
    mixed = cut(head.drop("w").unionByName(extra))
    given = mixed.groupBy("source").agg(F.count("*").alias("docs"), F.max("pass").alias("most_used"), F.sum("tokens").alias("given"))
    everything = mixed.agg(F.sum("tokens")).first()[0] or 0
    zero = F.lit(0)
    shares = t.join(given, "source", "left").select(
        "source", "weight", F.coalesce("docs", zero).alias("docs"), F.coalesce("most_used", zero).alias("most_used"),
        F.coalesce("given", zero).alias("tokens"), (F.coalesce("given", zero) / F.lit(max(everything, 1))).alias("share"),
    )
    return mixed.orderBy("finish", "source", "id"), shares


def _mix(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    documents = table(spark, folder, "documents").select(F.col("doc_id").alias("id"), "source", "text")
    return mix(documents, table(spark, folder, "mix_targets"))


def p9_mix(spark: SparkSession, folder: str) -> DataFrame:
    """The mixed documents in order, as (doc_id, source, pass, tokens, finish)."""
    return _mix(spark, folder)[0].withColumnRenamed("id", "doc_id")


def p9_shares(spark: SparkSession, folder: str) -> DataFrame:
    """The shares reached by each source listed in mix_targets."""
    return _mix(spark, folder)[1]


QUERIES = {"p9_mix": p9_mix, "p9_shares": p9_shares}
SQL: dict[str, str] = {}
