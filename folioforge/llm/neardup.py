"""Problem 6: groups of records that are largely the same text.

Method: MinHash banding. A record's words are the runs of [a-z0-9] of its lower-cased
text and its features all runs of three consecutive words, kept as 64-bit hashes.
``plan_bands`` picks rows a band and the number of bands for the recall wanted at the
threshold; records that share a band hash meet in a shuffle on it and every candidate
pair is checked on the full feature sets.

Scale: records with equal feature sets are one class from the start, so that copies
meet nowhere; hot bands are split into blocks (``pairs_by_key``). Only hashes are
shuffled for banding; feature sets move once for the candidates' check.

Defined results: a null title or abstract counts as empty text; records of fewer than
three words, and records with a null id, are similar to nothing and form a class of
their own. Repeated rows count once. ``similar_pairs`` gives all pairs of records, those
of equal sets too, whatever the size of their group; blocks of a group's members meet in
tasks of their own, and the result grows with the square of a group. ``groups`` is
linear in the records: every record with its class and its number of links.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.plans.components import connected_components
from folioforge.plans.lineage import cut
from folioforge.plans.skew import pairs_by_key
from folioforge.sources.tables import table

RUN = 3


def plan_bands(threshold: float, recall: float, noise: float = 0.06) -> tuple[int, int]:
    """(bands, rows): the plan with recall at ``threshold`` that costs least, counting
    one for each band and the chance, times 10^4, that records of similarity ``noise``
    meet in a band."""
    plans = []
    for rows in range(1, 9):
        bands = max(1, math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows)))
        plans.append((bands * (1 + 1e4 * noise**rows), bands, rows))
    return min(plans)[1:]


def features(records: DataFrame) -> DataFrame:
    """(id, feats): the set of hashed three-word runs of each record (id, text)."""
    # the words are bound as a lambda's variable, else each w[i] would split the text again
    runs = f"transform(sequence(0, size(w) - {RUN}), i -> xxhash64(w[i], w[i + 1], w[i + 2]))"
    empty = "cast(array() as array<bigint>)"
    words = "regexp_extract_all(lower(text), '[a-z0-9]+', 0)"
    one = f"transform(array({words}), w -> if(size(w) < {RUN}, {empty}, array_sort(array_distinct({runs}))))[0]"
    return records.where("text is not null").select("id", F.expr(one).alias("feats"))


def _bands(batches: Iterator[pa.RecordBatch], bands: int, rows: int, seed: int = 11) -> Iterator[pa.RecordBatch]:
    rng = np.random.default_rng(seed)
    n = bands * rows
    mul = rng.integers(1, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    add = rng.integers(0, 2**63, n, dtype=np.uint64)
    mix = rng.integers(1, 2**63, rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    for batch in batches:
        if not batch.num_rows:
            continue
        lists = batch.column("feats")
        x = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
        starts = np.r_[0, np.cumsum(lists.value_lengths().to_numpy())[:-1]].astype(np.int64)
        sig = np.empty((batch.num_rows, n), np.uint64)
        for k in range(n):
            h = x * mul[k] + add[k]
            h ^= h >> np.uint64(29)
            sig[:, k] = np.minimum.reduceat(h, starts)
        keys = (sig.reshape(-1, bands, rows) * mix).sum(axis=2, dtype=np.uint64) + np.arange(bands, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        offsets = np.arange(0, batch.num_rows * bands + 1, bands, dtype=np.int32)
        yield pa.record_batch([batch.column("id"), pa.ListArray.from_arrays(offsets, pa.array(keys.reshape(-1).view(np.int64)))], names=["id", "bands"])


def classes_of(records: DataFrame) -> DataFrame:
    """(id, rep, feats): records with features; rep is the least id with equal ones."""
    f = features(records.where("id is not null").dropDuplicates(["id"])).where("size(feats) > 0")
    f = f.withColumns({"h1": F.xxhash64("feats"), "h2": F.xxhash64(F.lit(3), "feats")})
    reps = f.groupBy("h1", "h2").agg(F.min("id").alias("rep"))
    return f.join(reps.hint("merge"), ["h1", "h2"]).select("id", "rep", "feats")


def representative_pairs(classes: DataFrame, threshold: float, recall: float) -> DataFrame:
    """(a, b, similarity) of class representatives, similarity >= threshold."""
    bands, rows = plan_bands(threshold, recall)
    reps = classes.where("id = rep").select("id", "feats")
    keyed = cut(reps.mapInArrow(lambda it: _bands(it, bands, rows), "id bigint, bands array<bigint>"))
    candidates = pairs_by_key(keyed.select("id", F.explode("bands").alias("band")), "band", "id")
    sides = [reps.select(F.col("id").alias(s), F.col("feats").alias(f"f{s}")) for s in "ab"]
    met = candidates.join(sides[0].hint("merge"), "a").join(sides[1].hint("merge"), "b")
    common = F.size(F.array_intersect("fa", "fb"))
    met = met.select("a", "b", (common / (F.size("fa") + F.size("fb") - common)).alias("similarity"))
    return met.where(F.col("similarity") >= threshold)


def similar_pairs(records: DataFrame, threshold: float = 0.5, recall: float = 0.995) -> DataFrame:
    """(id_a, id_b, similarity), id_a < id_b, of records (id bigint, text string)."""
    classes = cut(classes_of(records.select("id", "text")))
    pairs = representative_pairs(classes, threshold, recall)
    several = classes.groupBy("rep").agg(F.count("*").alias("n")).where("n > 1").select("rep")
    member = classes.select("id", "rep").join(several.hint("merge"), "rep")
    inside = pairs_by_key(member, "rep", "id").select("a", "b", F.lit(1.0).alias("similarity"))
    across = pairs
    for s in "ab":
        across = across.join(member.select(F.col("rep").alias(s), F.col("id").alias(f"m{s}")).hint("merge"), s, "left")
    across = across.select(F.coalesce("ma", "a").alias("a"), F.coalesce("mb", "b").alias("b"), "similarity")
    return across.union(inside).select(F.least("a", "b").alias("id_a"), F.greatest("a", "b").alias("id_b"), "similarity")


def groups(records: DataFrame, threshold: float = 0.5, recall: float = 0.995) -> DataFrame:
    """(id, class_id, links): every record with the least id of its group and the
    number of other texts it is linked to (copies count with their class)."""
    records = records.select("id", "text").where("id is not null")
    classes = cut(classes_of(records))
    pairs = cut(representative_pairs(classes, threshold, recall))
    both = pairs.select("a", "b").union(pairs.select("b", "a"))
    links = both.groupBy(F.col("a").alias("rep")).agg(F.count("*").alias("links"))
    tied = connected_components(pairs).select(F.col("node").alias("rep"), "component")
    known = classes.select("id", "rep").join(tied, "rep", "left").join(links, "rep", "left")
    known = known.select("id", F.coalesce("component", "rep").alias("class_id"), F.coalesce("links", F.lit(0)).alias("links"))
    rest = records.select("id").distinct().join(known.select("id"), "id", "left_anti")
    return known.union(rest.select("id", F.col("id").alias("class_id"), F.lit(0).cast("bigint").alias("links")))


def _papers(spark: SparkSession, folder: str) -> DataFrame:
    papers = table(spark, folder, "papers", "id", "title", "abstract").where("length(abstract) > 0")
    return papers.select("id", F.concat_ws(" ", F.coalesce("title", F.lit("")), "abstract").alias("text"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of papers with abstracts whose similarity is 0.5 or more."""
    return similar_pairs(_papers(spark, folder)).select("id_a", "id_b")


def p6_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Every paper with an abstract, its group and its number of links."""
    return groups(_papers(spark, folder))


QUERIES = {"p6_found": p6_found, "p6_groups": p6_groups}

_PAIRS = """
with recursive p as (
  select distinct id, list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i+1] || ' ' || w[i+2])) as f
  from (select id, regexp_extract_all(lower(coalesce(title, '') || ' ' || abstract), '[a-z0-9]+') as w
        from papers where length(abstract) > 0)),
u as (select id, unnest(f) as x from p),
c as (select a.id as id_a, b.id as id_b, count(*) as n from u a join u b on a.x = b.x and a.id < b.id group by all),
s as (select id_a, id_b from c join p a on a.id = id_a join p b on b.id = id_b
      where n / (len(a.f) + len(b.f) - n) >= 0.5)"""

SQL: dict[str, str] = {
    "p6_found": _PAIRS + " select id_a, id_b from s",
    "p6_groups": _PAIRS
    + """,
e as (select id_a as a, id_b as b from s union all select id_b, id_a from s),
r as (select id as node, id as reach from p union select r.node, e.b from r join e on e.a = r.reach),
t as (select p.id, min(list_sort(f)) as fs from p group by p.id),
d as (select e.a as id, count(distinct y.fs) as links from e join t x on x.id = e.a join t y on y.id = e.b
      where x.fs <> y.fs group by e.a)
select r.node as id, min(r.reach) as class_id, coalesce(any_value(d.links), 0)::bigint as links
from r left join d on d.id = r.node group by r.node""",
}
