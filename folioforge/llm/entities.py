"""Problem 4: matching citations to papers without a common key.

Method: the q-grams of each attribute are encoded as a fixed vector of 512 bits. Close
title vectors are found exactly by multi-index hashing: a vector is cut into six
chunks, and two vectors at most 11 bits apart have a chunk in which they differ by one
bit or none. A chunk's bits are folded by exclusive or to a key, which keeps a
difference of one bit at one bit or less, so that the keys of one side, and of the
other with every bit flipped once, meet in a plain equi-join. A sketch of each vector
goes with its keys, and pairs whose sketches alone are further apart than the radius are
left out where they meet: no close pair can be lost by it. Cut-off titles are looked
up by vectors of beginnings of fixed lengths, titles without their second part by
vectors of the first (both up to 5 bits, for which equal keys suffice). Pairs so found
are compared by Dice scores of titles and authors and by years; a latent-class model
(expectation maximisation over the counts of score patterns) turns the weighted scores
into the confidence that the pair is a match. A citation keeps its best paper if the
confidence reaches one half. A cited title with words of which none is like any word of
the paper's title says more than the title and is another work.

Scale: vectors are made once for each distinct title, and equal vectors meet once, so
that beginnings shared by many titles are one entry of the join. Keys are eight-byte
numbers. The joins of keys and vectors are sort-merge joins by hint: keys compress so
well that their measured size would make the planner broadcast them. Titles are spread
by their number, not their bytes, before they are encoded. What comes to the driver is
one row for each score pattern, of which there are at most 125.

Defined results: a null or blank title matches nothing; null authors or years neither
support nor contradict. Repeated rows count once; equal scores go to the smallest
paper id. Rows with null ids are no records. Empty tables give no matches.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F

from folioforge.llm.names_text import author_names, fold, plain_words
from folioforge.plans.lineage import cut
from folioforge.plans.skew import spread
from folioforge.sources.tables import table

BITS, CHUNKS, KEY = 512, 6, 32
#: Bits of a chunk; the last one has what is left.
CHUNK = -(-BITS // CHUNKS)
RADIUS, RADIUS_EXACT = 11, 5
#: Kinds of title vectors: whole, first part, beginnings of so many characters.
WHOLE, FIRST, BEGINNINGS = 0, 1, (20, 26, 32, 38, 44, 50, 56, 62, 68)
#: Letters in words of a cited title that the paper's lacks, from which it is another work.
SURPLUS = 5

_NOTE = re.compile(r"\s*(?:\[[^\[\]]*\]|\((?:in |to |submitted|preprint|forthcoming|accepted|unpublished|under)[^()]*\)|,?\s*(?:in press|forthcoming|to appear|submitted|preprint|unpublished))\s*\.?\s*$", re.I)
_VENUE = re.compile(r"^(.{12,}?\w[\"'”’)\]]*)[.!?]+[\"'”’]*\s+((?:[A-Z][\w&-]*\s+)(?:(?:of|on|in|the|and|for|&|[A-Z][\w-]*)\s*){1,7})\.?$")
_CUT = re.compile(r"\s*(?:\.\.\.|…)\s*$")


@lru_cache(1 << 18)
def _word_vector(word: str) -> int:
    """Bits of the padded two-letter grams of a word."""
    x, v = f"^{word}$", 0
    for i in range(len(x) - 1):
        v |= 1 << zlib.crc32(x[i : i + 2].encode()) % BITS
    return v


def encode(words: list[str]) -> int:
    v = 0
    for w in words:
        v |= _word_vector(w)
    return v


def _beginning(words: list[str], size: int) -> list[str]:
    return " ".join(words)[:size].split()


def paper_variants(title: str) -> list[tuple[int, int]]:
    """(kind, vector) under which a paper's title is filed."""
    words = plain_words(title)
    out = [(WHOLE, encode(words))]
    parts = re.split(r"[:?]\s+|\s+-\s+", title, maxsplit=1)
    if len(parts) == 2 and len(plain_words(parts[0])) >= 3:
        out.append((FIRST, encode(plain_words(parts[0]))))
    length = len(" ".join(words))
    return out + [(2 + i, encode(_beginning(words, n))) for i, n in enumerate(BEGINNINGS) if length > n]


def without_notes(title: str) -> tuple[str, bool]:
    """A cited title without quotes, notes and venue; whether a venue stood there."""
    t = _NOTE.sub("", title.strip()).strip()
    venue = _VENUE.match(t)
    if venue and not venue[2].isupper():
        t = venue[1]
    else:
        venue = None
    t = _NOTE.sub("", t.strip("\"'“”‘’ ")).strip()
    return t.strip("\"'“”‘’ "), bool(venue)


def citation_variants(title: str) -> list[tuple[int, int]]:
    """(kind, vector) under which a cited title is looked up."""
    t, venue = without_notes(title)
    stem = _CUT.sub("", t)
    words = plain_words(stem)
    out = []
    length = len(" ".join(words))
    if stem == t:
        v = encode(words)
        out += [(WHOLE, v), (FIRST, v)]
        if plain_words(title) != words:
            out.append((WHOLE, encode(plain_words(title))))
    if stem != t or venue:
        fitting = [i for i, n in enumerate(BEGINNINGS) if n <= length]
        if fitting:
            out.append((2 + fitting[-1], encode(_beginning(words, BEGINNINGS[fitting[-1]]))))
    return out


def _alike(a: str, b: str) -> bool:
    """Whether one word may be the other mistyped: by grams, or by letters in another order."""
    if word_dice(a, b) >= 0.5:
        return True
    common = sum((Counter(a) & Counter(b)).values())
    return abs(len(a) - len(b)) < 3 and 2 * common >= 0.75 * (len(a) + len(b))


def surplus(cited: str, written: str) -> int:
    """Letters of the cited title's words, notes and venue aside, for which the paper's
    title has none: equal words are paired first, then those that may be mistyped. Of a
    cut-off title the last word may be a beginning."""
    t = without_notes(cited)[0]
    stem = _CUT.sub("", t)
    words, known = plain_words(stem), plain_words(written)
    last = words.pop() if stem != t and words else ""
    free, have = Counter(known), Counter(words)
    free, odd = free - have, have - free
    if last and not any(k.startswith(last) for k in free):
        odd[last] += 1
    run, extra = "".join(known), 0
    for w in odd.elements():
        near = next((k for k in free if _alike(w, k)), None)
        if near:
            free -= Counter([near])
        elif w not in have.keys() & set(known) and w not in run:  # else said twice, or parted by a wrong blank
            extra += len(w)
    return extra


def _longs(v: int) -> list[int]:
    return [x - (1 << 64) if x >= 1 << 63 else x for x in ((v >> s) & (2**64 - 1) for s in range(0, BITS, 64))]


def _fold(chunk: int) -> int:
    key = 0
    while chunk:
        key ^= chunk & ((1 << KEY) - 1)
        chunk >>= KEY
    return key


def _keys(kind: int, v: int) -> list[int]:
    """One key for each chunk: kind, chunk and the chunk's bits folded."""
    return [(kind << 52) | (c << 48) | _fold((v >> c * CHUNK) & ((1 << CHUNK) - 1)) for c in range(CHUNKS)]


_ONE = pa.struct([("kind", pa.int32()), ("v", pa.list_(pa.int64())), ("keys", pa.list_(pa.int64()))])
_TITLE = "cls bigint, variants array<struct<kind int, v array<bigint>, keys array<bigint>>>"


def _encode_titles(batches: Iterator[pa.RecordBatch], cited: bool) -> Iterator[pa.RecordBatch]:
    variants = citation_variants if cited else paper_variants
    for batch in batches:
        if batch.num_rows:
            made = [
                [{"kind": k, "v": _longs(v), "keys": _keys(k, v)} for k, v in dict.fromkeys(variants(t)) if v]
                for t in batch.column("title").to_pylist()
            ]
            yield pa.record_batch([batch.column("cls"), pa.array(made, pa.list_(_ONE))], names=["cls", "variants"])


def _distance(a: str, b: str) -> str:
    return " + ".join(f"bit_count({a}[{i}] ^ {b}[{i}])" for i in range(BITS // 64))


def _ones(a: str) -> str:
    return " + ".join(f"bit_count({a}[{i}])" for i in range(BITS // 64))


#: A vector's number of ones, above its 32-bit pieces folded by exclusive or.
_XOR = " ^ ".join(f"v[{i}]" for i in range(BITS // 64))
SKETCH = f"shiftleft(cast({_ones('v')} as bigint), 32) | (({_XOR}) ^ shiftrightunsigned({_XOR}, 32)) & 4294967295L"
#: No more than the distance of the vectors: neither changes by more than one for a bit that differs.
SKETCH_DISTANCE = "greatest(abs(shiftright(cs, 32) - shiftright(ps, 32)), bit_count((cs ^ ps) & 4294967295L))"


def close_titles(cited: DataFrame, papers: DataFrame) -> DataFrame:
    """(ccls, pcls, title): pairs of title classes within the radius and their best Dice,
    for encoded titles (cls, variants) of either side."""
    sides = {}
    for s, d in (("c", cited), ("p", papers)):
        flat = d.select("cls", F.explode("variants").alias("x")).select("cls", "x.*")
        flat = flat.withColumn("vid", F.xxhash64("kind", "v"))
        owners = flat.select(F.col("cls").alias(f"{s}cls"), F.col("vid").alias(f"{s}vid"))
        sides[s] = owners, flat.groupBy("vid").agg(F.first("kind").alias("kind"), F.first("v").alias("v"), F.first("keys").alias("keys"))
    (co, cv), (po, pv) = sides["c"], sides["p"]
    flips = f"concat(keys, flatten(transform(keys, k -> transform(sequence(0, {KEY - 1}), b -> k ^ shiftleft(1L, b)))))"
    sketch = lambda s: F.expr(SKETCH).alias(f"{s}s")
    filed = pv.select(F.col("vid").alias("pvid"), sketch("p"), F.explode(F.when(F.col("kind") == WHOLE, F.expr(flips)).otherwise(F.col("keys"))).alias("key"))
    asked = cv.select(F.col("vid").alias("cvid"), sketch("c"), F.explode("keys").alias("key"))
    met = asked.join(filed.hint("merge"), "key").where(f"{SKETCH_DISTANCE} <= if(shiftright(key, 52) = {WHOLE}, {RADIUS}, {RADIUS_EXACT})")
    met = met.select("cvid", "pvid").distinct()
    met = met.join(cv.select(F.col("vid").alias("cvid"), "kind", F.col("v").alias("cv")).hint("merge"), "cvid")
    met = met.join(pv.select(F.col("vid").alias("pvid"), F.col("v").alias("pv")).hint("merge"), "pvid")
    met = met.withColumn("d", F.expr(_distance("cv", "pv"))).where(F.col("d") <= F.when(F.col("kind") == WHOLE, RADIUS).otherwise(RADIUS_EXACT))
    # both vectors' ones are their common ones twice and the differing ones once
    ones = F.expr(f"{_ones('cv')} + {_ones('pv')}")
    close = met.select("cvid", "pvid", ((ones - F.col("d")) / ones).alias("title"))
    owned = close.join(co.hint("merge"), "cvid").join(po.hint("merge"), "pvid")
    return owned.groupBy("ccls", "pcls").agg(F.max("title").alias("title"))


@lru_cache(1 << 18)
def word_dice(a: str, b: str) -> float:
    if a == b:
        return 1.0
    x, y = _word_vector(a), _word_vector(b)
    return 2 * (x & y).bit_count() / (x.bit_count() + y.bit_count())


def people(cited: str | None, written: str | None) -> float | None:
    """How well the cited names are found among the written: the mean over the cited
    of the best share of long words in common, by Dice of the words' vectors."""
    a, b = ([x for n in author_names(f) if (x := re.findall(r"[^\W\d_]{3,}", fold(n)))] for f in (cited, written))
    if not a or not b:
        return None
    shares = []
    for x in a:
        best = 0.0
        for y in b:
            few, many = (x, y) if len(x) <= len(y) else (y, x)
            hits = [d for w in few if (d := max(word_dice(w, v) for v in many)) >= 0.6]
            best = max(best, sum(hits) / len(few))
        shares.append(best)
    return sum(shares) / len(shares)


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds ``shared``, how far the people agree; titles that say more are left out."""
    for batch in batches:
        if batch.num_rows:
            batch = batch.filter(pa.array([surplus(c, p) < SURPLUS for c, p in zip(batch.column("ct").to_pylist(), batch.column("pt").to_pylist(), strict=True)], pa.bool_()))
            found = [people(c, p) for c, p in zip(batch.column("ca").to_pylist(), batch.column("pa").to_pylist(), strict=True)]
            yield batch.drop_columns(["ca", "pa", "ct", "pt"]).append_column("shared", pa.array(found, pa.float64()))


def _level(value: Column, *bounds: float) -> Column:
    """0 below the first bound, 1 below the second, ..."""
    out = F.lit(len(bounds))
    for i in reversed(range(len(bounds))):
        out = F.when(value < bounds[i], i).otherwise(out)
    return out


def calibrate(patterns: list[tuple[int, ...]], counts: list[int], rounds: int = 100) -> np.ndarray:
    """Posterior of a match for each pattern, by expectation maximisation of two
    classes whose fields are independent. Level -1 of a field says nothing. The start:
    the higher the levels, the likelier a match."""
    x, n = np.array(patterns), np.array(counts, float)
    fields = x.shape[1]
    top = x.max(axis=0)
    score = np.where(x < 0, 0.5, x / np.maximum(top, 1)).mean(axis=1)
    post = 1 / (1 + np.exp(-12 * (score - 0.65)))
    for _ in range(rounds):
        prior = ((post * n).sum() + 1) / (n.sum() + 2)
        logit = np.full(len(x), np.log(prior / (1 - prior)))
        for f in range(fields):
            levels = range(top[f] + 1)
            m = np.array([(post * n)[x[:, f] == v].sum() + 0.5 for v in levels])
            u = np.array([((1 - post) * n)[x[:, f] == v].sum() + 0.5 for v in levels])
            weight = np.log(m / m.sum()) - np.log(u / u.sum())
            logit += np.where(x[:, f] < 0, 0, weight[np.maximum(x[:, f], 0)])
        new = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        if np.abs(new - post).max() < 1e-9:
            break
        post = new
    return post


def match(cited: DataFrame, papers: DataFrame, least: float = 0.5) -> DataFrame:
    """(citation_id, paper_id, confidence) for cited (id, title, authors, year) and
    papers (id, title, authors, year): at most one paper for each citation."""
    spark = cited.sparkSession
    cited, papers = (d.select("id", "title", "authors", F.col("year").cast("int").alias("year")).where("id is not null and title is not null") for d in (cited, papers))
    sides = []
    for d, is_cited in ((cited, True), (papers, False)):
        titles = d.groupBy("title").agg(F.min("id").alias("cls"))
        rows = spread(titles.select("cls", "title"), d.count())
        encoded = cut(rows.mapInArrow(lambda it, c=is_cited: _encode_titles(it, c), _TITLE))
        records = d.join(titles.hint("merge"), "title").groupBy("cls", "title", "authors", "year").agg(F.min("id").alias("rid"))
        sides.append((titles, encoded, records))
    (ct, ce, cr), (_, pe, pr) = sides
    near = close_titles(ce, pe)
    for s, r in (("c", cr), ("p", pr)):
        r = r.select(F.col("cls").alias(f"{s}cls"), F.col("rid").alias(f"{s}rid"), F.col("title").alias(f"{s}t"), F.col("authors").alias(f"{s}a"), F.col("year").alias(f"{s}y"))
        near = near.join(r.hint("merge"), f"{s}cls")
    near = near.select("crid", "prid", "title", "cy", "py", "ca", "pa", "ct", "pt")
    pairs = near.mapInArrow(_compared, "crid bigint, prid bigint, title double, cy int, py int, shared double")
    shared = F.col("shared")
    # a year of one or two digits has lost its century
    apart = F.abs(F.col("cy") - F.when(F.col("cy") < 100, F.col("py") % 100).otherwise(F.col("py")))
    pairs = pairs.select(
        "crid", "prid", "title", F.coalesce(shared, F.lit(0.5)).alias("people"), F.coalesce(-apart, F.lit(-2)).alias("when"),
        _level(F.col("title"), 0.85, 0.92, 0.96, 0.99).alias("t"),
        F.when(shared.isNull(), -1).otherwise(_level(shared, 0.3, 0.55, 0.8)).alias("a"),
        F.when(apart.isNull(), -1).otherwise(F.when(apart == 0, 3).when(apart == 1, 2).when(apart < 5, 1).otherwise(0)).alias("y"),
    )
    pairs = cut(pairs)
    # at most 5 x 5 x 5 patterns
    counts = pairs.groupBy("t", "a", "y").count().collect()
    if not counts:
        return spark.createDataFrame([], "citation_id bigint, paper_id bigint, confidence double")
    patterns = [(r["t"], r["a"], r["y"]) for r in counts]
    post = calibrate(patterns, [r["count"] for r in counts])
    weights = spark.createDataFrame([(*p, float(c)) for p, c in zip(patterns, post, strict=True)], "t int, a int, y int, confidence double")
    scored = pairs.join(F.broadcast(weights), ["t", "a", "y"]).where(F.col("confidence") >= least)
    best = W.partitionBy("crid").orderBy(F.desc("confidence"), F.desc("title"), F.desc("people"), F.desc("when"), "prid")
    chosen = scored.withColumn("n", F.row_number().over(best)).where("n = 1").select("crid", "prid", "confidence")
    # back to every citation of the same title, authors and year
    same = cited.join(ct.hint("merge"), "title").select(F.col("id").alias("citation_id"), "cls", "authors", "year").distinct()
    rids = cr.select("cls", F.col("authors").alias("au"), F.col("year").alias("yr"), F.col("rid").alias("crid")).join(chosen.hint("merge"), "crid")
    on = (F.col("same.cls") == F.col("r.cls")) & F.col("authors").eqNullSafe(F.col("au")) & F.col("year").eqNullSafe(F.col("yr"))
    return same.alias("same").join(rids.alias("r"), on).select("citation_id", F.col("prid").alias("paper_id"), "confidence").distinct()


def _matches(spark: SparkSession, folder: str) -> DataFrame:
    cited = table(spark, folder, "citations").select("id", F.col("cited_title").alias("title"), F.col("cited_authors").alias("authors"), F.col("cited_year").alias("year"))
    return match(cited, table(spark, folder, "papers", "id", "title", "authors", "year"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Citations and the papers of the library that they describe."""
    return _matches(spark, folder).select("citation_id", "paper_id")


def p4_confidence(spark: SparkSession, folder: str) -> DataFrame:
    """The same with the confidence of each match."""
    return _matches(spark, folder)


QUERIES = {"p4_found": p4_found, "p4_confidence": p4_confidence}
SQL: dict[str, str] = {}
