"""Problem 3: linking the spellings of names that people typed.

Method: the distinct words of all spellings meet in what is left of them without one
letter: words one edit apart share such a rest, whatever the edit, and few others do, so
that the number of words compared follows the number of words. Whether two that meet are
one edit apart is asked where they meet, before any pair is shuffled. A word
that is much rarer than a similar one is read as a misspelling of it. Spellings that agree
in a rare word (the family name, a group's place) are then verified by soft weighted
word similarity, in which each word weighs by its rarity and initials, short forms and
nicknames count as given names they can stand for; a spelling that only has initials
joins the one person they fit, or the one that clearly prevails.

People whose family names are one edit apart and whose given names agree are one
person, since a misspelling may be copied as often as the name itself.

Scale: work is on distinct spellings and words, counted with map-side partial sums.
Nothing is grouped in Python: roles of words, owners of initials and entities come from
joins and aggregates on (family name, given name), and pairs are made in blocks, so
that a family name shared by a third of all people is split over tasks.

Defined results: every spelling has an entity. Spellings that cannot be read as a person's
or a group's name (one word alone, initials alone, more than four long words) are linked
if their words are equal but for case, accents and order. A word of up to three letters is
taken as written, since one edit of it makes another name as often as a misspelling.
Null and empty lists and names give nothing. Repeated rows count once
for weights. Spellings are compared as typed: equal strings are one spelling. An
initial that fits several people about equally well is linked to none of them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioforge.llm.names_text import author_names, fold
from folioforge.plans.components import connected_components
from folioforge.plans.lineage import cut
from folioforge.plans.skew import pairs_by_key
from folioforge.sources.tables import table

#: Nicknames and the given name they stand for.
NICKNAMES = dict(
    x.split(":")
    for x in """
    alex:alexander al:albert andy:andrew ana:anastasia nastya:anastasia stacy:anastasia ben:benjamin benny:benjamin beppe:giuseppe peppe:giuseppe pino:giuseppe beth:elizabeth betty:elizabeth eliza:elizabeth
    lisa:elizabeth liz:elizabeth lizzie:elizabeth bill:william billy:william will:william willy:william bob:robert bobby:robert rob:robert robbie:robert bert:robert cathy:katherine kate:katherine kathy:katherine katie:katherine kit:katherine kitty:katherine
    chris:christopher topher:christopher dan:daniel danny:daniel dave:david dick:richard rick:richard rich:richard dima:dmitri mitya:dmitri ed:edward eddie:edward ned:edward ted:theodore teddy:theodore theo:theodore
    fred:frederick freddy:frederick freddie:frederick gabi:gabriela gabby:gabriela gaby:gabriela greg:gregory hannes:johannes hans:johannes jan:johannes jack:john jenny:jennifer jen:jennifer jenn:jennifer jim:james jimmy:james joe:joseph
    josie:josephine jo:josephine josefine:josephine jorgito:jorge lena:magdalena magda:magdalena leni:magdalena leo:leonard len:leonard lenny:leonard lou:louis lucy:lucia luz:lucia maggie:margaret meg:margaret peggy:margaret peg:margaret greta:margaret marge:margaret matt:matthew mat:mateus
    mike:michael mick:michael mickey:michael misha:mikhail nick:nicholas nicky:nicholas nico:nicholas klaus:nicholas paco:francisco pancho:francisco fran:francisco frank:francis pat:patricia patty:patricia tricia:patricia trish:patricia pete:peter quin:quentin ron:ronald
    sam:samuel sammy:samuel sasha:alexander sandy:alexander sanya:alexander steve:stephen sue:susanne susi:susanne sanne:susanne susie:susanne tom:thomas tommy:thomas tomek:tomasz tony:anthony val:valeria lera:valeria vicky:victoria vic:victoria tori:victoria vika:victoria vik:vikram
    olya:olga oxana:oksana ksyusha:oksana ulli:ulrike uli:ulrike rike:ulrike henk:henrik hiro:hiroshi inga:ingrid zeyno:zeynep
    """.split()
)
#: Words that make a name a group's, by the form they are brought to.
GROUP_WORDS = dict(
    x.split(":")
    for x in """
    institute:institute inst:institute institut:institute laboratory:laboratory lab:laboratory labs:laboratory laboratories:laboratory consortium:consortium consort:consortium cons:consortium collaboration:collaboration collab:collaboration coll:collaboration
    group:group grp:group working:working wg:working centre:centre center:centre ctr:centre team:team network:network net:network project:project proj:project university:university univ:university society:society soc:society association:association assoc:association
    department:department dept:department committee:committee alliance:alliance foundation:foundation council:council initiative:initiative survey:survey observatory:observatory
    """.split()
)
SMALL_WORDS = frozenset("the of for and in on at".split())
PARTICLES = frozenset("van der den de la von vom zu zum al el bin ibn di da del della dos du le ter ten y".split())

_ROLE = "spelling string, n bigint, kind string, form string, words array<string>, initials array<string>, short array<string>"


def read_name(spelling: str) -> tuple[str, str, list[str], list[str], list[str]]:
    """(kind, form, words, initials, short forms) of one spelling.

    kind is group, person or other. For a person form says where the family name
    stands: first or last of ``words`` for certain, either, or alone; words are the
    long ones without particles."""
    plain = fold(spelling).replace("’", "'")
    if any(w in GROUP_WORDS for w in re.findall(r"[a-z]+", plain)) and len(re.findall(r"[^\W_]+", plain)) > 2:
        return "group", "set", [GROUP_WORDS.get(w, w) for w in re.findall(r"[^\W_]+", plain) if w not in SMALL_WORDS], [], []
    before, comma, after = plain.partition(",")
    raw_before = fold_case(spelling).partition(",")[0]

    def parts(text: str, raw: str) -> list[tuple[str, str]]:
        """(type, word) in order: w long word, i initial, s short form, p particle."""
        out = []
        upper = raw.isupper()
        for token in re.findall(r"[^\W\d_][\w'’-]*\.?", raw):
            low = fold(token).rstrip(".")
            low = re.sub(r"^(?:al|el)-", "", low)
            if low in PARTICLES and len(low) > 1 and not token.endswith(".") and (upper or not token.isupper()):
                out.append(("p", low))
            elif len(low) == 1:
                out.append(("i", low))
            elif token.endswith("."):
                out.append(("s", low))
            elif len(low) <= 2 and token.isupper() and not upper or len(low) <= 2 and upper and len(raw.split()) > 1:
                out += [("i", c) for c in low]
            else:
                out.append(("w", low.replace("'", "").replace("-", "")))
        return out

    if comma:
        family, given = parts(before, raw_before), parts(after, fold_case(spelling).partition(",")[2])
        words = [w for t, w in family if t == "w"] + [w for t, w in given if t == "w"]
        form = "first" if any(t == "w" for t, _ in family) else "either"
        rest = given
    else:
        rest = parts(plain, fold_case(spelling))
        words = [w for t, w in rest if t == "w"]
        types = "".join(t for t, _ in rest)
        if len(words) == 1:
            form = "alone"
        elif "p" in types:
            at = types.index("p")
            form = "first" if "w" not in types[:at] else "last"
        elif re.fullmatch(r"w+i+w+|[is]+w+|w[is]+w+", types):
            form = "last"
        else:
            form = "either"
    initials = [w for t, w in rest if t == "i"]
    short = [w for t, w in rest if t == "s"]
    if not words or len(words) > 4:
        return "other", "set", words, initials, short
    return "person", form, words, initials, short


def fold_case(spelling: str) -> str:
    """The spelling with plain letters, its case kept."""
    return "".join(fold(c).upper() if c.isupper() else fold(c) for c in spelling)


def _spellings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names = [n for f in batch.column("field").to_pylist() for n in author_names(f)]
        if names:
            yield pa.record_batch([pa.array(names)], names=["spelling"])


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    strings = pa.list_(pa.string())
    for batch in batches:
        if batch.num_rows:
            read = [read_name(s) for s in batch.column("spelling").to_pylist()]
            cols = [pa.array([r[i] for r in read], pa.string() if i < 2 else strings) for i in range(5)]
            yield pa.record_batch([batch.column("spelling"), batch.column("n"), *cols], names=["spelling", "n", "kind", "form", "words", "initials", "short"])


def within_one_edit(a: str, b: str) -> bool:
    """One letter more, less or other, or two neighbours swapped."""
    if a == b or abs(len(a) - len(b)) > 1:
        return a == b
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    if len(a) == len(b):
        return a[i + 1 :] == b[i + 1 :] or a[i : i + 2] == b[i : i + 2][::-1] and a[i + 2 :] == b[i + 2 :]
    long, few = (a, b) if len(a) > len(b) else (b, a)
    return long[i + 1 :] == few[i:]


#: A word and what is left of it without one of its letters. Words one edit apart share
#: one of these: the longer loses the letter it has more, either loses the letter that
#: differs, or one of the two that are swapped.
LEFT_OF = "array_distinct(concat(array(word), transform(sequence(1, length(word)), i -> concat(substr(word, 1, i - 1), substr(word, i + 1)))))"
#: ``within_one_edit`` of a and b.
ONE_EDIT = "levenshtein(a, b) <= 1 or length(a) = length(b) and exists(sequence(1, length(a) - 1), i -> concat(substr(a, 1, i - 1), substr(a, i + 1, 1), substr(a, i, 1), substr(a, i + 2)) = b)"


def similar_words(words: DataFrame) -> DataFrame:
    """(a, b, na, nb), both ways, of words (word, n) that are one edit apart."""
    words = words.where("length(word) >= 4").select("word", "n")
    left = words.select("word", F.explode(F.expr(LEFT_OF)).alias("left")).select("word", F.xxhash64("left").alias("left"))
    near = cut(pairs_by_key(left, "left", "word", keep=ONE_EDIT))
    for s in "ab":
        near = near.join(words.select(F.col("word").alias(s), F.col("n").alias(f"n{s}")), s)
    near = near.select("a", "b", "na", "nb")
    return near.union(near.select("b", "a", "nb", "na"))


@F.pandas_udf(T.StringType())
def _given(words: pd.Series) -> pd.Series:
    """The given name that a nickname stands for; a literal map would swell every plan."""
    return words.map(lambda w: NICKNAMES.get(w, w), na_action="ignore")


def entities(mentions: DataFrame, much: float = 4.0, share: float = 0.75) -> DataFrame:
    """(spelling, entity) of mentions (field string), a row for each list of names.
    much: how much more frequent a word is than its misspelling; share: the part of
    the mentions that a person must have to get an initial that others fit too."""
    spelt = cut(mentions.where("field is not null").mapInArrow(_spellings, "spelling string").groupBy("spelling").agg(F.count("*").alias("n")))
    read = cut(spelt.mapInArrow(_read, _ROLE))
    words = cut(read.select(F.explode("words").alias("word"), "n").groupBy("word").agg(F.sum("n").alias("n")))
    similar = cut(similar_words(words))
    right = similar.where(F.col("nb") >= much * F.col("na"))
    right = right.groupBy("a").agg(F.max_by("b", F.struct("nb", "b")).alias("b"))
    flat = read.where("kind <> 'other'").select("spelling", F.posexplode("words").alias("at", "word"))
    flat = flat.join(right.withColumnRenamed("a", "word"), "word", "left").select("spelling", F.struct("at", F.coalesce("b", "word").alias("w")).alias("x"))
    fixed = flat.groupBy("spelling").agg(F.expr("transform(array_sort(collect_list(x)), x -> x.w)").alias("words"))
    read = cut(read.drop("words").join(fixed, "spelling"))

    groups = read.where("kind = 'group'").select("spelling", F.concat(F.lit("g|"), F.array_join(F.array_sort(F.array_distinct("words")), " ")).alias("entity"))
    # how often a word stands where a given name, and where a family name, stands for certain
    people = read.where("kind = 'person'")
    sure = people.where("form in ('first', 'last') and size(words) > 1")
    family = F.when(F.col("form") == "first", F.element_at("words", 1)).otherwise(F.element_at("words", -1))
    other = F.when(F.col("form") == "first", F.element_at("words", -1)).otherwise(F.element_at("words", 1))
    roles = sure.select(F.explode(F.array(F.struct(family.alias("w"), F.lit(1).alias("f"), F.lit(0).alias("g")), F.struct(other.alias("w"), F.lit(0).alias("f"), F.lit(1).alias("g")))).alias("x"), "n")
    alone = people.where("form = 'alone' and (size(initials) > 0 or size(short) > 0)").select(F.struct(F.element_at("words", 1).alias("w"), F.lit(1).alias("f"), F.lit(0).alias("g")).alias("x"), "n")
    roles = roles.union(alone).groupBy("x.w").agg(F.sum(F.col("x.f") * F.col("n")).alias("f"), F.sum(F.col("x.g") * F.col("n")).alias("g"))
    leaning = roles.select("w", ((F.col("g") + 1) / (F.col("f") + F.col("g") + 2)).alias("lean"))
    two = people.where("form = 'either' and size(words) > 1").select("spelling", F.element_at("words", 1).alias("w1"), F.element_at("words", -1).alias("w2"))
    half = F.lit(0.5)
    two = two.join(leaning.select(F.col("w").alias("w1"), F.col("lean").alias("l1")), "w1", "left").join(leaning.select(F.col("w").alias("w2"), F.col("lean").alias("l2")), "w2", "left")
    turned = two.select("spelling", (F.coalesce("l2", half) > F.coalesce("l1", half)).alias("turned"))
    people = people.join(turned, "spelling", "left")
    first = (F.col("form") == "first") | F.coalesce("turned", F.lit(False)) | (F.col("form") == "alone")
    people = people.select(
        "spelling", "n", F.when(first, F.element_at("words", 1)).otherwise(F.element_at("words", -1)).alias("family"),
        F.when(F.size("words") > 1, F.when(first, F.element_at("words", 2)).otherwise(F.element_at("words", 1))).alias("given"),
        F.coalesce(F.try_element_at("short", F.lit(1)), F.try_element_at("initials", F.lit(1))).alias("start"),
        F.when(F.size("words") > 1, F.try_element_at("initials", F.lit(1))).otherwise(
            F.when(F.size("short") > 0, F.try_element_at("initials", F.lit(1))).otherwise(F.try_element_at("initials", F.lit(2)))
        ).alias("middle"),
    )
    people = cut(people.withColumn("given", _given("given")))
    named = people.where("given is not null")
    # people of one family and given name are told apart by middle initials, if these differ
    persons = named.groupBy("family", "given").agg(F.sum("n").alias("n"), F.collect_set("middle").alias("middles"))
    full = named.join(persons.select("family", "given", "middles"), ["family", "given"]).select(
        "spelling", "n", "family", "given", F.when(F.size("middles") > 1, F.col("middle")).alias("m")
    )
    known = full.groupBy("family", "given", F.coalesce("m", F.lit("")).alias("m")).agg(F.sum("n").alias("n"))
    known = known.join(persons.select("family", "given", "middles"), ["family", "given"]).select(
        "family", "given", "m", "n", F.when(F.col("m") != "", F.array("m")).otherwise(F.col("middles")).alias("middles")
    )
    entity = lambda g, m: F.concat_ws("|", F.lit("p"), "family", g, m)
    full = full.select("spelling", entity(F.col("given"), F.coalesce("m", F.lit(""))).alias("entity"), "family", "given")
    known = cut(known)
    # initials and short forms: the person of the family whom they fit, if one prevails
    bare = people.where("given is null and start is not null")
    askers = bare.select("family", "start", "middle").distinct()
    # the first letter is a key too, so that a frequent family name is parted
    letter = lambda c: F.substring(c, 1, 1)
    fits = askers.withColumn("c", letter("start")).join(known.withColumn("c", letter("given")), ["family", "c"]).where(
        "startswith(given, start) and (middle is null or size(middles) = 0 or array_contains(middles, middle))"
    )
    exact = F.expr("middle is not null and array_contains(middles, middle)").cast("int")
    mine = W.partitionBy("family", "start", F.coalesce("middle", F.lit("")))
    fits = fits.withColumn("e", exact).withColumn("top", F.max("e").over(mine)).where("e = top")
    fits = fits.withColumn("part", F.col("n") / F.sum("n").over(mine)).where(F.col("part") >= share)
    fits = fits.select("family", "start", F.coalesce("middle", F.lit("")).alias("mi"), entity(F.col("given"), F.col("m")).alias("entity"))
    bare = bare.withColumn("mi", F.coalesce("middle", F.lit(""))).join(fits, ["family", "start", "mi"], "left")
    own = entity(F.concat(F.col("start").substr(1, 1), F.lit("*")), F.lit(""))
    several = F.col("entity").isNull()
    # without a fitting person, initials of one family belong together if no full name contradicts
    rival = known.select("family", F.col("given").substr(1, 1).alias("i")).distinct().withColumn("rival", F.lit(True))
    bare = bare.withColumn("i", F.col("start").substr(1, 1)).join(rival, ["family", "i"], "left")
    alone_ = F.when(F.col("rival"), F.concat(F.lit("s|"), F.col("spelling"))).otherwise(own)
    bare = bare.select("spelling", F.when(several, alone_).otherwise(F.col("entity")).alias("entity"), "family", "i", several.alias("loose"))
    bare = cut(bare)

    # the same person under a misspelt family name: one edit apart, given names that agree
    nodes = full.select("entity", "family", "given").distinct()
    loose = bare.where("loose").select("entity", "family", "i").distinct()
    near = similar.select(F.col("a").alias("family"), F.col("b").alias("other"))
    there = lambda d: d.select(F.col("entity").alias("entity2"), F.col("family").alias("other"), *[F.col(c) for c in d.columns[2:]])
    same = nodes.join(near, "family").join(there(nodes), ["other", "given"]).select(F.col("entity").alias("a"), F.col("entity2").alias("b"))
    same = same.union(loose.join(near, "family").join(there(loose), ["other", "i"]).select("entity", "entity2"))
    # a loose initial takes the people of similar family names that it fits, if they
    # share one given name
    fits = loose.join(near, "family").join(there(nodes), "other").where("startswith(given, i)")
    only = fits.groupBy("entity").agg(F.min("given").alias("x"), F.max("given").alias("y"), F.min("entity2").alias("b")).where("x = y")
    same = cut(same.union(only.select("entity", "b")))
    tied = connected_components(same).select(F.col("node").alias("entity"), "component")
    out = full.select("spelling", "entity").union(bare.select("spelling", "entity")).join(tied, "entity", "left")
    known = cut(groups.union(out.select("spelling", F.coalesce("component", "entity").alias("entity"))))
    words = F.array_sort(F.concat("words", "initials", "short"))
    rest = spelt.mapInArrow(_read, _ROLE).join(known.select("spelling"), "spelling", "left_anti")
    return known.union(rest.select("spelling", F.concat(F.lit("o|"), F.when(F.size(words) > 0, F.array_join(words, " ")).otherwise(F.col("spelling"))).alias("entity")))


def soft_similarity(a: str, b: str, weights: dict[str, float]) -> float:
    """Weighted share of the words of either that find a partner in the other: equal or
    one edit away, by nickname, or by an initial or short form."""
    x, y = read_name(a), read_name(b)

    def tokens(r: tuple) -> list[str]:
        return [*(NICKNAMES.get(w, w) for w in r[2]), *r[3], *r[4]]

    def alike(s: str, t: str) -> float:
        if s == t:
            return 1.0
        if len(s) > 3 and len(t) > 3 and within_one_edit(s, t):
            return 0.9
        few, many = sorted((s, t), key=len)
        return 0.8 if len(few) <= 3 and many.startswith(few) else 0.0

    p, q = tokens(x), tokens(y)
    total = best = 0.0
    for s, others in [(s, q) for s in p] + [(t, p) for t in q]:
        w = weights.get(s, 1.0) if len(s) > 3 else 0.3
        total += w
        best += w * max((alike(s, t) for t in others), default=0.0)
    return best / total if total else 0.0


def _verify(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            cols = [batch.column(c).to_pylist() for c in ("a", "b", "wa", "wb")]
            ok = [soft_similarity(a, b, dict(wa or ()) | dict(wb or ())) >= least for a, b, wa, wb in zip(*cols, strict=True)]
            yield batch.filter(pa.array(ok, pa.bool_())).select(["a", "b"])


def linked_spellings(mentions: DataFrame, least: float = 0.6) -> DataFrame:
    """(name_a, name_b), name_a < name_b: the spellings of one person or group."""
    owners = cut(entities(mentions))
    pairs = pairs_by_key(owners, "entity", "spelling")
    # the weight of a word: the rarer among spellings, the more it counts
    total = owners.count()
    word = F.explode(F.expr("regexp_extract_all(lower(spelling), '[\\\\p{L}]{4,}', 0)")).alias("word")
    flat = owners.select("spelling", word)
    weight = flat.groupBy("word").agg(F.log(F.lit(1.0 + total) / F.count("*")).alias("w"))
    weights = flat.join(weight, "word").groupBy("spelling").agg(F.map_from_entries(F.collect_set(F.struct("word", "w"))).alias("ws"))
    weights, pairs = cut(weights), cut(pairs)
    for s in "ab":
        pairs = pairs.join(weights.select(F.col("spelling").alias(s), F.col("ws").alias(f"w{s}")), s, "left")
    checked = pairs.select("a", "b", "wa", "wb").mapInArrow(lambda it: _verify(it, least), "a string, b string")
    return checked.select(F.col("a").alias("name_a"), F.col("b").alias("name_b"))


def _mentions(spark: SparkSession, folder: str) -> DataFrame:
    papers = table(spark, folder, "papers").select("id", F.col("authors").alias("field"))
    cited = table(spark, folder, "citations").select("id", F.col("cited_authors").alias("field"))
    return papers.distinct().union(cited.distinct()).select("field")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of spellings of the same person or group."""
    return linked_spellings(_mentions(spark, folder))


def p3_entities(spark: SparkSession, folder: str) -> DataFrame:
    """Every spelling with the entity it was linked to."""
    return entities(_mentions(spark, folder))


QUERIES = {"p3_found": p3_found, "p3_entities": p3_entities}
SQL: dict[str, str] = {}
