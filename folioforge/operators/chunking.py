"""Cutting texts into chunks: word windows, sentence packing, headings, structure."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from folioforge.functions.text import classify_section, importance, sentences, token_estimate


def word_windows(text: Column, size: int = 600, overlap: int = 100) -> Column:
    """Windows of ``size`` words, each starting with the last ``overlap`` of the one
    before; a text of ``size`` words or fewer stays as it is."""
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    # starts go on until a window reaches the end
    many = F.transform(
        F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil((F.size(words) - size) / (size - overlap)).cast("int"))),
        lambda i: F.array_join(F.slice(words, i * (size - overlap) + 1, size), " "),
    )
    return F.when(F.size(words) <= size, F.array(text)).otherwise(many)


def sentence_chunks(text: Column, most: int = 900, overlap: bool = True) -> Column:
    """Sentences packed up to ``most`` estimated tokens; each further chunk starts with
    the last sentence of the one before. One sentence is never split."""
    est = lambda s: F.floor(F.length(s) / 4).cast("int")
    empty = F.filter(F.array(F.lit("")), lambda s: s != "")
    start = F.struct(empty.alias("done"), empty.alias("now"), F.lit(0).alias("n"))

    def step(a: Column, s: Column) -> Column:
        full = (F.size(a["now"]) > 0) & (a["n"] + est(s) > most)
        carry = F.slice(a["now"], -1, 1) if overlap else empty
        carried = est(F.element_at(a["now"], -1)) if overlap else F.lit(0)
        flushed = F.struct(F.concat(a["done"], F.array(F.array_join(a["now"], " "))).alias("done"), F.concat(carry, F.array(s)).alias("now"), (carried + est(s)).alias("n"))
        grown = F.struct(a["done"].alias("done"), F.concat(a["now"], F.array(s)).alias("now"), (a["n"] + est(s)).alias("n"))
        return F.when(full, flushed).otherwise(grown)

    end = lambda a: F.when(F.size(a["now"]) > 0, F.concat(a["done"], F.array(F.array_join(a["now"], " ")))).otherwise(a["done"])
    return F.aggregate(sentences(text), start, step, end)


def markdown_sections(text: Column) -> Column:
    """Array of (name, body) by headings of levels 1 to 3; what precedes the first has
    a null name. Rules, images and link targets leave the body."""
    blocks = F.split(text, r"(?m)(?=^#{1,3}[ \t]+\S)")
    head = r"(?s)^#{1,3}[ \t]+([^\n]+)\n?(.*)$"

    def one(b: Column) -> Column:
        named = b.rlike(r"^#{1,3}[ \t]+\S")
        body = F.when(named, F.regexp_extract(b, head, 2)).otherwise(b)
        for pattern, to in ((r"(?m)^\s*[-*]{3,}\s*$", ""), (r"!\[.*?\]\(.*?\)", ""), (r"\[([^\]]+)\]\([^)]+\)", "$1")):
            body = F.when(named, F.regexp_replace(body, pattern, to)).otherwise(body)
        return F.struct(F.when(named, F.trim(F.regexp_extract(b, head, 1))).alias("name"), F.regexp_replace(body, r"^\s+|\s+$", "").alias("body"))

    return F.filter(F.transform(blocks, one), lambda x: x["name"].isNotNull() | (x["body"] != ""))


#: Forms of headings that part a paper, and of its abstract.
HEADINGS = (
    re.compile(r"^\s*(\d+\.(?:\d+\.?)*)\s+([A-Z][^\n]{2,100})\s*$", re.M),
    re.compile(r"^\s*(\d+\.(?:\d+\.?)*)\s+([A-Z][^\n]{2,80})\n", re.M),
    re.compile(r"^\s*(Abstract|Introduction|Background|Related Work|Methods?|Methodology|Results?|Discussion|Conclusion|References?|Acknowledgements?|Appendix)\s*$", re.M | re.I),
    re.compile(r"^\s*([A-Z][A-Z\s]{3,50})\s*$", re.M),
)
ABSTRACT = re.compile(r"\b(Abstract|ABSTRACT|Summary)\b[:\s]*\n(.{100,3000}?)\n\n", re.S)
#: Tokens of a chunk at most, of Markdown chunks at most, characters kept of references.
MOST, MOST_MARKDOWN, MOST_REFERENCES = 900, 400, 2000


def parse_structure(text: str) -> list[tuple[str, str, str]]:
    """(kind, name, text) of a paper's parts in reading order, references last; kinds are
    title, abstract, section and references. Parts without text are left out."""
    titles = (line.strip() for line in text.split("\n")[:10])
    title = next((t for t in titles if 10 < len(t) < 200), "")
    abstract = m[2].strip() if (m := ABSTRACT.search(text)) else ""
    # where each heading stands; of forms that fit at one place the last names it
    marks = {m.start(): m[0].strip() for form in HEADINGS for m in form.finditer(text)}
    bounds = [*sorted(marks), len(text)]
    spans = {(a, marks[a]): text[a:b].strip().partition("\n")[2].strip() for a, b in zip(bounds, bounds[1:], strict=False)}
    of_kind = {k: [("references" if k else "section", name, body) for (_, name), body in spans.items() if name.lower().startswith("reference") == k] for k in (False, True)}
    sections, references = of_kind[False], of_kind[True][-1:]
    if not sections and not abstract:
        sections = [("section", "Main Content", text.replace(title, "", 1).strip() if title else text)]
    parts = [("title", "title", title), ("abstract", "Abstract", abstract), *sections, *references]
    return [p for p in parts if p[2]]


def _structures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [(i, n, *part) for i, t in zip(b.column("id").to_pylist(), b.column("text").to_pylist(), strict=True) for n, part in enumerate(parse_structure(t))]
        if rows:
            ids, parts, *texts = zip(*rows, strict=True)
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(parts, pa.int32()), *map(pa.array, texts)], names=["id", "part", "kind", "name", "body"])


def structure(texts: DataFrame) -> DataFrame:
    """(id, part, kind, name, body) of texts (id, text): one row for each part of the paper."""
    return texts.select("id", "text").where("id is not null and text is not null").mapInArrow(_structures, "id bigint, part int, kind string, name string, body string")


def _numbered(parts: DataFrame, pieces: Column) -> DataFrame:
    """(id, chunk_index, chunk_type, section, text, importance) of parts (id, part,
    chunk_type, section) and the pieces of each. A text's parts are few, and its chunks
    are numbered by how many pieces the parts before it have."""
    p = parts.withColumn("pieces", pieces).withColumn("before", F.coalesce(F.sum(F.size("pieces")).over(W.partitionBy("id").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    flat = p.select("id", "before", "chunk_type", "section", F.posexplode("pieces").alias("i", "text"))
    return flat.select("id", (F.col("before") + F.col("i")).cast("int").alias("chunk_index"), "chunk_type", "section", "text", importance(F.col("chunk_type")).alias("importance"))


def hybrid_chunks(texts: DataFrame, most: int = MOST) -> DataFrame:
    """Chunks of texts (id, text) by structure: the title, the abstract, the sections by
    sentences, the beginning of the references."""
    kind, body = F.col("kind"), F.col("body")
    parts = structure(texts).withColumn("chunk_type", F.when(kind == "section", classify_section(F.col("name"))).when(kind == "references", "reference").otherwise(kind))
    parts = parts.withColumn("section", F.when(kind == "references", "References").when(kind != "title", F.col("name")))
    whole = (kind == "title") | ((kind == "abstract") & (token_estimate(body, 0) <= most))
    pieces = F.when(whole, F.array(body)).when(kind == "references", F.array(F.substring(body, 1, MOST_REFERENCES))).otherwise(sentence_chunks(body, most))
    return _numbered(parts, pieces)


def markdown_chunks(texts: DataFrame, most: int = MOST_MARKDOWN) -> DataFrame:
    """Chunks of Markdown texts (id, text) by heading and sentence; a text of headings
    only is cut as it is."""
    named = texts.select("id", F.posexplode(markdown_sections(F.col("text"))).alias("part", "x")).select("id", "part", F.col("x.name").alias("section"), F.col("x.body").alias("body")).where("body <> ''")
    bare = texts.where(F.col("text").rlike(r"\S")).join(named.select("id").distinct(), "id", "left_anti")
    parts = named.unionByName(bare.select("id", F.lit(0).alias("part"), F.lit(None).cast("string").alias("section"), F.col("text").alias("body")))
    parts = parts.withColumn("chunk_type", F.when(F.col("section").isNull(), "paragraph").otherwise(classify_section(F.col("section"))))
    return _numbered(parts, sentence_chunks(F.col("body"), most))


def chunks_by(strategy: str, texts: DataFrame) -> DataFrame:
    """Chunks of texts (id, text) by a strategy: structure or hybrid, sentence, simple."""
    if strategy in ("structure", "hybrid"):
        return hybrid_chunks(texts)
    cut = {"sentence": lambda t: sentence_chunks(t, MOST), "simple": word_windows}.get(strategy)
    if cut is None:
        raise ValueError("strategy is one of structure, hybrid, sentence, simple")
    parts = texts.where(F.col("text").rlike(r"\S")).select("id", F.lit(0).alias("part"), F.lit("paragraph").alias("chunk_type"), F.lit(None).cast("string").alias("section"), "text")
    return _numbered(parts, cut(F.col("text")))


def chunk_hash(text: Column) -> Column:
    return F.sha2(text, 256)


__all__ = ["chunk_hash", "chunks_by", "hybrid_chunks", "markdown_chunks", "markdown_sections", "sentence_chunks", "structure", "token_estimate", "word_windows"]
