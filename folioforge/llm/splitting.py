"""Problem 7: splitting oversized texts at natural boundaries.

Method: lexical-cohesion segmentation. Two blocks of words slide over the text; the
cosine of their word counts at each gap is its cohesion, and how far a gap lies below
the peaks on either side is its depth. Pieces are cut from left to right: among the
boundaries of the most natural kind inside the size window the deepest valley is
taken, where there is one past half of the window. Then each piece but the first is
given the end of the piece before as overlap.

Boundaries: a paragraph ends at a blank line; a sentence at . ! or ? before white space
and a capital letter unless an abbreviation stands there; a word at white space. Where
a run without white space exceeds the limit it is cut anywhere, but not before a
combining mark. White space between pieces belongs to none of them.

Scale: rows are split on their own, in Arrow batches, without a shuffle; only rows
above the limit, found by the scan's own filter, reach Python, and only offsets come
back. A piece's number among all of its owner's pieces is a running total.

Defined results: null texts and null ids give no row; a text at the limit is one
piece; a text of white space only has no piece and the boundary "paragraph". Repeated
rows count once. Any length of text is split whole, in time linear in its length.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from unicodedata import combining

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.plans.running import running_total
from folioforge.sources.tables import table

KINDS = ("paragraph", "sentence", "word", "none")
BLOCK = 40
#: Abbreviations after which a full stop ends no sentence.
ABBREVIATIONS = frozenset(
    "al app approx art bsp bzw ca cf ch chap col comp corp dept diff dr ed eds e.g eg eq eqn eqs esp est etc ex fig figs fr gen gov inc i.e ie jr lit ltd max med min mr mrs ms no nos nr op p par pp prof ref refs rep resp rev sec sect sr st suppl tab tel univ viz vol vols vs z.b zit".split()
)

_BLANK = re.compile(r"[^\S\n]*\n(?:[^\S\n]*\n)+\s*")
_STOP = re.compile(r"[.!?]\s+(?=[^\W\d_a-z])")
_SPACE = re.compile(r"\s+")
_WORD = re.compile(r"[^\W\d_]{3,}")
_LAST = re.compile(r"[^\W\d_][\w.]*$")


def _ends_sentence(text: str, stop: int) -> bool:
    if text[stop] != ".":
        return True
    last = _LAST.search(text, max(0, stop - 20), stop)
    return not last or last[0].lower() not in ABBREVIATIONS


def boundaries(text: str) -> list[list[tuple[int, int]]]:
    """For paragraph, sentence and word: (end of content, start of the next) in order."""
    paragraphs = [(m.start(), m.end()) for m in _BLANK.finditer(text)]
    sentences = [
        (m.start() + 1, m.end()) for m in _STOP.finditer(text) if text[m.end()].isupper() and _ends_sentence(text, m.start())
    ]
    words = [(m.start(), m.end()) for m in _SPACE.finditer(text)]
    return [[b for b in kind if 0 < b[0] and b[1] < len(text)] for kind in (paragraphs, sentences, words)]


def cohesion(text: str) -> tuple[list[int], np.ndarray]:
    """Starts of the words, and at the gap before each the cosine of the counts of the
    BLOCK words on either side; updated word by word."""
    found = [(m.start(), m[0].lower()) for m in _WORD.finditer(text)]
    words = [w for _, w in found]
    n = len(words)
    sims = np.ones(n + 1)
    left: Counter = Counter()
    right: Counter = Counter(words[:BLOCK])
    dot, ll, rr = 0, 0, sum(v * v for v in right.values())
    for g in range(1, n):
        w = words[g - 1]  # from right to left
        a, b = left[w], right[w]
        dot += b - a - 1  # (a + 1)(b - 1) - a b
        ll += 2 * a + 1
        rr -= 2 * b - 1
        left[w], right[w] = a + 1, b - 1
        if g + BLOCK - 1 < n:
            w = words[g + BLOCK - 1]
            dot += left[w]
            rr += 2 * right[w] + 1
            right[w] += 1
        if g > BLOCK:
            w = words[g - BLOCK - 1]
            dot -= right[w]
            ll -= 2 * left[w] - 1
            left[w] -= 1
        sims[g] = dot / (ll * rr) ** 0.5 if ll and rr else 1.0
    return [s for s, _ in found], sims


def _deepest(sims: list[float]) -> int:
    """The place of the deepest valley; of equal ones the last."""
    n = len(sims)
    rise = list(sims)  # highest point reached going left without a descent
    for i in range(1, n):
        rise[i] = max(sims[i], rise[i - 1]) if sims[i - 1] >= sims[i] else sims[i]
    fall = list(sims)
    for i in range(n - 2, -1, -1):
        fall[i] = max(sims[i], fall[i + 1]) if sims[i + 1] >= sims[i] else sims[i]
    return max(range(n), key=lambda i: (rise[i] + fall[i] - 2 * sims[i], i))


def split_text(text: str, limit: int = 1200, overlap: int = 100) -> tuple[str, list[tuple[int, int, int]]]:
    """(boundary, pieces): boundary is the least natural kind of cut that was needed;
    a piece is (from, start, end), its text being text[from:end], of which
    text[from:start] repeats the end of the piece before."""
    start = len(text) - len(text.lstrip())
    end = len(text.rstrip())
    if end - start <= limit:
        return KINDS[0], [(start, start, end)] if start < end else []
    kinds = boundaries(text)
    ends = [[b[0] for b in kind] for kind in kinds]
    places, sims = cohesion(text)
    worst, pieces, at, low = 0, [], start, start
    while True:
        # the last piece takes all that is left; its overlap shrinks if it must
        if end - at <= limit:
            pieces.append((max(low, end - limit), at, end))
            return KINDS[worst], pieces
        stop = after = None
        room = limit - (overlap if pieces else 0)
        for rank, kind in enumerate(kinds):
            # past half of the window with full overlap, before that, with less overlap
            for x, y in ((at + room // 2, at + room), (at, at + room), (at + room, at + limit)):
                i, j = bisect_right(ends[rank], x), bisect_right(ends[rank], y)
                if i < j:
                    if j - i > 1:
                        depth = [float(sims[bisect_left(places, b[1])]) for b in kind[i:j]]
                        i += _deepest(depth)
                    stop, after = kind[i]
                    break
            if stop is not None:
                worst = max(worst, rank)
                break
        else:
            worst, stop = 3, at + room
            while stop > at + 1 and combining(text[stop]):
                stop -= 1
            after = stop
        pieces.append((max(low, stop - limit), at, stop))
        # the overlap begins at a word of the last `overlap` characters, where one does
        low = max(at, stop - overlap)
        if low > at and not text[low - 1].isspace():
            i = bisect_left(ends[2], low)
            if i < len(ends[2]) and kinds[2][i][1] < stop:
                low = kinds[2][i][1]
        low = max(low, after - overlap)  # white space between the pieces counts
        at = after


def _split(batches: Iterator[pa.RecordBatch], limit: int, overlap: int) -> Iterator[pa.RecordBatch]:
    piece = pa.struct([("n", pa.int32()), ("lo", pa.int32()), ("start", pa.int32()), ("stop", pa.int32())])
    for batch in batches:
        if not batch.num_rows:
            continue
        kinds, rows = [], []
        for text in batch.column("text").to_pylist():
            kind, pieces = split_text(text, limit, overlap)
            kinds.append(kind)
            rows.append([{"n": i, "lo": a, "start": b, "stop": c} for i, (a, b, c) in enumerate(pieces)])
        yield pa.record_batch([batch.column("id"), pa.array(kinds), pa.array(rows, pa.list_(piece))], names=["id", "boundary", "pieces"])


def split_items(items: DataFrame, limit: int = 1200, overlap: int = 100) -> DataFrame:
    """(id, boundary, pieces) for each of items (id bigint, text string) above the
    limit; pieces array<struct<n, lo, start, stop>> are offsets in characters."""
    if not 0 <= overlap < limit // 2:
        raise ValueError("the overlap must be less than half of the limit")
    long = items.select("id", "text").where(F.col("id").isNotNull() & (F.length("text") > limit))
    schema = "id bigint, boundary string, pieces array<struct<n int, lo int, start int, stop int>>"
    return long.mapInArrow(lambda it: _split(it, limit, overlap), schema)


def split_pieces(items: DataFrame, limit: int = 1200, overlap: int = 100) -> DataFrame:
    """(id, owner, section, place, boundary, repeated, piece): all items, in pieces.

    items: id, owner, place (order within the owner), section, text. An item at or
    below the limit is one piece with boundary null. ``place`` is numbered anew from 0
    over the owner's pieces in the order (place, id, piece); ``repeated`` is the number
    of leading characters that repeat the piece before.
    """
    items = items.select("id", "owner", "place", "section", "text").where("id is not null").dropDuplicates(["id"])
    cuts = split_items(items, limit, overlap)
    placed = items.select("id", "owner", "place").join(cuts, "id", "left").select(
        "id", "owner", "place", "boundary", "pieces", F.coalesce(F.size("pieces"), F.lit(1)).alias("n_pieces")
    )
    first = running_total(placed, ["owner"], ["place", "id"], "n_pieces", "upto").select(
        "id", "boundary", "pieces", (F.col("upto") - F.col("n_pieces")).alias("before")
    )
    whole = F.expr("array(struct(0 as n, 0 as lo, 0 as start, length(text) as stop))")
    out = items.select("id", "owner", "section", "text").join(first, "id")
    out = out.withColumn("p", F.explode(F.when(F.col("boundary").isNull(), whole).otherwise(F.col("pieces"))))
    return out.select(
        "id", "owner", "section", (F.col("before") + F.col("p.n")).cast("int").alias("place"), "boundary",
        (F.col("p.start") - F.col("p.lo")).alias("repeated"),
        F.expr("substring(text, p.lo + 1, p.stop - p.lo)").alias("piece"),
    )


def _chunks(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "paper_chunks").select(
        "id", F.col("paper_id").alias("owner"), F.col("chunk_index").alias("place"),
        F.col("section_name").alias("section"), F.col("text_content").alias("text"),
    )


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """The kind of boundary that suffices for each chunk above 1,200 characters."""
    return split_items(_chunks(spark, folder)).select("id", "boundary").distinct()


def p7_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """All chunks in pieces of at most 1,200 characters, numbered anew."""
    return split_pieces(_chunks(spark, folder)).select(
        "id", F.col("owner").alias("paper_id"), F.col("place").alias("chunk_index"),
        F.col("section").alias("section_name"), "boundary", "repeated", "piece",
    )


QUERIES = {"p7_found": p7_found, "p7_pieces": p7_pieces}
_STOPPED = "|".join(sorted(x.replace(".", "[.]") for x in ABBREVIATIONS))
_MASK = f"'(?i)(^|[^\\pL\\d_.])({_STOPPED})[.](\\s)', '\\1\\2' || chr(1) || '\\3', 'g'"
SQL: dict[str, str] = {
    "p7_found": f"""
with t as (select distinct id, text_content as x from paper_chunks where length(text_content) > 1200),
p as (select id, x, unnest(regexp_split_to_array(x, '[ \\t]*\\n([ \\t]*\\n)+\\s*')) as para from t),
s as (select id, x, para, unnest(string_split(
        -- masked twice, since neighbouring abbreviations share the blank between them
        regexp_replace(
          regexp_replace(regexp_replace(para, {_MASK}), {_MASK}),
          '([.!?])\\s+(\\p{{Lu}})', '\\1' || chr(2) || '\\2', 'g'), chr(2))) as sent from p),
l as (select id, max(length(trim(para, ' ' || chr(10)))) as mp, max(length(trim(sent, ' ' || chr(10)))) as ms,
             max(list_max(list_transform(regexp_split_to_array(x, '\\s+'), lambda w: length(w)))) as mw
      from s group by id)
select id, case when mp <= 1200 then 'paragraph' when ms <= 1200 then 'sentence' when mw <= 1200 then 'word' else 'none' end as boundary
from l""",
}
