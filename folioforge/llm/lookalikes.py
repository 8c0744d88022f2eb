"""Problem 10: one character form for texts that look the same.

Method: the words of the corpus that are written plainly form a vocabulary, held as
tries. A word with a variant character, as it stands, traverses its trie with a weighted
edit automaton in which look-alike letters, compatibility forms, composition and
ignorable characters cost nothing and any other edit costs one; each path tells which
kinds of variants it passed. Words reached at no cost are spellings of it, and the most
frequent one in the script of its unmistakable letters is taken. Words that reach
nothing are normalised by table.

Scale: only texts with a variant character leave the scan, found by one JVM pattern and
written once; texts of plain bytes are passed by length alone. The vocabulary, words
written once included, is counted with map-side partial sums. Tries are built for
subtrees of it: the beginnings of plain looks, each the shortest with at most
``subtree`` words, so that none is hot; they meet only the distinct variant words with
the same beginning. The spellings found are joined back to their texts.

What belongs to the writing stays: full-width forms and U+3000 in Japanese texts,
joiners between letters of scripts that use them and in emoji, words wholly in another
script, Greek letters as symbols, marks without a composed form.

Defined results: a null text stays null and has no kinds; an empty text stays empty;
rows with a null id are no documents. Repeated rows count once. Texts are processed
whole; two different texts under one id are one row each in ``canonical_text``.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.plans.lineage import cut
from folioforge.sources.tables import table

KINDS = ("fullwidth", "combining", "invisible", "space", "presentation", "lookalike")

#: Letters of other scripts and the Latin letter of the same look.
CYRILLIC = dict(zip("АВЕЅІЈКМНОРСТУХаеѕіјорсухһԁԛԝӏ", "ABESIJKMHOPCTYXaesijopcyxhdqwl", strict=True))
GREEK = dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧαικνορτυχϲϳ", "ABEZHIKMNOPTYXaikvoptuxcj", strict=True))
#: Letters that few languages write; no Latin letter is taken for one of them.
RARE = frozenset("ЅЈѕјһԁԛԝӏϲϳ")
LATIN_OF = CYRILLIC | GREEK

_INVISIBLE = "­͏؜ᅟᅠ឴឵᠎​-‏‪-‮⁠-⁤⁦-⁯ㅤ﻿ﾠ"
_BLANK = "\t   -   　"
_FORMS = "ﬀ-ﬆ\U0001d400-\U0001d7ff"
_WIDE = "！-～"
_FOREIGN = r"[\p{IsCyrillic}\p{IsGreek}]"
#: What a text needs to be looked at: for Java's and for Python's patterns.
_MIXED = r"\p{IsLatin}[\p{M}\p{Cf}]*" + _FOREIGN + "|" + _FOREIGN + r"[\p{M}\p{Cf}]*\p{IsLatin}"
SUSPECT = f"[{_INVISIBLE}{_BLANK}{_FORMS}{_WIDE}]|\\p{{M}}|{_MIXED}"

_WORD = regex.compile(rf"[\p{{L}}\p{{M}}\p{{N}}\p{{Cf}}{_INVISIBLE}{_WIDE}{_FORMS}]+")
_CORE = regex.compile(rf"[\p{{L}}\p{{N}}{_WIDE}{_FORMS}]")
_DIRTY = regex.compile(rf"[{_INVISIBLE}{_FORMS}{_WIDE}]|\p{{M}}|" + _MIXED)
_SPACES = regex.compile(f"[{_BLANK}]")
_IDEOGRAPHIC = regex.compile(r"[\p{Hiragana}\p{Katakana}\p{Han}]")
_KANA = regex.compile(r"[\p{Hiragana}\p{Katakana}]")
_LETTER = regex.compile(r"\p{L}")
_LATIN, _CYR, _GRK = (regex.compile(rf"\p{{Script={s}}}") for s in ("Latin", "Cyrillic", "Greek"))
_IGNORABLE = regex.compile(f"[{_INVISIBLE}]")
_JOINS = regex.compile(r"[\p{Arabic}\p{Syriac}\p{Mongolian}\p{Devanagari}\p{Bengali}\p{Gurmukhi}\p{Gujarati}\p{Oriya}\p{Tamil}\p{Telugu}\p{Kannada}\p{Malayalam}\p{Sinhala}\p{Khmer}\p{Myanmar}]")
_MARK = regex.compile(r"\p{M}")


def _belongs(text: str, i: int) -> bool:
    """Whether the joiner at i is part of the writing around it."""
    if text[i] not in "‌‍" or not 0 < i < len(text) - 1:
        return False
    a, b = text[i - 1], text[i + 1]
    if _JOINS.match(a) and _JOINS.match(b):
        return True
    return text[i] == "‍" and (unicodedata.category(a) in ("So", "Sk") or a == "️") and unicodedata.category(b) in ("So", "Sk")


@lru_cache(1 << 16)
def _plain(c: str) -> tuple[str, str | None]:
    """The plain form of a character and the kind of variant it is."""
    o = ord(c)
    if 0xFF01 <= o <= 0xFF5E:
        return chr(o - 0xFEE0), "fullwidth"
    if 0xFB00 <= o <= 0xFB06 or 0x1D400 <= o <= 0x1D7FF:
        return unicodedata.normalize("NFKC", c), "presentation"
    return c, None


@lru_cache(1 << 16)
def _looks(c: str) -> str:
    """The Latin look of a letter, its marks kept; itself if it has none."""
    d = unicodedata.normalize("NFD", c)
    return unicodedata.normalize("NFC", LATIN_OF.get(d[0], d[0]) + d[1:])


def units(word: str, japanese: bool = False) -> tuple[list[str], list[str]]:
    """The word's characters in plain, composed form, and the kinds of variants met."""
    kinds: list[str] = []
    out: list[str] = []
    fresh = False  # whether the last character came as a letter, so that a mark may join it
    for i, c in enumerate(word):
        if _IGNORABLE.match(c):
            if _belongs(word, i):
                out.append(c)
            else:
                kinds.append("invisible")
            continue
        if _MARK.match(c) and out and fresh:
            joined = unicodedata.normalize("NFC", out[-1] + c)
            if len(joined) < len(out[-1]) + 1:
                out[-1] = joined
                kinds.append("combining")
            else:
                out[-1] += c
            continue
        p, kind = (c, None) if japanese else _plain(c)
        if kind:
            kinds.append(kind)
        out += p
        fresh = bool(_LETTER.match(out[-1]))
    return out, kinds


def skeleton(chars: list[str]) -> str:
    return "".join(_looks(c) for c in chars)


def by_table(chars: list[str], kinds: list[str]) -> tuple[str, list[str]]:
    """Spelling of a word that no vocabulary word looks like: look-alikes of the
    rarer script become letters of the more frequent one."""
    letters = [c[0] for c in chars if _LETTER.match(c)]
    latin = [c for c in letters if _LATIN.match(c)]
    other = [c for c in letters if _CYR.match(c) or _GRK.match(c)]
    if not latin or not other:
        return "".join(chars), kinds
    alike = [c for c in other if _looks(c) != c]
    cyr = sum(bool(_CYR.match(c)) for c in other)
    if len(letters) < 4 and not cyr:  # a symbol of a formula, such as a Greek letter with an index
        return "".join(chars), kinds
    strict_other = len(other) - len(alike)
    back = {v: k for k, v in (CYRILLIC if cyr * 2 >= len(other) else GREEK).items() if k not in RARE}
    strict_latin = sum(_looks(c) == c and unicodedata.normalize("NFD", c)[0] not in back for c in latin)
    if (strict_latin, len(latin)) >= (strict_other, len(other)):
        if not alike:
            return "".join(chars), kinds
        return "".join(_looks(c) for c in chars), [*kinds, "lookalike"]
    swapped = [unicodedata.normalize("NFC", back.get(d[0], d[0]) + d[1:]) for d in (unicodedata.normalize("NFD", c) for c in chars)]
    return "".join(swapped), [*kinds, "lookalike"] if swapped != chars else kinds


class Trie:
    """Vocabulary words by their letters; a node is [children, count or 0]."""

    def __init__(self) -> None:
        self.root: list = [{}, 0]

    def add(self, word: str, count: int) -> None:
        node = self.root
        for c in word:
            node = node[0].setdefault(c, [{}, 0])
        node[1] = count

    def reach(self, word: str, most: int = 0, japanese: bool = False) -> list[tuple[int, str, int, frozenset[str]]]:
        """(cost, spelling, count, kinds) of all words within ``most`` of the word as it
        stands. The automaton's states are (step of the word, node, cost). An ignorable
        character stays at its node, a compatibility form steps through its letters, a
        letter with its marks steps to the composed one, a letter steps to any of the
        same look, all for nothing; another letter, a letter more or less costs one."""
        steps = list(_steps(word, japanese))
        found: dict[str, tuple[int, int, frozenset[str]]] = {}
        stack = [(0, self.root, "", 0, frozenset())]
        seen: dict[tuple[int, int], int] = {}
        while stack:
            i, node, path, cost, kinds = stack.pop()
            if seen.get((i, id(node)), most + 1) <= cost:
                continue
            seen[i, id(node)] = cost
            if i == len(steps):
                if node[1] and (path not in found or found[path][0] > cost):
                    found[path] = (cost, node[1], kinds)
            else:
                letter, kind = steps[i]
                met = kinds | {kind} if kind else kinds
                if not letter:
                    stack.append((i + 1, node, path, cost, met))
                    continue
                look = _looks(letter)
                for c, child in node[0].items():
                    if c == letter:
                        stack.append((i + 1, child, path + c, cost, met))
                    elif _looks(c) == look:
                        stack.append((i + 1, child, path + c, cost, met | {"lookalike"}))
                    elif cost < most:
                        stack.append((i + 1, child, path + c, cost + 1, met))
                if cost < most:
                    stack.append((i + 1, node, path, cost + 1, met))
            if cost < most:
                for c, child in node[0].items():
                    stack.append((i, child, path + c, cost + 1, kinds))
        return [(cost, spelling, n, kinds) for spelling, (cost, n, kinds) in found.items()]


def _steps(word: str, japanese: bool) -> Iterator[tuple[str, str | None]]:
    """(letter, kind) that the automaton consumes: "" for an ignorable character."""
    i = 0
    while i < len(word):
        c = word[i]
        i += 1
        if _IGNORABLE.match(c):
            yield (c, None) if _belongs(word, i - 1) else ("", "invisible")
            continue
        plain, kind = (c, None) if japanese else _plain(c)
        yield from ((x, kind) for x in plain[:-1])
        last, marks = plain[-1:], 0
        while last and i < len(word) and (_MARK.match(word[i]) or _IGNORABLE.match(word[i])) and _LETTER.match(last):
            if _IGNORABLE.match(word[i]):
                yield "", "invisible"
            else:
                joined = unicodedata.normalize("NFC", last + word[i])
                marks += len(joined) <= len(last)
                last = joined
            i += 1
        if kind and marks:
            yield "", kind
        yield from ((x, "combining" if marks else kind) for x in last)


def spell(word: str, trie: Trie | None, japanese: bool) -> tuple[str, list[str]]:
    """(canonical spelling, kinds of variants found) of one word."""
    chars, kinds = units(word, japanese)
    letters = "".join(chars)
    mixed = _LATIN.search(letters) and (_CYR.search(letters) or _GRK.search(letters))
    if trie is not None:
        sure = [c for c in chars if _looks(c) == c]
        scripts = [s for s in (_LATIN, _CYR, _GRK) if any(s.match(c) for c in sure)]
        ranked = sorted(
            trie.reach(word, japanese=japanese),
            key=lambda x: (x[0], -sum(bool(s.match(c)) for c in x[1] for s in scripts), -x[2], x[1]),
        )
        if not mixed:  # a word wholly in one script keeps it
            ranked = [x for x in ranked if "lookalike" not in x[3]]
        if ranked:
            return ranked[0][1], sorted(ranked[0][3])
    return by_table(chars, kinds) if mixed else (letters, kinds)


def _japanese(text: str) -> bool:
    if not _KANA.search(text):
        return False
    return len(_IDEOGRAPHIC.findall(text)) * 3 >= len(_LETTER.findall(text))


def _dirty_words(text: str) -> set[str]:
    return {m[0] for m in _WORD.finditer(text) if _DIRTY.search(m[0]) and _CORE.search(m[0])}


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, words, ja = [], [], []
        for i, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            j = _japanese(text)
            for w in _dirty_words(text):
                ids.append(i)
                words.append(w)
                ja.append(j)
        if ids:
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(words), pa.array(ja)], names=["id", "word", "ja"])


def _beginnings(batches: Iterator[pd.DataFrame], dirty: bool) -> Iterator[pd.DataFrame]:
    """Adds all beginnings of a word's plain look, its end being a letter too."""
    for pdf in batches:
        looks = [skeleton(units(w, bool(j))[0] if dirty else list(w)) + "\0" for w, j in zip(pdf.word, pdf.ja, strict=True)]
        yield pdf.assign(starts=[[x[:n] for n in range(min(len(x), LONGEST) + 1)] for x in looks])


#: Beginnings of subtrees are no longer than this; words that share so many letters are few.
LONGEST = 24


def _match(vocabulary: pd.DataFrame, words: pd.DataFrame) -> pd.DataFrame:
    trie = Trie()
    for w, n in zip(vocabulary.word, vocabulary.n, strict=True):
        trie.add(w, int(n))
    spelt = [spell(w, trie, bool(j)) for w, j in zip(words.word, words.ja, strict=True)]
    return pd.DataFrame({"word": words.word, "ja": words.ja, "canon": [s for s, _ in spelt], "kinds": [sorted(set(k)) for _, k in spelt]})


def rewrite(text: str, spelt: dict[str, tuple[str, list[str]]]) -> tuple[str, list[str]]:
    """The text with every variant replaced, and the kinds found in it."""
    japanese, kinds = _japanese(text), set()

    def word(m: regex.Match) -> str:
        w = m[0]
        # marks and joiners by themselves are judged below, by what stands around them
        if not _DIRTY.search(w) or not _CORE.search(w):
            return w
        canon, found = spelt.get(w) or spell(w, None, japanese)
        kinds.update(found)
        return canon

    def blank(m: regex.Match) -> str:
        if japanese and m[0] == "　":
            return m[0]
        kinds.add("space")
        return " "

    out = _SPACES.sub(blank, _WORD.sub(word, text))
    # ignorables between other characters than those of words; joiners of emoji stay
    kept = []
    for i, c in enumerate(out):
        if _IGNORABLE.match(c) and not _belongs(out, i):
            kinds.add("invisible")
        else:
            kept.append(c)
    return "".join(kept), sorted(kinds)


def _rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        done = [
            rewrite(t, {x["word"]: (x["canon"], x["kinds"]) for x in s or ()})
            for t, s in zip(batch.column("text").to_pylist(), batch.column("spelt").to_pylist(), strict=True)
        ]
        yield pa.record_batch(
            [batch.column("id"), pa.array([x for x, _ in done], pa.string()), pa.array([k for _, k in done], pa.list_(pa.string()))],
            names=["id", "text", "kinds"],
        )


def is_suspect(text: Column) -> Column:
    """Whether a variant may stand in the text. A text whose letters are single bytes
    and that has no tab holds none; only others are searched with the pattern."""
    plain = (F.octet_length(text) == F.char_length(text)) & ~F.contains(text, F.lit("\t"))
    return ~plain & text.rlike(SUSPECT)


def variants(documents: DataFrame, subtree: int = 20_000) -> DataFrame:
    """(id, text, kinds) of those documents (id bigint, text string) in which a
    variant may stand, text being the consistent form."""
    documents = documents.select("id", "text").where("id is not null")
    suspect = cut(documents.where(is_suspect(F.col("text"))))
    words = cut(suspect.mapInArrow(_words, "id bigint, word string, ja boolean"))
    dirty = words.select("word", "ja").distinct().mapInPandas(lambda it: _beginnings(it, True), "word string, ja boolean, starts array<string>")
    plain = documents.select(F.explode(F.regexp_extract_all("text", F.lit(r"\p{L}+"), 0)).alias("word"))
    vocabulary = plain.groupBy("word").agg(F.count("*").alias("n")).where(~is_suspect(F.col("word")))
    vocabulary = vocabulary.withColumn("ja", F.lit(False)).mapInPandas(lambda it: _beginnings(it, False), "word string, n bigint, ja boolean, starts array<string>")
    # a subtree is the shortest beginning with few enough words
    vocabulary = cut(vocabulary)
    sizes = vocabulary.select(F.explode("starts").alias("start")).groupBy("start").agg(F.count("*").alias("m"))
    small = sizes.where((F.col("m") <= subtree) | (F.length("start") >= LONGEST)).select("start")

    def shard(d: DataFrame) -> DataFrame:
        own = d.select("word", "ja", F.explode("starts").alias("start")).join(small, "start").groupBy("word", "ja").agg(F.min_by("start", F.length("start")).alias("shard"))
        return d.drop("starts").join(own, ["word", "ja"], "left").withColumn("shard", F.coalesce("shard", F.concat(F.lit("\0"), F.substring("word", 1, 2))))

    asked = cut(shard(dirty))
    filed = shard(vocabulary).join(asked.select("shard").distinct(), "shard", "left_semi")
    spelt = (
        filed.groupBy("shard").cogroup(asked.groupBy("shard"))
        .applyInPandas(_match, "word string, ja boolean, canon string, kinds array<string>")
    )
    per_text = words.join(spelt, ["word", "ja"]).groupBy("id").agg(F.collect_set(F.struct("word", "canon", "kinds")).alias("spelt"))
    return suspect.join(per_text, "id", "left").mapInArrow(_rewrite, "id bigint, text string, kinds array<string>")


def canonical_text(documents: DataFrame) -> DataFrame:
    """(id, text, kinds) of every document, kinds empty where nothing was found."""
    documents = documents.select("id", "text").where("id is not null").distinct()
    none = F.array().cast("array<string>")
    clean = documents.where(F.col("text").isNull() | ~is_suspect(F.col("text"))).select("id", "text", none.alias("kinds"))
    return clean.unionByName(variants(documents))


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select(F.col("doc_id").alias("id"), "text")


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    """A row for each document and kind of variant found in it."""
    return variants(_documents(spark, folder)).select(F.col("id").alias("doc_id"), F.explode("kinds").alias("kind")).distinct()


def p10_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's text in the consistent form."""
    return canonical_text(_documents(spark, folder)).select(F.col("id").alias("doc_id"), "text", F.array_join("kinds", ",").alias("kinds"))


QUERIES = {"p10_found": p10_found, "p10_texts": p10_texts}
SQL: dict[str, str] = {}
