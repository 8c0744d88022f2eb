"""Problem 5: noise in text from scanned pages, found and repaired.

Method: the lines of a text are judged with their neighbours by boosted classifiers of
line pairs, which find running headers and page numbers and decide at each mark at a
line's end, over any furniture between, whether the halves are one word. Words are
looked up by their three-letter grams: an inverted join retrieves for each rarer word
the more frequent words of the corpus that share all but a few grams, and a boosted
ranking, on how scanners confuse letters and on both counts, chooses a replacement or
none.

The classifiers are fitted here, on lines and words made for it: a bounded sample of
texts is wrapped again with furniture set in, words are cut and misread by rule.
``sample`` texts, titles and words each is the bound.

Scale: all texts are counted for the vocabulary with map-side partial sums; only texts
with line breaks reach Python, as pages that were scanned keep their lines. Retrieval and
ranking work on distinct words, prefix grams first, hot grams in blocks of both sides. Texts move in no shuffle of ``p5_found``.

Defined results: null texts and null ids give nothing; texts without line breaks have
no noise; blank lines part paragraphs. Repeated rows count once; if texts of one id
differ, the noise found in each counts. Whole texts of any length are judged. Empty
tables give no rows. Words in which nothing is surely misread stay as they are.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.llm.boosting import Boosted
from folioforge.plans.lineage import cut
from folioforge.plans.skew import meet_by_key, spread
from folioforge.sources.tables import table

KINDS = ("hyphen", "misread", "header", "page")
#: What stands on the page and what a scanner reads for it.
CONFUSIONS = [x.split(":") for x in "e:c c:e t:f f:t s:5 o:0 i:1 l:1 n:ri u:ii d:cl m:rn g:9 h:b b:h w:vv li:h h:li i:l l:i b:6 b:8 z:2 rn:m cl:d ri:n a:o o:a u:n n:u y:v v:y q:g g:q in:m ni:m tt:ll e:o r:t j:i".split()]
MARKS = "-‐¬\xad‑"
_TOKEN = r"[\p{L}\p{N}]+(?:-[\p{L}\p{N}]+)*"
_WORD = re.compile(r"[^\W_]+(?:-[^\W_]+)*")
_ROMAN = re.compile(r"^[ivxlcdm]+$", re.I)
_BROKEN = re.compile(rf"([^\W_]+(?:-[^\W_]+)*)[{MARKS}][^\S\n]*$")
_START = re.compile(r"^\s*([^\W_]+(?:-[^\W_]+)*)")


# -- lines ---------------------------------------------------------------------


def line_features(lines: list[str]) -> np.ndarray:
    """A row for each line, with the lines before and after it."""
    kept = [x.strip() for x in lines]
    widths = sorted(len(x) for x in kept if x) or [1]
    usual = max(widths[len(widths) // 2], 1)
    rows = []
    for i, x in enumerate(kept):
        before = kept[i - 1] if i else ""
        after = kept[i + 1] if i + 1 < len(kept) else ""
        letters = sum(c.isalpha() for c in x)
        upper = sum(c.isupper() for c in x)
        digits = sum(c.isdigit() for c in x)
        words = x.split()
        core = x.strip("-–—·•|[](){}.~= ")
        lower_words = sum(w.islower() for w in words)
        title_words = sum(w[0].isupper() for w in words)
        rows.append(
            [
                len(x) / usual,
                letters / max(len(x), 1),
                upper / max(letters, 1),
                digits / max(len(x), 1),
                len(words),
                lower_words / max(len(words), 1),
                title_words / max(len(words), 1),
                core.isdigit(),
                bool(_ROMAN.match(core)) and core == core.lower() or bool(_ROMAN.match(core)) and len(core) > 1,
                x.startswith("(") and x.endswith(")"),
                bool(re.match(r"^(?:page|p\.|pp\.|seite|pag\.|s\.)\s*\W*[\divxlc]+", x, re.I)),
                bool(re.search(r"\b(?:of|von|sur|de|/)\s*\d+\W*$", x)) and digits > 1,
                bool(re.match(r"^\W*(?:\d+(?:\.\d+)*|[IVX]+)[.)]?\s+\S", x)) and len(words) < 6,
                bool(re.search(r"\bvol(?:\.|ume)\s*\d+|\bno\.\s*\d+", x, re.I)),
                bool(re.search(r"\s\d{1,4}$", x)) and digits <= 4,
                bool(re.match(r"^\d{1,4}\s", x)),
                bool(re.search(r"\S\s{2,}\S", x)) or x.count("|") > 1 or x.count("\t") > 0,
                bool(re.search(r"\bet\s+al\b", x, re.I)),
                x[-1:] in ".!?:;,",
                before[-1:] in ".!?:" or not before,
                before[-1:] in MARKS and before != "",
                after[:1].islower(),
                i == 0,
                i == len(kept) - 1,
                len(before) / usual,
                upper == letters and letters > 3,
                not re.search(r"[.!?,;]", x[:-1]),
            ]
        )
    return np.array(rows, float).reshape(len(rows), -1)


_SECTIONS = "Introduction|Methods|Results|Discussion|Conclusion|Related Work|References|Abstract|Main Content|Setup|Data|Background|Evaluation|Limitations|Appendix".split("|")


def _furniture(rng: np.random.Generator, titles: list[str], venues: list[str]) -> tuple[str, int]:
    """(line, kind): 0 part of the text, 1 running header, 2 page number."""
    n = int(rng.integers(1, 600))
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    title, venue, roman = pick(titles), pick(venues), pick("i ii iii iv v vi vii viii ix x xi xii xiii xiv xv xvi xviii xix xx xxi xxiv xl".split())
    size = int(rng.integers(24, 75))
    kind = int(rng.integers(3))
    if kind == 1:
        word = title.split()[0]
        forms = [title.upper()[:size], title.upper()[:size], title.upper()[:60], f"{title.upper()[:size]} {n}", f"{n} {title.upper()[:size]}", f"{venue}, vol. {n % 60 + 1}", f"{venue} {n}", f"{n} {venue}", venue, f"AUTHORS OF {word.upper()} ET AL.", f"{word} et al.", f"{word} et al. {n}", title[:size].strip(), f"{venue} | {n}"]
        weights = np.array([6, 4, 4, 1, 1, 5, 5, 2, 3, 2, 1, 1, 1, 1], float)
        return forms[int(rng.choice(len(forms), p=weights / weights.sum()))].strip(), 1
    if kind == 2:
        forms = [f"{n}", f"- {n} -", f"– {n} –", f"· {n} ·", f"[{n}]", f"{n} |", f"| {n}", f"p. {n}", f"Page {n}", f"page {n}", f"Page {n} of {n + int(rng.integers(1, 200))}", f"{n} / {n + 9}", roman, roman, roman.upper() if len(roman) > 1 else roman, f"- {roman} -", f"* {n} *"]
        return pick(forms), 2
    section = pick(_SECTIONS)
    forms = [f"{n % 9 + 1}. {section}", f"{n % 9 + 1} {section}", f"{n % 9 + 1}.{n % 4 + 1} {section}", section, section.upper(), f"{n % 9 + 1}. {section.upper()}", f"({n % 60})", f"({n % 60})", f"({n % 9}.{n % 7})", f"station {n % 30}  {n % 97}  0.{n % 89 + 10}", f"site {n % 30}\t{n}\t{n % 7}.{n % 10}", f"| {word_of(title)} | {n} | 0.{n % 90} |", f"{word_of(title)}  {n}  {n % 100}", f"- {title[:50].lower()}", f"x = {n % 9}y + {n % 7}", f"{n % 7}.{n % 90}."]
    return pick(forms), 0


def word_of(title: str) -> str:
    return title.split()[0].strip(":,?") if title.split() else "a"


def _wrapped(text: str, width: int) -> list[str]:
    lines, line = [], ""
    for w in text.split():
        if line and len(line) + len(w) + 1 > width:
            lines.append(line)
            line = w
        else:
            line = f"{line} {w}".strip()
    return [*lines, line]


def fit_lines(texts: list[str], titles: list[str], venues: list[str], seed: int = 3) -> tuple[Boosted, Boosted]:
    """(header, page): classifiers of lines, fitted on texts wrapped with furniture."""
    rng = np.random.default_rng(seed)
    titles, venues = titles or ["A study of something"], venues or ["Journal of Something"]
    xs, ys = [], []
    for text in texts or ["some words of a text that says little and goes on for a while."]:
        lines = _wrapped(text, int(rng.integers(40, 95)))
        kinds = [0] * len(lines)
        for i in range(len(lines) - 1):  # some words are cut at the line's end
            m = re.match(r"^([a-z]{6,})\s", lines[i + 1])
            if m and rng.random() < 0.15:
                lines[i], lines[i + 1] = f"{lines[i]} {m[1][:3]}-", lines[i + 1][3:]
        for _ in range(int(rng.integers(1, 4))):
            at = int(rng.integers(len(lines) + 1))
            line, kind = _furniture(rng, titles, venues)
            lines.insert(at, line)
            kinds.insert(at, kind)
        if rng.random() < 0.3:  # a table at the end
            rows = [f"{word_of(titles[int(rng.integers(len(titles)))]).lower()} {rng.integers(30)}  {rng.integers(99)}  0.{rng.integers(10, 99)}" for _ in range(int(rng.integers(1, 4)))]
            lines += rows
            kinds += [0] * len(rows)
        xs.append(line_features(lines))
        ys += kinds
    x, y = np.concatenate(xs), np.array(ys)
    return Boosted(rounds=80).fit(x, y == 1), Boosted(rounds=60).fit(x, y == 2)


def read_lines(text: str, header: np.ndarray, page: np.ndarray) -> tuple[list[tuple[str, str]], list[tuple[str, str, str]]]:
    """(lines, breaks): the lines with their kind (text, header, page, blank), and the
    (left, mark, right) of each mark at a line's end whose next line of text goes on."""
    kinds = []
    for x, h, p in zip(text.split("\n"), header, page, strict=True):
        kinds.append((x, "blank" if not x.strip() else "page" if p >= 0.5 and p >= h else "header" if h >= 0.5 else "text"))
    body = [x for x, k in kinds if k == "text"]
    breaks = []
    for a, b in zip(body, body[1:]):
        m, n = _BROKEN.search(a), _START.match(b)
        if m and n:
            breaks.append((m[1], a.rstrip()[-1], n[1]))
    return kinds, breaks


def _broken_key(left: str, mark: str, right: str) -> str:
    return f"{left.lower()}\t{mark}\t{right.lower()}" + ("" if right[:1].islower() else "\t^")


def _scan(batches: Iterator[pa.RecordBatch], header: Boosted, page: Boosted) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        texts = batch.column("text").to_pylist()
        feats = [line_features(t.split("\n")) for t in texts]
        flat = np.concatenate(feats)
        hs, ps = header.predict(flat), page.predict(flat)
        at, found, breaks, words = 0, [], [], []
        for t, f in zip(texts, feats, strict=True):
            lines, cuts = read_lines(t, hs[at : at + len(f)], ps[at : at + len(f)])
            at += len(f)
            found.append([k for k in ("header", "page") if any(x == k for _, x in lines)])
            breaks.append([_broken_key(*b) for b in cuts])
            body = "\n".join(x for x, k in lines if k == "text")
            whole = re.sub(rf"[{MARKS}][^\S\n]*\n\s*", "", body)
            # cut words are looked up whole; the halves are no words
            words.append(sorted({p.lower() for w in _WORD.findall(whole) for p in w.split("-") if 3 <= len(p) <= 40 and not p.isdigit()}))
        strings = pa.list_(pa.string())
        yield pa.record_batch(
            [batch.column("record_table"), batch.column("record_id"), pa.array(found, strings), pa.array(breaks, strings), pa.array(words, strings)],
            names=["record_table", "record_id", "found", "breaks", "words"],
        )


# -- words ---------------------------------------------------------------------


def vocabulary(texts: DataFrame) -> DataFrame:
    """(word, n, clean) of all texts and of those without line breaks, compounds whole
    and in parts; words cut at a line's end are left out."""
    whole = F.when(F.col("text").contains("\n"), F.regexp_replace("text", rf"\S+[{MARKS}][ \t]*\n\s*\S+", " ")).otherwise(F.col("text"))
    clean = (~F.col("text").contains("\n")).cast("bigint").alias("clean")
    tokens = texts.select(F.explode(F.regexp_extract_all(F.lower(whole), F.lit(_TOKEN), F.lit(0))).alias("word"), clean)
    tokens = tokens.groupBy("word").agg(F.count("*").alias("n"), F.sum("clean").alias("clean"))
    parts = tokens.where("word like '%-%'").select(F.explode(F.split("word", "-")).alias("word"), "n", "clean")
    return tokens.union(parts).where("length(word) <= 60").groupBy("word").agg(F.sum("n").alias("n"), F.sum("clean").alias("clean"))


def misreadings(word: str) -> list[str]:
    """All forms of the word with one thing misread."""
    out = []
    for true, seen in CONFUSIONS:
        i = word.find(true)
        while i >= 0:
            out.append(word[:i] + seen + word[i + len(true) :])
            i = word.find(true, i + 1)
    return out


def confusion_cost(seen: str, true: str) -> int:
    """0 for equal, 1 for one confusion, 2 for two, 9 for none such; by the first
    difference and the rest."""
    if seen == true:
        return 0
    i = 0
    while i < min(len(seen), len(true)) and seen[i] == true[i]:
        i += 1
    j = 0
    while j < min(len(seen), len(true)) - i and seen[-1 - j] == true[-1 - j]:
        j += 1
    best = 9
    for t, s in CONFUSIONS:
        for k in range(max(0, i - len(s) + 1), i + 1):
            if true.startswith(t, k) and seen.startswith(s, k):
                rest_t, rest_s = true[k + len(t) :], seen[k + len(s) :]
                if rest_t == rest_s:
                    return 1
                if len(rest_s) < len(seen) and abs(len(rest_t) - len(rest_s)) <= 1 and best > 2:
                    for t2, s2 in CONFUSIONS:
                        q = rest_t.find(t2)
                        while q >= 0:
                            if rest_t[:q] + s2 + rest_t[q + len(t2) :] == rest_s:
                                best = 2
                            q = rest_t.find(t2, q + 1)
    return best


def _grams(word: str) -> set[str]:
    x = f"##{word}#"
    return {x[i : i + 3] for i in range(len(x) - 2)}


def word_features(seen: str, true: str, n_seen: float, n_true: float, clean: float) -> list[float]:
    """clean: how often the seen word stands in texts that were not scanned."""
    a, b = _grams(seen), _grams(true)
    return [
        math.log((n_true + 1) / (n_seen + 1)), confusion_cost(seen, true), len(true), len(seen) - len(true),
        2 * len(a & b) / (len(a) + len(b)), any(c.isdigit() for c in seen), seen[0] == true[0], seen[-1] == true[-1], sum(c.isdigit() for c in seen) / len(seen),
        clean / max(n_seen, 1), math.log((n_true + 1) / (clean + 1)),
    ]


def fit_words(words: list[tuple[str, int]], seed: int = 4) -> Boosted:
    """Ranks replacements; fitted on misread words of the vocabulary against other
    changes of words and against words as frequent as their likes."""
    rng = np.random.default_rng(seed)
    letters = "abcdefghijklmnopqrstuvwxyz"
    xs, ys = [], []
    for w, n in words or [("station", 50), ("seasons", 60), ("measured", 70)]:
        bad = misreadings(w)
        if bad:
            xs.append(word_features(bad[int(rng.integers(len(bad)))], w, k := n * 10 ** rng.uniform(-4, -1.2), n, k * rng.uniform(0, 0.04)))
            ys.append(1)
            # as rare as a misreading, but written where nothing was scanned
            xs.append(word_features(bad[int(rng.integers(len(bad)))], w, k := n * 10 ** rng.uniform(-4, -1.2), n, k * rng.uniform(0.25, 1)))
            ys.append(0)
            # as frequent as the word itself: another word
            xs.append(word_features(bad[int(rng.integers(len(bad)))], w, k := n * 10 ** rng.uniform(-0.8, 1), n, k * rng.uniform(0, 1)))
            ys.append(0)
        for _ in range(2):
            i, c = int(rng.integers(len(w))), letters[int(rng.integers(26))]
            other = [w[:i] + c + w[i + 1 :], w[:i] + w[i + 1 :], w[:i] + c + w[i:]][int(rng.integers(3))]
            if other and other != w and confusion_cost(other, w) > 2:
                xs.append(word_features(other, w, k := n * 10 ** rng.uniform(-4, 0), n, k * rng.uniform(0, 1)))
                ys.append(0)
    return Boosted().fit(np.array(xs), np.array(ys))


#: A misreading changes at most this many of a word's grams.
CHANGED = 4
#: A word of which this share stands in texts that were not scanned is as it was written.
WRITTEN = 0.25


def retrieve(suspects: DataFrame, known: DataFrame, ratio: float = 8.0) -> DataFrame:
    """(seen, meant, n_seen, n_meant, clean): known words that share all but CHANGED grams with
    a suspect and are ``ratio`` times as frequent. Suspects (word, n, clean), known (word, n)."""
    gram = "array_distinct(transform(sequence(1, length(x.w) - 2), i -> substring(x.w, i, 3)))"
    grams = F.expr(f"transform(array(struct(concat('##', word, '#') as w)), x -> {gram})[0]")
    sides = {s: d.withColumn("g", grams) for s, d in (("seen", suspects), ("meant", known))}
    flat = {s: d.select("word", F.explode("g").alias("gram")) for s, d in sides.items()}
    order = flat["meant"].groupBy("gram").agg(F.count("*").alias("f"))
    prefix = {}
    for s, d in flat.items():
        ranked = d.join(order, "gram", "left").groupBy("word").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("f", F.lit(0)).alias("f"), "gram"))).alias("r"))
        prefix[s] = ranked.select("word", F.explode(F.expr(f"transform(slice(r, 1, {CHANGED + 1}), y -> y.gram)")).alias("gram"))
    met = meet_by_key(prefix["seen"].withColumnRenamed("word", "a"), prefix["meant"].withColumnRenamed("word", "b"), "gram").withColumnsRenamed({"a": "seen", "b": "meant"})
    met = met.where("seen <> meant and abs(length(seen) - length(meant)) <= 1")
    for s, d in sides.items():
        more = ["clean"] if s == "seen" else []
        met = met.join(d.select(F.col("word").alias(s), F.col("g").alias(f"g_{s}"), F.col("n").alias(f"n_{s}"), *more), s)
    enough = F.size(F.array_intersect("g_seen", "g_meant")) >= F.greatest(F.size("g_seen"), F.size("g_meant")) - CHANGED
    return met.where(enough & (F.col("n_meant") >= ratio * F.greatest("n_seen", F.lit(0.5)))).select("seen", "meant", "n_seen", "n_meant", "clean")


def _rank(batches: Iterator[pa.RecordBatch], model: Boosted) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            cols = [batch.column(c).to_pylist() for c in ("seen", "meant", "n_seen", "n_meant", "clean")]
            x = np.array([word_features(*r) for r in zip(*cols, strict=True)])
            # a scanner's reading comes about by its confusions; others are other words
            p = np.where(x[:, 1] <= 2, model.predict(x), 0.0)
            out = pa.record_batch([batch.column("seen"), batch.column("meant"), pa.array(p)], names=["seen", "meant", "p"])
            yield out.filter(pa.array(p >= 0.5))


def break_features(joined: float, hyphenated: float, mark: str, left: str, right: str, lower: bool) -> list[float]:
    return [math.log((joined + 0.5) / (hyphenated + 0.5)), joined > 0, hyphenated > 0, mark == "-", len(left), len(right), lower, any(c.isdigit() for c in left + right)]


def fit_breaks(words: list[tuple[str, int]], compounds: list[tuple[str, int, int]], seed: int = 5) -> Boosted:
    """Whether the mark at a line's end is no part of the word; fitted on words cut
    inside, some unknown, and on compounds (word, n, n of its joined form) cut at their
    hyphen."""
    rng = np.random.default_rng(seed)
    xs, ys = [], []
    for w, n in words:
        if len(w) > 4 and "-" not in w:
            i = int(rng.integers(2, len(w) - 1))
            mark = MARKS[int(rng.integers(4))] if rng.random() < 0.4 else "-"
            xs.append(break_features(0 if rng.random() < 0.2 else n, 0, mark, w[:i], w[i:], True))
            ys.append(1)
    for w, n, joined in compounds:
        left, right = w.rsplit("-", 1)
        xs += [break_features(joined, n, "-", left, right, True)] * 3
        ys += [0] * 3
        xs.append(break_features(0, 0, "-", left, right, False))
        ys.append(0)
    if not xs:
        xs, ys = [break_features(9, 0, "-", "ab", "cd", True), break_features(0, 9, "-", "ab", "cd", True)] * 20, [1, 0] * 20
    return Boosted().fit(np.array(xs), np.array(ys))


def _join_breaks(batches: Iterator[pa.RecordBatch], model: Boosted) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            rows = []
            for key, nj, nh in zip(batch.column("brk").to_pylist(), batch.column("nj").to_pylist(), batch.column("nh").to_pylist(), strict=True):
                left, mark, right, *rest = key.split("\t")
                rows.append(break_features(nj, nh, mark, left, right, not rest))
            yield pa.record_batch([batch.column("brk"), pa.array(model.predict(np.array(rows)) >= 0.5)], names=["brk", "joins"])


# -- the operator --------------------------------------------------------------


class Scans:
    """The pieces of one run: what was found in each text, and what words become.

    texts: (record_table, record_id, text); titles: (title, venue) for the classifiers.
    """

    def __init__(self, texts: DataFrame, titles: DataFrame, sample: int = 1500) -> None:
        total = texts.select("record_id").count()
        texts = texts.select("record_table", "record_id", "text").where("record_id is not null and text is not null")
        self.texts, self.sample, self.total = texts, sample, total
        self.vocabulary = cut(vocabulary(texts))
        plain = texts.where(~F.col("text").contains("\n") & F.length("text").between(200, 2000))

        def take(d: DataFrame, by: list[str], n: int, of: int) -> DataFrame:
            """About n rows by the hash of ``by``. Rows are thinned out first, so that not
            every partition sends n of them."""
            thin = d.where(F.pmod(F.xxhash64(*by), F.lit(max(1, of // (8 * n)))) == 0)
            return thin.orderBy(F.xxhash64(F.lit(1), *by), *by).limit(n)

        few = min(sample, 800)
        bodies = [r["text"] for r in take(plain, ["record_id", "record_table"], few, total).select("text").collect()]
        heads = titles.where("length(title) > 20").select("title", "venue")
        heads = take(heads, ["title", "venue"], sample, titles.count()).distinct().collect()
        of = self.vocabulary.count()
        self.header, self.page = fit_lines(bodies, [r[0] for r in heads], sorted({r[1] for r in heads if r[1]}))
        common = self.vocabulary.where("n >= 5 and word rlike '^\\\\p{L}{4,}$'")
        words = [(r[0], r[1]) for r in take(common, ["word"], sample, of // 4).collect()]
        two = self.vocabulary.where("n >= 2 and word rlike '^\\\\p{L}{2,}(-\\\\p{L}{2,})+$'").withColumn("joined", F.regexp_replace("word", "-", ""))
        two = take(two, ["word"], sample, of // 100).join(self.vocabulary.select(F.col("word").alias("joined"), F.col("n").alias("nj")), "joined", "left")
        compounds = [(r["word"], r["n"], r["nj"] or 0) for r in two.select("word", "n", "nj").collect()]
        self.ranking, self.joining = fit_words(words), fit_breaks(words, compounds)
        header, page = self.header, self.page
        schema = "record_table string, record_id bigint, found array<string>, breaks array<string>, words array<string>"
        self.scanned = cut(texts.where(F.col("text").contains("\n")).mapInArrow(lambda it: _scan(it, header, page), schema))

    def corrections(self) -> DataFrame:
        """(seen, meant): the words to be replaced."""
        count = self.vocabulary
        seen = self.scanned.select(F.explode("words").alias("word")).distinct().join(count, "word", "left")
        seen = seen.select("word", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("clean", F.lit(0)).alias("clean"))
        seen = seen.where(F.col("word").rlike(r"\p{L}") & (F.col("clean") < WRITTEN * F.greatest("n", F.lit(1))))
        known = count.select("word", "n").where("n >= 5 and word rlike '^\\\\p{L}{3,40}$'")
        model = self.ranking
        ranked = retrieve(seen, known).mapInArrow(lambda it: _rank(it, model), "seen string, meant string, p double")
        return ranked.groupBy("seen").agg(F.max_by("meant", F.struct("p", "meant")).alias("meant"))

    def joins(self) -> DataFrame:
        """(brk): the line ends whose mark is no part of the word."""
        brk = self.scanned.select(F.explode("breaks").alias("brk")).distinct()
        part = lambda i: F.element_at(F.split("brk", "\t"), i)
        n = self.vocabulary
        brk = brk.withColumns({"j": F.concat(part(1), part(3)), "h": F.concat_ws("-", part(1), part(3))})
        brk = brk.join(n.select(F.col("word").alias("j"), F.col("n").alias("nj")), "j", "left").join(n.select(F.col("word").alias("h"), F.col("n").alias("nh")), "h", "left")
        zero, model = F.lit(0), self.joining
        brk = brk.select("brk", F.coalesce("nj", zero).alias("nj"), F.coalesce("nh", zero).alias("nh"))
        return brk.mapInArrow(lambda it: _join_breaks(it, model), "brk string, joins boolean").where("joins").select("brk")

    def found(self) -> DataFrame:
        """(record_table, record_id, noise)."""
        key = ["record_table", "record_id"]
        lines = self.scanned.select(*key, F.explode("found").alias("noise"))
        broken = self.scanned.select(*key, F.explode("breaks").alias("brk")).join(self.joins(), "brk").select(*key, F.lit("hyphen").alias("noise"))
        misread = self.scanned.select(*key, F.explode("words").alias("seen")).join(self.corrections(), "seen").select(*key, F.lit("misread").alias("noise"))
        return lines.union(broken).union(misread).distinct()

    def repaired(self) -> DataFrame:
        """(record_table, record_id, text): every text as continuous paragraphs."""
        key = ["record_table", "record_id"]
        fixes = self.scanned.select(*key, F.explode("words").alias("seen")).join(self.corrections(), "seen")
        fixes = fixes.groupBy(*key).agg(F.map_from_entries(F.collect_set(F.struct("seen", "meant"))).alias("fixes"))
        joins = self.scanned.select(*key, F.explode("breaks").alias("brk")).join(self.joins(), "brk").groupBy(*key).agg(F.collect_set("brk").alias("joins"))
        broken = self.texts.where(F.col("text").contains("\n")).distinct().join(fixes, key, "left").join(joins, key, "left")
        header, page = self.header, self.page
        mended = spread(broken, self.total).mapInArrow(lambda it: _repair(it, header, page), "record_table string, record_id bigint, text string")
        return mended.union(self.texts.where(~F.col("text").contains("\n")).distinct())


def repair(text: str, header: np.ndarray, page: np.ndarray, joins: set[str], fixes: dict[str, str]) -> str:
    """Paragraphs without furniture, cut words whole, misread words replaced; headings,
    rows of tables and items of lists keep their lines."""
    lines, _ = read_lines(text, header, page)
    out = ""
    gap = False
    for x, kind in lines:
        if kind == "blank":
            gap = True
        if kind != "text":
            continue
        line = x.strip()
        m, n = _BROKEN.search(out), _START.match(line)
        own = re.match(r"^(?:\d+(?:\.\d+)*\.?\s+[A-Z]|[-*•]\s|\|)", line) or re.search(r"\S\s{2,}\S", line)
        if gap and out:
            out += "\n\n" + line
        elif m and n:
            one = _broken_key(m[1], out.rstrip()[-1], n[1]) in joins
            out = (out.rstrip()[:-1] if one else out.rstrip()) + line
        elif not out:
            out = line
        else:
            last = out.rsplit("\n", 1)[-1]
            alone = own or re.match(r"^\d+(?:\.\d+)*\.?\s+[A-Z][\w ]{2,40}$", last) or re.search(r"\S\s{2,}\S", last)
            out += ("\n" if alone else " ") + line
        gap = False

    def fix(m: re.Match) -> str:
        w = m[0]
        t = fixes.get(w.lower())
        return w if t is None else t.upper() if w.isupper() and len(w) > 2 else t[:1].upper() + t[1:] if w[:1].isupper() else t

    return re.sub(r"[^\W_]+", fix, out) if fixes else out


def _repair(batches: Iterator[pa.RecordBatch], header: Boosted, page: Boosted) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        done = []
        for text, fixes, joins in zip(*(batch.column(c).to_pylist() for c in ("text", "fixes", "joins")), strict=True):
            f = line_features(text.split("\n"))
            done.append(repair(text, header.predict(f), page.predict(f), set(joins or ()), dict(fixes or ())))
        yield pa.record_batch([batch.column("record_table"), batch.column("record_id"), pa.array(done, pa.string())], names=["record_table", "record_id", "text"])


def _scans(spark: SparkSession, folder: str) -> Scans:
    chunks = table(spark, folder, "paper_chunks").select(F.lit("paper_chunks").alias("record_table"), F.col("id").alias("record_id"), F.col("text_content").alias("text"))
    papers = table(spark, folder, "papers", "id", "title", "publication", "abstract")
    abstracts = papers.select(F.lit("papers").alias("record_table"), F.col("id").alias("record_id"), F.col("abstract").alias("text"))
    return Scans(chunks.union(abstracts), papers.select("title", F.col("publication").alias("venue")))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """A row for each record and kind of noise found in it."""
    return _scans(spark, folder).found()


def p5_texts(spark: SparkSession, folder: str) -> DataFrame:
    """All texts, those of scanned pages repaired."""
    return _scans(spark, folder).repaired()


QUERIES = {"p5_found": p5_found, "p5_texts": p5_texts}
SQL: dict[str, str] = {}
