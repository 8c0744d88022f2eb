"""Text expressions: tokens, keywords, sentences, token estimates, sections."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that are no keywords.
STOPWORDS = """
a an the is are was were be been being have has had do does did will would could should may might must shall can
what which who whom this that these those i we you he she it they me us him her them my our your his its their
in on at to for of with by from up about into through before after above below between out over under
then how when where why all any both each more most other some such no not only same so than too very just as or and but if while
paper papers study work works show shows also however therefore thus hence although though based using used proposed approach given well
two one new use per get via
""".split()

#: Section keys in the order in which they are looked for, and token budgets.
SECTION_BUDGETS = {
    "abstract": 700, "introduction": 400, "conclusion": 400, "results": 450, "discussion": 300,
    "methods": 300, "methodology": 300, "experiment": 300, "related": 160, "background": 160, "_other": 120,
}

#: How much a chunk counts by its type.
IMPORTANCE = {
    "title": 1.0, "abstract": 1.0, "introduction": 0.9, "methods": 0.7, "results": 0.8, "discussion": 0.9,
    "conclusion": 0.9, "section": 0.7, "paragraph": 0.5, "reference": 0.3, "figure_caption": 0.6,
}

#: Parts of a heading and the chunk type they mean, the first that fits.
SECTION_TYPES = [
    ("abstract", "abstract"), ("intro", "introduction"), ("method", "methods"), ("approach", "methods"), ("result", "results"),
    ("discussion", "discussion"), ("conclusion", "conclusion"), ("summary", "conclusion"), ("reference", "reference"),
]


def tokens(text: Column) -> Column:
    """Lower-case words; characters that are no letters, digits, _ or blanks vanish."""
    bare = F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_\s]", "")
    return F.filter(F.split(bare, r"\s+"), lambda t: t != "")


def keywords(text: Column, least: int = 3) -> Column:
    """Tokens of ``least`` letters or more that are no stopwords, in order, repeated."""
    stop = F.array(*map(F.lit, STOPWORDS))
    return F.filter(tokens(text), lambda t: (F.length(t) >= least) & ~F.array_contains(stop, t))


def token_estimate(text: Column, least: int = 1) -> Column:
    """A token for every four characters."""
    return F.greatest(F.lit(least), F.floor(F.length(text) / 4).cast("int"))


def sentences(text: Column) -> Column:
    """Parts after . ! or ? and white space, without empty ones."""
    return F.filter(F.split(F.trim(text), r"(?<=[.!?])\s+"), lambda s: s != "")


def clean(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def _first(rules: list[tuple[Column, str]], rest: str) -> Column:
    out = F.lit(rest)
    for condition, value in reversed(rules):
        out = F.when(condition, value).otherwise(out)
    return out


def section_key(section: Column, chunk_type: Column) -> Column:
    """The first budgeted section named in the section or the type, else _other."""
    name = F.lower(F.coalesce(F.nullif(section, F.lit("")), chunk_type, F.lit("")))
    return _first([(F.contains(name, F.lit(k)), k) for k in SECTION_BUDGETS if k != "_other"], "_other")


def section_budget(key: Column) -> Column:
    pairs = [F.lit(x) for kv in SECTION_BUDGETS.items() for x in kv]
    return F.element_at(F.create_map(*pairs), key)


def classify_section(name: Column) -> Column:
    low = F.lower(name)
    return _first([(F.contains(low, F.lit(part)), kind) for part, kind in SECTION_TYPES], "section")


def importance(chunk_type: Column) -> Column:
    pairs = [F.lit(x) for kv in IMPORTANCE.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), chunk_type), F.lit(0.5))
