"""Metadata, identifiers, file names and message parsing as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioforge.functions.text import clean

#: Formats of identifiers.
DOI, ARXIV, YEAR = r"10\.\d{4,}/\S+", r"(?i)arXiv:(\d{4}\.\d{4,5})", r"\b(19|20)\d{2}\b"
#: Words left out of external search queries.
QUERY_STOPWORDS = """
the a an and or for of in on at to from with by as is are was were be been being this that these those it its we our your their
what which who how when where why can could should would may might must shall will do does did has have had having not no yes
all any some such same other into than then too very just also only about over after before between both each few more most much
through while paper papers work related similar find
""".split()


def _found(text: Column, pattern: str, group: int = 0) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def doi(text: Column) -> Column:
    return _found(text, DOI)


def arxiv_id(text: Column) -> Column:
    return _found(text, ARXIV, 1)


def year(text: Column) -> Column:
    return F.regexp_extract(text, YEAR, 0).try_cast("int")


def title(text: Column) -> Column:
    """The first capitalised line, else the first line before a blank one, of 10 to
    200 characters, that is no address."""
    lines = [clean(F.regexp_extract(text, p, 1)) for p in (r"(?m)^([A-Z][^\n]{10,200})\n", r"(?m)^(.{10,200}?)\n\n")]
    fit = [F.when(F.length(x).between(10, 200) & ~F.startswith(x, F.lit("http")), x) for x in lines]
    return F.coalesce(*fit)


def abstract(text: Column) -> Column:
    return F.coalesce(*[clean(_found(text, rf"(?is){w}[:\s]+(.{{50,2000}}?)(?:\n\n|keywords|introduction)", 1)) for w in ("abstract", "summary")])


def authors_after(text: Column, title_: Column) -> Column:
    """Up to five pairs of capitalised words between the title and character 500."""
    at = F.instr(text, title_)
    part = F.substr(text, at + F.length(title_), F.greatest(F.lit(0), F.lit(500) - F.length(title_)))
    names = F.regexp_extract_all(part, F.lit(r"([A-Z][a-z]+\s+[A-Z][a-z]+)"), F.lit(1))
    return F.when((at > 0) & (F.size(names) > 0), F.array_join(F.slice(names, 1, 5), ", "))


def safe_name(name: Column) -> Column:
    """A string fit for a file name, at most 200 characters; "unnamed" if none is left."""
    x = F.regexp_replace(name, r'[<>:"/\\|?*]', "")
    x = F.regexp_replace(x, r"\s+", "_")
    x = F.regexp_replace(x, r"[^\p{L}\p{N}\-_.]", "")
    x = F.regexp_replace(F.regexp_replace(x, "_+", "_"), r"^[._]+|[._]+$", "")
    return F.coalesce(F.nullif(F.substring(x, 1, 200), F.lit("")), F.lit("unnamed"))


def last_name(author: Column) -> Column:
    """The last word before the first comma."""
    words = F.filter(F.split(F.trim(F.split(author, ",")[0]), r"\s+"), lambda w: w != "")
    return F.coalesce(F.try_element_at(words, F.lit(-1)), F.lit("unknown"))


def author_label(authors: Column) -> Column:
    """Last names of the first two, and _et_al for more."""
    parts = F.transform(F.split(authors, ","), lambda a: F.trim(a))
    names = F.array_join(F.transform(F.slice(parts, 1, 2), last_name), "_")
    label = F.concat(names, F.when(F.size(parts) > 2, "_et_al").otherwise(""))
    return F.when(F.coalesce(authors, F.lit("")) == "", "unknown").otherwise(safe_name(label))


def file_name(pattern: str, *, year: Column, authors: Column, title: Column, doi: Column, arxiv_id: Column) -> Column:
    """``pattern`` with {year} {first_author} {authors} {title} {short_title} {doi}
    {arxiv_id} filled, "unknown" for what is missing, and .pdf at its end."""
    unknown = lambda c: F.coalesce(F.nullif(c, F.lit("")), F.lit("unknown"))
    values = {
        "year": unknown(year.cast("string")),
        "first_author": unknown(F.when(F.coalesce(authors, F.lit("")) != "", last_name(authors))),
        "authors": author_label(authors),
        "title": safe_name(title),
        "short_title": safe_name(F.substring(title, 1, 50)),
        "doi": safe_name(doi),
        "arxiv_id": unknown(F.replace(arxiv_id, F.lit("."), F.lit("_"))),
    }
    out = F.lit(pattern)
    for key, value in values.items():
        out = F.replace(out, F.lit("{" + key + "}"), value)
    return out if pattern.endswith(".pdf") else F.concat(out, F.lit(".pdf"))


def normal_arxiv(raw: Column) -> Column:
    """Lower case without the arxiv: prefix and the version."""
    return F.regexp_replace(F.trim(F.regexp_replace(F.lower(F.trim(raw)), "^arxiv:", "")), r"v\d+$", "")


def arxiv_from_url(url: Column) -> Column:
    return normal_arxiv(F.regexp_extract(url, r"(?i)arxiv\.org/abs/([^?\s#]+)", 1))


def search_query(text: Column, most: int = 14) -> Column:
    """An external search for the first distinct words that mean something."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"[a-z][a-z0-9+\-]+"), F.lit(0))
    stop = F.array(*map(F.lit, QUERY_STOPWORDS))
    terms = F.slice(F.array_distinct(F.filter(words, lambda w: ~F.array_contains(stop, w))), 1, most)
    return F.when(F.size(terms) > 0, F.concat(F.lit("all:"), F.array_join(terms, "+"))).otherwise("all:learning")


def comparison_key(ids: Column, section: Column | None = None) -> Column:
    """Cache key of a set of papers, in any order, and a section."""
    joined = F.array_join(F.transform(F.array_sort(ids), lambda i: i.cast("string")), ",")
    return F.sha2(joined if section is None else F.concat_ws(":", joined, section), 256)


def search_key(query: Column, most: int) -> Column:
    """Cache key of an external search."""
    return F.sha2(F.concat(query, F.lit(f"\n{most}")), 256)


def limit_kind(message: Column) -> Column:
    """Whether a refusal for load holds for the day (rpd) or the minute (rpm)."""
    low = F.lower(message)
    return F.when(F.contains(low, F.lit("per day")) | F.contains(low, F.lit("rpd")), "rpd").otherwise("rpm")


def retry_seconds(message: Column) -> Column:
    """Whole seconds to wait, from "try again in Xs" or "Xms"; 60 if not said."""
    amount = F.regexp_extract(message, r"(?i)try again in (\d+(?:\.\d+)?)(m?s)", 1).try_cast("double")
    unit = F.lower(F.regexp_extract(message, r"(?i)try again in (\d+(?:\.\d+)?)(m?s)", 2))
    seconds = F.when(unit == "ms", amount / 1000).otherwise(amount)
    return F.when(amount.isNull(), 60).otherwise(F.greatest(F.lit(1), F.floor(seconds).cast("int") + 1))


#: Labels of a paper profile, in their order.
PROFILE = ("PROBLEM", "METHODOLOGY", "FINDINGS", "CONTRIBUTIONS", "LIMITATIONS", "SUMMARY")


def profile_field(text: Column, label: str) -> Column:
    """What stands between a label and the next; "" if either is missing."""
    i = PROFILE.index(label)
    end = rf"(?={PROFILE[i + 1]}:)" if i + 1 < len(PROFILE) else "$"
    return F.trim(F.regexp_extract(text, rf"(?is){label}:\s*(.*?)\s*{end}", 1))


def first_paragraph(text: Column) -> Column:
    return F.split(text, "\n\n")[0]


def cut_with_dots(text: Column, most: int) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("..."))).otherwise(text)


def themes(answers: DataFrame) -> DataFrame:
    """(id, theme, description, paper_id) of answers (id, text) that list themes in
    blocks parted by rules; a block without a name gives nothing."""
    b = answers.select("id", F.explode(F.split("text", "-{3,}")).alias("b"))
    field = lambda label: F.trim(F.regexp_extract("b", rf"{label}:\s*(.+)", 1))
    ids = F.regexp_extract_all(F.regexp_extract("b", r"PAPERS:\s*(.+)", 1), F.lit(r"\d+"), F.lit(0))
    t = b.select("id", field("THEME").alias("theme"), field("DESCRIPTION").alias("description"), ids.alias("ids")).where("theme <> ''")
    return t.select("id", "theme", "description", F.explode("ids").alias("p")).select("id", "theme", "description", F.col("p").try_cast("bigint").alias("paper_id"))


def themes_or_all(answers: DataFrame, papers: DataFrame) -> DataFrame:
    """(id, theme, description, paper_id): the themes of each answer (id, text) with those
    of its papers (id, paper_id) that they name; where an answer has no theme, one theme
    of all its papers."""
    found = themes(answers)
    named = found.join(papers, ["id", "paper_id"], "left_semi").select("id", "theme", "description", "paper_id").distinct()
    rest = papers.join(found.select("id").distinct(), "id", "left_anti")
    return named.unionByName(rest.select("id", F.lit("Overview of the Literature").alias("theme"), F.lit("A synthesis of all reviewed papers.").alias("description"), "paper_id"))


def email(text: Column) -> Column:
    return _found(text, r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}")


#: Fixed value: what asks for a review of the literature.
REVIEW = r"(?i)\b(literature\s+review|lit\s+review|write\s+a\s+review|review\s+(the\s+)?literature|systematic\s+review)\b"


def topic(question: Column) -> Column:
    """What a review is asked about, without the words that ask for it and the papers named."""
    t = question
    for pattern in (REVIEW, r"(?i)\b(on|about|for|of|the)\b", r"(?i)\bpapers?\s+\d+(?:[,\s]+\d+)*"):
        t = F.regexp_replace(t, pattern, "")
    t = F.regexp_replace(F.regexp_replace(t, r"\s+", " "), r"^[ .,?]+|[ .,?]+$", "")
    return F.when(t == "", "Research Library").otherwise(t)


def merged(embedded: Column, found: Column) -> Column:
    """A field of a file's own metadata, or what was found in its text."""
    return F.coalesce(F.nullif(F.trim(embedded), F.lit("")), found)
