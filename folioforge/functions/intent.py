"""What a question asks for, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Patterns by which questions are told apart, matched in lower case.
COMPARISON = [r"\bcompare\b", r"\bcomparison\b", r"\bversus\b", r"\bvs\.?\b", r"\bdifference[s]?\b", r"\bcontrast\b", r"\bsimilarit(?:y|ies)\b", r"\bhow\s+(?:do|does)\s+(?:.*?)\s+differ\b", r"\bwhat(?:'s| is)\s+the\s+difference\b"]
SIMILAR = [r"\bsimilar\s+papers?\b", r"\brelated\s+work\b", r"\brelated\s+papers?\b", r"\bpapers?\s+similar\b", r"\bpapers?\s+like\b", r"\bmore\s+papers?\s+(?:on|about|like)\b", r"\bfind\s+similar\b", r"\bsuggestions?\s+for\s+related\b", r"\bwhat\s+else\s+(?:to\s+)?read\b", r"\barxiv\s+(?:for\s+)?(?:similar|related)\b", r"\bother\s+papers?\s+(?:on|about)\b"]
LIST_SECTIONS = [r"\blist\s+(?:the\s+)?sections?\b", r"\bshow\s+(?:me\s+)?(?:the\s+)?sections?\b", r"\bwhat\s+sections?\s+(?:does|do|are\s+in|are\s+there)\b", r"\bwhich\s+sections?\s+(?:does|do|are\s+in|are\s+there)\b", r"\bsections?\s+(?:does|do)\s+(?:this|the)\s+paper\s+have\b", r"\bwhat(?:'s| is| are)\s+(?:the\s+)?sections?\s+(?:in|of)\b", r"\bsections?\s+(?:in|of)\s+(?:this|the)\s+paper\b", r"\btable\s+of\s+contents?\b", r"\bpaper\s+structure\b", r"\bhow\s+is\s+(?:this\s+|the\s+)?paper\s+(?:organized|structured|divided)\b"]
SUMMARIZE = [r"\b(?:summari[sz]e?|summarise|give\s+(?:me\s+)?(?:a\s+)?(?:summary|overview)|what\s+is\s+(?:this|the)\s+paper|explain\s+(?:this|the|paper)|describe\s+(?:this|the)\s+paper|tldr|tl;?dr)\b"]
#: How papers are named in a question, in the order of search.
PAPER_IDS = [r"\[(\d+)\]", r"(?i)\bpaper\s+(?:id\s*)?(\d+)", r"\b#(\d+)\b", r"(?i)\bid\s*(\d+)"]
#: Sections a question may name, the first that fits.
SECTIONS = {"abstract": r"\babstract\b", "introduction": r"\bintro(?:duction)?\b", "methodology": r"\bmethodolog(?:y|ies)\b|\bmethods?\b", "results": r"\bresults?\b|\bfindings?\b", "discussion": r"\bdiscussion\b", "conclusion": r"\bconclusions?\b", "related": r"\brelated\s+work\b", "background": r"\bbackground\b", "experiment": r"\bexperiments?\b"}


def asks(question: Column, patterns: list[str]) -> Column:
    return F.lower(question).rlike("|".join(patterns))


def paper_ids(question: Column) -> Column:
    """Ids named, pattern by pattern, each once; ids beyond bigint are left out."""
    found = F.concat(*[F.regexp_extract_all(question, F.lit(p), F.lit(1)) for p in PAPER_IDS])
    return F.array_distinct(F.filter(F.transform(found, lambda x: x.try_cast("bigint")), lambda x: x.isNotNull()))


def section_named(question: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, pattern in reversed(SECTIONS.items()):
        out = F.when(F.lower(question).rlike(pattern), name).otherwise(out)
    return out


def dispatch(question: Column) -> Column:
    """Which plan answers the question: compare, similar, list_sections,
    summarize_section, summarize or qa."""
    n = F.size(paper_ids(question))
    one = (n == 1) & asks(question, SUMMARIZE)
    return (
        F.when(asks(question, COMPARISON) & (n >= 2), "compare").when(asks(question, SIMILAR), "similar")
        .when(asks(question, LIST_SECTIONS), "list_sections").when(one & section_named(question).isNotNull(), "summarize_section")
        .when(one, "summarize").otherwise("qa")
    )


#: Sections as a comparison may name them, the first that fits.
SECTION_FORMS = {
    "abstract": [r"\babstract[s]?\b"],
    "introduction": [r"\bintroduction\b", r"\bintro\b"],
    "methodology": [r"\bmethodolog(?:y|ies)\b", r"\bmethod[s]?\b", r"\bapproach(?:es)?\b"],
    "results": [r"\bresult[s]?\b", r"\bfinding[s]?\b"],
    "discussion": [r"\bdiscussion[s]?\b"],
    "conclusion": [r"\bconclusion[s]?\b", r"\bsummar(?:y|ies)\b"],
    "references": [r"\breference[s]?\b", r"\bcitation[s]?\b", r"\bbibliograph(?:y|ies)\b"],
}


def section_compared(question: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, forms in reversed(SECTION_FORMS.items()):
        out = F.when(asks(question, forms), name).otherwise(out)
    return out


def comparison_requests(questions: DataFrame, known: DataFrame) -> DataFrame:
    """(id, question, kind, named, known) of questions (id, question) that ask to compare
    at least two papers of those known (paper_id): of a section or of the whole papers."""
    q = F.col("question")
    asked = questions.where(asks(q, COMPARISON)).withColumn("ids", paper_ids(q)).where(F.size("ids") >= 2)
    there = asked.select("id", "question", F.explode("ids").alias("paper_id")).join(known, "paper_id").groupBy("id", "question").agg(F.count("*").cast("int").alias("known"))
    kind = F.when(section_compared(q).isNull(), "whole").otherwise("section")
    return asked.join(there, ["id", "question"]).where("known >= 2").select("id", "question", kind.alias("kind"), F.size("ids").alias("named"), "known")
