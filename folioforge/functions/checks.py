"""Checks of arguments, notes and stored values."""

from __future__ import annotations

import shutil

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bounds of arguments and of what a note may hold.
TOP_K, LIMIT, QUERY = (1, 100), (1, 10_000), (1, 500)
SORTS = ("indexed_at", "year", "title")
NOTE_QUESTION, NOTE_ANSWER, NOTE_BYTES, FREE_BYTES = 10_000, 50_000, 5 * 1024 * 1024, 10 * 1024 * 1024


def note_is_sound(question: Column, answer: Column, papers: Column, note: Column) -> Column:
    """Neither side blank nor too long, at least one paper, and a note of a size that is kept."""
    said = lambda c: F.length(F.regexp_replace(F.coalesce(c, F.lit("")), r"^[ \t\r\n]+|[ \t\r\n]+$", "")) > 0
    fits = (F.length(question) <= NOTE_QUESTION) & (F.length(answer) <= NOTE_ANSWER)
    return said(question) & said(answer) & fits & (F.size(papers) > 0) & (F.octet_length(F.coalesce(note, F.lit(""))) <= NOTE_BYTES)


def is_json(text: Column) -> Column:
    """Whether a stored value reads back as JSON; other text is text."""
    return F.try_parse_json(text).isNotNull() & (F.trim(text) != "")


def between(name: str, value: int, bounds: tuple[int, int]) -> int:
    if isinstance(value, bool) or not isinstance(value, int) or not bounds[0] <= value <= bounds[1]:
        raise ValueError(f"{name} must be a whole number from {bounds[0]} to {bounds[1]}")
    return value


def positive(name: str, value: int, least: int = 1) -> int:
    if isinstance(value, bool) or not isinstance(value, int) or value < least:
        raise ValueError(f"{name} must be a whole number of {least} or more")
    return value


def sort_by(value: str) -> str:
    if value not in SORTS:
        raise ValueError(f"sort by one of {', '.join(SORTS)}")
    return value


def search_text(value: str) -> str:
    text = (value or "").strip()
    between("length of the query", len(text), QUERY)
    return text


def has_room(folder: str, needed: int = FREE_BYTES) -> bool:
    return shutil.disk_usage(folder).free >= needed
