"""Reading names: lists of authors as they are typed, and plain forms of text."""

from __future__ import annotations

import json
import re
import unicodedata

_ET_AL = re.compile(r"(?:^|[\s,;&]+)et\.?\s+al\.?\s*$", re.I)
_AND = re.compile(r"\s+(?:and|&)\s+|^\s*(?:and|&)\s+")


def author_names(field: str | None) -> list[str]:
    """The names of a list: a JSON array, or parted by ";", or by "," with "and" or "&"
    possibly before the last. Trimmed, otherwise as typed; "et al." is no name."""
    if not field or not field.strip():
        return []
    text = field.strip()
    parts = None
    if text.startswith("["):
        try:
            parts = [x for x in json.loads(text) if isinstance(x, str)]
        except ValueError:
            parts = None
    if parts is None:
        parts = text.split(";") if ";" in text else [y for x in text.split(",") for y in _AND.split(x)]
        parts = [_ET_AL.sub("", re.sub(r"^\s*(?:and|&)\s+", "", x)) for x in parts]
    return [x.strip() for x in parts if x.strip() and not _ET_AL.fullmatch(x.strip())]


def fold(text: str) -> str:
    """Lower case without accents."""
    if text.isascii():
        return text.lower()
    return "".join(c for c in unicodedata.normalize("NFKD", text.lower()) if not unicodedata.combining(c))


def plain_words(text: str | None) -> list[str]:
    return re.findall(r"[^\W_]+", fold(text or ""))
