"""File sources: scans of folders with content hashes, external feeds, adapters."""

from __future__ import annotations

import fnmatch
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Fixed value: characters that are no blanks, up to which a parser has found no text.
FEW = 100
#: Files that are left out unless told otherwise.
IGNORED = (".*", "~*", "*.tmp")


def _glob(pattern: str) -> str:
    """A regular expression for the last parts of a path, as many as the glob has; *
    stays within a part."""
    inner = (fnmatch.translate(p).removeprefix("(?s:").rpartition(")")[0] for p in pattern.strip("/").split("/"))
    return "(^|/)" + "/".join(inner).replace(".*", "[^/]*") + "$"


def scan_folder(spark: SparkSession, folder: str, pattern: str = "*.{pdf,PDF}", recursive: bool = True, ignored: tuple[str, ...] = IGNORED) -> DataFrame:
    """(path, file_hash, size, modified) of the files that match and that no glob of
    ``ignored`` fits, compared with the last parts of the path."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower()).load(folder)
    for g in ignored:
        files = files.where(~F.col("path").rlike(_glob(g)))
    return files.select("path", F.sha2("content", 256).alias("file_hash"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def parse_files(spark: SparkSession, folder: str, parser: Callable[[bytes], str], pattern: str = "*", fallback: Callable[[bytes], str] | None = None, metadata: Callable[[bytes], dict] | None = None) -> DataFrame:
    """(path, text, error, title, authors, publication): the injected parser over each
    file, the second one where the first finds hardly any text, and the file's own
    fields. A file that cannot be read has an error instead of a text."""
    fields = ("title", "authors", "publication")

    def read(content: bytes) -> tuple[str | None, str | None]:
        text = error = None
        for parse in (parser, fallback):
            if parse is None or text is not None and len("".join(text.split())) > FEW:
                continue
            try:
                new = parse(content)
                text, error = (new, None) if text is None or len(new or "") > len(text) else (text, error)
            except Exception as e:  # noqa: BLE001 - one bad file does not stop the run
                error = None if text is not None else str(e)
        return text, error

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for path, content in zip(f.path, f.content, strict=True):
                try:
                    own = metadata(bytes(content)) if metadata else {}
                except Exception:  # noqa: BLE001
                    own = {}
                rows.append((path, *read(bytes(content)), *(own.get(k) for k in fields)))
            yield pd.DataFrame(rows, columns=["path", "text", "error", *fields])

    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    return files.select("path", "content").mapInPandas(run, "path string, text string, error string, title string, authors string, publication string")


def atom_entries(feeds: DataFrame, most: int = 2000) -> DataFrame:
    """(feed, n, external_id, title, summary) of Atom feeds (feed, xml); entries
    without an identifier, and feeds that are no XML, give nothing."""
    import xml.etree.ElementTree as ET

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ns = {"a": "http://www.w3.org/2005/Atom"}
        for f in frames:
            rows = []
            for feed, xml in zip(f.feed, f.xml, strict=True):
                try:
                    entries = ET.fromstring(xml).findall("a:entry", ns)
                except (ET.ParseError, TypeError):
                    continue
                for n, e in enumerate(entries):
                    url, title, text = (" ".join((e.findtext(f"a:{x}", "", ns) or "").split()) for x in ("id", "title", "summary"))
                    if "/abs/" in url:
                        rows.append((feed, n, url, title, text[:most]))
            yield pd.DataFrame(rows, columns=["feed", "n", "url", "title", "summary"])

    from folioforge.functions.extract import arxiv_from_url

    return feeds.select("feed", "xml").mapInPandas(run, "feed string, n int, url string, title string, summary string").select(
        "feed", "n", arxiv_from_url(F.col("url")).alias("external_id"), "title", "summary"
    )
