"""Sizes of texts in tokens of a public tokenizer, for the packing and mixing operators."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A file of token ranks; a parameter everywhere, never copied here.
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Fixed value: how the vocabulary's tokenizer parts a text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(2)
def tokenizer(vocabulary: str) -> tiktoken.Encoding:
    """The tokenizer of a rank file, loaded once a worker."""
    with open(vocabulary, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def _counted(batches: Iterator[pa.RecordBatch], vocabulary: str) -> Iterator[pa.RecordBatch]:
    encode = tokenizer(vocabulary).encode_ordinary
    for batch in batches:
        if batch.num_rows:
            n = [len(encode(t)) if t else 0 for t in batch.column("text").to_pylist()]
            yield batch.drop_columns(["text"]).append_column("tokens", pa.array(n, pa.int64()))


def with_tokens(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """``documents`` with bigint ``tokens`` in place of ``text``; null texts have 0."""
    kept = [f for f in documents.schema.fields if f.name != "text"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", tokens bigint"
    ordered = documents.select(*[F.col(f"`{f.name}`") for f in kept], "text")
    return ordered.mapInArrow(lambda it: _counted(it, vocabulary), schema)
