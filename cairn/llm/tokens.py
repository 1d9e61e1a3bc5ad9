"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.runtime import arrow_map, spread

#: Vocabulary of byte-level BPE ranks; a parameter of every function here.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How a text is cut into words before the pairs of each are merged (fixed value: the vocabulary's own pattern).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

@lru_cache(maxsize=2)
def encoder(vocabulary: str):
    import tiktoken

    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding(os.path.basename(vocabulary), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count(text: str | None, vocabulary: str = VOCABULARY) -> int:
    """Tokens of text, whole, whatever its length; 0 for null and empty texts."""
    if not text:
        return 0
    return len(encoder(vocabulary).encode_ordinary(text))


def prompt_end(text: str) -> int:
    """Where the first line that isn't blank ends: the part of an example that bears no loss."""
    start = len(text) - len(text.lstrip())
    end = text.find("\n", start)
    return len(text) if end < 0 else end + 1


def token_counts(documents: DataFrame, keep: tuple[str, ...] = (), vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, the columns of keep, tokens, loss_tokens (those after the first line) of each document, once.

    Null ids are left out; null and empty texts have 0 tokens. Whole texts are tokenized where they lie; repeated
    rows of one id count once (the one with most tokens).
    """
    rows = documents.select(F.col("doc_id").cast("long"), *keep, "text").where(F.col("doc_id").isNotNull())
    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[1:-1]]

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens, loss = [], []
            for text in batch.column(batch.num_columns - 1).to_pylist():
                n = count(text, vocabulary)
                tokens.append(n)
                loss.append(max(0, n - count(text[: prompt_end(text)], vocabulary)) if n else 0)
            columns = [batch.column(k) for k in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(tokens, pa.int64()), pa.array(loss, pa.int64())], names=[*batch.schema.names[:-1], "tokens", "loss_tokens"])

    sized = arrow_map(spread(rows), counted, ", ".join(["doc_id bigint", *kept, "tokens bigint", "loss_tokens bigint"]))
    largest = F.max(F.struct("tokens", "loss_tokens", *keep))
    return sized.groupBy("doc_id").agg(largest.alias("s")).select("doc_id", *(F.col(f"s.{c}").alias(c) for c in keep), "s.tokens", "s.loss_tokens")
