"""Problem 6 as DataFrame operators."""

from __future__ import annotations

from pyspark.sql import DataFrame

from presswork.llm import bpe
from presswork.session import spread


def _two(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return spread(docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")))


def token_ids(docs: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids: one row per input row. Null and empty texts have an empty list; repeated rows
    stay repeated; a null id stays null; other columns are ignored whatever their names."""
    path = vocabulary or bpe.default_vocabulary()
    return _two(docs, id_col, text_col).mapInArrow(lambda b: bpe.encode_batches(b, path), "doc_id bigint, ids array<int>")


def token_counts(docs: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens: as token_ids, with only the number of ids."""
    path = vocabulary or bpe.default_vocabulary()
    return _two(docs, id_col, text_col).mapInArrow(lambda b: bpe.count_batches(b, path), "doc_id bigint, n_tokens bigint")


def token_round_trip(docs: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, same: whether the ids, decoded in parts, give the text back."""
    path = vocabulary or bpe.default_vocabulary()
    return _two(docs, id_col, text_col).mapInArrow(lambda b: bpe.round_trip_batches(b, path), "doc_id bigint, n_tokens bigint, same boolean")
