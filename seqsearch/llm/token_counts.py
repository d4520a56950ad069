"""Token counts of texts, without the ids.

Texts go to Python in Arrow batches and only lengths come back. Work is balanced by bytes: the scan is
split by bytes, and within a task texts are encoded in groups of about the same number of bytes, long texts cut at safe
boundaries (see ``chunks``) so that no group grows with one text. No shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .chunks import PieceEncoder, by_size, distinct, groups, load


@lru_cache(maxsize=2)
def _encoder(path: str) -> PieceEncoder:
    return PieceEncoder(path, len)


@lru_cache(maxsize=2)
def _splittable(path: str) -> bool:
    """Only a byte-level pre-tokenizer without a normalizer allows the cuts of ``chunks``."""
    import json

    model = json.loads(load(path).to_str())
    pre = model["pre_tokenizer"] or {}
    return model["normalizer"] is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", False) and not pre["add_prefix_space"] and not model["post_processor"] and all(not t["lstrip"] and not t["rstrip"] and not t["single_word"] and not any(c.isspace() for c in t["content"]) for t in model["added_tokens"])


def counts(path: str, texts: pa.Array) -> np.ndarray:
    """Tokens of each text; null and empty: 0."""
    if not path.endswith(".model") and _splittable(path):
        out = np.zeros(len(texts), np.int64)
        for owner, part, at in groups(texts):
            found, codes = distinct(part, at)
            if found:
                lengths = np.array(_encoder(path).values(found), np.int64)
                out += np.bincount(owner, lengths[codes], len(texts)).astype(np.int64)
        return out
    made: list[int] = []
    for group in by_size([t or "" for t in texts.to_pylist()]):
        if path.endswith(".model"):
            made += [len(ids) for ids in _sentencepiece(path).encode(group, num_threads=1)]
        else:
            made += [len(e.ids) for e in load_once(path).encode_batch_fast(group, add_special_tokens=False)]
    return np.array(made, np.int64)


@lru_cache(maxsize=2)
def load_once(path: str):
    return load(path)


@lru_cache(maxsize=2)
def _sentencepiece(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def token_counts(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 512) -> DataFrame:
    """``id, n_bytes, n_tokens, over_limit`` of every row.

    ``path``: a tokenizers .json or a sentencepiece .model that every executor can open. No begin, end or
    added special tokens; special strings inside texts are handled as the library does by default.
    Null and empty texts have 0 bytes and 0 tokens. Very long texts are cut at safe boundaries and their parts' counts
    added, where the tokenizer allows it (byte-level, no normalizer); others are encoded whole. A null id stays null,
    repeated rows stay repeated, an empty table gives an empty one. There are no ties. Other columns are not read, so
    extra ones may have any names.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = counts(path, batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(made, pa.int64())], names=["id", "n_bytes", "n_tokens"])

    source = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"))
    schema = T.StructType([T.StructField("id", source.schema["id"].dataType), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])
    return source.mapInArrow(run, schema).select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
