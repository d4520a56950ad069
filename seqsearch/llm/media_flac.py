"""Media columns: bytes kept as FLAC streams in a binary column, and read back with all checksums verified.

Encoding and decoding are two Arrow functions of one stage: no shuffle, and memory bounded by groups of documents of
about ``GROUP`` bytes (a longer document makes a group of its own and is coded in slices of frames).
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import flac

GROUP = 1 << 20


def payload(text: str | None) -> bytes:
    """UTF-8 and spaces up to a positive multiple of the block; null: as the empty text."""
    data = (text or "").encode()
    return data + b" " * (max(1, -(-len(data) // flac.BLOCK)) * flac.BLOCK - len(data))


def _groups(batch: pa.RecordBatch, column: int):
    at, size = 0, 0
    lengths = [len(v.as_buffer()) if v.is_valid else 0 for v in batch.column(column)]
    for i, n in enumerate(lengths):
        if i > at and size + n > GROUP:
            yield batch.slice(at, i - at)
            at, size = i, 0
        size += n
    if at < batch.num_rows:
        yield batch.slice(at)


def to_media(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n_bytes, media``: each row's text, padded with spaces to whole blocks, as a FLAC stream.

    Null and empty texts are one block of spaces. Null ids stay null, repeated rows stay repeated, an empty table
    gives an empty one; other columns are not read. A very long text is coded in slices of frames, with seek points for as
    many frames as their table has room for.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _groups(whole, 1):
                texts = batch.column(1).to_pylist()
                media = flac.encode([payload(t) for t in texts])
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len((t or "").encode()) for t in texts], pa.int64()), pa.array(media, pa.binary())], names=["id", "n_bytes", "media"])

    source = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(run, f"id {source.schema['id'].dataType.simpleString()}, n_bytes long, media binary").withColumnRenamed("id", id_col)


def feature(data: bytes) -> str:
    """Of the samples read back: blocks, least, largest, sum of squares, and changes of sign."""
    x = (np.frombuffer(data, np.uint8) ^ 0x80).view(np.int8).astype(np.int64)
    return f"{len(x) // flac.BLOCK}:{x.min()}:{x.max()}:{(x * x).sum()}:{int(((x[1:] < 0) != (x[:-1] < 0)).sum())}"


def read_media(df: DataFrame, id_col: str = "doc_id", data: bool = False) -> DataFrame:
    """Decodes ``media``: ``id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature``,
    with ``data`` the bytes too. A stream that is damaged ends the job; a null one gives nulls. Null ids stay null, repeated
    rows stay repeated, an empty table gives an empty one; other columns are not read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _groups(whole, 2):
                media = batch.column(2).to_pylist()
                decoded = iter(flac.decode([m for m in media if m is not None]))
                rows = []
                for m in media:
                    if m is None:
                        rows.append((None,) * 7)
                        continue
                    p = next(decoded)
                    rows.append((len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]), len(m), hashlib.sha256(m).hexdigest(), feature(p), p if data else None))
                columns = list(zip(*rows, strict=True))
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary())
                arrays = [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)][: 7 if data else 6]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *arrays], names=["id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "pcm"][: 9 if data else 8])

    source = df.select(F.col(id_col).alias("id"), "n_bytes", "media")
    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(run, f"id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string" + ", pcm binary" * data).withColumnRenamed("id", id_col)


def pcm_blocks(df: DataFrame, id_col: str = "doc_id", frames: int = 256) -> DataFrame:
    """Decodes ``media`` into PCM blocks: ``id, sample, n, pcm``, a row for each ``frames`` frames of a stream.

    ``sample`` is the offset of a block's first sample, so that a reader finds sample x in the block that begins at
    ``x - x % (192 * frames)``; ``pcm`` are ``n`` signed 8-bit samples. All checksums are verified, a stream that is damaged
    ends the job. A null stream has no blocks; null ids stay null, repeated rows give repeated blocks.
    """
    most = flac.BLOCK * frames

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _groups(whole, 1):
                media = batch.column(1).to_pylist()
                kept = [i for i, m in enumerate(media) if m is not None]
                for i, p in zip(kept, flac.decode([media[i] for i in kept]), strict=True):
                    signed = (np.frombuffer(p, np.uint8) ^ 0x80).tobytes()
                    at = list(range(0, len(signed), most))
                    parts = [signed[a : a + most] for a in at]
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([i] * len(at), pa.int64())), pa.array(at, pa.int64()), pa.array(list(map(len, parts)), pa.int64()), pa.array(parts, pa.binary())], names=["id", "sample", "n", "pcm"])

    source = df.select(F.col(id_col).alias("id"), "media")
    return source.mapInArrow(run, f"id {source.schema['id'].dataType.simpleString()}, sample long, n long, pcm binary").withColumnRenamed("id", id_col)
