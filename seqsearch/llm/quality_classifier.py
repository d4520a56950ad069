"""Quality by nearest-neighbour voting in a latent-semantic space.

1. A text's *terms* are its words, lower-cased and hashed; and beside them pairs and triples of neighbouring character classes
   (letters by case, digits, each ASCII mark, white space), hashed, and a few facts about its words: repeats, share of
   distinct words, length. The whole text counts.
2. A bounded sample of labelled documents (``SAMPLE`` rows, in the order of a hash of their ids) is turned into tf-idf
   vectors, and these are reduced to ``DIMS`` latent dimensions by subspace iteration.
3. Projection and sample vectors, of a size fixed by these parameters, are broadcast; every document's cosine with every
   sample vector is computed in blocks, and its ``NEIGHBOURS`` nearest vote with the labels, weighed by similarity.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import tidy

SAMPLE = 4000
DIMS = 48
NEIGHBOURS = 25
#: A neighbour's weight is its similarity to this power: near ones count, far ones hardly.
POWER = 16
HELD_OUT = 5

_MARKS = b"!\"#$%&'()*+,-./:;<=>?@[]^_{|}~"
_KINDS = 6 + len(_MARKS)
_TRIPLES = 1024
_FACTS = 24
_SHAPES = _KINDS * _KINDS + _TRIPLES + _FACTS
_WORDS = 4096
#: Shapes come first, then words.
TERMS = _SHAPES + _WORDS
#: A word is what stands between marks, digits and white space.
_SPLIT = bytes(b if chr(b).isalpha() or b >= 128 else 32 for b in range(256))


def _classes() -> np.ndarray:
    """A class for each byte: 0 letter, 1 capital, 2 digit, 3 space, 4 line feed, 5 other white space and controls, then marks."""
    kind = np.zeros(256, np.int64)
    kind[:128] = 5
    kind[ord("a") : ord("z") + 1] = 0
    kind[ord("A") : ord("Z") + 1] = 1
    kind[ord("0") : ord("9") + 1] = 2
    kind[ord(" ")], kind[ord("\n")] = 3, 4
    for i, mark in enumerate(_MARKS):
        kind[mark] = 6 + i
    return kind


_KIND = _classes()


def terms(text: str | None) -> np.ndarray:
    """Counts of a text's terms; of an empty one all 0."""
    data = (text or "").encode()
    out = np.zeros(TERMS, np.float32)
    if not data.strip():
        return out
    kind = _KIND[np.frombuffer(data, np.uint8)]
    # runs of one class are told by up to three of it, so long words don't outweigh all else
    if len(kind) > 3:
        same = kind[1:] == kind[:-1]
        kind = kind[np.concatenate([[True, True], ~(same[1:] & same[:-1])])]
    pairs = kind[:-1] * _KINDS + kind[1:]
    out[: _KINDS * _KINDS] = np.bincount(pairs, minlength=_KINDS * _KINDS)
    if len(kind) > 2:
        triples = ((pairs[:-1] * _KINDS + kind[2:]) * 2654435761 >> 7) % _TRIPLES
        out[_KINDS * _KINDS : _KINDS * _KINDS + _TRIPLES] = np.bincount(triples, minlength=_TRIPLES)
    found = data.split()
    n, at = len(found), _KINDS * _KINDS + _TRIPLES
    distinct = len(set(found))
    again = sum(map(eq, found, found[1:]))
    # facts are given the weight of a share of all words, so that they don't fade in long texts
    out[at] = again
    out[at + 1] = sum(map(eq, found, found[2:]))
    out[at + 2 + min(9, 10 * distinct // (n + 1))] = n * (0.2 if n < 40 else 0.5)
    out[at + 12 + min(9, int(np.log2(n + 1)))] = n * 0.1
    spoken = (text or "").lower().encode().translate(_SPLIT).split()
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, spoken), np.uint64, len(spoken))
    out[_SHAPES:] = np.bincount((hashes % np.uint64(_WORDS)).astype(np.int64), minlength=_WORDS)
    return out


def packed(counts: np.ndarray) -> bytes:
    """The places of counts that aren't 0, and these."""
    at = np.flatnonzero(counts).astype(np.uint16)
    return at.tobytes() + counts[at].tobytes()


def unpacked(rows: list[bytes]) -> np.ndarray:
    out = np.zeros((len(rows), TERMS), np.float32)
    for row, data in zip(out, rows, strict=True):
        n = len(data) // 6
        row[np.frombuffer(data[: 2 * n], np.uint16)] = np.frombuffer(data[2 * n :], np.float32)
    return out


def weigh(counts: np.ndarray, idf: np.ndarray | None = None, out: np.ndarray | None = None) -> np.ndarray:
    """Shares of shapes and of words, square roots taken, times idf, each part and then the whole of length 1; empty rows stay 0.
    ``out`` may be ``counts`` itself."""
    out = np.empty(counts.shape, np.float32) if out is None else out
    for at in range(0, len(counts), 256):
        for part in (slice(0, _SHAPES), slice(_SHAPES, TERMS)):
            own = counts[at : at + 256, part]
            x = np.sqrt(own / np.maximum(own.sum(axis=1, keepdims=True), 1e-9))
            if idf is not None:
                x *= idf[part]
            out[at : at + 256, part] = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
        out[at : at + 256] /= np.maximum(np.linalg.norm(out[at : at + 256], axis=1, keepdims=True), 1e-9)
    return out


class Model:
    """idf, projection, and the sample's latent vectors with their labels. With ``reuse`` the counts are overwritten."""

    def __init__(self, counts: np.ndarray, labels: np.ndarray, reuse: bool = False):
        n = len(counts)
        self.base = float(labels.mean()) if n else 0.5
        self.idf = (1 + np.log((1 + n) / (1 + (counts > 0).sum(axis=0)))).astype(np.float32)
        x = weigh(counts, self.idf, counts if reuse else None)
        q = np.random.Generator(np.random.PCG64(5)).standard_normal((TERMS, DIMS)).astype(np.float32)
        for _ in range(8):
            q, _ = np.linalg.qr(x.T @ (x @ q)) if n else (q, None)
        self.projection = q.astype(np.float32)
        self.vectors, self.labels = self._placed(x), labels.astype(np.float32)

    def latent(self, counts: np.ndarray) -> np.ndarray:
        return self._placed(weigh(counts, self.idf))

    def _placed(self, x: np.ndarray) -> np.ndarray:
        y = x @ self.projection
        return (y / np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-9)).astype(np.float32)

    def score(self, counts: np.ndarray) -> np.ndarray:
        """Shares of label 1 among the nearest of the sample; without terms or sample the sample's share."""
        out = np.full(len(counts), self.base)
        k = min(NEIGHBOURS, len(self.labels))
        known = np.flatnonzero(counts.sum(axis=1) > 0)
        if not k or not len(known):
            return out
        near = self.latent(counts[known]) @ self.vectors.T
        last = np.partition(near, len(self.labels) - k, axis=1)[:, [len(self.labels) - k]]
        row, best = np.nonzero(near >= last)  # all that tie with the last one count
        weight = np.maximum(near[row, best], 0).astype(np.float64) ** POWER + 1e-12
        out[known] = np.bincount(row, weight * self.labels[best], len(near)) / np.bincount(row, weight, len(near))
        return np.clip(out, 0, 1)


def held_out(id_col: str = "doc_id"):
    """Rows whose labels are never learnt from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % HELD_OUT == 0, F.lit(True))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> Model:
    """Learns from at most ``sample`` labelled documents that aren't held out, taken in the order of a hash of their ids.

    Null labels and ids are left out; of several labels of an id the largest holds, of several texts of an id one counts.
    Null and empty texts are texts without terms. Without any labelled document all scores are 0.5. Other columns of either
    table are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array([packed(terms(t)) for t in part.column(1).to_pylist()], pa.binary())], names=["id", "label", "terms"])

    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col)).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("label"))
    chosen = known.orderBy(F.xxhash64("id"), "id").limit(sample)
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(chosen), "id").select("id", "text", "label")
    made = source.mapInArrow(tidy(run), f"id {source.schema['id'].dataType.simpleString()}, label int, terms binary")
    # of rows that repeat an id one counts, whatever the order they come in, so the sample is of different documents
    rows = sorted((r["id"], r["label"], bytes(r["terms"])) for r in made.groupBy("id").agg(F.max("label").alias("label"), F.min("terms").alias("terms")).collect())
    return Model(unpacked([r[2] for r in rows]), np.array([r[1] for r in rows], np.float32), reuse=True)


def classify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", least: float = 0.3, keep: bool = False) -> DataFrame:
    """``id, held_out, score, predicted`` of every row; with ``keep`` instead the rows that reach ``least``, as they are.

    The score depends on the text alone, read whole, however long. Sample documents that tie with the last neighbour all
    vote. Null, empty and blank texts have the sample's share of label 1. Null ids
    stay null and count as held out, repeated rows stay repeated, an empty table gives an empty one. Without ``keep`` other
    columns are not read; with it they are carried, whatever their names.
    """
    name = "_score"
    while keep and name in docs.columns:
        name += "_"
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            texts = batch.column(at).to_pylist()
            scores = [own.score(np.stack([terms(t) for t in texts[i : i + 512]])) for i in range(0, len(texts), 512)]
            made = np.concatenate(scores) if scores else np.empty(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.float64())] if keep else [batch.column(0), pa.array(made, pa.float64())], names=[*batch.schema.names, name] if keep else ["id", name])

    if keep:
        return docs.mapInArrow(tidy(run), T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])).where(F.col(name) >= least).drop(name)
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias(text_col))
    made = source.mapInArrow(tidy(run), f"id {source.schema['id'].dataType.simpleString()}, _score double")
    return made.select(F.col("id").alias(id_col), held_out("id").alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= least).cast("int").alias("predicted"))
