"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

1. A text's *features* are its distinct words, pairs of neighbouring words, and pairs with one or two words between them, each a
   64-bit hash, so that hardly any two share one. Case doesn't count; the whole text does.
2. The model learns from a bounded sample of labelled documents (``SAMPLE``, in the order of a hash of their ids). Features of
   fewer than ``LEAST_DOCS`` of them are never weighed, and of the others the ``FEATURES`` most frequent are.
3. The sample is dealt out to ``SHARDS``; in each of ``EPOCHS`` rounds every shard's task goes on from the common state with
   FTRL-proximal steps (a learning rate for each coordinate, L1 and L2), and the driver takes the mean of the shards'
   states, which are no larger than the features.
4. L1 leaves few weights that aren't 0. These are broadcast, and every text is scored where it is read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, tidy
from .quality_classifier import held_out

SAMPLE, LEAST_DOCS, FEATURES = 12_000, 4, 1 << 17
SHARDS, EPOCHS = 8, 8
ALPHA, BETA, L1, L2 = 4.0, 1.0, 4.0, 0.1
#: Toxic documents are the rarer ones; each counts as so many.
RARE = 4.0
#: Words whose hashes a task holds at most, and bytes of text that are looked at together.
HELD_WORDS, TOGETHER = 200_000, 2 << 20
_WORDS = bytes(b if chr(b).isalnum() or b >= 128 else 32 for b in range(128)) + bytes(range(128, 256))
#: Odd multipliers, one for each kind of pair: the words between its two.
_KINDS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)


class _Hashes(dict):
    """Words to their hashes; forgets all when it is full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= HELD_WORDS:
            self.clear()
        self[word] = made = xxhash.xxh3_64_intdigest(word)
        return made


def features(texts: list[str | None], hashes: _Hashes) -> tuple[np.ndarray, np.ndarray]:
    """``(text, feature)`` of all words and pairs of some texts; repeats are left in, pairs never cross texts."""
    words = [(t or "").lower().encode().translate(_WORDS).split() for t in texts]
    n = np.array([len(w) for w in words], np.int64)
    h = np.fromiter((hashes[x] for w in words for x in w), np.uint64, int(n.sum()))
    text = np.repeat(np.arange(len(texts), dtype=np.int32), n)
    found, of = [h], [text]
    for gap, odd in enumerate(_KINDS, 1):
        first, second = h[:-gap], h[gap:]
        mixed = (first * np.uint64(odd)) ^ (second + np.uint64(gap))
        mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        inside = text[:-gap] == text[gap:]
        found.append((mixed ^ (mixed >> np.uint64(32)))[inside])
        of.append(text[:-gap][inside])
    return np.concatenate(of), np.concatenate(found)


def _some(texts: list[str | None]) -> Iterator[tuple[int, list[str | None]]]:
    """Texts a few MB at a time, with the place of the first."""
    begin, size = 0, 0
    for i, t in enumerate(texts):
        if i > begin and size + len(t or "") > TOGETHER:
            yield begin, texts[begin:i]
            begin, size = i, 0
        size += len(t or "")
    if begin < len(texts):
        yield begin, texts[begin:]


class Model:
    """Weights of the features that have one, in the order of their hashes, and the weight of every text."""

    def __init__(self, hashes: np.ndarray, weights: np.ndarray, bias: float):
        order = np.argsort(hashes)
        self.hashes, self.weights, self.bias = hashes[order], weights[order].astype(np.float64), bias

    def places(self, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the features have a weight, and where."""
        if not len(self.hashes):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.hashes, found), len(self.hashes) - 1)
        known = np.flatnonzero(self.hashes[at] == found)
        return known, at[known]

    def score(self, texts: list[str | None], hashes: _Hashes) -> np.ndarray:
        out = np.full(len(texts), self.bias)
        for begin, some in _some(texts):
            of, found = features(some, hashes)
            known, at = self.places(found)
            n = max(1, len(self.hashes))
            pairs = np.unique(of[known].astype(np.int64) * n + at)
            out[begin : begin + len(some)] += np.bincount(pairs // n, self.weights[pairs % n], len(some))
        return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def weights(z: np.ndarray, n: np.ndarray, l1: float = L1) -> np.ndarray:
    return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((BETA + np.sqrt(n)) / ALPHA + L2))


def ftrl(z: np.ndarray, n: np.ndarray, values: np.ndarray, rows: list[np.ndarray], labels: list[int]) -> None:
    """FTRL-proximal steps through ``rows`` (places of the features of each) in place; the last place is the bias, without L1.
    A feature has the same value in all texts that have it."""
    for at, label in zip(rows, labels, strict=True):
        at = np.append(at, len(z) - 1)
        x = values[at]
        w = weights(z[at], n[at])
        w[-1] = weights(z[at[-1]], n[at[-1]], 0.0)
        g = (1 / (1 + np.exp(-np.clip(w @ x, -30, 30))) - label) * (RARE if label else 1.0) * x
        root = np.sqrt(n[at])
        n[at] += g * g
        z[at] += g - (np.sqrt(n[at]) - root) / ALPHA * w


def _learner(state, values):
    """One shard's steps from the common state; gives what they changed."""

    def learn(key, table):
        begun = state.value
        z, n = (x.copy() for x in begun)
        table = table.take(pa.compute.sort_indices(table, [("turn", "ascending"), ("id", "ascending")]))
        ftrl(z, n, values.value, [x.values.to_numpy(zero_copy_only=False) for x in table.column("places")], table.column("label").to_pylist())
        at = np.flatnonzero((z != begun[0]) | (n != begun[1]))
        moved = [at.astype("<i4"), z[at] - begun[0][at], n[at] - begun[1][at]]
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int64())} | {name: pa.array([x.tobytes()], pa.binary()) for name, x in zip(("at", "z", "n"), moved, strict=True)})

    return learn


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE, shards: int = SHARDS, epochs: int = EPOCHS) -> Model:
    """Learns from at most ``sample`` labelled documents that aren't held out, in the order of a hash of their ids.

    Null labels and ids are left out; of several labels of an id the largest holds, of several texts of an id the largest.
    Null and empty texts have no features. Without any labelled document all scores are 0.5; with one label only, those of
    the bias. Other columns of either table are not read. Reruns agree: shards and the order within them depend on ids alone.
    """
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col)).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("label"))
    chosen = known.orderBy(F.xxhash64("id"), "id").limit(sample)

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for batch in batches:
            for begin, some in _some(batch.column(2).to_pylist()):
                of, found = features(some, hashes)
                own = [np.unique(found[of == i]).astype("<u8") for i in range(len(some))]
                part = batch.slice(begin, len(some))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([x.view("<i8") for x in own], pa.list_(pa.int64()))], names=["id", "label", "features"])

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where("id is not null").join(F.broadcast(chosen), "id")
    source = source.groupBy("id", "label").agg(F.max("text").alias("text"))
    id_type = source.schema["id"].dataType.simpleString()
    made = cut(source.mapInArrow(tidy(distinct), f"id {id_type}, label int, features array<bigint>"), "toxic-features")
    often = made.select(F.explode("features").alias("f")).groupBy("f").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") >= LEAST_DOCS)
    frequent = often.orderBy(F.desc("c"), "f").limit(FEATURES).toArrow().sort_by("f")
    vocabulary, size = frequent.column("f").to_numpy(), len(frequent) + 1
    # what few texts have counts for more: its value falls from 1 to 0 as it gets more common; the bias has 1
    total = max(2, made.count())
    value = np.append(np.log(total / frequent.column("c").to_numpy()) / max(np.log(total / LEAST_DOCS), 1.0), 1.0)
    context = docs.sparkSession.sparkContext
    shared, values = context.broadcast(vocabulary), context.broadcast(value)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            places = []
            for found in batch.column(2):
                x = np.asarray(found.values.to_numpy(zero_copy_only=False), np.int64)
                at = np.minimum(np.searchsorted(own, x), max(0, len(own) - 1))
                places.append(at[own[at] == x].astype(np.int32) if len(own) else np.empty(0, np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(places, pa.list_(pa.int32()))], names=["id", "label", "places"])

    rows = made.mapInArrow(tidy(placed), f"id {id_type}, label int, places array<int>")
    rows = cut(rows.select(F.pmod(F.xxhash64("id"), F.lit(shards)).alias("shard"), F.xxhash64("id", F.lit(1)).alias("turn"), "id", "label", "places"), "toxic-rows")
    z, n = np.zeros(size), np.zeros(size)
    for _ in range(epochs):
        state = context.broadcast((z, n))
        moves = rows.groupBy("shard").applyInArrow(_learner(state, values), "shard bigint, at binary, z binary, n binary").toArrow().sort_by("shard")
        z, n = z.copy(), n.copy()
        for moved in zip(*(moves.column(x) for x in ("at", "z", "n")), strict=True):
            at, dz, dn = (np.frombuffer(x.as_buffer(), kind) for x, kind in zip(moved, ("<i4", "<f8", "<f8"), strict=True))
            z[at] += dz / len(moves)
            n[at] += dn / len(moves)
        state.destroy()
    w = (weights(z, n) * value)[:-1]
    kept = np.flatnonzero(w)
    return Model(vocabulary[kept].view("<u8"), w[kept], float(weights(z[-1], n[-1], 0.0)))


def classify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5) -> DataFrame:
    """``id, held_out, score, predicted`` of every row.

    The score depends on the text alone, read whole, however long. Null, empty and blank texts have the score of a text
    without features. Null ids stay null and count as held out, repeated rows stay repeated, an empty table gives an empty one.
    Other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, hashes = shared.value, _Hashes()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own.score(batch.column(1).to_pylist(), hashes), pa.float64())], names=["id", "_score"])

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    made = source.mapInArrow(tidy(run), f"id {source.schema['id'].dataType.simpleString()}, _score double")
    return made.select(F.col("id").alias(id_col), held_out("id").alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= least).cast("int").alias("predicted"))
