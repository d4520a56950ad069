"""Near-duplicate documents: one-permutation hashing, banded buckets, star-shaped candidate edges, exact confirmation.

1. A document is its set of word shingles, as 64-bit hashes. Documents with the same set are one *node*, so exact copies
   cost one row each and never a pair.
2. A node's signature holds the smallest hash in each of ``bins`` equal ranges of hashes: one pass over the set. An empty
   bin takes the value of the first bin that isn't empty in an order of its own (densification), so short sets compare as
   well as long ones. ``rows`` bins make a band, and nodes that agree in a band share a bucket.
3. In a bucket all nodes are compared with its centre alone, the node that has most company over all its buckets (in a
   group of edited copies that is the text they were made from). So a bucket of n nodes gives n - 1 pairs.
4. A star can miss a link between two nodes that are both unlike the centre. So, once the components of the confirmed
   edges are known, buckets whose nodes are not all in one component are searched in blocks for pairs across components.
   Signatures are compared there, and pairs that look alike become rows. Where these would be many for a block (a large
   group of texts that are somewhat alike), the block's full sets are compared in place instead, and only links that join
   two components come out of it.
5. Every candidate is confirmed on the full sets, and components follow from the confirmed edges.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, small, tidy
from .components import components

BANDS, ROWS = 25, 5
BINS = BANDS * ROWS
#: Pairs whose signatures agree in so many standard deviations less of their bins than a link would on average are not
#: confirmed on full sets.
DEVIATIONS = 5
#: A block with more pairs than this for each of its nodes is compared in place.
DENSE = 4
#: Needed ids up to this count are broadcast (8 bytes each), beyond it they are joined by shuffle.
BROADCAST_IDS = 1_000_000
#: A block holds about twice so many nodes at most, and about twice so many shingles (8 bytes each) if no text has more.
_BLOCK, _BLOCK_SHINGLES = 512, 1 << 20
_U = np.uint64


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> _U(33))


def shingles(text: str | None, size: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles of ``size`` words, A-Z in lower case; with fewer words of all of them."""
    found = (text or "").encode().lower().split()
    n = len(found)
    if not n:
        return np.empty(0, _U)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, found), _U, n)
    if n < size:
        h = np.array([xxhash.xxh3_64_intdigest(b" ".join(found), seed=n)], _U)
    else:
        s = np.zeros(n - size + 1, _U)
        for k in range(size):
            s = s * _U(0x9E3779B97F4A7C15) + h[k : k + n - size + 1]
            s ^= s >> _U(29)
        h = _mix(s)
    h.sort()
    return h[np.concatenate([[True], h[1:] != h[:-1]])] if n > 1 else h


def shared(a: np.ndarray, b: np.ndarray) -> int:
    """How many hashes two sorted sets that aren't empty have in common."""
    if len(a) < len(b):
        a, b = b, a
    return int((a[np.minimum(np.searchsorted(a, b), len(a) - 1)] == b).sum())


@lru_cache(maxsize=1)
def _plan() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of the bins' ranges, each bin's order over the others, and odd factors for bands."""
    rng = np.random.Generator(np.random.PCG64(20240131))
    starts = np.array([(i << 64) // BINS + (1 if (i << 64) % BINS else 0) for i in range(BINS)], _U)
    order = np.stack([rng.permutation(BINS) for _ in range(BINS)])
    return starts, order, rng.integers(1, 2**63, size=(BANDS, ROWS), dtype=np.int64).astype(_U) * _U(2) + _U(1)


def signature(hashes: np.ndarray) -> np.ndarray:
    """The densified one-permutation signature of a set that isn't empty."""
    starts, order, _ = _plan()
    at = np.searchsorted(hashes, starts)
    end = np.append(at[1:], len(hashes))
    full = at < end
    out = hashes[np.minimum(at, len(hashes) - 1)]
    if not full.all():
        empty = np.flatnonzero(~full)
        own = order[empty]
        out[empty] = out[own[np.arange(len(empty)), full[own].argmax(axis=1)]]
    return out


def bands(sig: np.ndarray) -> np.ndarray:
    return _mix((_mix(sig.reshape(BANDS, ROWS)) * _plan()[2]).sum(axis=1, dtype=_U) + np.arange(BANDS, dtype=_U)).view(np.int64)


def _sets(docs: DataFrame) -> DataFrame:
    """``id, n, key, bands, sig``: a row for each document; without words ``n`` is 0 and the rest null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                rows = []
                for text in batch.column(1).to_pylist():
                    s = shingles(text)
                    if len(s):
                        sig = signature(s)
                        rows.append((len(s), xxhash.xxh3_128_digest(s.tobytes()), bands(sig), (sig & _U(255)).astype(np.uint8).tobytes()))
                    else:
                        rows.append((0, None, None, None))
                n, key, band, sig = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(key, pa.binary()), pa.array(band, pa.list_(pa.int64())), pa.array(sig, pa.binary())], names=["id", "n", "key", "bands", "sig"])

    return docs.mapInArrow(tidy(run), f"id {docs.schema['id'].dataType.simpleString()}, n long, key binary, bands array<long>, sig binary")


def _least(n, percent: int):
    """The share of agreeing bins from which on a pair is confirmed: as many bins count as a set of ``n`` fills."""
    filled = BINS * (1 - np.exp(-np.asarray(n, dtype=float) / BINS))
    j = percent / 100
    return j - DEVIATIONS * np.sqrt(j * (1 - j) / filled)


def _alike(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Of ``u, v`` those whose sizes and signatures allow a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(-1, BINS) for i in (2, 3))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["u", "v"]).filter(pa.array((x == y).mean(axis=1) >= _least(batch.column(4).to_numpy(zero_copy_only=False), percent)))

    a = nodes.select(F.col("node").alias("u"), F.col("n").alias("nu"), F.col("sig").alias("su"))
    b = nodes.select(F.col("node").alias("v"), F.col("n").alias("nv"), F.col("sig").alias("sv"))
    joined = pairs.join(a, "u").join(b, "v").where((100 * F.col("nu") >= percent * F.col("nv")) & (100 * F.col("nv") >= percent * F.col("nu")))
    return joined.select("u", "v", "su", "sv", F.least("nu", "nv").alias("n")).mapInArrow(tidy(run), "u binary, v binary")


def _texts(involved: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """``node, text`` of the nodes asked for. Only their texts are shuffled."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                keys = [xxhash.xxh3_128_digest(shingles(t).tobytes()) for t in batch.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), batch.column(0)], names=["node", "text"])

    ids = cut(involved.join(nodes.select("node", "id"), "node").select("id").distinct(), "involved")
    texts = docs.join(small(ids, BROADCAST_IDS), "id", "left_semi").select("text")
    if not ids.where("id is null").isEmpty():
        # nodes of which no row has an id; not joined, as all would meet in one task
        texts = texts.union(docs.where("id is null").select("text"))
    return cut(texts.mapInArrow(tidy(keyed), "node binary, text string"), "texts").dropDuplicates(["node"])


def _confirm(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """Of ``u, v`` those that are links on full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, None
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                keep = []
                for v, x, y in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                    if v != last:
                        last, held = v, shingles(y)
                    t = shingles(x)
                    both = shared(t, held)
                    keep.append(100 * both >= percent * (len(t) + len(held) - both))
                yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    texts = _texts(pairs.select(F.col("u").alias("node")).union(pairs.select("v")).distinct(), nodes, docs)
    joined = pairs.join(texts.select(F.col("node").alias("u"), F.col("text").alias("x")), "u").join(texts.select(F.col("node").alias("v"), F.col("text").alias("y")), "v")
    return joined.select("u", "v", "x", "y").mapInArrow(tidy(run), "u binary, v binary")


def _blocks(members: DataFrame, labels: DataFrame) -> DataFrame:
    """``b, i, j, node, label, few``: buckets of several components, centres left out, dealt out to blocks.

    Nodes outside the bucket's largest component (``few``) meet all its nodes: each of ``i`` parts of all meets each of
    ``j`` parts of the few, so a block has at most about twice ``_BLOCK`` rows and twice ``_BLOCK_SHINGLES`` shingles.
    """
    m = members.where("node <> centre").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    sizes = m.groupBy("b", "label").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("n"))
    about = sizes.groupBy("b").agg(F.count(F.lit(1)).alias("kinds"), F.sum("size").alias("all"), F.sum("n").alias("all_n"), F.max(F.struct("size", "label", "n")).alias("largest")).where("kinds > 1")
    parts = lambda size, n: F.ceil(F.greatest(size / _BLOCK, n / _BLOCK_SHINGLES))
    left, right = parts(F.col("all"), F.col("all_n")), parts(F.col("all") - F.col("largest.size"), F.col("all_n") - F.col("largest.n"))
    # a table of its own, one row a bucket: the join either broadcasts it, by its size, or can split a bucket's rows
    about = cut(about.select("b", F.col("largest.label").alias("main"), left.alias("left"), right.alias("right")), "split-buckets")
    m = m.join(about, "b")
    h, zero = F.xxhash64("node"), F.lit(0).cast("long")
    every = m.select("b", F.pmod(h, F.col("left")).alias("i"), F.explode(F.sequence(zero, F.col("right") - 1)).alias("j"), "node", "label", F.lit(False).alias("few"))
    few = m.where("label <> main").select("b", F.explode(F.sequence(zero, F.col("left") - 1)).alias("i"), F.pmod(h, F.col("right")).alias("j"), "node", "label", F.lit(True).alias("few"))
    return every.union(few)


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[tuple]]]:
    """Of rows sorted by their first three columns: each block's key and its other columns."""
    key, rows = None, []
    for batch in batches:
        for *k, node, label, few, n, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if k != key:
                if len(rows) > 1:
                    yield key, rows
                key, rows = k, []
            rows.append((node, label, few, n, data))
    if len(rows) > 1:
        yield key, rows


def _across(blocks: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """``b, i, j, u, v``: pairs of a block that lie in two components and may be links; for a block with too many of them
    one row without ``u`` and ``v``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, rows in _grouped(batches):
            node, label, few, n, sig = zip(*rows, strict=True)
            sig, n, label, few = np.frombuffer(b"".join(sig), np.uint8).reshape(-1, BINS), np.array(n), np.array(label, dtype=object), np.array(few)
            right, found = np.flatnonzero(~few), set()
            for i in np.flatnonzero(few):
                fits = right[(label[right] != label[i]) & (100 * n[right] >= percent * n[i]) & (100 * n[i] >= percent * n[right])]
                agree = (sig[fits] == sig[i]).mean(axis=1) >= _least(np.minimum(n[fits], n[i]), percent)
                found.update((min(node[i], node[j]), max(node[i], node[j])) for j in fits[agree])
                if len(found) > DENSE * len(rows):
                    found = {(None, None)}
                    break
            if found:
                u, v = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array([k] * len(u), pa.int64()) for k in key] + [pa.array(u, pa.binary()), pa.array(v, pa.binary())], names=["b", "i", "j", "u", "v"])

    with_sigs = blocks.join(nodes.select("node", "n", "sig"), "node").select("b", "i", "j", "node", "label", "few", "n", "sig")
    return _dealt(with_sigs).mapInArrow(tidy(run), "b long, i long, j long, u binary, v binary")


def _dealt(rows: DataFrame) -> DataFrame:
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "b", "i", "j").sortWithinPartitions("b", "i", "j")


def _in_place(dense: DataFrame, blocks: DataFrame, nodes: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """Links ``u, v`` of dense blocks that join two components, found on full sets within the block.

    A pair is compared in the first band that it shares, so not once for each bucket, and not at all where the links
    of the block have joined its components before.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, rows in _grouped(batches):
            node, label, few, n, texts = zip(*rows, strict=True)
            known: dict[bytes, tuple] = {}
            for k, t in zip(node, texts, strict=True):
                if k not in known:
                    hashes = shingles(t)
                    known[k] = (hashes, bands(signature(hashes)))
            sets = [known[k][0] for k in node]  # sorted arrays: eight bytes a shingle
            band, n, few = np.stack([known[k][1] for k in node]), np.array(n), np.array(few)
            root = {x: x for x in label}

            def find(x, root=root):
                while root[x] != x:
                    root[x] = root[root[x]]
                    x = root[x]
                return x

            right, found = np.flatnonzero(~few), []
            for i in np.flatnonzero(few).tolist():
                fits = right[(100 * n[right] >= percent * n[i]) & (100 * n[i] >= percent * n[right])]
                same = band[fits] == band[i]
                first = same.argmax(axis=1)
                fits = fits[same.any(axis=1) & (band[i][first] == key[0])]
                for j in fits.tolist():
                    a, b = find(label[i]), find(label[j])
                    if a != b:
                        both = shared(sets[i], sets[j])
                        if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                            root[a] = b
                            found.append((node[i], node[j]))
            if found:
                u, v = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.binary()), pa.array(v, pa.binary())], names=["u", "v"])

    rows = cut(blocks.join(dense, ["b", "i", "j"]), "dense")
    texts = _texts(rows.select("node").distinct(), nodes, docs)
    whole = rows.join(texts, "node").join(nodes.select("node", "n"), "node").select("b", "i", "j", "node", "label", "few", "n", "text")
    return _dealt(whole).mapInArrow(tidy(run), "u binary, v binary")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 85) -> DataFrame:
    """``id, n_shingles, component_id, kept`` of every row of ``df``.

    Two documents are linked if 100 * (shared shingles) >= ``percent`` * (shingles of either). ``component_id`` is the
    smallest id that a document reaches by links, ``kept`` whether it is its own. Null, empty and blank texts have no
    shingle and no link. Rows with the same text are one node whatever their ids; rows with a null id have
    part in the links, and a component of nulls alone has the id null and nothing kept. An empty table gives an
    empty one. Texts are read whole, however long: 8 bytes a shingle in memory, for about 1024 texts or 2M shingles
    at a time, or one text that has more. Ties
    between centres of a bucket go to the larger digest. Other columns are not read, so extra ones may have any names. A
    link of similarity 0.85 shares no bucket with probability 5e-7.
    """
    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    sets = cut(_sets(docs), "sets")
    known = sets.where("key is not null")
    nodes = cut(known.groupBy("key").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("sig").alias("sig")).withColumnRenamed("key", "node"), "nodes")
    rows = nodes.select("node", "n", F.explode("bands").alias("b"))
    shared = cut(rows.groupBy("b").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "buckets")
    members = cut(rows.join(shared, "b"), "members")
    company = members.groupBy("node").agg(F.sum("size").alias("company"))
    members = members.join(company, "node")
    centres = cut(members.groupBy("b").agg(F.max(F.struct("company", "node")).alias("x")).select("b", F.col("x.node").alias("centre")), "centres")
    members = cut(members.select("b", "node", "n").join(centres, "b"), "members")
    star = members.where("node <> centre").select(F.col("node").alias("u"), F.col("centre").alias("v")).distinct()
    edges = cut(_confirm(cut(_alike(star, nodes, percent), "pairs"), nodes, docs, percent), "edges")
    labels = cut(components(edges), "labels")
    blocks = cut(_blocks(members, labels), "blocks")
    across = cut(_across(blocks, nodes, percent), "pairs")
    pairs, dense = across.where("u is not null").select("u", "v").distinct(), across.where("u is null").select("b", "i", "j")
    more = [] if pairs.isEmpty() else [cut(_confirm(pairs, nodes, docs, percent), "edges")]
    more += [] if dense.isEmpty() else [cut(_in_place(dense, blocks, nodes, docs, percent), "edges")]
    for found in more:
        edges = edges.union(found)
    if any(not found.isEmpty() for found in more):
        labels = cut(components(edges), "labels")
    of = nodes.select("node", "id").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    smallest = of.groupBy("label").agg(F.min("id").alias("component"))
    of = of.join(smallest, "label").select(F.col("node").alias("key"), "component")
    out = sets.select("id", "n", "key").join(of, "key", "left")
    component = F.when(F.col("key").isNull(), F.col("id")).otherwise(F.col("component"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))


def drop_near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 85) -> DataFrame:
    """The rows of ``df``, with all columns, of which one document of each group stays: the one with the smallest id.

    Of repeated rows of a document that stays (same id and text) one stays. Rows without id stay, as no id tells them;
    rows that share an id but not a text stay if one of them does. Other cases as in ``near_duplicates``.
    """
    found = cut(near_duplicates(df, id_col, text_col, percent), "near-duplicates")
    by_id = found.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max("kept").alias("stays"), F.count(F.lit(1)).alias("rows"))
    by_id = cut(by_id.where("rows > 1 or not stays"), "not-single")
    gone, several = by_id.where("not stays").select("_id"), by_id.where("stays").select("_id")
    out = df.join(small(gone, BROADCAST_IDS), df[id_col] == gone["_id"], "left_anti")
    if several.isEmpty():
        return out
    several = small(several, BROADCAST_IDS)
    once = out.join(several, out[id_col] == several["_id"], "left_semi").dropDuplicates([id_col, text_col])
    return out.join(several, out[id_col] == several["_id"], "left_anti").unionByName(once)
