"""Prefix trie of conversations, merged family by family.

Conversations come in families: those of a base id share turns of the base conversation. A trie node is a sequence of turns, named
by a chain of digests, so no text is moved after its turn was read.

1. Turns are brought together by base id, in the order of the conversations and their turns, and read as a stream: the base's
   first turns are kept, every conversation is rebuilt turn by turn, and the family's trie is built beside it. One turn is held
   at a time, and at most ``HELD_NODES`` nodes, so the longest conversation needs no more memory than a short one.
2. Only the families' combined nodes are shuffled, and added up by name to the global trie.
3. A node belongs to the smallest conversation that starts with it, so each conversation owns the end of its path from some
   depth on, or nothing. Sums over subtrees are then sums along owned ends, and each end is added once to the nodes above
   it, which are on its conversation's own path. That is linear in the turns, whatever the trie's shape, without rounds.
4. A node's list of ending conversations is put together from pieces of at most ``PIECE`` ids and hashed piece by piece.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, tidy
from .source_mixing import word_count

FAMILY, HEAD = 20, 4
#: Nodes of a family's trie that are held, and ids in a piece of a node's list.
HELD_NODES, PIECE = 100_000, 1024
ROOT = bytes(16)
_NODE = pa.schema([("conv", pa.int64()), ("depth", pa.int64()), ("key", pa.binary()), ("parent", pa.binary()), ("words", pa.int64()), ("ends", pa.bool_()), ("n", pa.int64())])


class _Family:
    """Rebuilds the conversations of a family from its turns, and counts its nodes."""

    def __init__(self) -> None:
        self.base = self.conv = None
        self.heads: list[tuple[bytes, int]] = []
        self.nodes: dict[bytes, list] = {}
        self.rows: list[tuple] = []
        self.last: tuple | None = None

    def turn(self, base: int, conv: int, shared: int, digest: bytes, words: int) -> None:
        if base != self.base:
            self.end_family()
            self.base = base
        if conv != self.conv:
            self.end_conversation()
            self.conv, self.place, self.depth, self.key = conv, 0, 0, ROOT
            self.step(ROOT, None, 0)
            for head in self.heads[:shared] if conv != base else ():
                self.go(*head)
        if conv == base:
            if self.place < HEAD - 1:
                self.heads.append((digest, words))
            self.go(digest, words)
        elif self.place >= shared:
            self.go(digest, words)
        self.place += 1

    def go(self, digest: bytes, words: int) -> None:
        parent, self.key = self.key, hashlib.sha256(self.key + digest).digest()[:16]
        self.depth += 1
        self.step(self.key, parent, words)

    def step(self, key: bytes, parent: bytes | None, words: int) -> None:
        if self.last:
            self.rows.append((*self.last, False, None))
        self.last = (self.conv, self.depth, key, parent, words)
        node = self.nodes.get(key)
        if node is None:
            if len(self.nodes) >= HELD_NODES:
                self.hand_on()
            self.nodes[key] = [self.conv, self.depth, key, parent, words, None, 1]
        else:
            node[0] = min(node[0], self.conv)
            node[6] += 1

    def end_conversation(self) -> None:
        if self.last:
            self.rows.append((*self.last, True, None))
            self.last = None

    def end_family(self) -> None:
        self.end_conversation()
        self.hand_on()
        self.conv = None
        self.heads = []

    def hand_on(self) -> None:
        self.rows.extend(self.nodes.values())
        self.nodes = {}

    def made(self) -> pa.RecordBatch:
        rows, self.rows = self.rows, []
        return pa.RecordBatch.from_arrays([pa.array(column, field.type) for column, field in zip(zip(*rows, strict=True), _NODE, strict=True)], schema=_NODE)


def _rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    family = _Family()
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            family.turn(*row)
            if len(family.rows) >= 20_000:
                yield family.made()
    family.end_family()
    if family.rows:
        yield family.made()


def _hash_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of lists, in order, to each list's digest."""
    key, digest, keys, found = None, None, [], []
    for batch in batches:
        for name, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if name != key:
                if key is not None:
                    keys.append(key)
                    found.append(digest.hexdigest())
                key, digest = name, hashlib.sha256(ids.encode())
            else:
                digest.update(b"," + ids.encode())
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(found, pa.string())], names=["key", "ends_sha256"])
        keys, found = [], []
    if key is not None:
        yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([digest.hexdigest()], pa.string())], names=["key", "ends_sha256"])


def rebuilt(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One table of ``conv, depth, key, parent, words, ends, n``: the rebuilt conversations' turns, one row each with the root
    before them and ``ends`` at the last (``n`` null), and the families' combined nodes with ``n`` conversations of which
    ``conv`` is the smallest (``ends`` null)."""
    plain = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    conv = F.col(f"`{conv_col}`").cast("long")
    turns = df.select(conv.alias("conv"), F.col(f"`{turn_col}`").alias("turn"), plain(role_col).alias("role"), plain(text_col).alias("text")).where("conv is not null")
    base = F.col("conv") - F.col("conv") % FAMILY
    # the role's length tells where it ends
    content = F.concat(F.length("role").cast("string"), F.lit(" "), F.col("role"), F.col("text"))
    turns = turns.select(base.alias("base"), "conv", (F.crc32(F.col("conv").cast("string").cast("binary")) % HEAD).cast("int").alias("shared"), F.substring(F.unhex(F.sha2(content, 256)), 1, 16).alias("digest"), word_count("text").alias("words"), "turn")
    order = ["base", F.col("conv") != F.col("base"), "conv", F.asc_nulls_first("turn"), "digest"]
    stream = turns.repartition("base").sortWithinPartitions(*order).select("base", "conv", "shared", "digest", "words")
    return stream.mapInArrow(tidy(_rebuild), "conv long, depth long, key binary, parent binary, words long, ends boolean, n long")


def _lists(ends: DataFrame) -> DataFrame:
    """``key, conv`` to ``key, ends_sha256``: of each key's ids in ascending order, joined by commas."""
    pieces = ends.groupBy("key", F.floor(F.col("conv") / PIECE).alias("piece")).agg(F.array_join(F.sort_array(F.collect_list("conv")).cast("array<string>"), ",").alias("ids"))
    stream = pieces.repartition("key").sortWithinPartitions("key", "piece").select("key", "ids")
    return stream.mapInArrow(tidy(_hash_lists), "key binary, ends_sha256 string")


def trie(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256`` of each node.

    Turns are taken in the order of ``turn``, null first, and where these tie by a digest of role and text; repeated rows are
    turns of their own. Null roles and texts are empty ones, empty and very long texts are turns like others. Rows without
    ``conv_id`` belong to no conversation. An empty table has no node, not even a root. Other columns are not read.
    """
    made = cut(rebuilt(df, conv_col, turn_col, role_col, text_col), "trie-families")
    family, paths = made.where("n is not null"), made.where("n is null").select("conv", "depth", "key", "ends")
    merged = family.groupBy("key").agg(F.max("depth").alias("depth"), F.max("parent").alias("parent"), F.max("words").alias("words"), F.sum("n").alias("n_convs"), F.min("conv").alias("conv"))
    merged = cut(merged, "trie-nodes")
    children = merged.where("parent is not null").groupBy(F.col("parent").alias("key")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = merged.join(children, "key", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    owned, below = Window.partitionBy("conv"), Window.partitionBy("conv").orderBy(F.desc("depth"))
    own: Column = F.sum((F.col("n_convs") - 1) * F.col("words")).over(below)
    leaf = F.max(F.when(F.col("n_children") == 0, 1).otherwise(0)).over(owned).cast("long")
    nodes = cut(nodes.withColumn("own", own).withColumn("leaf", leaf).withColumn("top", F.min("depth").over(owned)), "trie-owned")

    tops = nodes.where("depth = top").select("conv", "top", "own", "leaf", "parent")
    above = paths.join(tops.where("top > 0").select("conv", "top", "own", "leaf"), "conv").where("depth < top")
    above = above.groupBy("key").agg(F.sum("own").alias("above"), F.sum("leaf").alias("leaves"))
    parents = tops.where("top > 0").join(merged.select(F.col("key").alias("parent"), F.col("conv").alias("parent_conv")), "parent").select("conv", "parent_conv")
    out = nodes.join(above, "key", "left").join(_lists(paths.where("ends").select("key", "conv")), "key", "left").join(parents, "conv", "left")
    parent = F.when(F.col("depth") > F.col("top"), F.col("conv")).otherwise(F.col("parent_conv"))
    saved, leaves = F.col("own") + F.coalesce("above", F.lit(0)), F.col("leaf") + F.coalesce("leaves", F.lit(0))
    return out.select(F.col("conv").alias("conv_id"), "depth", parent.alias("parent_conv_id"), "n_convs", "n_children", leaves.alias("n_leaves"), saved.alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))
