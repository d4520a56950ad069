"""BPE with word ends, by a table of distinct words.

1. Texts are cut into *blocks* of consecutive rows of about ``BLOCK`` bytes. In the task that reads it, a block's words
   are split at ASCII white space and made distinct; a word's place in that list is its code in the block.
2. The distinct words of all blocks are shuffled by word, so that each distinct word of the corpus is encoded once,
   whatever number of blocks has it. A word in a third of all places is one row a block.
3. Its ids go back to the blocks that asked, by a second shuffle, and to their places in the block's list by position
   (a word's bucket, then its code): flat files with an index by the block's digest, one file for each task.
4. The texts are read again. A block of which the digest is found takes its ids from there by code; the texts stay
   where they are read, and no task sees more of the word table than the words of its own block.
5. Decoding joins ids with the id-to-piece table, which has one row for each id of the vocabulary, by id.

The word tokenizer drops white space, so a text's ids are its words' ids, one after the other. A block that isn't found
(a source that gives its rows in another order when it is read again) is encoded where it is; the result is the same.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import BYTE_NAMES, Held, as_bytes, buffers, by_size, load, plain_words
from .common import Blob, let_go, open_fs, parts_for, scratch, tidy
from .token_counts import load_once

#: Bytes of texts in a block; a longer text is a block of its own.
BLOCK = 8 << 20
#: Bytes of a block's texts that are split, and put together, at a time.
SLICE = 1 << 20
#: Bytes of texts, as they are stored, for each task that encodes words.
PART = 16 << 20
#: Bytes of words and ids that such a task holds; far more than a part has.
HELD = 128 << 20


def blocks(batches: Iterator[pa.RecordBatch], text: int, most: int) -> Iterator[pa.Table]:
    """The rows in blocks: each ends with the row at which its texts (column ``text``) reach ``most`` bytes. How the rows
    come in batches makes no difference."""
    held, size = [], 0
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at, before = 0, 0
        while at < batch.num_rows:
            stop = int(np.searchsorted(ends, before + most - size, "left")) + 1
            held.append(batch.slice(at, stop - at))
            if stop > batch.num_rows:
                size += int(ends[-1]) - before
                break
            yield pa.Table.from_batches(held)
            at, before, held, size = stop, int(ends[stop - 1]), [], 0
    if held:
        yield pa.Table.from_batches(held)


def split(texts: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Of texts: how many words each has, the words' codes, and the distinct words. Nulls have none."""
    counts, found = [], []
    for rows in blocks(iter(pa.table({"text": texts}).to_batches()), 0, SLICE):
        lists = pc.ascii_split_whitespace(pc.fill_null(rows.column(0).combine_chunks(), ""))
        every, ends = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
        some = pc.not_equal(pc.binary_length(every), 0)
        before = np.concatenate([[0], np.cumsum(some.to_numpy(zero_copy_only=False))])
        counts.append(np.diff(before[ends - ends[0]]))
        found.append(every.filter(some))
    coded = pa.chunked_array(found, pa.string()).combine_chunks().dictionary_encode()
    return np.concatenate([*counts, np.empty(0, np.int64)]), coded.indices.to_numpy(), coded.dictionary


def digest(words: pa.Array) -> bytes:
    """128 bits that tell a block's list of words."""
    data, at = buffers(words)
    h = xxhash.xxh3_128(np.diff(at).tobytes())
    h.update(data[at[0] : at[-1]])
    return h.digest()


def _shard(block: bytes, parts: int) -> int:
    return int.from_bytes(block[:8], "little") % parts


def dealt(words: pa.Array, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of each of a block's words, by its hash, and the order of the words by bucket and code."""
    bucket = np.fromiter(map(xxhash.xxh3_64_intdigest, as_bytes(words)), np.uint64, len(words)) % np.uint64(parts)
    return bucket.astype(np.int32), np.argsort(bucket, kind="stable")


def _unit(path: str) -> tuple[str, int]:
    """How ids are stored between the steps, and the number that ends a word's ids: one that is no id."""
    return ("<u2", 0xFFFF) if load_once(path).get_vocab_size(with_added_tokens=True) < 0xFFFF else ("<u4", 0xFFFFFFFF)


class WordEncoder:
    """Ids of single words. Words of Latin-1 letters, perhaps before ASCII punctuation, go to the library's BPE model as
    its normalizer and pre-tokenizer would give them to it; all others take the whole way, in batches."""

    def __init__(self, path: str):
        self.tokenizer = load_once(path)
        self.model = self.tokenizer.model
        self.marks: dict[bytes, list[int]] = {b"": []}

    def ids(self, found: list[bytes]) -> list[bytes]:
        """32-bit little-endian ids of each word."""
        words, plain = plain_words(found)
        out: list[bytes | None] = []
        tokenize, marks = self.model.tokenize, self.marks
        for whole, word, direct in zip(found, words, plain.tolist(), strict=True):
            if not direct:
                out.append(None)
                continue
            rest = whole[len(word) :]
            if rest not in marks:
                if len(marks) > 10_000:
                    marks.clear()
                    marks[b""] = []
                marks[rest] = self.tokenizer.encode(rest.decode(), add_special_tokens=False).ids
            if word.isascii():
                spelled = word.lower().decode()
            else:
                text = word.decode()
                if max(text) > "\u00ff":
                    out.append(None)
                    continue
                spelled = text.lower().encode().decode("latin-1").translate(BYTE_NAMES)
            out.append(array("I", [t.id for t in tokenize(spelled)] + marks[rest]).tobytes())
        for some in by_size([i for i, ids in enumerate(out) if ids is None], lambda i: len(found[i])):
            for i, e in zip(some, self.tokenizer.encode_batch_fast([found[i].decode() for i in some], add_special_tokens=False), strict=True):
                out[i] = array("I", e.ids).tobytes()
        return out


@lru_cache(maxsize=2)
def _encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def distinct_words(texts: DataFrame, parts: int, block: int = BLOCK) -> DataFrame:
    """``bucket, block, words``: the words of each block, dealt out to buckets; a space between them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in blocks(batches, 0, block):
            _, _, words = split(rows.column(0))
            if not len(words):
                continue
            bucket, order = dealt(words, parts)
            first = np.flatnonzero(np.diff(bucket[order], prepend=np.int32(-1)))
            own = words.cast(pa.large_binary()).take(pa.array(order))
            blobs = pc.binary_join(pa.LargeListArray.from_arrays(np.append(first, len(order)), own), pa.scalar(b" ", pa.large_binary()))
            yield pa.RecordBatch.from_arrays([pa.array(bucket[order[first]]), pa.array([digest(words)] * len(first), pa.binary()), blobs.cast(pa.binary())], names=["bucket", "block", "words"])

    return texts.mapInArrow(tidy(run), "bucket int, block binary, words binary")


def encode_words(asked: DataFrame, path: str, parts: int, held: int = HELD) -> DataFrame:
    """``shard, block, bucket, ids``: for each row of ``asked``, which come bucket by bucket, its words' ids, each word's
    with an end mark. A word of several rows is encoded once."""
    unit, mark = _unit(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = _encoder(path), np.array([mark], unit).tobytes()

        def make(words: list[bytes]) -> list[bytes]:
            return [np.frombuffer(ids, "<u4").astype(unit).tobytes() + end if unit != "<u4" else ids + end for ids in encoder.ids(words)]

        known = Held(make, held)
        for batch in batches:
            for bucket, block, words in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                asked = words.split(b" ")
                known.know(asked)
                yield pa.RecordBatch.from_pydict({"shard": pa.array([_shard(block, parts)], pa.int32()), "block": pa.array([block], pa.binary()), "bucket": pa.array([bucket], pa.int32()), "ids": pa.array([b"".join(map(known.__getitem__, asked))], pa.binary())})

    return asked.select("bucket", "block", "words").mapInArrow(tidy(run), "shard int, block binary, bucket int, ids binary")


def write_blocks(encoded: DataFrame, out: str, parts: int) -> None:
    """Bring each block's ids together, bucket by bucket, in ``out/<shard>``: the blocks one after the other, then an index
    (digests, offsets) and the number of blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blob, last = None, None
        digests, offsets = [], [0]
        try:
            for batch in batches:
                for at in range(batch.num_rows):
                    shard, block, bucket = (c[at].as_py() for c in batch.columns[:3])
                    blob = blob or Blob(f"{out}/{shard}")
                    if (block, bucket) == last:  # equal blocks ask for the same words
                        continue
                    if not digests or block != digests[-1]:
                        digests.append(block)
                        offsets.append(offsets[-1])
                    last = block, bucket
                    blob.write(data := batch.column(3)[at].as_py())
                    offsets[-1] += len(data)
            if blob:
                blob.write(b"".join(digests) + np.array(offsets, "<u8").tobytes() + np.array([len(digests)], "<u8").tobytes())
                blob.done()
                blob = None
                yield pa.RecordBatch.from_pydict({"n": [len(digests)]})
        finally:
            if blob:
                blob.drop()

    laid = encoded.repartitionById(parts, "shard").sortWithinPartitions("block", "bucket")
    laid.mapInArrow(run, "n long").agg(F.sum("n")).collect()


def find_block(out: str, unit: str, mark: int, words: pa.Array, parts: int) -> tuple[np.ndarray, np.ndarray] | None:
    """How many ids each of a block's words has, and the ids, read from the block's file; None if there is none."""
    own = digest(words)
    filesystem, name = open_fs(f"{out}/{_shard(own, parts)}")
    size = filesystem.get_file_info(name).size
    if not size:
        return None
    with filesystem.open_input_file(name) as f:
        n = int(np.frombuffer(f.read_at(8, size - 8), "<u8")[0])
        index = f.read_at(16 * n + 8 * (n + 1), size - 8 - 16 * n - 8 * (n + 1))
        at = next((i for i in range(n) if index[16 * i : 16 * i + 16] == own), None)
        if at is None:
            return None
        begin, end = np.frombuffer(index, "<u8", 2, 16 * n + 8 * at).tolist()
        data = f.read_at(end - begin, begin)
    stream = np.frombuffer(data, unit)
    ends = np.flatnonzero(stream == mark)
    lists = pa.LargeListArray.from_arrays(np.append(0, ends - np.arange(len(ends))), pa.array(stream[stream != mark].astype("<u4")))
    place = np.empty(len(words), np.int64)
    place[dealt(words, parts)[1]] = np.arange(len(words))
    lists = lists.take(pa.array(place))
    return np.diff(lists.offsets.to_numpy()), lists.flatten().to_numpy()


@lru_cache(maxsize=2)
def piece_table(path: str) -> pa.Array:
    """The id-to-piece table: a row for each id of the vocabulary, at the place of its number."""
    tokenizer = load(path)  # not kept: the table is all that decoding needs
    return pa.array([(tokenizer.id_to_token(i) or "").encode() for i in range(tokenizer.get_vocab_size(with_added_tokens=True))], pa.large_binary())


def decode_ids(pieces: pa.Array, ids: pa.LargeListArray) -> pa.Array:
    """The texts of lists of ids: a join with the id-to-piece table by id, pieces with a space between them."""
    return pc.binary_join(pa.LargeListArray.from_arrays(ids.offsets, pieces.take(ids.values)), pa.scalar(b" ", pa.large_binary()))


def encode_decode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", ids: bool = False, block: int = BLOCK) -> DataFrame:
    """``id, n_tokens, ids_sha256, decoded_sha256`` of every row; with ``ids`` also ``ids`` (array of int).

    Encodes as the tokenizer of ``path`` (a .json with a word-wise pre-tokenizer that drops white space) with
    ``add_special_tokens=False``, and decodes as its ``decode(ids, skip_special_tokens=False)``: pieces joined by a
    space. Null and empty texts, and texts of white space, have no ids. A text of more than ``block`` bytes is a block of
    its own, so memory is bounded by that or by the longest text. A null id stays null; repeated rows stay repeated; an
    empty table gives an empty one. There are no ties. Other columns are not read, so extra ones may have any names.
    """
    source = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    parts = parts_for(source, PART)
    out = scratch(df.sparkSession, "word-blocks")
    asked = distinct_words(source.select("text"), parts, block).repartitionById(parts, "bucket")
    write_blocks(encode_words(asked, path, parts), out, parts)
    return _assemble(source, out, path, parts, ids, block).withColumnRenamed("id", id_col)


def _assemble(source: DataFrame, out: str, path: str, parts: int, with_ids: bool, block: int) -> DataFrame:
    unit, mark = _unit(path)
    pieces = piece_table(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if _encoder.cache_info().currsize or load_once.cache_info().currsize:
            _encoder.cache_clear()  # a worker that has encoded words needs no tokenizer to put texts together
            load_once.cache_clear()
            let_go()
        for rows in blocks(batches, 1, block):
            n_words, codes, words = split(rows.column(1))
            found = find_block(out, unit, mark, words, parts) if len(words) else (np.empty(0, "<u4"), np.empty(0, "<u4"))
            if found is None:
                made = _encoder(path).ids(as_bytes(words))
                found = np.fromiter(map(len, made), np.int64, len(made)) // 4, np.frombuffer(b"".join(made), "<u4")
            sizes, of_words = found
            lists = pa.LargeListArray.from_arrays(np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]), pa.array(of_words))
            before, at = np.concatenate([[0], np.cumsum(n_words)]), 0
            for some in blocks(iter(rows.to_batches()), 1, SLICE):
                words_at = before[at : at + some.num_rows + 1]
                own = codes[words_at[0] : words_at[-1]]
                yield assembled(some.column(0).combine_chunks(), lists.take(pa.array(own)).flatten(), np.concatenate([[0], np.cumsum(sizes[own], dtype=np.int64)])[words_at - words_at[0]])
                at += some.num_rows

    def assembled(row_ids: pa.Array, every: pa.Array, ends: np.ndarray) -> pa.RecordBatch:
        texts = decode_ids(pieces, pa.LargeListArray.from_arrays(ends, every))
        blob, at = memoryview(every.to_numpy()).cast("B") if len(every) else b"", (ends * 4).tolist()
        ids_sha = [hashlib.sha256(blob[a:b]).hexdigest() for a, b in zip(at, at[1:], strict=False)]
        columns = [row_ids, pa.array(np.diff(ends), pa.int64()), pa.array(ids_sha, pa.string()), pa.array([hashlib.sha256(t.as_buffer()).hexdigest() for t in texts], pa.string())]
        names = ["id", "n_tokens", "ids_sha256", "decoded_sha256"]
        if with_ids:
            columns += [pa.ListArray.from_arrays(ends.astype(np.int32), every.cast(pa.int32()))]
            names += ["ids"]
        return pa.RecordBatch.from_arrays(columns, names=names)

    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(tidy(run), f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)


def decode(df: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``id, decoded``: what the tokenizer's ``decode(ids, skip_special_tokens=False)`` gives for arrays of ids.

    A join of the ids, by position, with the id-to-piece table, done within each row's array: the table has one row
    for each id of the vocabulary. Null arrays give null, empty ones the empty text; ids beyond the table are an error.
    Null ids of rows stay null, repeated rows stay repeated, other columns are not read.
    """

    pieces = piece_table(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1).cast(pa.large_list(pa.int64()))
            texts = decode_ids(pieces, pa.LargeListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))]), pa.int64()), lists.flatten()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pc.if_else(lists.is_valid(), texts.cast(pa.large_string()), pa.scalar(None, pa.large_string())).cast(pa.string())], names=["id", "decoded"])

    source = df.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))
    return source.mapInArrow(run, f"id {source.schema['id'].dataType.simpleString()}, decoded string").withColumnRenamed("id", id_col)
