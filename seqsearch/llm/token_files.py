"""Token ids as flat binary files, with 64-bit document offsets, for training loaders that map memory.

Layout of a folder, ``k`` being the number of a part:

* ``part-k.ids``: the ids of the part's documents, one after the other, unsigned little-endian integers of
  2 bytes where the vocabulary allows it, else 4;
* ``part-k.off``: 64-bit offsets, in ids, of the part's documents, and of its end;
* ``part-k.doc``: the 64-bit ids of the documents;
* ``index/``: Parquet, a row for each part: ``part, n_docs, n_null, n_tokens, width, base``; ``base`` is the number of
  ids in all parts before it, a prefix sum over the parts, and the first ``n_null`` documents have no id.

Documents are range-partitioned by id and sorted within a part, so the parts in order hold the documents in
ascending order. Ids are written as batches come, under a name of their own; a part that is whole is moved to its name, so
a task that runs again (a lost executor) writes the same file again. The driver handles one small row for each part, no
document.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .chunks import PieceEncoder, distinct, groups
from .common import Blob, map_blob, parts_for, scratch
from .token_counts import _splittable, load_once

#: Bytes of texts as they are stored, for each part.
PART = 64 << 20
#: Documents are read back in batches of about so many bytes of ids.
BATCH = 4 << 20


@lru_cache(maxsize=2)
def _encoder(path: str, dtype: str) -> PieceEncoder:
    return PieceEncoder(path, lambda ids: array(_CODES[dtype], ids).tobytes())


#: array's type codes; executors are little-endian machines, as Spark's own formats assume
_CODES = {"<u2": "H", "<u4": "I"}


def encode(path: str, dtype: str, texts: pa.Array, end: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The ids of the texts, each text's followed by ``end``, in steps: ids, and the numbers of the ids of texts before
    which a text ends. Null and empty texts have none but ``end``."""
    ended = 0  # texts of which the end has been given
    if _splittable(path):
        for owner, part, at in groups(texts):
            found, codes = distinct(part, at)
            if not found:
                continue
            made = _encoder(path, dtype).values(found)
            sizes = np.fromiter(map(len, made), np.int64, len(made)) // np.dtype(dtype).itemsize
            # the end is one more piece, after the last piece of each text before this group's last one
            last = int(owner[-1])
            places = np.searchsorted(owner, np.arange(ended, last), "right")
            codes = np.insert(codes, places, len(made))
            lists = pa.LargeListArray.from_arrays(np.concatenate([[0], np.cumsum(sizes), [int(sizes.sum()) + 1]]), pa.array(np.frombuffer(b"".join([*made, np.array([end], dtype).tobytes()]), dtype)))
            ids = lists.take(pa.array(codes)).flatten().to_numpy()
            yield ids, np.cumsum(np.append(sizes, 1)[codes])[places + np.arange(len(places))]
            ended = last
    else:
        for i, text in enumerate(texts.to_pylist()):
            ids = [*load_once(path).encode(text or "", add_special_tokens=False).ids, end]
            yield np.array(ids, dtype), np.array([len(ids)])
            ended = i + 1
    left = len(texts) - ended
    yield np.full(left, end, dtype), np.arange(1, left + 1)


def write(df: DataFrame, path: str, end_id: int, out: str | None = None, parts: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> str:
    """Write the documents' ids, each document followed by ``end_id``; returns the folder's URI.

    ``out``: a folder that all executors can write to; by default one below ``spark.checkpoint.dir``. ``parts``: by
    default as the size of the texts asks for, ``spark.sql.shuffle.partitions`` at least. Null and empty texts hold the
    end id alone. Very long texts are written in several steps. Repeated ids stand side by side by their texts, as do
    null ids, which come first; a second and third key deal them out to parts. Ids must be integers. An empty table
    gives an index without parts. Other columns are not read, so extra ones may have any names.
    """
    spark = df.sparkSession
    if not isinstance(df.schema[id_col].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        raise TypeError(f"{id_col} must be an integer column")
    out = out or scratch(spark, "token-files")
    parts = parts or parts_for(df, PART)
    width = "<u2" if load_once(path).get_vocab_size(with_added_tokens=True) <= 1 << 16 and end_id < 1 << 16 else "<u4"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = TaskContext.get().partitionId()
        name = f"{out}/part-{k:06d}"
        n_docs = n_null = n_tokens = 0
        blobs: list[Blob] = []
        try:
            for batch in batches:
                if not batch.num_rows:
                    continue
                if not blobs:
                    blobs += [Blob(f"{name}.{x}") for x in ("ids", "off", "doc")]
                    blobs[1].write(bytes(8))
                for ids, ends in encode(path, width, batch.column(1), end_id):
                    blobs[0].write(ids.tobytes())
                    blobs[1].write((n_tokens + ends).astype("<i8").tobytes())
                    n_tokens += len(ids)
                docs = batch.column(0)
                blobs[2].write(docs.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8").tobytes())
                n_docs, n_null = n_docs + batch.num_rows, n_null + docs.null_count
            if blobs:
                for blob in blobs:
                    blob.done()
                blobs = []
                yield pa.RecordBatch.from_pydict({"part": [k], "n_docs": [n_docs], "n_null": [n_null], "n_tokens": [n_tokens], "width": [width]})
        finally:
            for blob in blobs:
                blob.drop()

    source = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    ordered = (F.col("id").asc_nulls_first(), F.substring("text", 1, 64).asc_nulls_first())
    spread = source.withColumn("row", F.monotonically_increasing_id()).repartitionByRange(parts, *ordered, F.xxhash64("text"), F.col("row"))
    made = spread.sortWithinPartitions(F.col("id").asc_nulls_first(), F.col("text").asc_nulls_first()).select("id", "text").mapInArrow(run, "part long, n_docs long, n_null long, n_tokens long, width string")
    made.write.parquet(f"{out}/made")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    spark.read.schema(made.schema).parquet(f"{out}/made").withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0))).write.parquet(f"{out}/index")
    return out


def read(spark, out: str) -> DataFrame:
    """Every document of a folder, read back from its files: ``doc_id, start, n_tokens, ids`` (bytes, 32-bit
    little-endian). A folder without parts gives no rows; a part whose files and index differ is an error."""
    return _read(spark, out, "ids binary", lambda ids: ids.astype("<u4").tobytes())


def read_digests(spark, out: str) -> DataFrame:
    """As ``read``, with ``ids_crc32`` of the ids as little-endian unsigned 32-bit integers in their place."""
    return _read(spark, out, "ids_crc32 long", lambda ids: zlib.crc32(ids.astype("<u4").tobytes()))


def _read(spark, out: str, column: str, value) -> DataFrame:
    kind = pa.binary() if column.endswith("binary") else pa.int64()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                name = f"{out}/part-{row['part']:06d}"
                ids, off, docs = map_blob(f"{name}.ids", row["width"]), map_blob(f"{name}.off", "<i8"), map_blob(f"{name}.doc", "<i8")
                if len(docs) != row["n_docs"] or len(ids) != row["n_tokens"]:
                    raise OSError(f"{name}: files and index differ")
                at = 0
                while at < len(docs):
                    stop = max(at + 1, min(at + 8192, int(np.searchsorted(off, off[at] + BATCH // 4, "right")) - 1))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([None if i < row["n_null"] else int(docs[i]) for i in range(at, stop)], pa.int64()),
                            pa.array(off[at:stop] + row["base"], pa.int64()),
                            pa.array(np.diff(off[at : stop + 1]), pa.int64()),
                            pa.array([value(ids[off[i] : off[i + 1]]) for i in range(at, stop)], kind),
                        ],
                        names=["doc_id", "start", "n_tokens", column.split()[0]],
                    )
                    at = stop

    index = spark.read.schema("part long, n_docs long, n_null long, n_tokens long, width string, base long").parquet(f"{out}/index")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return index.repartitionByRange(parts, "part").mapInArrow(run, f"doc_id long, start long, n_tokens long, {column}")
