"""What the operators of this subpackage share: columns, shared folders, cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of bytes other than these six ASCII white-space characters.
WORD_GAP = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where the session names none and runs on one machine (tests) a temporary one is made and set; on a cluster that
    is an error, as each machine would have its own.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        jdir = spark.sparkContext._jsc.sc().getCheckpointDir()
        named = jdir.get() if jdir.isDefined() else None
    if not named:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="seqsearch-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark)}/seqsearch/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet below the shared folder and read it again.

    Lineage ends there; a lost executor costs a read, not a recomputation.
    """
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parts_for(df: DataFrame, each: int) -> int:
    """Partitions for a shuffle of ``df``: one for ``each`` bytes of the files that it is read from, but at least
    ``spark.sql.shuffle.partitions``. Inputs of unknown size count as nothing."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = (int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), sum(n for n in sizes if n < 1 << 60) // each)


def small(df: DataFrame, most: int) -> DataFrame:
    """``df`` with a hint to broadcast it if it has at most ``most`` rows; else joins shuffle it."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def words(text: str) -> F.Column:
    """Native: array of the words of a string column; null and empty texts have none."""
    parts = F.split(F.coalesce(F.col(text), F.lit("")), WORD_GAP)
    return F.filter(parts, lambda w: w != "")


def open_fs(uri: str):
    """(pyarrow filesystem, path) of a URI; a plain path is local."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


class Blob:
    """A file that is written in steps under a name of its own and moved to ``uri`` when it is whole, so that a reader
    sees a whole file or none. A repeated attempt of a task writes the same bytes again."""

    def __init__(self, uri: str):
        self.filesystem, self.path = open_fs(uri)
        self.filesystem.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.own = f"{self.path}.{uuid.uuid4().hex}"
        self.out = self.filesystem.open_output_stream(self.own)
        self.write = self.out.write

    def done(self) -> None:
        self.out.close()
        self.filesystem.move(self.own, self.path)

    def drop(self) -> None:
        """Leave nothing of a file that isn't whole."""
        self.out.close()
        self.filesystem.delete_file(self.own)


def map_blob(uri: str, dtype: str):
    """A file as a numpy array: memory-mapped where it is local, else read. No file: an empty array."""
    import numpy as np

    filesystem, path = open_fs(uri)
    if not filesystem.get_file_info(path).size:
        return np.empty(0, dtype)
    if filesystem.type_name == "local":
        return np.memmap(path, dtype=dtype, mode="r")
    with filesystem.open_input_file(path) as f:
        return np.frombuffer(f.read(), dtype=dtype)


def let_go() -> None:
    """Give memory that is free back to the machine: Spark keeps Python workers for later tasks, which may be others', and
    the JVM beside them needs the room."""
    import contextlib
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def tidy(run):
    """An Arrow function that calls ``let_go`` at the end of each task."""

    def whole(batches):
        try:
            yield from run(batches)
        finally:
            let_go()

    return whole
