"""What operators share: checked broadcasts and spreading of small inputs over cores."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the folder that driver and executors share, ``spark.checkpoint.dir``. A session on one machine that
    names none gets a temporary one; on a cluster that is an error."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="seqsearch-")
    return f"{folder.rstrip('/')}/seqsearch/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet below the shared folder and read it again: lineage ends there, and what is read is the same
    however often."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, most: int) -> DataFrame:
    """``df`` with a hint to broadcast it if it has at most ``most`` rows; else joins shuffle it."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def spread(df: DataFrame) -> DataFrame:
    """A table smaller than one split for each core is dealt out to all cores; larger ones stay as they are read.

    Cutting a sequence into k-mers multiplies its bytes, so the work should be spread before. At scale the scan has
    splits enough and nothing is shuffled.
    """
    plan = df._jdf.queryExecution().optimizedPlan()
    while plan.children().size() == 1:
        if plan.getClass().getSimpleName().startswith("Repartition"):
            return df  # dealt out already
        plan = plan.children().head()
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    split = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < cores * split else df


def pieces(sizes: np.ndarray, most: int, rows: int) -> Iterator[tuple[int, int]]:
    """``(begin, end)`` of runs of rows whose ``sizes`` come to ``most`` at most, and of ``rows`` rows at most; a row that is larger
    is a run of its own."""
    ends, at = np.cumsum(sizes, dtype=np.int64), 0
    while at < len(sizes):
        end = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right"))
        end = min(max(end, at + 1), at + rows)
        yield at, end
        at = end
