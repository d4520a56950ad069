"""Search over FASTA files as they arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..config import SearchConfig
from ..plans.search import search
from ..sources.fasta import parse


def search_files(spark: SparkSession, folder: str, queries: DataFrame, cfg: SearchConfig, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Runs a fixed query set against each batch of new files; ``sink`` gets the ranked hits and the batch's number.

    E-values refer to ``cfg.search_space``, a number, so that they don't depend on how files fall into batches.
    A batch that is run again after a failure has the same number, so a sink that overwrites by it writes once.
    """
    if not isinstance(cfg.search_space, int):
        raise ValueError("a stream needs a search space given as a number")

    def each(batch: DataFrame, number: int) -> None:
        text = batch.select(F.regexp_replace(F.regexp_replace("value", r"\A>", ""), r"\n\z", "").alias("value"))
        subjects = parse(text, "value", "db").select(F.xxhash64("name", "seq").alias("s_id"), F.col("name").alias("s_name"), F.col("seq").alias("s_seq"))
        sink(search(queries, subjects, cfg), number)

    stream = spark.readStream.option("lineSep", "\n>").text(folder)
    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
