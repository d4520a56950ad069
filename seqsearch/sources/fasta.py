"""FASTA records as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scoring import residues


def parse(records: DataFrame, text: str = "value", role: str = "db", keep: tuple[str, ...] = ()) -> DataFrame:
    """``[keep], name, seq`` of records given as text without the leading ``>``: a header line and content lines.

    The header is the rest of its line. Content ends at a blank line, in databases also at a line that starts with ``#``;
    what follows until the next record is no part of it. A record with a space in its content, or without a name, is
    dropped; one without content stays, with an empty sequence. Letters are upper-cased, other characters become ``*``,
    and databases lose ``-``. A last line without a line feed is content like any other.
    """
    if role not in ("query", "db"):
        raise ValueError("role must be 'query' or 'db'")
    lines = F.split(F.col(text), "\n")
    ends: Column = F.array_position(F.transform(F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0))), lambda x: ((x == "") | x.startswith("#")) if role == "db" else (x == "")), True)
    content = F.slice(lines, F.lit(2), F.when(ends > 0, ends.cast("int") - 1).otherwise(F.greatest(F.size(lines) - 1, F.lit(0))))
    out = records.select(*keep, F.get(lines, F.lit(0)).alias("name"), F.array_join(content, "").alias("raw"))
    return out.where((F.col("name") != "") & ~F.col("raw").contains(" ")).select(*keep, "name", residues("raw", role).alias("seq"))


def records(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``value`` for each record of FASTA files, without its ``>``. What stands before a file's first ``>`` is no record.

    Spark splits the files at line starts of ``>``, so large ones are read in parallel by all cores. Only a file's first piece
    still has its ``>``, or is no record if it has none; it is the first row of the split that begins the file. Files of
    any length give one row each to find it, and splits are the same whenever the files are read.
    """
    raw = spark.read.option("lineSep", "\n>").text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    first = raw.where("block = 0").groupBy("file").agg(F.min("row").alias("first")).select(F.col("first"), F.lit(True).alias("begins"))
    # by the row's number, so that the rows stay where they are read
    pieces = raw.join(F.broadcast(first), F.col("row") == F.col("first"), "left")
    whole = F.when(F.col("begins"), F.substr("value", F.lit(2))).otherwise(F.col("value"))
    kept = pieces.where(F.col("begins").isNull() | F.col("value").startswith(">"))
    return kept.select(F.regexp_replace(whole, r"\n\z", "").alias("value"))


def read_fasta(spark: SparkSession, path: str | list[str], role: str = "db") -> DataFrame:
    """``name, seq`` of the records of FASTA files."""
    return parse(records(spark, path), "value", role)


def with_ids(df: DataFrame, prefix: str) -> DataFrame:
    """``<prefix>_id, _name, _seq, _len``: ids from 0 in the order of the files, without a sort or a single task."""
    return _indexed(df, prefix).withColumn(f"{prefix}_len", F.length(f"{prefix}_seq"))


def _indexed(df: DataFrame, prefix: str) -> DataFrame:
    """Numbers rows by partition and place in it; partitions' bases are a running sum over one row each."""
    placed = df.withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id())
    sizes = placed.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"), F.min("_i").alias("_first"))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).select("_p", "_base")
    return placed.join(F.broadcast(base), "_p").select((F.col("_i") + F.col("_base")).alias(f"{prefix}_id"), F.col("name").alias(f"{prefix}_name"), F.col("seq").alias(f"{prefix}_seq"))
