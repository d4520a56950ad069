"""k-mers of sequences, and what an index of them looks like."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scoring import homopolymer


def kmers(df: DataFrame, id_col: str, seq_col: str, k: int, keep: tuple[str, ...] = ()) -> DataFrame:
    """``id, [keep], pos, kmer``: all overlapping k-mers. Sequences shorter than k, and null ones, have none.

    Position and k-mer are made inside the array that is exploded, so the sequence isn't copied to each row.
    """
    last = F.length(seq_col) - k
    at = F.transform(F.sequence(F.lit(0), last), lambda i: F.struct(i.alias("pos"), F.substring(F.col(seq_col), i + 1, F.lit(k)).alias("kmer")))
    return df.where(F.length(seq_col) >= k).select(id_col, *keep, F.explode(at).alias("x")).select(id_col, *keep, "x.pos", "x.kmer")


def seeds(df: DataFrame, id_col: str, seq_col: str, k: int, keep: tuple[str, ...] = (), illegal: bool = False, blank_tail_a: bool = False) -> DataFrame:
    """k-mers that may start a match: not one letter k times, and (unless ``illegal``) letters only."""
    found = kmers(df, id_col, seq_col, k, keep).where(~homopolymer("kmer", k))
    if not illegal:
        found = found.where(F.col("kmer").rlike("^[A-Z]+$"))
    return found.where(~_tail_a("kmer", k)) if blank_tail_a else found


def _tail_a(kmer: str, k: int) -> Column:
    """Three equal letters and then A's to the end."""
    first = F.substring(kmer, 1, 1)
    return F.col(kmer) == F.concat(F.repeat(first, 3), F.lit("A" * (k - 3)))


def index_stats(found: DataFrame) -> DataFrame:
    """Of k-mers: how many are distinct, and the most places that one has."""
    places = found.groupBy("kmer").agg(F.count(F.lit(1)).alias("places"))
    return places.agg(F.count(F.lit(1)).alias("distinct_kmers"), F.max("places").alias("max_places"))
