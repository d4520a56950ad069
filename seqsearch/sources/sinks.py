"""Results as text, in six layouts. Each field of the tabular ones is followed by a tab."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import FORMATS
from ..functions.scoring import identifier, six_digits


def _tabbed(*columns: Column) -> Column:
    return F.concat(*[F.concat(c.cast("string"), F.lit("\t")) for c in columns])


def tabular(hits: DataFrame) -> Column:
    """Twelve columns; the last is the raw score."""
    return _tabbed(identifier("q_name"), identifier("s_name"), six_digits("p_identity"), *map(F.col, ("align_length", "mismatch", "gap_open", "q_begin", "q_end", "s_begin", "s_end")), six_digits("evalue"), F.col("score"))


def extended(hits: DataFrame) -> Column:
    """Sixteen columns, with the shares of positives and of the subject covered (its last residue left out)."""
    return _tabbed(identifier("s_name"), identifier("q_name"), F.col("q_name"), six_digits("evalue"), *map(F.col, ("bitscore", "score", "align_length")), six_digits("p_identity"), *map(F.col, ("n_identity", "mismatch", "positive", "gap_open", "gaps")), six_digits("ppos"), six_digits("scov"), F.col("s_ori"))


def reduced(hits: DataFrame) -> Column:
    return _tabbed(identifier("q_name"), identifier("s_name"), six_digits("evalue"), F.col("score"), F.col("bitscore"))


def fasta(hits: DataFrame) -> Column:
    """The aligned part of the subject, without gaps, under its full name."""
    return F.concat(F.lit(">"), F.col("s_name"), F.lit("\n"), F.col("s_ori"))


def a3m_row(hits: DataFrame) -> Column:
    """A subject in the columns of the query: insertions in lower case, ``-`` where it has nothing."""
    pairs = F.zip_with(F.split("q_aln", ""), F.split("s_aln", ""), lambda q, s: F.when(q == "-", F.when(s == "*", "J").otherwise(F.lower(s))).otherwise(s))
    after = F.col("q_len") - F.col("q_end") - 1
    return F.concat(F.lit(">"), F.col("s_name"), F.lit("\n"), F.repeat(F.lit("-"), F.col("q_begin")), F.array_join(pairs, ""), F.repeat(F.lit("-"), after))


def pairwise_row(hits: DataFrame) -> Column:
    score = F.concat(F.lit("\nScore = "), F.col("score").cast("string"), F.lit("\tE-value = "), six_digits("evalue"), F.lit("\n"))
    return F.concat(score, F.col("s_name"), F.lit("\nS: "), F.col("s_begin").cast("string"), F.lit("\t"), F.col("s_aln"), F.lit("\n     \t"), F.col("match"), F.lit("\nQ: "), F.col("q_begin").cast("string"), F.lit("\t"), F.col("q_aln"))


def with_shares(hits: DataFrame) -> DataFrame:
    return hits.withColumn("ppos", F.col("positive") / F.col("align_length") * 100).withColumn("scov", (F.col("s_end") - F.col("s_begin")) / F.col("s_len") * 100)


#: What each layout takes of an alignment's statistics and strings.
WANTED = {
    0: ("score", "p_identity", "align_length", "mismatch", "gap_open", "q_begin", "q_end", "s_begin", "s_end"),
    1: ("score", "q_begin", "s_begin", "q_aln", "s_aln", "match"),
    2: ("s_ori",),
    3: ("score", "align_length", "p_identity", "n_identity", "mismatch", "positive", "gap_open", "gaps", "s_begin", "s_end", "s_ori"),
    4: ("q_begin", "q_end", "q_aln", "s_aln"),
    5: ("score",),
}
ROWS = {0: tabular, 1: pairwise_row, 2: fasta, 3: extended, 4: a3m_row, 5: reduced}


def rendered(hits: DataFrame, fmt: int) -> DataFrame:
    """``q_id, rank, line`` of each hit in layout ``fmt`` (0 to 5)."""
    if fmt not in FORMATS:
        raise ValueError(f"format must be one of {sorted(FORMATS)}")
    if fmt == 3:
        hits = with_shares(hits)
    return hits.select("q_id", "rank", ROWS[fmt](hits).alias("line"))


def with_headers(lines: DataFrame, queries: DataFrame, fmt: int) -> DataFrame:
    """Adds each query's own lines, as rank 0, to those layouts that have them; queries without hits have them too."""
    if fmt == 4:
        head = F.concat(F.lit(">"), F.col("q_name"), F.lit("\n"), F.col("q_seq"))
    elif fmt == 1:
        head = F.concat(F.lit("=========================\n\nQuery "), F.col("q_id").cast("string"), F.lit(": "), F.col("q_name"), F.lit(" #"), F.col("q_seq"), F.lit("#"))
    else:
        return lines
    return lines.unionByName(queries.select("q_id", F.lit(0).alias("rank"), head.alias("line")))


def write(hits: DataFrame, queries: DataFrame, fmt: int, out: str) -> None:
    """Write text in query order. Layout 2 writes the tabular text too, below ``<out>.fasta`` the sequences; layout 4 a
    folder for each query. Files are written by the executors, sorted by ranges of the query id."""
    if fmt == 2:
        write(hits, queries, 0, out)
        out += ".fasta"
    lines = with_headers(rendered(hits, fmt), queries, fmt)
    if fmt == 4:
        named = lines.join(queries.select("q_id", identifier("q_name").alias("query")), "q_id")
        named.repartition("query").sortWithinPartitions("query", "rank").select("query", F.col("line").alias("value")).write.partitionBy("query").text(out)
        return
    lines.orderBy("q_id", "rank").select(F.col("line").alias("value")).write.text(out)
