"""Scores, thresholds and statistics as column expressions: all of it stays in the JVM but the printing of doubles."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Gap costs, and the statistical parameters of the matrix with these costs.
GAP_FIRST, GAP_NEXT = 11, 1
LAMBDA, K, LN2 = 0.267, 0.041, 0.69314718055995
BIN = 8


def normalise(text: str) -> Column:
    """Residues of a text: letters A to Z in upper case, nothing else. ASCII is filtered before case is changed."""
    return F.upper(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), "[^A-Za-z]", ""))


def residues(seq: str, role: str = "db") -> Column:
    """A FASTA record's sequence: upper case, illegal characters as ``*``; in databases ``-`` is dropped."""
    col = F.regexp_replace(F.col(seq), "-", "") if role == "db" else F.col(seq)
    return F.upper(F.regexp_replace(col, "[^A-Za-z]", "*"))


def kmer_code(kmer: str) -> Column:
    """A k-mer as a number: five bits a residue, the first lowest."""
    return F.aggregate(F.split(kmer, ""), F.struct(F.lit(0).cast("long").alias("code"), F.lit(1).cast("long").alias("unit")), lambda s, c: F.when(c == "", s).otherwise(F.struct((s["code"] + (F.ascii(c) - 65) * s["unit"]).alias("code"), (s["unit"] * 32).alias("unit"))), lambda s: s["code"])


def homopolymer(kmer: str, k: int) -> Column:
    return F.col(kmer) == F.repeat(F.substring(kmer, 1, 1), k)


def threshold(q_len: str, k: int, filter_level: int) -> Column:
    """Votes must exceed this: the integer part of log10(length) + level + 5 - k."""
    return F.floor(F.log10(F.col(q_len).cast("double")) + F.lit(float(filter_level + 5 - k))).cast("long")


def diagonal_bin(q_len: str, s_pos: str, q_pos: str) -> Column:
    """Diagonals are grouped by eight; a bin's centre is ``8 * bin + 3``."""
    return F.expr(f"(cast({q_len} as bigint) + {s_pos} - {q_pos}) div {BIN}")


def bitscore(score: str) -> Column:
    return F.floor((F.lit(LAMBDA) * F.col(score) - F.lit(math.log(K))) / F.lit(LN2)).cast("int")


def evalue(bits: str, q_len: str, space: Column) -> Column:
    return space.cast("double") * F.col(q_len) * F.pow(F.lit(2.0), -F.col(bits))


def identifier(name: str) -> Column:
    """A header up to its first space."""
    return F.substring_index(name, " ", 1)


def gap_count(a: str, b: str) -> Column:
    return (F.regexp_count(F.col(a), F.lit("-")) + F.regexp_count(F.col(b), F.lit("-"))).cast("int")


def gap_opens(a: str, b: str) -> Column:
    return (F.regexp_count(F.col(a), F.lit("-+")) + F.regexp_count(F.col(b), F.lit("-+"))).cast("int")


def mismatches(q_aln: str, s_aln: str) -> Column:
    """Columns whose characters differ; gaps count."""
    pairs = F.zip_with(F.split(q_aln, ""), F.split(s_aln, ""), lambda x, y: F.when(x != y, 1).otherwise(0))
    return F.aggregate(pairs, F.lit(0), lambda s, x: s + x)


def _six_digits(values: pa.Array) -> pa.Array:
    coded = values.dictionary_encode()
    return pa.array(["0" if x == 0 else f"{x:.6g}" for x in coded.dictionary.to_pylist()], pa.string()).take(coded.indices)


def six_digits(value: str) -> Column:
    """A double with six significant digits and no trailing zeros, as C++ streams print it; made once for each distinct value of
    an Arrow batch, as E-values and shares of small numbers are few."""
    return F.arrow_udf(_six_digits, "string")(F.col(value).cast("double"))
