from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from seqsearch.config import SearchConfig
from seqsearch.functions import scoring
from seqsearch.functions.matrix import blosum62


def test_matrix_is_the_public_one():
    m = blosum62()
    assert m.shape == (26, 26) and (m == m.T).all()
    diagonal = dict(zip("ABCDEFGHIJKLMNOPQRSTUVWXYZ", m.diagonal().tolist(), strict=True))
    assert diagonal == dict(A=4, B=4, C=9, D=6, E=5, F=6, G=6, H=8, I=4, J=3, K=5, L=4, M=5, N=6, O=0, P=7, Q=5, R=5, S=4, T=5, U=0, V=4, W=11, X=-1, Y=7, Z=4)
    at = lambda a, b: m[ord(a) - 65, ord(b) - 65]
    assert (m[14] == 0).all() and (m[20] == 0).all()
    assert all(at("X", c) == (0 if c in "OU" else -1) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
    assert [at("W", "Y"), at("B", "K"), at("Z", "C"), at("J", "M"), at("I", "V"), at("F", "W")] == [2, 0, -3, 2, 3, 1]


@pytest.mark.parametrize(("k", "p", "n", "least"), [(5, 1, 9, 1), (5, 1, 99, 2), (5, 1, 100, 3), (5, 1, 300, 3), (5, 0, 50, 1), (4, 1, 1000, 5), (3, 1, 300, 5)])
def test_thresholds(spark, k, p, n, least):
    assert spark.range(1).select(F.lit(n).alias("q_len")).select(scoring.threshold("q_len", k, p)).first()[0] == least


def test_bit_scores_and_evalues(spark):
    rows = spark.createDataFrame([(s,) for s in (0, 20, 40, 60, 100)], "score int").withColumn("bits", scoring.bitscore("score")).withColumn("q_len", F.lit(10))
    got = rows.withColumn("e", scoring.evalue("bits", "q_len", F.lit(1000))).orderBy("score").collect()
    assert [r["bits"] for r in got] == [4, 12, 20, 27, 43]
    assert [r["e"] for r in got] == [1000 * 10 * 2.0**-b for b in (4, 12, 20, 27, 43)]


def test_six_digits_as_streams_print_them(spark):
    values = [0.0, 1.0, 100.0, 99.5, 1.5e-20, 1234567.0, 123456.0, 0.0001, 0.00001234567, 33.333333333, 66.6666666, 999999.5, 1e-5, 2.5e100, 87.5, 3.0e-310, 100000.0, 1e15, 35.15625, 35.15635, 0.0009765625, 2.0000005, 4.0000015, 32.8125, 1.00000625, 7812.5625, 12345.5, 65535.25]
    got = [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").orderBy("i").select(scoring.six_digits("v")).collect()]
    assert got == [f"{v:g}" for v in values]


def test_kmer_code_and_homopolymers(spark):
    rows = spark.createDataFrame([("AAAAA",), ("XXXXX",), ("AAAAC",), ("BCDEF",)], "kmer string")
    got = rows.select(scoring.kmer_code("kmer"), scoring.homopolymer("kmer", 5)).collect()
    assert [r[0] for r in got] == [0, sum(23 << (5 * i) for i in range(5)), 2 << 20, sum((i + 1) << (5 * i) for i in range(5))]
    assert [r[1] for r in got] == [True, True, False, False]


def test_normalise_filters_ascii_before_case(spark):
    assert spark.createDataFrame([("aß Zé-1",)], "t string").select(scoring.normalise("t")).first()[0] == "AZ"


def test_config_is_validated():
    for bad in ({"k": 6}, {"band": 0}, {"max_align": -1}, {"search_space": "x"}, {"must_include": (("A", 0),)}):
        with pytest.raises(ValueError):
            SearchConfig(**bad)
    assert math.isclose(SearchConfig().max_evalue, 10)


def test_six_digits_are_made_for_distinct_values(spark):
    import pyarrow as pa

    values = pa.array([0.5, None, -0.0, 0.5, 1e-7, float("inf")] * 50)
    assert scoring._six_digits(values).to_pylist() == ["0.5", None, "0", "0.5", "1e-07", "inf"] * 50
    plan = spark.range(2).selectExpr("cast(id as double) v", "cast(id as double) / 3 w").select(scoring.six_digits("v"), scoring.six_digits("w"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "format_string" not in plan
