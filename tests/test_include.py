from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F
from seqsearch.config import SearchConfig
from seqsearch.operators.include import before_alignment, count_matches, includes, java_pattern

TEXTS = ["AAAB", "", "BBB", "ARGWWHRAAAAH", "RAAAAHRAAAAAH", "A_B", "A*B*", "AB" * 40, "XAAX", None]


def plain(text: str | None, expression: str, most: int) -> int | None:
    """Search, and search again in what is left; these expressions mean the same to Python."""
    if text is None:
        return None
    n = 0
    while n < most and (m := re.search(expression, text)):
        n, text = n + 1, text[m.end() :]
    return n


@pytest.mark.parametrize("expression", ["^A", "A$", "A*", "A", "R[A-Z]{4,7}H", r"\bA", r"\BA", "A(?=B)", "A(?!A)", "(A)B|B\\1", "^(?:A|B)", "[^A]", "A|", r"\w", "[*_]", "AB?", "(AB)+"])
def test_counts_go_on_behind_the_last_match(spark, expression):
    table = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, t string")
    for most in (1, 3):
        made = [r[0] for r in table.orderBy("i").select(count_matches(F.col("t"), expression, most)).collect()]
        assert made == [plain(t, expression, most) for t in TEXTS], (expression, most)


def test_anchors_hold_again_behind_each_match(spark):
    row = spark.createDataFrame([("AAAB",)], "t string")
    assert row.select(includes(F.col("t"), (("^A", 3),))).first()[0] is True
    assert row.select(includes(F.col("t"), (("^A", 4),))).first()[0] is False
    assert row.select(includes(F.col("t"), (("^A", 3), ("B$", 1)))).first()[0] is True


def test_translation():
    assert java_pattern("^A$") == r"\AA\z"
    assert java_pattern("[[:alpha:]_]+") == r"[\p{Alpha}_]+"
    assert java_pattern("[a[b&&c^]") == r"[a\[b\&\&c\^]"
    assert java_pattern("[^]x]") == r"[^\]x]"
    assert java_pattern(r"\v\0\.\x41\u0041") == r"\x0B\x00\.\x41\u0041"
    for wrong in (r"\Ax", r"x\z", r"\Qx\E", "(?<=A)B", "(?i)a", "a++", "a*+", "[a", "a\\", r"\p{Alpha}", "[[:no:]]"):
        with pytest.raises(ValueError):
            java_pattern(wrong)
    with pytest.raises(ValueError):
        SearchConfig(must_include=(("(?<x>A)", 1),))


def test_brackets_hold_what_they_say(spark):
    row = spark.createDataFrame([("a[b&&c^]d",)], "t string")
    assert row.select(count_matches(F.col("t"), "[a[b&^]", 99)).first()[0] == 6
    assert row.select(count_matches(F.col("t"), "[[:alpha:]]", 99)).first()[0] == 4


@pytest.mark.parametrize("expression", ["A", "R[A-Z]{4,7}H", "AB?", "(AB)+", "A+B|A", "(?:A|AA)B", "(A)B|B\\1", "[*_]", "^A", "A*"])
def test_enough_matches(spark, expression):
    """The filter says what a count of the matches says, and doesn't give a match up to find others."""
    table = spark.createDataFrame([(i, t) for i, t in enumerate([*TEXTS, "AAB", "AAAB\nAB", "RAAAAHRAAAAH"])], "i int, t string").orderBy("i")
    for times in (1, 2, 3):
        made = [tuple(r) for r in table.select(includes(F.col("t"), ((expression, times),)), count_matches(F.col("t"), expression, times)).collect()]
        assert [m for m, _ in made] == [None if n is None else n >= times for _, n in made], (expression, times)


def test_filter_stops_at_the_last_match_asked_for(spark):
    """Windows are neither rewritten letter by letter nor searched to their ends."""
    plan = spark.createDataFrame([("AB",)], "t string").where(includes(before_alignment(F.col("t")), (("T[A-Z]{1,3}E", 2),)))._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" not in plan and "RLIKE" in plan
    texts = spark.createDataFrame([("A*B",), ("AB",), ("**",), ("",), (None,)], "t string")
    assert [r[0] for r in texts.select(before_alignment(F.col("t"))).collect()] == ["A_B", "AB", "__", "", None]
