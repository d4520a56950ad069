"""Quality rules as weak supervision, in DataFrame functions only.

Each rule reads cheap counts of a document and votes good (1) or bad (-1), or abstains (0). How far a rule can
be trusted is not set by hand: expectation-maximisation over the whole table estimates, for each rule, how
often it votes bad on good and on bad documents, and from these each document's probability of being good.

Documents enter the estimation only through their pattern of votes, and there are at most 3 ** (number of rules)
patterns whatever the size of the table. So one aggregation with partial counts is the only shuffle; the rounds of
the estimation run inside one row, and the patterns' probabilities come back by a join with at most that many rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD_GAP, cut

SYMBOLS = "#*$%&|<>"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
ROUNDS = 20
#: Rules as (name, bad if, good if), integer SQL conditions over the counts; neither: the rule abstains. Symbols and bars have
#: a strict and a mild rule: text that is full of them breaks both, so that the estimation can tell it from text with one
#: weak bad vote without being told how far each rule can be trusted.
RULES = (
    ("symbols", "100 * n_symbols > 8 * word_chars", "100 * n_symbols <= word_chars"),
    ("capitals", "100 * n_upper > 40 * (n_upper + n_lower)", "100 * n_upper <= 15 * (n_upper + n_lower)"),
    ("exclamations", "100 * n_exclaims > 20 * n_words", "100 * n_exclaims <= 2 * n_words"),
    ("bars", "100 * n_bars > 15 * n_words", "n_bars = 0"),
    ("repeats", "100 * n_repeat_words > 25 * n_words", "100 * n_repeat_words <= 10 * n_words"),
    ("same_lines", "100 * n_dup_lines > 60 * n_lines", "n_dup_lines = 0 and n_lines >= 5"),
    ("word_length", "word_chars > 14 * n_words or word_chars < 2 * n_words", "word_chars between 3 * n_words and 12 * n_words"),
    ("sentences", "100 * n_stops < n_words", "100 * n_stops >= 3 * n_words"),
    ("some_symbols", "100 * n_symbols > 3 * word_chars", "200 * n_symbols <= word_chars"),
    ("some_bars", "100 * n_bars > 5 * n_words", "100 * n_bars <= n_words"),
)
#: Start of the estimation: share of good documents, and how often a rule that votes says bad of bad and of good ones.
START = (0.8, 0.3, 0.005)
#: Added to each count of votes, so that no estimate is 0 or 1.
SMOOTH = 1.0


def _without(column: str, characters: str) -> Column:
    return F.length(column) - F.length(F.translate(column, characters, ""))


def counts(df: DataFrame, carried: Column, text_col: str = "text") -> DataFrame:
    """``id``, which is ``carried``, and the counts that rules read, for each row; a null text has none of anything.

    All within a row: a document's words and 3-word windows stay arrays, nothing is exploded.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    a = df.select(carried.alias("id"), text.alias("text"))
    # what is left when lower-case and non-ASCII characters go is short, and holds all that is counted by character
    a = a.select("id", "text", F.regexp_replace("text", r"[^\x00-\x60\x7B-\x7F]+", "").alias("rest"), F.filter(F.split("text", WORD_GAP), lambda w: w != "").alias("words"), F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"))
    last = F.size("words") - 3
    windows = F.when(last < 0, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(F.get("words", i), F.get("words", i + 1), F.get("words", i + 2))))
    a = a.select("id", F.size("words").cast("long").alias("n_words"), F.length("text").alias("chars"), "rest", windows.alias("windows"), F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"))
    some = F.size(F.array_distinct("windows")) < F.size("windows")
    a = a.withColumn("placed", F.when(some, F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    same = lambda x, i: (F.get("placed", i - 1)["h"] == x["h"]) | (F.get("placed", i + 1)["h"] == x["h"])
    a = a.withColumn("found", F.when(F.col("placed").isNotNull(), F.sort_array(F.transform(F.filter("placed", lambda x, i: F.coalesce(same(x, i), F.lit(False))), lambda x: x["i"]))))
    # a window covers 3 words, or as many as there are up to the next one's start
    covered = F.transform("found", lambda x, i: F.least(F.lit(3), F.coalesce(F.get("found", i + 1) - x, F.lit(3))))
    a = a.withColumn("n_repeat_words", F.coalesce(F.aggregate(covered, F.lit(0), lambda s, x: s + x), F.lit(0)).cast("long"))
    gaps = " \t\n\x0b\x0c\r"
    return a.select(
        "id",
        "n_words",
        (F.col("chars") - _without("rest", gaps)).cast("long").alias("word_chars"),
        _without("rest", SYMBOLS).cast("long").alias("n_symbols"),
        "n_dup_lines",
        "n_repeat_words",
        "n_lines",
        _without("rest", UPPER).cast("long").alias("n_upper"),
        (F.col("chars") - F.length("rest")).cast("long").alias("n_lower"),
        _without("rest", "!").cast("long").alias("n_exclaims"),
        _without("rest", "|").cast("long").alias("n_bars"),
        _without("rest", ".").cast("long").alias("n_stops"),
    )


def _votes(counted: DataFrame) -> DataFrame:
    """Adds ``pattern``: the votes plus 1 as digits of base 3; null for a document without a word, which has no vote."""
    pattern = reduce(lambda a, r: a * 3 + F.expr(f"case when {r[1]} then 0 when {r[2]} then 2 else 1 end"), RULES, F.lit(0))
    return counted.withColumn("pattern", F.when(F.col("n_words") > 0, pattern.cast("int")))


def _sum(xs, value) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda s, x: s + value(x))


def estimate(patterns: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """``pattern, n`` (a row for each pattern) to one row: ``share`` of good documents, ``bad`` and ``good``, for each
    rule how often it says bad of bad and of good documents when it votes, and ``posteriors`` of the patterns."""
    k = len(RULES)
    votes = lambda p: F.transform(F.sequence(F.lit(k - 1), F.lit(0)), lambda j: F.pmod((p / F.pow(F.lit(3.0), j)).cast("int"), F.lit(3)))
    one = patterns.where("pattern is not null").agg(F.sort_array(F.collect_list(F.struct("pattern", F.col("n").cast("double").alias("n")))).alias("rows"))
    one = one.select(F.transform("rows", lambda r: F.struct(r["pattern"].alias("pattern"), r["n"].alias("n"), votes(r["pattern"]).alias("v"))).alias("rows"))

    def posterior(state, r):
        each = F.transform(r["v"], lambda v, j: F.when(v == 0, F.log(F.get(state["good"], j) / F.get(state["bad"], j))).when(v == 2, F.log((1 - F.get(state["good"], j)) / (1 - F.get(state["bad"], j)))).otherwise(0.0))
        return 1 / (1 + F.exp(-(F.log(state["share"] / (1 - state["share"])) + _sum(each, lambda x: x))))

    def step(state, _):
        weighed = F.transform("rows", lambda r: F.struct(r["n"].alias("n"), r["v"].alias("v"), (r["n"] * posterior(state, r)).alias("g")))
        # in an array of one element, so that the weighed rows are made once and then named
        return F.get(F.transform(F.array(weighed), update), F.lit(0))

    def update(rows):
        def rate(weight):
            at = lambda j, kinds: _sum(rows, lambda r: F.when(F.get(r["v"], j).isin(kinds), weight(r)).otherwise(0.0))
            return F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda j: (at(j, [0]) + SMOOTH) / (at(j, [0, 2]) + 2 * SMOOTH))

        share = (_sum(rows, lambda r: r["g"]) + SMOOTH) / (_sum(rows, lambda r: r["n"]) + 2 * SMOOTH)
        return F.struct(share.alias("share"), rate(lambda r: r["n"] - r["g"]).alias("bad"), rate(lambda r: r["g"]).alias("good"))

    start = F.struct(F.lit(START[0]).alias("share"), F.array_repeat(F.lit(START[1]), k).alias("bad"), F.array_repeat(F.lit(START[2]), k).alias("good"))
    one = one.withColumn("state", F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, step))
    return one.select("state.share", "state.bad", "state.good", F.transform("rows", lambda r: F.struct(r["pattern"].alias("pattern"), posterior(F.col("state"), r).alias("p_quality"))).alias("posteriors"))


def quality_rules(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5, rounds: int = ROUNDS) -> DataFrame:
    """A row for each row of ``df``: ``id``, the base counts, ``base_failed``, ``pattern``, ``p_quality`` and ``kept``.

    ``base_failed``: under 50 words, or over half of the words in repeated 3-word windows. ``kept``: not failed and a
    probability of at least ``least``. A null, empty or blank text has counts of 0, no vote, a null probability, and
    fails. Texts are counted whole, however long. Equal patterns of votes get equal probabilities, so there are no ties.
    Null ids stay null, repeated rows stay repeated, an empty table gives an empty one; other columns are not
    read. Reads the texts once: the counts are written to the shared folder before they are used twice.
    """
    voted = cut(_votes(counts(df, F.col(id_col), text_col)), "rule-votes")
    out = _judge(voted, voted.groupBy("pattern").agg(F.count(F.lit(1)).alias("n")), least, rounds)
    return out.select(F.col("id").alias(id_col), *BASE, "base_failed", "kept", "pattern", "p_quality")


def keep_good(df: DataFrame, text_col: str = "text", least: float = 0.5, rounds: int = ROUNDS) -> DataFrame:
    """The rows of ``df`` that ``quality_rules`` keeps, with all their columns; cases as there.

    Reads the texts twice, to estimate and to judge; only a row for each pattern of votes is written, no text."""
    voted = _votes(counts(df, F.struct(*(F.col(f"`{c}`") for c in df.columns)), text_col))
    patterns = cut(voted.groupBy("pattern").agg(F.count(F.lit(1)).alias("n")), "rule-patterns")
    # counts come out of an array of one row, so that what is filtered by them doesn't count once more
    once = voted.select("id", F.inline(F.array(F.struct("n_words", "n_repeat_words", "pattern"))))
    return _judge(once, patterns, least, rounds).where("kept").select("id.*")


def _judge(voted: DataFrame, patterns: DataFrame, least: float, rounds: int) -> DataFrame:
    known = estimate(patterns, rounds).select(F.explode("posteriors").alias("x")).select("x.pattern", "x.p_quality")
    out = voted.join(F.broadcast(known), "pattern", "left")  # at most 3 ** len(RULES) rows
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    out = out.withColumn("base_failed", failed)
    return out.withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("p_quality") >= least, F.lit(False)))
