"""Mix sources to target weights by hash thresholds, in DataFrame functions only; nothing is sorted.

A document's hash is a number below 2 ** 40 that depends on its id and text. A source takes every document whole as
often as its target holds all of them, and once more those whose hash is under a threshold that spends the rest of
the target. The threshold is found in a histogram: sizes are summed by source and hash bucket (partial sums before the
shuffle, so a source with a third of all rows is one row for each bucket and task), running sums over a source's buckets
tell the bucket in which the target is met, and only that bucket is split again by the next bits. Thresholds nest: a
larger target takes the documents of a smaller one and more.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_GAP, cut, small

BITS, LEVELS = 10, 4
WEIGHTS = (3, 1, 2)
#: Per-source plans are broadcast up to this number of sources, and joined by shuffle beyond it.
BROADCAST_SOURCES = 100_000


def word_count(text_col: str = "text") -> Column:
    """Number of words of a text; null: 0."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    parts = F.size(F.split(text, WORD_GAP))
    ends = F.when(text.rlike(r"\A[\x20\x09-\x0D]"), 1).otherwise(0) + F.when(text.rlike(r"[\x20\x09-\x0D]\z"), 1).otherwise(0)
    return F.when(text.rlike(r"[^\x20\x09-\x0D]"), parts - ends).otherwise(0).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, percent: int = 150, most: int = 2) -> DataFrame:
    """``source, source_size`` to those and ``target``: ``percent`` % of all sizes by weight, ``most`` times a size at most.

    Weights repeat over the sources in order of code points, null last. What a source cannot take goes to the
    others by weight until none is above its bound: all targets are ``level * weight`` or the bound, and the level
    follows from running sums in the order in which sources meet their bounds. A row for each source, no document.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.get(F.array(*map(F.lit, weights)), F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))))
    s = sizes.withColumn("w", w).withColumn("bound", most * F.col("source_size"))
    met = Window.orderBy(F.col("bound") / F.col("w"), F.col("source").asc_nulls_last())
    every = Window.partitionBy(F.lit(0))
    before = met.rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("budget", F.sum("source_size").over(every) * percent / F.lit(100.0)).withColumn("spent", F.coalesce(F.sum("bound").over(before), F.lit(0))).withColumn("left", F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0)))
    level = (F.col("budget") - F.col("spent")) / F.col("left")
    s = s.withColumn("level", F.when(level * F.col("w") <= F.col("bound"), level))
    s = s.withColumn("level", F.max("level").over(every))  # the first: levels rise up to it and fall after
    return s.select("source", "source_size", F.least(F.coalesce(F.col("level") * F.col("w"), F.col("bound").cast("double")), F.col("bound").cast("double")).alias("target"))


def _hash(id_col: str, text_col: str) -> Column:
    null = F.lit("")
    digest = F.md5(F.concat_ws("|", F.coalesce(F.col(id_col).cast("string"), null), F.coalesce(F.col(text_col).cast("string"), null)).cast("binary"))
    return F.conv(F.substring(digest, 1, BITS * LEVELS // 4), 16, 10).cast("long")


def _same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def thresholds(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, percent: int = 150, most: int = 2) -> DataFrame:
    """``source, size, h`` of documents to ``s, source_size, target, whole, limit``: how often a source's documents are
    taken whole, and under which hash once more."""
    shift = lambda level: BITS * (LEVELS - 1 - level)
    first = cut(docs.groupBy("source", F.shiftright("h", shift(0)).alias("bucket")).agg(F.sum("size").alias("size")), "mix-buckets")
    goal = targets(first.groupBy("source").agg(F.sum("size").alias("source_size")), weights, percent, most)
    goal = goal.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)).withColumn("need", F.col("target") - F.col("whole") * F.col("source_size"))
    goal = cut(goal, "mix-targets")
    # a source's threshold so far, and what is still to be spent within the bucket that starts there
    state = goal.select("source", "need", F.lit(0).cast("long").alias("start"))
    histogram = first
    for level in range(LEVELS):
        known = small(state.select(F.col("source").alias("s"), "need", "start"), BROADCAST_SOURCES)
        if level:
            inside = docs.join(known, _same("source", "s") & (F.shiftright("h", shift(level - 1)) == F.shiftright("start", shift(level - 1))))
            histogram = inside.groupBy("source", F.shiftright("h", shift(level)).alias("bucket")).agg(F.sum("size").alias("size"))
        run = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        rows = histogram.withColumn("under", F.coalesce(F.sum("size").over(run), F.lit(0))).join(known, _same("source", "s"))
        # the last bucket that starts within the budget is the one to split
        last = rows.where(F.col("under") <= F.col("need")).groupBy("source").agg(F.max(F.struct("bucket", "under", "size", "need")).alias("x"))
        state = cut(last.select("source", (F.col("x.need") - F.col("x.under")).alias("need"), F.shiftleft(F.col("x.bucket"), shift(level)).alias("start"), F.col("x.size").alias("size")), "mix-threshold")
    # of the smallest bucket left, all or none: whichever is nearer to the target
    limit = F.when(2 * F.col("need") >= F.col("size"), F.col("start") + 1).otherwise(F.col("start"))
    found = goal.select(F.col("source").alias("s"), "source_size", "target", "whole", F.col("need").alias("due")).join(state.select("source", limit.alias("limit")), _same("s", "source"), "left")
    return cut(found.select("s", "source_size", "target", "whole", F.when(F.col("due") > 0, F.coalesce("limit", F.lit(0))).otherwise(F.lit(0)).alias("limit")), "mix-plan")


def _copies(hashed: str, most: int) -> Column:
    return (F.col("whole") + F.when((F.col("whole") < most) & (F.col(hashed) < F.col("limit")), 1).otherwise(0)).cast("long")


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, percent: int = 150, most: int = 2) -> DataFrame:
    """``id, size, source_size, target, copies, taken`` of every row of ``df``.

    ``size`` is the number of words, ``copies`` how often the mix takes the row (0 to ``most``), ``taken`` the words it
    takes so. Null texts have size 0; a null source is a source of its own. Rows that are the same in id, text and source
    have the same hash and are taken alike. Sources without words have target 0. An empty table gives an empty one;
    other columns are not read. Reruns agree, as hashes depend on the rows alone.
    """
    docs = cut(df.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(text_col).alias("size"), _hash(id_col, text_col).alias("h")), "mix-sizes")
    plan = thresholds(docs, weights, percent, most)
    out = docs.join(small(plan, BROADCAST_SOURCES), _same("source", "s")).withColumn("copies", _copies("h", most))
    return out.select(F.col("id").alias(id_col), "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def take(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, percent: int = 150, most: int = 2) -> DataFrame:
    """The mix itself: the rows of ``df`` with all columns, each as often as ``mix`` takes it; cases as there.

    The thresholds are applied while the rows are read again; texts are not shuffled.
    """
    docs = cut(df.select(F.col(source_col).alias("source"), word_count(text_col).alias("size"), _hash(id_col, text_col).alias("h")), "mix-sizes")
    plan = small(thresholds(docs, weights, percent, most), BROADCAST_SOURCES)
    row = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"), F.col(source_col).alias("source"), _hash(id_col, text_col).alias("h"))
    out = row.join(plan, _same("source", "s")).withColumn("copies", _copies("h", most)).where("copies > 0")
    return out.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy")).select("row.*")
