"""Source divergence audit: how far the term shares of a language's sources lie apart, and which terms set a source apart.

1. Terms are counted where the texts are read, with bounded memory, and counts are merged by (lang, source, term); of each
   language the terms in enough documents are kept.
2. Shares are whole numbers in units of 1e-9, smoothed, so a term that a source lacks has the source's *baseline* share. The
   divergence of a pair is the baseline's times the number of terms, corrected where a source has a term: by the histogram of
   its counts against the other's baseline, and once more only for terms that both have. Terms that neither has cost nothing.
3. The terms most above their language's share are found by radix select: histograms over ten bits of the value at a time,
   partly summed before the shuffle, tell each group's k-th value; terms that tie with it are told apart by histograms over
   the next two UTF-8 bytes. No group is sorted or gathered: only its k terms are.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, small, tidy

LEAST_DOCS, TOP, UNIT = 10, 10, 1_000_000_000
#: Bits of a value, and how many of them a histogram splits by.
BITS, STEP = 30, 10
#: Rows of a group that tie with its k-th value are sorted up to this number, and split by their bytes beyond it.
SORTED = 1000
#: Tables of one row a source are broadcast up to this number of rows, and joined by shuffle beyond it.
BROADCAST_GROUPS = 100_000
#: Distinct (term, source) and bytes of text that a task counts before it hands the counts on.
HELD_TERMS, HELD_BYTES, SLICE = 200_000, 64 << 20, 4 << 20
#: Letters A to Z in lower case, and all bytes of other characters than ASCII; the rest parts terms.
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def _slices(text: str | None) -> Iterator[list[bytes]]:
    """Terms of a text, some MB of it at a time."""
    data, at = (text or "").encode().translate(_LETTERS), 0
    while at < len(data):
        end = data.find(b" ", at + SLICE)
        end = len(data) if end < 0 else end
        yield data[at:end].split()
        at = end


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    held = 0

    def rows() -> Iterator[pa.RecordBatch]:
        for (lang, source), (times, docs) in counts.items():
            every = list(times)
            for at in range(0, len(every), 50_000):
                terms = every[at : at + 50_000]
                columns = [pa.array([lang] * len(terms), pa.string()), pa.array([source] * len(terms), pa.string()), pa.array(terms, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([times[t] for t in terms], pa.int64()), pa.array([docs[t] for t in terms], pa.int64())], names=["lang", "source", "term", "n", "docs"])
        counts.clear()

    for batch in batches:
        for lang, source, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            times, docs = counts.setdefault((lang, source), (Counter(), Counter()))
            seen: set[bytes] = set()
            for terms in _slices(text):
                times.update(terms)
                seen.update(terms)
                held += sum(map(len, terms))
            docs.update(seen)
            if held > HELD_BYTES or sum(len(t) for t, _ in counts.values()) > HELD_TERMS:
                yield from rows()
                held = 0
    yield from rows()


def term_counts(docs: DataFrame) -> DataFrame:
    """``lang, source, term, n, docs`` of ``lang, source, text`` without nulls: occurrences, and documents that have the term."""
    found = docs.mapInArrow(tidy(_count), "lang string, source string, term string, n long, docs long")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _share(n: str, total: str, terms: str) -> Column:
    """The smoothed share of a count in whole units."""
    return F.expr(f"1 + (cast({n} + 2 as decimal(20, 0)) * cast({UNIT} as decimal(10, 0))) div cast({total} + 2 * {terms} as decimal(20, 0))")


def _apart(p: Column, q: Column) -> Column:
    """``(p - q) ** 2 / (p + q)``, rounded down; symmetric."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def select_top(rows: DataFrame, group: list[str], value: str, item: str, k: int = TOP, bits: int = BITS, sorted_at: int = SORTED) -> DataFrame:
    """The ``k`` rows of each group with the largest values; of equal values those first whose item is smaller in UTF-8 bytes.

    ``value`` is a long from 0 to below ``2 ** bits``; (group, item) is unique and without nulls. A radix select: for each group
    the k-th value is found ``STEP`` bits at a time, and where more than ``sorted_at`` rows tie with it, the k-th item two
    bytes at a time, behind what all tied items have in common. What is left, less than ``k + sorted_at`` rows of a group, is
    numbered. Adds ``rank``.
    """
    enough = F.col("c") <= F.greatest(F.col("need"), F.lit(sorted_at))
    keys = [f"_{g}" for g in group]
    same = [F.col(g) == F.col(k_) for g, k_ in zip(group, keys, strict=True)]
    named = [F.col(g).alias(k_) for g, k_ in zip(group, keys, strict=True)]

    def boundary(histogram: DataFrame, order: Column) -> DataFrame:
        """Of ``group, bucket, c, need``: the bucket in which ``need`` rows are met, what is needed of it, and its size; or the
        last one where there are fewer rows."""
        before = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        placed = histogram.withColumn("before", F.coalesce(F.sum("c").over(before), F.lit(0))).where("before < need")
        return placed.groupBy(*group).agg(F.max_by(F.struct("bucket", "before", "c", "need"), "before").alias("x")).select(*group, F.col("x.bucket").alias("bucket"), (F.col("x.need") - F.col("x.before")).alias("need"), F.col("x.c").alias("c"))

    def counted(found: DataFrame, bucket: Column) -> DataFrame:
        return found.groupBy(*group, bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("c"), F.max("_need").alias("need"))

    state, shift = None, bits
    while shift:
        width = min(STEP, shift)
        shift -= width
        if state is None:
            found = rows.withColumn("_need", F.lit(k).cast("long"))
        else:
            known = small(state.select(*named, F.col("bucket").alias("_bucket"), F.col("need").alias("_need")), BROADCAST_GROUPS)
            found = rows.join(known, [*same, F.shiftright(value, shift + width) == F.col("_bucket")])
        state = cut(boundary(counted(found, F.shiftright(value, shift)), F.desc("bucket")), "top-bits")
    # ties with the k-th value: bytes as hexadecimal digits, four of them at a time
    ends = state.select(*named, F.col("bucket").alias("_least"), F.col("need").alias("_need"), F.when(enough, F.lit("~")).alias("_last"))
    open_ = state.where(~enough).select(*group, F.col("bucket").alias("least"), "need")
    digits, closed = F.hex(F.encode(F.col(item), "UTF-8")), []
    while not open_.isEmpty():
        known = small(open_.select(*named, F.col("least").alias("_least"), F.col("need").alias("_need"), *([F.col("past").alias("_past")] if "past" in open_.columns else [])), BROADCAST_GROUPS)
        found = rows.join(known, [*same, F.col(value) == F.col("_least")])
        if "past" in open_.columns:
            found = found.where(F.startswith(digits, F.col("_past")))
        text = found.select(*group, "_need", "_least", digits.alias("d"))
        ends_ = text.groupBy(*group).agg(F.min("d").alias("a"), F.max("d").alias("z"))
        differ = F.array_position(F.zip_with(F.split("a", "(?<=\\G..)"), F.split("z", "(?<=\\G..)"), lambda a, z: ~a.eqNullSafe(z)), True)
        # where one item goes on after another's end, the first byte after it tells them apart
        common = cut(ends_.select(*named, F.when(differ > 0, 2 * differ + 2).otherwise(F.length("a") + 4).cast("int").alias("_upto")), "top-common")
        text = text.join(small(common, BROADCAST_GROUPS), same)
        hist = text.groupBy(*group, F.expr("substring(d, 1, _upto)").alias("bucket")).agg(F.count(F.lit(1)).alias("c"), F.max("_need").alias("need"), F.max("_least").alias("least"))
        least = hist.groupBy(*group).agg(F.max("least").alias("least"))
        state = cut(boundary(hist.select(*group, "bucket", "c", "need"), F.asc("bucket")).join(least, group), "top-bytes")
        closed.append(state.where(enough).select(*named, F.col("bucket").alias("_end")))
        open_ = state.where(~enough).select(*group, "least", "need", F.col("bucket").alias("past"))
    for some in closed:
        ends = ends.join(small(some, BROADCAST_GROUPS), keys, "left").select(*keys, "_least", "_need", F.coalesce("_last", F.when(F.col("_end").isNotNull(), F.concat("_end", F.lit("~")))).alias("_last"))
    ends = small(cut(ends, "top-ends"), BROADCAST_GROUPS)
    kept = rows.join(ends, [*same, F.col(value) >= F.col("_least")]).where((F.col(value) > F.col("_least")) | (digits < F.col("_last")))
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(F.desc(value), F.asc(item)))
    return kept.select(*rows.columns, rank.alias("rank")).where(F.col("rank") <= k)


def divergence(df: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """``lang, source, part, item, value, rank``: part ``pair`` has the divergence of each source from each other one of its
    language, part ``term`` the ``top`` kept terms that lie most above the language's share. Ranks count from 1, by value
    descending, then by the item's UTF-8 bytes.

    Null text, language and source are read as empty ones, which are a language and a source like others. Repeated rows
    count as often as they stand there. Whole texts are counted, however long. A language without kept terms has pairs with
    value 0 and no terms; one with a single source has no pairs; an empty table gives an empty result. Other columns are not
    read. All arithmetic is on whole numbers.
    """
    plain = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(a) for c, a in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))]
    docs = df.select(*plain)
    counts = cut(term_counts(docs), "divergence-counts")
    kept = cut(counts.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs")).where(F.col("docs") >= least_docs).select("lang", "term", "lang_n"), "divergence-kept")
    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("lang_n").alias("lang_total"))
    found = cut(counts.select("lang", "source", "term", "n").join(kept, ["lang", "term"]), "divergence-terms")
    totals = found.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = docs.select("lang", "source").distinct().join(langs, "lang", "left").join(totals, ["lang", "source"], "left")
    groups = groups.select("lang", "source", F.coalesce("v", F.lit(0)).alias("v"), F.coalesce("lang_total", F.lit(0)).alias("lang_total"), F.coalesce("total", F.lit(0)).alias("total"))
    groups = cut(groups.withColumn("base", F.when(F.col("v") > 0, _share("0L", "total", "v")).otherwise(F.lit(1))), "divergence-groups")

    # the smaller name is the pair's first source
    one = groups.select("lang", F.col("source").alias("a"), "v", F.col("base").alias("a0"))
    two = small(groups.select("lang", F.col("source").alias("b"), F.col("base").alias("b0")), BROADCAST_GROUPS)
    pairs = cut(one.join(two, "lang").where("a < b"), "divergence-pairs")
    rated = found.join(small(groups.select("lang", "source", "v", "total", "base"), BROADCAST_GROUPS), ["lang", "source"])
    rated = rated.select("lang", "source", "term", "base", _share("n", "total", "v").alias("p"))
    p, a0, b0, q = F.col("p"), F.col("a0"), F.col("b0"), F.col("q")
    start = pairs.select("lang", "a", "b", (F.col("v") * _apart(a0, b0)).alias("value"))
    shares = rated.groupBy("lang", "source", "p").agg(F.count(F.lit(1)).alias("c"))
    known = small(pairs, BROADCAST_GROUPS)
    of_a = shares.withColumnRenamed("source", "a").join(known, ["lang", "a"]).select("lang", "a", "b", (F.col("c") * (_apart(p, b0) - _apart(a0, b0))).alias("value"))
    of_b = shares.withColumnRenamed("source", "b").join(known, ["lang", "b"]).select("lang", "a", "b", (F.col("c") * (_apart(a0, p) - _apart(a0, b0))).alias("value"))
    left = rated.select("lang", "term", F.col("source").alias("a"), "p", F.col("base").alias("a0"))
    right = rated.select("lang", "term", F.col("source").alias("b"), F.col("p").alias("q"), F.col("base").alias("b0"))
    both = left.join(right, ["lang", "term"]).where("a < b").select("lang", "a", "b", (_apart(p, q) - _apart(p, b0) - _apart(a0, q) + _apart(a0, b0)).alias("value"))
    half = [x.groupBy("lang", "a", "b").agg(F.sum("value").alias("value")) for x in (of_a, of_b, both)]
    value = cut(start.union(half[0]).union(half[1]).union(half[2]).groupBy("lang", "a", "b").agg(F.sum("value").alias("value")), "divergence-values")
    ways = value.select("lang", F.col("a").alias("source"), F.col("b").alias("item"), "value").union(value.select("lang", "b", "a", "value"))

    above = found.join(small(groups.select("lang", "source", "v", "total", "lang_total"), BROADCAST_GROUPS), ["lang", "source"])
    above = above.select("lang", "source", F.col("term").alias("item"), _share("n", "total", "v").alias("p"), _share("lang_n", "lang_total", "v").alias("q")).where("p > q")
    above = cut(above.select("lang", "source", "item", _apart(p, q).alias("value")), "divergence-above")
    terms = select_top(above, ["lang", "source"], "value", "item", top)
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item")))  # of a language's sources
    out = ways.select("lang", "source", F.lit("pair").alias("part"), "item", "value", rank.alias("rank"))
    return out.union(terms.select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank"))
