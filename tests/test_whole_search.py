"""The registered searches against brute force over small tables of edited passages."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F
from test_kernel import plain

from seqsearch.functions.scoring import K, LAMBDA, LN2
from seqsearch.plans import catalogue
from seqsearch.sources import store

SF = "/root/testdata/sf0.001"
LAYOUTS = ("search_m8", "search_pairwise", "search_fasta", "search_extended", "search_a3m", "search_reduced")


def words(rng, n):
    return ["".join(rng.choice("ACDEFGHIKLMNPQRSTVWY") for _ in range(rng.randint(3, 8))) for _ in range(n)]


def edited(rng, found, every):
    """One word in ``every`` is another one of the same length, so that diagonals stay."""
    return [w if i % every else "".join(rng.choice("ACDEFGHIKLMNPQRSTVWY") for _ in w) for i, w in enumerate(found)]


def stored(spark, path, items, docs):
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame([(i, t, "s") for i, t in enumerate(docs)], "doc_id long, text string, source string").write.parquet(f"{path}/documents.parquet")
    return str(path)


def brute(items, docs):
    """``(q, s, bin): (votes, score)`` of every candidate by the reference's rule with an E-value of at most 10."""
    clean = lambda t: re.sub("[^A-Z]", "", t.upper())
    items, docs = list(map(clean, items)), list(map(clean, docs))
    space, out = sum(len(d) + 1 for d in docs), {}
    for q, a in enumerate(items):
        for s, b in enumerate(docs):
            votes = Counter((len(a) + j - i) // 8 for i in range(len(a) - 4) for j in range(len(b) - 4) if a[i : i + 5] == b[j : j + 5] and len(set(a[i : i + 5])) > 1)
            for at, n in votes.items():
                found = plain(a, b, 8 * at + 3 - len(a), 8) if n >= int(math.log10(len(a)) + 1) + 1 else None
                if found and space * len(a) * 2.0 ** -math.floor((LAMBDA * found[0] - math.log(K)) / LN2) <= 10:
                    out[q, s, at] = (n, found[0])
    return out


def test_weak_candidates_are_aligned(spark, tmp_path):
    """Short and edited copies, with 4 to 19 votes in a bin, come out of each registered search."""
    rng = random.Random(1)
    made = [words(rng, 14) for _ in range(3)]
    items = [" ".join(x) for x in made]
    docs = [" ".join(words(rng, 6) + part + words(rng, 6)) for x in made for part in (x, edited(rng, x, 3), edited(rng, x, 2), x[:3], x[4:7], x[9:12])]
    expected = brute(items, docs)
    assert sum(n < 20 for n, _ in expected.values()) >= 8 and max(Counter(q for q, _, _ in expected).values()) <= 10
    path, queries = stored(spark, tmp_path, items, docs), catalogue.queries()
    got = {(r["q_id"], r["s_id"], r["bin"]): (r["votes"], r["score"]) for r in queries["search_hits"](spark, path).collect()}
    assert got == {k: v for k, v in expected.items() if v[1] >= 40}
    for name in LAYOUTS:
        assert Counter(r["q_id"] for r in queries[name](spark, path).collect() if r["rank"]) == Counter(q for q, _, _ in expected)


def test_weak_candidates_must_include(spark, tmp_path):
    """A copy with few votes that has the expression twice is found."""
    rng = random.Random(2)
    head = "TACEQWTGHEKLMN"
    docs = [" ".join([*words(rng, 6), head, *words(rng, 6)]), " ".join(words(rng, 12))]
    path = stored(spark, tmp_path, [" ".join([head, *words(rng, 8)])], docs)
    found = catalogue.search_must_include(spark, path).collect()
    assert [(r["s_id"], r["rank"]) for r in found] == [(0, 1)] and "TACEQWTGHE" in found[0]["s_ori"]


def test_all_copies_are_reported(spark, tmp_path):
    """A passage in thirty documents has thirty hits and more in every layout, not the first ten."""
    rng = random.Random(4)
    passage = words(rng, 14)
    items, docs = [" ".join(passage)], [" ".join([*words(rng, 3), *passage, *words(rng, 3)]) for _ in range(30)]
    expected = brute(items, docs)
    path, queries = stored(spark, tmp_path, items, docs), catalogue.queries()
    got = queries["search_hits"](spark, path).collect()
    assert {(r["q_id"], r["s_id"], r["bin"]) for r in got} == {k for k, v in expected.items() if v[1] >= 40} and {r["s_id"] for r in got} == set(range(30))
    for name in LAYOUTS:
        assert sorted(r["rank"] for r in queries[name](spark, path).collect() if r["rank"]) == list(range(1, len(expected) + 1))


def test_positions_of_all_subjects(spark):
    """The first and last slot of each subject, and of the terminator behind it."""
    laid = store.layout(catalogue._subjects(spark, SF).select("s_id", "s_len"), max_residues=catalogue.VOLUME).cache()
    asked = laid.select(F.explode(F.array("s_offset", F.col("s_offset") + F.greatest(F.col("s_len") - 1, F.lit(0)), F.col("s_offset") + F.col("s_len"))).alias("pos")).distinct()
    got = {r["pos"]: (r["s_id"], r["s_pos"]) for r in store.position_to_subject(asked, laid).collect()}
    expected = {r["s_offset"] + p: (r["s_id"], p) for r in laid.collect() for p in {0, max(r["s_len"] - 1, 0), r["s_len"]}}
    assert got == expected


def test_batches_are_cut_by_letters(monkeypatch):
    import numpy as np
    from seqsearch.operators.common import pieces

    sizes = np.array([3, 3, 3, 50, 0, 0, 4, 6, 1])
    assert list(pieces(sizes, 10, 100)) == [(0, 3), (3, 4), (4, 8), (8, 9)]
    assert list(pieces(sizes, 1000, 4)) == [(0, 4), (4, 8), (8, 9)]
    assert list(pieces(sizes[:0], 10, 4)) == []


def test_long_queries_and_small_batches_give_the_same(spark, monkeypatch):
    """Queries of 20,000 letters that a subject holds with changes; the same hits when few letters are aligned at a time."""
    import random

    from seqsearch.config import SearchConfig
    from seqsearch.operators import align, voting
    from seqsearch.plans.search import search

    dice = random.Random(2)
    text = "".join(dice.choices("ACDEFGHIKLMNPQRSTVWY", k=20_000))
    other = text[:9_000] + "WW" + text[9_000:15_000] + text[15_003:]
    queries = spark.createDataFrame([(i, f"q{i}", t, len(t)) for i, t in enumerate([text, text[5_000:], text[:300]])], "q_id long, q_name string, q_seq string, q_len int")
    subjects = spark.createDataFrame([(0, "s0", other), (1, "s1", text), (2, "s2", text[::-1]), (3, "s3", None)], "s_id long, s_name string, s_seq string")
    cfg = SearchConfig(min_score=200)
    key = ("q_id", "s_id", "bin", "score", "q_begin", "q_end", "s_begin", "s_end", "gaps", "rank")
    whole = sorted(tuple(r[k] for k in key) for r in search(queries, subjects, cfg).collect())
    assert max(r[3] for r in whole) > 90_000 and any(r[8] for r in whole)
    monkeypatch.setattr(align, "LETTERS", 25_000)
    monkeypatch.setattr(voting, "TOGETHER", 25_000)
    assert sorted(tuple(r[k] for k in key) for r in search(queries, subjects, cfg).collect()) == whole


def test_candidates_are_counted_by_group_as_the_search_runs(spark):
    from seqsearch.config import SearchConfig
    from seqsearch.operators import voting
    from seqsearch.plans.search import search

    queries, subjects, cfg = catalogue._queries(spark, SF), catalogue._subjects(spark, SF), SearchConfig()
    counts = []
    found = voting._scan(queries, subjects, cfg, "candidates", group=2_000, counts=counts)
    by_query = {r["q_id"]: r["count"] for r in found.groupBy("q_id").count().collect()}
    groups = [[r["q_id"] for r in rows] for rows in voting._groups(queries, cfg, 2_000)]
    assert len(groups) > 2
    assert [c.get["candidates"] for c in counts] == [sum(by_query.get(q, 0) for q in g) for g in groups]
    # before all filters, and with the search's own run
    counts = []
    search(queries, subjects, SearchConfig(min_score=10**6), counts=counts).collect()
    assert [c.get["candidates"] for c in counts] == [sum(by_query.values())]


def test_volume_size(spark):
    from seqsearch.sources import store

    assert store.of_part(16 * 1000) == 1000 and store.of_part(16 * 1000 + 1) == 1001
    assert store.of_part(1 << 60) == store.LONGEST == 2**32 - 10_000
    assert store.volume_size(spark, 10) == 1_000_000
    assert store.volume_size(spark, 40_000_000) == 40_000_000 // spark.sparkContext.defaultParallelism + 1
    assert store.volume_size(spark, 1 << 50) == (1 << 30) // 16


def test_frequent_kmers_are_salted(spark):
    """A passage in all queries: its k-mers are dealt out, and the hits are those of the index, none twice."""
    from seqsearch.config import SearchConfig
    from seqsearch.operators import seeds, voting

    cfg = SearchConfig()
    common = "MKVLAWGHEYRRND"
    queries = spark.createDataFrame([(i, common + "ACDEFGHIKL"[i % 10] * 3 + common, 0) for i in range(60)], "q_id long, q_seq string, q_len int").withColumn("q_len", F.length("q_seq"))
    subjects = spark.createDataFrame([(1, "WW" + common), (2, common * 3), (3, "ACDEF"), (4, None), (5, "")], "s_id long, s_seq string")
    of_q = seeds.seeds(queries, "q_id", "q_seq", cfg.k).withColumnRenamed("pos", "q_pos")
    dealt, hot = voting.salted(of_q, 25)
    assert hot.count() == len(common) - cfg.k + 1 and {r["salts"] for r in hot.collect()} == {5}
    assert dealt.count() == of_q.count() and dealt.groupBy("kmer", "salt").count().agg(F.max("count")).first()[0] < 60
    joined = sorted(map(tuple, voting.joined_hits(queries, subjects, cfg, 25).collect()))
    assert joined == sorted(map(tuple, voting._scan(queries, subjects, cfg, "hits").collect())) and len(joined) > 1000
