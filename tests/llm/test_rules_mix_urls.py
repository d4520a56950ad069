"""Quality rules, source mixing and URL filters, against their SQL and against plain Python."""

from __future__ import annotations

import datetime
import glob
import math
import os
import re
from collections import Counter, defaultdict

import duckdb
import pytest
from helpers import SF, empty_docs, odd_docs
from pyspark.sql import functions as F

from seqsearch.llm import quality_rules, queries, source_mixing, url_filters

GAP = re.compile(r"[\x20\x09-\x0D]+")


def split(text):
    return [w for w in GAP.split(text or "") if w]


@pytest.fixture(scope="session")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_as_sql(spark, con, name):
    got, expected = queries.queries()[name](spark, SF).toPandas(), con.sql(queries.oracle_sql()[name]).df()
    rows = lambda df: sorted(map(repr, (d := df[sorted(df.columns)].astype(object)).where(d.notna(), None).values.tolist()))
    assert sorted(got.columns) == sorted(expected.columns) and rows(got) == rows(expected)


def base(text):
    words, lines = split(text), [x for x in (text or "").split("\n") if split(x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    covered = {i + d for i, w in enumerate(windows) if often[w] > 1 for d in range(3)}
    n = len(words)
    failed = n < 50 or 100 * len(covered) > 50 * n
    return n, sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered), failed


def test_base_counts(spark):
    docs = odd_docs(spark).unionByName(spark.read.parquet(f"{SF}/documents.parquet").where("doc_id between 20 and 60"), allowMissingColumns=True)
    got = Counter((r["doc_id"], *(r[c] for c in quality_rules.BASE), r["base_failed"]) for r in quality_rules.quality_rules(docs).collect())
    assert got == Counter((r["doc_id"], *base(r["text"])) for r in docs.collect())


def test_kept_rows_are_not_written(spark):
    """The stage writes its patterns of votes, not the texts that it keeps."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir").removeprefix("file://")
    files = lambda: {f: os.path.getsize(f) for f in glob.glob(f"{folder}/seqsearch/rule-*/*.parquet")}
    docs, before = spark.read.parquet(f"{SF}/documents.parquet"), files()
    kept = quality_rules.keep_good(docs)
    want = quality_rules.quality_rules(docs.where("text is not null")).where("kept")
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(r["doc_id"] for r in want.collect())
    assert 0 < sum(n for f, n in files().items() if f not in before) < 50_000 < docs.selectExpr("sum(length(text))").first()[0]
    assert sum(f.startswith("text") for f in kept.columns) == 1 and str(kept._jdf.queryExecution().optimizedPlan()).count("regexp_replace") == 1


def test_estimation_is_the_plain_one(spark):
    k = len(quality_rules.RULES)
    counts = {p.ljust(k, "2"): n for p, n in {"22222222": 900, "02222222": 40, "20222222": 30, "22221222": 50, "12121212": 7, "11111111": 5, "00220222": 4}.items()}
    counts |= {"0" + "2" * (k - 3) + "02": 25}
    rows = spark.createDataFrame([(int(p, 3), n) for p, n in counts.items()] + [(None, 3)], "pattern int, n long")
    got = quality_rules.estimate(rows).first()
    share, bad, good = quality_rules.START[0], [quality_rules.START[1]] * k, [quality_rules.START[2]] * k

    def posterior(p):
        x = math.log(share / (1 - share))
        for j, v in enumerate(p):
            x += {"0": math.log(good[j] / bad[j]), "1": 0, "2": math.log((1 - good[j]) / (1 - bad[j]))}[v]
        return 1 / (1 + math.exp(-x))

    for _ in range(quality_rules.ROUNDS):
        g = {p: n * posterior(p) for p, n in counts.items()}
        rate = lambda w, j: (sum(w(p) for p in counts if p[j] == "0") + 1) / (sum(w(p) for p in counts if p[j] != "1") + 2)  # noqa: B023, E731
        bad = [rate(lambda p: counts[p] - g[p], j) for j in range(k)]  # noqa: B023
        good = [rate(lambda p: g[p], j) for j in range(k)]  # noqa: B023
        share = (sum(g.values()) + 1) / (sum(counts.values()) + 2)
    assert math.isclose(got["share"], share, rel_tol=1e-9)
    assert all(math.isclose(a, b, rel_tol=1e-9) for a, b in zip([*got["bad"], *got["good"]], [*bad, *good], strict=True))
    assert {r["pattern"]: round(r["p_quality"], 9) for r in got["posteriors"]} == {int(p, 3): round(posterior(p), 9) for p in counts}


def test_rules_tell_clean_from_junk(spark):
    """On labelled rows with at least 50 words and few repeats: nearly all clean ones stay and nearly all junk goes."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = quality_rules.quality_rules(docs).join(labels, "doc_id").where("not base_failed").collect()
    clean, junk = ([r["kept"] for r in rows if r["quality"] == q] for q in (1, 0))
    assert sum(clean) / len(clean) > 0.98 and sum(junk) / len(junk) < 0.05


def test_keeping_rows(spark):
    docs = odd_docs(spark).unionByName(spark.read.parquet(f"{SF}/documents.parquet"), allowMissingColumns=True)
    kept = quality_rules.keep_good(docs)
    assert kept.columns == docs.columns
    judged = quality_rules.quality_rules(docs).where("kept")
    assert sorted(r[0] for r in kept.select("doc_id").collect()) == sorted(r["doc_id"] for r in judged.collect())
    assert quality_rules.keep_good(empty_docs(spark)).collect() == quality_rules.quality_rules(empty_docs(spark)).collect() == []


def targets(sizes):
    """The excess over a source's bound goes to the others by weight, again and again."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    budget, full, out = 1.5 * sum(sizes.values()), set(), {}
    while True:
        open_ = [s for s in names if s not in full]
        left = budget - sum(2 * sizes[s] for s in full)
        out = {s: 2.0 * sizes[s] if s in full else left * weight[s] / sum(weight[x] for x in open_) for s in names}
        over = {s for s in open_ if out[s] > 2 * sizes[s]}
        if not over:
            return out
        full |= over


def test_targets(spark):
    for sizes in ({"a": 100, "b": 100, "c": 100}, {"a": 1, "b": 1000, "c": 5, None: 70, "é": 3}, {"a": 0, "b": 10}, {"x": 7}, {"a": 0}):
        rows = source_mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()
        expected = targets(sizes)
        assert all(math.isclose(r["target"], expected[r["source"]], abs_tol=1e-6) for r in rows) and len(rows) == len(sizes)


def test_mix(spark):
    docs = odd_docs(spark).unionByName(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").withColumn("doc_id", F.col("doc_id") + 100), allowMissingColumns=True)
    rows, again = source_mixing.mix(docs).collect(), source_mixing.mix(docs.repartition(3)).collect()
    assert Counter(map(str, rows)) == Counter(map(str, again))
    sizes, source = defaultdict(int), {}
    for r in docs.collect():
        sizes[r["source"]] += len(split(r["text"]))
        source[r["doc_id"]] = r["source"]
    expected, taken, largest = targets(sizes), defaultdict(int), defaultdict(int)
    for r in rows:
        assert r["taken"] in (0, r["size"], 2 * r["size"])
        if r["doc_id"] is not None and r["doc_id"] > 99:
            s = source[r["doc_id"]]
            assert r["source_size"] == sizes[s] and math.isclose(r["target"], expected[s], rel_tol=1e-9)
    plan = source_mixing.mix(docs.select("doc_id", "text", "source", F.col("source").alias("s"))).count()
    assert plan == len(rows)
    joined = source_mixing.take(docs)
    assert joined.columns == docs.columns
    for r in joined.select("source", "text").collect():
        taken[r["source"]] += len(split(r["text"]))
    for r in docs.select("source", "text").collect():
        largest[r["source"]] = max(largest[r["source"]], len(split(r["text"])))
    assert all(abs(taken[s] - expected[s]) <= largest[s] for s in sizes)
    assert sum(taken.values()) == sum(r["taken"] for r in rows)
    assert source_mixing.mix(empty_docs(spark)).collect() == source_mixing.take(empty_docs(spark)).collect() == []


def test_larger_targets_take_what_smaller_ones_take(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    copies = [{r["doc_id"]: r["copies"] for r in source_mixing.mix(docs, percent=p).collect()} for p in (30, 60, 120)]
    assert all(small[d] <= large[d] for small, large in zip(copies, copies[1:], strict=False) for d in small)


def test_word_counts(spark):
    docs = odd_docs(spark)
    assert [r[0] for r in docs.select(source_mixing.word_count()).collect()] == [len(split(r["text"])) for r in docs.collect()]


EVENTS = [("Bad.example", "2024-01-10", True), ("bad.example", "2024-01-20", False), ("bad.example", "2024-02-01", True), ("x.bad.example", "2024-01-15", True), ("ok.example/a/b", "2024-01-01", True), ("tie.example", "2024-01-05", True), ("tie.example", "2024-01-05", False), ("twice.example", "2024-01-01", True), ("twice.example", "2024-01-03", True), (None, "2024-01-01", True), ("z.example", None, True), ("Case.Example/Path/A", "2024-01-01", True)]


def test_url_filters(spark):
    events = spark.createDataFrame(EVENTS, "key string, day string, listed boolean").withColumn("url", F.lit("clash")).withColumn("id", F.lit(1))
    days = ["2024-01-09", "2024-01-10", "2024-01-19", "2024-01-20", "2024-02-01", "2024-03-01"]
    urls = ["http://bad.example/", "https://u:p@X.BAD.example:80/q?bad", "http://notbad.example/", "http://ok.example/a/b/c", "http://ok.example/a/bc", "http://ok.example//a//b", "http://tie.example", "http://twice.example/#f", "mailto:bad.example", "", None, "http://CASE.example/Path/A/x", "http://case.example/path/a/x", "http://long.example/" + "a/" * 3000]
    rows = [(i, u, d, "k", "c") for i, u in enumerate(urls) for d in days] + [(0, urls[0], days[1], "k", "c")] * 2 + [(None, urls[0], days[1], "k", "c"), (7, urls[0], None, "k", "c")]
    captures = spark.createDataFrame(rows, "page_id long, url string, fetched string, key string, since string")
    got = Counter((r["page_id"], r["url"], str(r["fetched"]), r["n_active"], r["entry"], str(r["listed_on"])) for r in url_filters.filter_urls(captures, events).collect())

    def listed(key, day):
        """(since) while on the list"""
        since = None
        named = lambda e: e[0].split("/")[0].lower() + e[0][len(e[0].split("/")[0]) :]
        for d in sorted({e[1] for e in EVENTS if e[0] and e[1] and named(e) == key}):
            if d > day:
                break
            on = all(e[2] for e in EVENTS if e[0] and named(e) == key and e[1] == d)
            since = (since or d) if on else None
        return since

    expected = Counter()
    for i, u, d, *_ in rows:
        m = re.match(r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)[^/?#]*(/[^?#]*)?", u or "")
        found = []
        if m and d:
            host = m[1].lower()
            steps = [x for x in (m[2] or "").split("/") if x]
            keys = [".".join(host.split(".")[j:]) for j in range(host.count(".") + 1)] + [host + "/" + "/".join(steps[: j + 1]) for j in range(len(steps))]
            found = sorted((-len(k), k, s) for k in set(keys) if (s := listed(k, d)))
        expected[(i, u, str(d) if d else "None", len(found), found[0][1] if found else None, found[0][2] if found else "None")] += 1
    assert got == expected
    assert url_filters.filter_urls(captures.where("false"), events).collect() == []
    assert url_filters.filter_urls(captures, events.where("false")).where("blocked").count() == 0


def test_url_join_beyond_the_bound(spark, monkeypatch):
    events = spark.createDataFrame(EVENTS, "key string, day string, listed boolean")
    captures = spark.createDataFrame([(1, "http://bad.example/", "2024-01-11"), (2, "http://good.example/", "2024-01-11")], "page_id long, url string, fetched string")
    near = url_filters.filter_urls(captures, events).collect()
    monkeypatch.setattr(url_filters, "BROADCAST_INTERVALS", 0)
    assert sorted(map(str, url_filters.filter_urls(captures, events).collect())) == sorted(map(str, near))


def test_native_operators_run_no_python(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for df in (quality_rules.quality_rules(docs), source_mixing.mix(docs), source_mixing.take(docs), quality_rules.keep_good(docs), queries.op2_url_filters(spark, SF)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Arrow|Pandas|Cartesian|NestedLoop", plan)
