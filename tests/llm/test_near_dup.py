"""Near-duplicates against all pairs compared on their sets."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest
from helpers import SF, empty_docs, odd_docs

from seqsearch.llm import minhash
from seqsearch.llm.components import components


def shingles(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4)) if len(words) >= 5 else frozenset([tuple(words)])


def brute(rows, percent=85):
    """id -> (set size, smallest id reached) for (id, text) rows with distinct ids."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    by_size = sorted(range(len(rows)), key=lambda i: len(sets[i]))
    for x, i in enumerate(by_size):
        for j in by_size[x + 1 :]:
            if 100 * len(sets[i]) < percent * len(sets[j]):
                break
            if sets[i] and find(i) != find(j):
                both = len(sets[i] & sets[j])
                if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                    root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return {d: (len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(rows)}


def result(df):
    rows = df.collect()
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in rows)
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows}


def group(rng, n, length, edits, vocabulary):
    """A text and n copies of it with some words changed: alike to it, less to each other."""
    text = [rng.choice(vocabulary) for _ in range(length)]
    yield " ".join(text)
    for _ in range(n):
        own = list(text)
        for _ in range(rng.randint(0, edits)):
            own[rng.randrange(length)] = rng.choice(vocabulary)
        yield " ".join(own)


def planted(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    texts = [*group(rng, 60, 300, 10, vocabulary), *group(rng, 20, 60, 2, vocabulary), *group(rng, 6, 4000, 60, vocabulary), *group(rng, 10, 12, 1, vocabulary)]
    texts += ["Same TEXT of five words here", "same text OF five\twords here", "one two", "ONE  two", "one", "", None, " \n "]
    texts += [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 200))) for _ in range(40)]
    # a chain: neighbours are links, ends are not
    chain = [rng.choice(vocabulary) for _ in range(200)]
    for i in range(8):
        texts.append(" ".join(chain))
        chain[i * 20 : i * 20 + 3] = ["x", "y", str(i)]
    rng.shuffle(texts)
    return list(enumerate(texts, 7))


@pytest.mark.parametrize("seed", [1, 2])
def test_planted_groups(spark, seed):
    rows = planted(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert result(minhash.near_duplicates(df)) == brute(rows)


def test_dense_blocks_and_small_blocks(spark, monkeypatch):
    """Everything through blocks compared in place, in blocks of few rows, with all joins shuffled."""
    monkeypatch.setattr(minhash, "DENSE", -1)
    monkeypatch.setattr(minhash, "_BLOCK", 8)
    monkeypatch.setattr(minhash, "BROADCAST_IDS", 0)
    rows = planted(3)
    assert result(minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)


def test_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert result(minhash.near_duplicates(docs)) == brute(rows)


def test_odd_rows(spark):
    docs = odd_docs(spark)
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(docs).collect())
    expected = Counter()
    # equal texts are one node: the two long ones
    for r in docs.collect():
        n, d = len(shingles(r["text"])), r["doc_id"]
        c = 12 if d == 13 else d
        expected[(d, n, c, d is not None and d == c)] += 1
    assert got == expected
    assert minhash.near_duplicates(empty_docs(spark)).collect() == []


def test_dropping_copies(spark):
    docs = odd_docs(spark)
    kept = minhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    got = Counter((r["doc_id"], (r["text"] or "")[:9]) for r in kept.collect())
    # the second long text goes, of the row that is there three times one stays, and the other text of that id stays
    expected = Counter({(r["doc_id"], (r["text"] or "")[:9]): 1 for r in docs.collect() if r["doc_id"] != 13})
    assert got == expected
    assert minhash.drop_near_duplicates(empty_docs(spark)).collect() == []
    rows = planted(4)
    got = {r["doc_id"] for r in minhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {d for d, (_, c) in brute(rows).items() if d == c}


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(0)
    for n in (7, 40, 125, 1000, 5000):
        errors = []
        for _ in range(40):
            h = np.unique(rng.integers(0, 2**64, size=n + n // 5 + 1, dtype=np.uint64))
            a, b = h[: n + n // 10], np.concatenate([h[:n], h[n + n // 10 :]])
            b.sort()
            j = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
            sa, sb = minhash.signature(np.sort(a)), minhash.signature(b)
            assert np.isin(sa, a).all()
            errors.append((sa == sb).mean() - j)
        assert abs(np.mean(errors)) < 0.05


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(35)] + [(100 + i, 101 + i) for i in range(40)] + [(200, 200 + i) for i in range(50)] + [(7, 7)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: find(x) for x in root}
    assert components(spark.createDataFrame([], "u long, v long")).collect() == []


def test_rows_without_id_link_others(spark):
    """1 and 2 are alike only through a near copy that has no id."""
    a = [f"word{i}" for i in range(200)]
    b = a[:-10] + [f"end{i}" for i in range(10)]
    c = [f"begin{i}" for i in range(10)] + b[10:]
    rows = [(1, " ".join(a)), (None, " ".join(b)), (2, " ".join(c)), (3, "another text that is like none of them")]
    got = {r["doc_id"]: (r["component_id"], r["kept"]) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (1, True), None: (1, False), 2: (1, False), 3: (3, True)}
