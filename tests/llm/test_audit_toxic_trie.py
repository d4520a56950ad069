from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from helpers import SF, empty_docs, odd_docs
from pyspark.sql import functions as F
from seqsearch.llm import prefix_trie, source_divergence, toxicity
from seqsearch.llm.queries import oracle_sql, queries

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def by_sql(query: str, **tables):
    import duckdb

    con = duckdb.connect()
    for name, table in tables.items():
        con.register(name, table)
    return [tuple(r) for r in con.sql(query).fetchall()]


def apart(p: int, q: int) -> int:
    return (p - q) ** 2 // (p + q)


def plain_divergence(rows, least_docs=10, top=10):
    """The contract in plain Python: every kept term of every group, also those with count 0."""
    rows = [((lang or ""), (source or ""), TERM.findall((text or "").translate(LOWER))) for lang, source, text in rows]
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), sorted({r[:2] for r in rows})
    for lang, source, terms in rows:
        counts[lang, source].update(terms)
        docs[lang].update(set(terms))
    kept = {lang: [t for t, n in c.items() if n >= least_docs] for lang, c in docs.items()}
    share = lambda c, terms: {t: 1 + 10**9 * (c[t] + 2) // (sum(c[x] for x in terms) + 2 * len(terms)) for t in terms}
    p = {g: share(counts[g], kept[g[0]]) for g in groups}
    q = {lang: share(sum((counts[g] for g in groups if g[0] == lang), Counter()), terms) for lang, terms in kept.items()}
    out = []
    for lang, source in groups:
        pairs = [(-sum(apart(p[lang, source][t], p[lang, o][t]) for t in kept[lang]), o.encode()) for x, o in groups if x == lang and o != source]
        terms = [(-apart(p[lang, source][t], q[lang][t]), t.encode()) for t in kept[lang] if counts[lang, source][t] and p[lang, source][t] > q[lang][t]]
        for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
            out += [(lang, source, part, item.decode(), -v, i) for i, (v, item) in enumerate(found, 1)]
    return sorted(out)


def test_divergence_of_a_small_table(spark):
    dice = random.Random(3)
    words = ["Alpha", "beta", "GAMMA", "été", "ÉTÉ", "日本", "x", "y9z", "o'k"] + [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)]
    rows = [(dice.choice(["en", "de", None]), dice.choice(["a", "b", "c", None, "B"]), " ".join(dice.choices(words, k=dice.randrange(40)))) for _ in range(300)]
    rows += [("one", "only", "alpha alpha"), ("one", "only", None), ("fr", "a", ""), ("fr", "b", "rare words"), ("", "", "x" * 50_000)]
    made = source_divergence.divergence(spark.createDataFrame(rows, "lang string, source string, text string"))
    assert made.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, made.collect())) == plain_divergence(rows)


@pytest.mark.parametrize("sorted_at", [0, 3, 1000])
def test_top_of_each_group_with_ties(spark, sorted_at):
    dice = random.Random(sorted_at)
    rows = [("one", dice.choice([5, 5, 5, 9, 1 << 29]), "common" * 3 + "".join(dice.choices("aéz日", k=dice.randrange(7)))) for _ in range(400)]
    rows += [("two", 7, "same" * 50 + x) for x in ("", "a", "ab", "abc", "b", "aba", "é", "ab\U0001f600")] + [("three", 0, "zero"), ("four", 3, "a"), ("four", 4, "b")]
    rows = sorted(set(rows))
    table = spark.createDataFrame(rows, "g string, v long, t string")
    for k in (1, 4, 37):
        wanted = [(g, v, t, i) for name in ("one", "two", "three", "four") for i, (g, v, t) in enumerate(sorted((r for r in rows if r[0] == name), key=lambda r: (-r[1], r[2].encode()))[:k], 1)]
        assert sorted(map(tuple, source_divergence.select_top(table, ["g"], "v", "t", k, sorted_at=sorted_at).collect())) == sorted(wanted)


def test_counts_are_handed_on_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(source_divergence, "HELD_TERMS", 5)
    monkeypatch.setattr(source_divergence, "SLICE", 7)
    import pyarrow as pa

    texts = ["aa bb cc aa dd ee ff gg hh ii", "aa zz", None, "", "bb" * 20]
    batch = pa.RecordBatch.from_arrays([pa.array(["l"] * 5), pa.array(["s"] * 5), pa.array(texts)], names=["lang", "source", "text"])
    found, docs = Counter(), Counter()
    for made in source_divergence._count(iter([batch])):
        for r in made.to_pylist():
            found[r["term"]] += r["n"]
            docs[r["term"]] += r["docs"]
    assert found == Counter(TERM.findall(" ".join(t or "" for t in texts)))
    assert docs["aa"] == 2 and docs["bb"] == 1


def test_divergence_of_odd_and_empty_tables(spark):
    docs = odd_docs(spark)
    rows = [(r["lang"], r["source"], r["text"]) for r in docs.collect()]
    assert sorted(map(tuple, source_divergence.divergence(docs).collect())) == plain_divergence(rows)
    assert source_divergence.divergence(empty_docs(spark)).count() == 0


def test_divergence_equals_sql(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    made = sorted(tuple(r) for r in queries()["op11_source_divergence"](spark, SF).collect())
    assert made == sorted(by_sql(oracle_sql()["op11_source_divergence"], documents=docs.toPandas()))


def test_features_of_texts_do_not_cross():
    hashes = toxicity._Hashes()
    texts = ["A b C", None, "", "b c", "a"]
    of, found = toxicity.features(texts, hashes)
    assert np.bincount(of, minlength=5).tolist() == [6, 0, 0, 3, 1]  # words, pairs, and the pair around one word
    alone = toxicity.features(["b c"], hashes)[1]
    assert set(alone.tolist()) == set(found[of == 3].tolist()) and len(set(alone.tolist())) == 3
    assert found[of == 4][0] == found[of == 0][0]
    gaps = [set(toxicity.features([t], hashes)[1].tolist()) for t in ("p q", "p x q", "p x y q", "q p")]
    words = set(toxicity.features(["p", "q", "x", "y"], hashes)[1].tolist())
    pairs = [g - words for g in gaps]
    assert [len(x) for x in pairs] == [1, 3, 6, 1]
    # in order and apart from each other by so many words, else another feature; "p x" is in two of them
    assert len(set.union(*pairs)) == 10


def toxic_table(spark, n=600):
    dice = random.Random(1)
    words = ["".join(dice.choices("abcdefgh", k=4)) for _ in range(300)]
    rows, labels = [], []
    for i in range(n):
        text = dice.choices(words, k=dice.randrange(20, 80))
        toxic = i % 6 == 0
        if toxic:
            for w in dice.sample(["vile", "rotten", "horrid"], 2):
                text.insert(dice.randrange(len(text)), w.upper() + "!")
        rows.append((i, " ".join(text)))
        labels.append((i, int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_toxic_words_are_learnt_and_labels_of_held_out_rows_are_not(spark):
    docs, labels = toxic_table(spark)
    model = toxicity.fit(docs, labels)
    assert 0 < len(model.hashes) < 200  # sparse
    made = {r["doc_id"]: r for r in toxicity.classify(docs, model).collect()}
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r["score"] <= 1 for i, r in made.items())
    held = [(i % 6 == 0, r["predicted"] == 1) for i, r in made.items() if r["held_out"]]
    assert sum(a == b for a, b in held) >= 0.97 * len(held)
    turned = labels.withColumn("toxic", F.when(toxicity.held_out("doc_id"), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = toxicity.fit(docs.orderBy(F.desc("doc_id")), turned.union(turned))
    assert np.array_equal(model.hashes, again.hashes) and np.array_equal(model.weights, again.weights) and model.bias == again.bias


def test_long_texts_score_as_a_whole(spark):
    docs, labels = toxic_table(spark)
    model = toxicity.fit(docs, labels)
    hashes = toxicity._Hashes()
    clean, end = "quiet words here " * 200_000, "vile rotten horrid"
    a, b, c = model.score([clean, clean + end, clean + end], hashes)
    assert a < 0.5 < b and b == c


def test_toxicity_without_labels_and_of_odd_tables(spark):
    docs = odd_docs(spark)
    none = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, toxic int")
    made = toxicity.classify(docs, toxicity.fit(docs, none)).collect()
    assert len(made) == docs.count() and {r["score"] for r in made} == {0.5}
    labels = spark.createDataFrame([(i, i % 2) for i in range(13)] + [(1, 1), (None, 0)], "doc_id long, toxic int")
    made = toxicity.classify(docs, toxicity.fit(docs, labels)).collect()
    assert len({r["score"] for r in made if r["doc_id"] in (0, 1, 2, 3)}) == 1  # null, empty and blank texts
    assert all(r["held_out"] for r in made if r["doc_id"] is None)
    assert toxicity.classify(empty_docs(spark), toxicity.fit(empty_docs(spark), labels)).count() == 0


def test_toxicity_of_the_tables(spark):
    made = {r["doc_id"]: r for r in queries()["op12_toxicity"](spark, "/root/testdata/sf0.01").collect()}
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    clean = [made[i]["predicted"] for i, t in labels.items() if t == 0]
    toxic = [made[i]["predicted"] for i, t in labels.items() if t == 1]
    assert sum(clean) <= 0.02 * len(clean) and sum(toxic) >= 0.75 * len(toxic)


def plain_trie(rows):
    """The contract by lists of turns in plain Python."""
    own = defaultdict(list)
    digest = lambda role, text: hashlib.sha256(f"{len(role)} {role}{text}".encode()).digest()
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            own[conv].append((turn is not None, turn or 0, digest(role, text), role, text))
    turns = {c: [x[3:] for x in sorted(t)] for c, t in own.items()}
    rebuilt = {}
    for c, t in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % 20) * (1 if c > 0 else -1)
        rebuilt[c] = tuple(turns.get(base, [])[:h] + t[h:])
    nodes = defaultdict(list)
    for c, t in rebuilt.items():
        for d in range(len(t) + 1):
            nodes[t[:d]].append(c)
    children = Counter(path[:-1] for path in nodes if path)
    saved, leaves = Counter(), Counter()
    for path, members in nodes.items():
        for d in range(len(path) + 1):
            saved[path[:d]] += (len(members) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", path[-1][1])) if path else 0
            leaves[path[:d]] += not children[path]
    ends = lambda path: hashlib.sha256(",".join(str(c) for c in sorted(nodes[path]) if rebuilt[c] == path).encode()).hexdigest()
    return sorted((min(m), len(p), min(nodes[p[:-1]]) if p else None, len(m), children[p], leaves[p], saved[p], ends(p)) for p, m in nodes.items())


def key(row):
    return tuple(-1 << 60 if x is None else x for x in row)


def test_trie_of_odd_conversations(spark):
    dice = random.Random(5)
    texts = ["hello there", "a  b\tc", "", None, "x" * 20_000, "same", "same"]
    rows = []
    for c in [0, 1, 2, 3, 7, 19, 20, 21, 39, 61, 62, -1, -5, -20, -21, -39, 1000, 10**15, 10**15 + 3]:
        for t in range(dice.randrange(1, 8)):
            rows.append((c, dice.choice([t, t, None, 3]), dice.choice(["user", "assistant", None]), dice.choice(texts)))
    rows += [(None, 0, "user", "nobody's"), rows[3], rows[3], (80, None, None, None), (81, 0, "us", "er"), (82, 0, "user", ""), (83, 0, "u", "ser")]
    rows += [(c, t, "user", f"turn {t}") for c in range(100, 140) for t in range(4)]
    table = spark.createDataFrame([(*r, "k", 1, "c") for r in rows], "conv_id long, turn long, role string, text string, key string, n long, conv string")
    made = prefix_trie.trie(table)
    assert [f.dataType.simpleString() for f in made.schema.fields] == ["bigint"] * 7 + ["string"]
    assert sorted(map(tuple, made.collect()), key=key) == sorted(plain_trie(rows), key=key)
    assert prefix_trie.trie(table.limit(0)).count() == 0


def test_trie_holds_few_nodes_and_long_lists_in_pieces(spark, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(prefix_trie, "HELD_NODES", 2)
    batch = pa.RecordBatch.from_arrays([pa.array([0, 0, 0, 0]), pa.array([0, 0, 1, 1]), pa.array([0, 0, 1, 1]), pa.array([b"a", b"b", b"x", b"b"]), pa.array([1, 2, 3, 2])], names=["base", "conv", "shared", "digest", "words"])
    rows = [r for made in prefix_trie._rebuild(iter([batch])) for r in made.to_pylist()]
    counted = Counter()
    for r in rows:
        counted[r["key"]] += r["n"] or 0
    assert sorted(counted.values()) == [2, 2, 2] and [r["ends"] for r in rows if r["n"] is None] == [False, False, True] * 2
    ids = spark.range(-700, 5000, 3).select(F.lit(b"k").alias("key"), F.col("id").alias("conv"))
    wanted = hashlib.sha256(",".join(str(i) for i in range(-700, 5000, 3)).encode()).hexdigest()
    assert [(bytes(r[0]), r[1]) for r in prefix_trie._lists(ids).collect()] == [(b"k", wanted)]


def test_trie_equals_sql(spark):
    table = spark.read.parquet(f"{SF}/conversations.parquet")
    made = sorted((tuple(r) for r in queries()["op13_prefix_trie"](spark, SF).collect()), key=key)
    assert made == sorted(by_sql(oracle_sql()["op13_prefix_trie"], conversations=table.toPandas()), key=key)
    assert made == sorted(plain_trie([tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()]), key=key)
