"""The classifier's held-out accuracy, and the pipeline against a plain version of its stages."""

from __future__ import annotations

import random
import zlib
from collections import Counter

import numpy as np
from helpers import WORD, empty_docs, odd_docs
from pyspark.sql import functions as F
from test_near_dup import brute
from test_tokens import digests

import corpus_pipeline
from seqsearch.llm import chunks, quality_classifier, quality_rules, source_mixing

SF = "/root/testdata/sf0.01"


def tables(spark):
    return (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))


def test_held_out_accuracy(spark):
    docs, labels = tables(spark)
    model = quality_classifier.fit(docs, labels)
    rows = quality_classifier.classify(docs, model).join(labels, "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    held = [r for r in rows if r["held_out"]]
    right = sum(r["predicted"] == r["quality"] for r in held)
    assert len(held) > 40 and right / len(held) > 0.95


def test_texts_that_differ_in_words_alone(spark):
    """Good and bad texts of the same punctuation, casing and lengths: only the vocabulary tells them apart."""
    rng = random.Random(3)
    good, bad, both = (["".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 8))) for _ in range(300)] for _ in range(3))
    text = lambda own: " ".join(" ".join(rng.choice(own if rng.random() < 0.5 else both) for _ in range(8)).capitalize() + "." for _ in range(rng.randint(5, 30)))
    docs = spark.createDataFrame([(i, text(good if i % 2 else bad)) for i in range(600)], "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    held = quality_classifier.classify(docs, quality_classifier.fit(docs, labels)).where("held_out").collect()
    assert len(held) > 80 and sum(r["predicted"] == r["doc_id"] % 2 for r in held) / len(held) > 0.95


def test_repeated_ids_count_once(spark):
    """An id that most rows repeat takes no place of other documents in the sample."""
    docs = spark.createDataFrame([(i, f"text number {i} of some") for i in range(100)] + [(1, f"again {i}") for i in range(300)], "doc_id long, text string").coalesce(1).orderBy(F.desc(F.expr("doc_id = 1")))
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(100)], "doc_id long, quality int, toxic int")
    chosen = labels.where(~quality_classifier.held_out()).orderBy(F.xxhash64("doc_id"), "doc_id").limit(60).collect()
    model = quality_classifier.fit(docs, labels.where(F.col("doc_id").isin([r["doc_id"] for r in chosen] + [1])), sample=60)
    assert len(model.labels) == 60 and 20 < model.labels.sum() < 40


def test_counts_are_carried_whole():
    counts = np.stack([quality_classifier.terms(t) for t in ("", "one", "One two, two!\nthree", "a b " * 500)])
    assert (quality_classifier.unpacked([quality_classifier.packed(c) for c in counts]) == counts).all()
    assert quality_classifier.unpacked([]).shape == (0, quality_classifier.TERMS)


def test_scores_depend_on_the_text_alone(spark):
    docs, labels = tables(spark)
    model = quality_classifier.fit(docs, labels)
    score = lambda df: {r["doc_id"]: round(r["score"], 4) for r in quality_classifier.classify(df, model).collect()}
    moved = docs.withColumn("doc_id", F.col("doc_id") + 5000).withColumn("source", F.lit("x")).withColumn("lang", F.lit("y")).repartition(5)
    assert {k - 5000: v for k, v in score(moved).items()} == score(docs)


def test_labels_of_held_out_rows_are_not_learnt(spark):
    docs, labels = tables(spark)
    flipped = labels.withColumn("quality", F.when(quality_classifier.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = quality_classifier.fit(docs, labels), quality_classifier.fit(docs, flipped)
    assert (a.labels == b.labels).all() and (a.vectors == b.vectors).all()


def test_odd_rows_and_labels(spark):
    docs, labels = tables(spark)
    odd = odd_docs(spark)
    more = labels.unionByName(spark.createDataFrame([(None, 1, 0), (1, None, 0), (3, 0, 0), (3, 1, 0), (10**9, 1, 1)], "doc_id long, quality int, toxic int"))
    model = quality_classifier.fit(docs, more)
    rows = quality_classifier.classify(odd, model).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(r["doc_id"] for r in odd.collect())
    blank = {r["score"] for r in rows if r["doc_id"] in (0, 1, 2, 3)}
    assert blank == {model.base}
    kept = quality_classifier.classify(odd.withColumn("_score", F.lit(7)), model, keep=True)
    assert kept.columns == [*odd.columns, "_score"] and {r["_score"] for r in kept.collect()} == {7}
    assert quality_classifier.classify(empty_docs(spark), model).collect() == []
    nothing = quality_classifier.fit(docs, labels.where("false"))
    assert {r["score"] for r in quality_classifier.classify(odd, nothing).collect()} == {0.5}


def test_neighbours_are_the_nearest(spark):
    """Blocked scoring against one document at a time, all similarities sorted."""
    rng = np.random.default_rng(1)
    counts = rng.poisson(0.05, size=(300, quality_classifier.TERMS)).astype(np.float32)
    model = quality_classifier.Model(counts, rng.integers(0, 2, 300).astype(np.float32))
    asked = rng.poisson(0.05, size=(20, quality_classifier.TERMS)).astype(np.float32)
    for row, score in zip(asked, model.score(asked), strict=True):
        near = (model.vectors @ model.latent(row[None])[0]).astype(np.float64)
        best = np.argsort(-near)[: quality_classifier.NEIGHBOURS]
        weight = np.maximum(near[best], 0) ** quality_classifier.POWER + 1e-12
        assert abs(score - (weight * model.labels[best]).sum() / weight.sum()) < 1e-3


def test_pipeline(spark, tmp_path):
    """Each stage on its predecessor's rows, and the whole against run()."""
    docs, labels = tables(spark)
    docs = docs.where("doc_id < 400")
    for name, df in (("documents", docs), ("labels", labels)):
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, path = docs.columns, str(tmp_path)
    stages = dict(corpus_pipeline.STAGES)
    text = {r["doc_id"]: r["text"] for r in docs.collect()}

    first = stages["classify"](spark, docs, path)
    scores = quality_classifier.classify(docs, quality_classifier.fit(docs, labels)).collect()
    one = sorted(r["doc_id"] for r in first.collect())
    assert one == sorted(r["doc_id"] for r in scores if r["predicted"] == 1) and first.columns == columns
    truth = {r["doc_id"]: r["quality"] for r in labels.collect()}
    assert sum(truth[d] == 0 for d in text if d in truth and d in set(one)) <= 2
    assert sum(truth[d] == 1 for d in text if d in truth and d not in set(one)) <= 2

    second = stages["judge"](spark, first, path)
    two = sorted(r["doc_id"] for r in second.collect())
    assert two == sorted(r["doc_id"] for r in quality_rules.quality_rules(first).where("kept").collect()) and second.columns == columns

    third = stages["drop_copies"](spark, second, path)
    three = sorted(r["doc_id"] for r in third.collect())
    assert three == sorted(d for d, (_, c) in brute([(d, text[d]) for d in two]).items() if d == c) and third.columns == columns

    fourth = stages["mix"](spark, third, path)
    four = Counter(r["doc_id"] for r in fourth.collect())
    assert four == Counter({r["doc_id"]: r["copies"] for r in source_mixing.mix(third).collect() if r["copies"]}) and fourth.columns == columns

    tokenizer = chunks.load(WORD)
    expected = Counter({(d, *digests(tokenizer, text[d])): n for d, n in four.items()})
    got = lambda df: Counter(tuple(r)[:4] for r in df.collect())
    assert got(stages["encode"](spark, fourth, path)) == expected == got(corpus_pipeline.run(spark, path))


def test_stages_take_odd_and_empty_tables(spark):
    for docs in (odd_docs(spark), empty_docs(spark)):
        for name, stage in corpus_pipeline.STAGES:
            made = stage(spark, docs, SF)
            made.collect()
            assert name == "encode" or made.columns == docs.columns
