"""A corpus pipeline of five stages: classify, judge by rules, drop near-duplicates, mix sources, encode.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; ``run`` writes each stage's result
as Parquet in the shared folder and reads it again as the next one's input. All stages but the last return the columns
of ``documents``, and further columns of their input whatever their names; an empty table gives an empty one, and texts
are read whole, however long. What a stage does with nulls, ties and repeated rows is told with it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from seqsearch.llm import minhash, quality_classifier, quality_rules, source_mixing, word_bpe
from seqsearch.llm.common import cut
from seqsearch.llm.queries import tokenizer_path


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is at least 0.3; the classifier learns from the labels of those that are there.

    Null and empty texts have the share of label 1 among the sample as score; without any label all scores are 0.5, and all
    rows stay. Repeated rows have one score. Labels without a document, or null, are left out.
    """
    model = quality_classifier.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_classifier.classify(docs, model, least=0.3, keep=True)


def judge(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that don't fail the base rules and are good with a probability of at least 0.5.

    Null and empty texts have no words and fail the base rules. A row is judged by its text and the estimated rules
    alone, so repeated rows stay or go together.
    """
    return quality_rules.keep_good(docs)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id.

    Of repeated rows one stays. Rows without id stay; null and empty texts have no copies, so they stay too.
    """
    return minhash.drop_near_duplicates(docs, percent=85)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them: not at all, once or twice.

    Null texts have no words; a null source is a source of its own. Rows that are the same in id, text and source are
    taken alike.
    """
    return source_mixing.take(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256, ids`` of each row; other columns end here.

    Null and empty texts have no ids; a null id stays null, and a row that the mix takes twice is there twice.
    """
    return word_bpe.encode_decode(docs, tokenizer_path("word_bpe_49k.json"), ids=True)


STAGES = [("classify", classify), ("judge", judge), ("drop_copies", drop_copies), ("mix", mix), ("encode", encode)]

#: A fitted classifier and a tokenizer are beyond SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
