"""The queries ``opN_<name>``, one for each operator, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import sql
from .common import table


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import BASE, quality_rules

    return quality_rules(table(spark, sf_dir, "documents")).select("doc_id", *BASE, "base_failed", "kept")


#: A dated list for the query: key, day, listed.
URL_EVENTS = (
    ("spam-farm.example.org", "2023-06-01", True),
    ("spam-farm.example.org", "2024-07-01", False),
    ("spam-farm.example.org", "2024-10-01", True),
    ("ads-track.example.com", "2024-02-15", True),
    ("casino-win.example.net", "2022-01-01", True),
    ("casino-win.example.net", "2024-03-01", True),
    ("cheap-pills.example.net", "2024-05-05", True),
    ("adult-x.example.com", "2023-01-01", True),
    ("adult-x.example.com", "2024-09-01", False),
    ("free-bets.example.net", "2024-04-01", True),
    ("free-bets.example.net", "2024-04-01", False),
    ("free-bets.example.net", "2024-08-01", True),
    ("tionsh.example.net/de", "2024-03-01", True),
    ("tionsh.example.net/de", "2024-05-31", False),
    ("blog.tionble.example.com", "2024-11-15", True),
    ("tiontion.example.com/fr", "2024-01-01", True),
    ("Tiontion.Example.NET/en", "2024-02-01", True),
    ("therhe.example.org/EN", "2024-01-01", True),
)


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages have no day of fetching; here it is ``page_id`` modulo 365 days after the first of 2024."""
    from pyspark.sql import functions as F

    from .url_filters import filter_urls

    rows = ", ".join(f"('{key}', date'{day}', {str(listed).lower()})" for key, day, listed in URL_EVENTS)
    events = spark.sql(f"select * from values {rows} as t(key, day, listed)")
    day = F.date_add(F.to_date(F.lit("2024-01-01")), F.pmod("page_id", F.lit(365)).cast("int"))
    pages = table(spark, sf_dir, "pages").select("page_id", "url", day.alias("fetched"))
    found = filter_urls(pages, events)
    return found.select("page_id", "url", F.col("fetched").cast("string"), "host", "n_active", "blocked", "entry", F.col("listed_on").cast("string"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import token_counts

    return token_counts(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), limit=512)


def op4_media_flac(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .media_flac import read_media, to_media

    return read_media(to_media(table(spark, sf_dir, "documents")))


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), percent=85)


def op6_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_extract import extract

    return extract(table(spark, sf_dir, "pages"))


def op7_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .word_bpe import encode_decode

    return encode_decode(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_files import read_digests, write

    return read_digests(spark, write(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), end_id=2))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_classifier import classify, fit

    docs = table(spark, sf_dir, "documents")
    return classify(docs, fit(docs, table(spark, sf_dir, "labels")), least=0.3)


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .source_mixing import mix

    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .source_divergence import divergence

    return divergence(table(spark, sf_dir, "documents"))


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import classify, fit

    docs = table(spark, sf_dir, "documents")
    return classify(docs, fit(docs, table(spark, sf_dir, "labels")), least=0.5)


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .prefix_trie import trie

    return trie(table(spark, sf_dir, "conversations"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_quality_rules, op2_url_filters, op3_token_counts, op4_media_flac, op5_minhash, op6_html_extract, op7_word_bpe, op8_token_files, op9_quality_classifier, op10_source_mixing, op11_source_divergence, op12_toxicity, op13_prefix_trie)}


def oracle_sql() -> dict[str, str]:
    return {"op1_quality_rules": sql.quality_rules(), "op2_url_filters": sql.url_filters(URL_EVENTS), "op5_minhash": sql.near_duplicates(), "op10_source_mixing": sql.source_mixing(), "op11_source_divergence": sql.source_divergence(), "op13_prefix_trie": sql.prefix_trie()}
