"""The queries of this subpackage, with production parameters over whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import license_scan, mixing, sentencepieces, sharding, transport_streams, url_filters
from .common import table
from .line_dedup import dedup_lines
from .minhash_dedup import NearDupConfig, near_duplicates
from .quality_classifier import classify
from .quality_rules import quality_rules


def _held_out(doc_id):
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(4)) == 2


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quality score for every document, learned from the labels outside the held-out quarter."""
    labels = table(spark, sf_dir, "labels").where(~_held_out("doc_id")).select("doc_id", "quality")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return classify(docs, labels).select("doc_id", F.coalesce(_held_out("doc_id"), F.lit(False)).alias("held_out"), "score", "predicted")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words that a mix of 150 % of the corpus takes of each document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken")


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shard of every document, of 256."""
    docs = table(spark, sf_dir, "documents").select("doc_id")
    return sharding.assign_shards(docs, 256)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What fuzzy line dedup leaves of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_removed", F.octet_length("text").cast("bigint").alias("kept_bytes"), F.md5(F.col("text").cast("binary")).alias("kept_md5"))


def op5_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate component of every document, on two-word shingles."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_duplicates(docs, NearDupConfig(width=2)).select("doc_id", "n_shingles", "component_id", "kept")


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best license template of every document, and how much of it is there."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return license_scan.scan_licenses(docs).drop("text")


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The piece ids of every whole text, and whether they decode to it."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = sentencepieces.PieceModel.load(sentencepieces.default_model_path())
    return sentencepieces.encode_pieces(docs, model).drop("text")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts of every document, and the verdict of the base and divergence rules."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    judged = quality_rules(docs)
    return judged.select("doc_id", *[F.col(f"quality.{n}").alias(n) for n in names], F.round("quality.class_distance", 9).alias("class_distance"), F.round("quality.word_distance", 9).alias("word_distance"))


def op9_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text stored as a transport stream and read back from it."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    stored = transport_streams.store_media(docs).select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("bigint").alias("n_bytes"), "media")
    read = stored.withColumn("r", transport_streams.read_media(F.col("media")))
    return read.select(
        "doc_id", "n_bytes", "r.payload_bytes", "r.payload_sha256", "r.tail_crc32",
        F.octet_length("media").cast("bigint").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "r.feature", "r.pts", "r.access_points",
    )


RULES = [
    url_filters.Rule("allow", "com/"),
    url_filters.Rule("block", "example.com/en/"),
    url_filters.Rule("allow", "www.example.com/en/"),
    url_filters.Rule("block", "net/es/"),
    url_filters.Rule("block", "net/fr/"),
]


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict for every page's url, by rule or by its host's reputation."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    judged = url_filters.filter_urls(pages, labels, RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict", "n_labelled", F.round("bad_bound", 6).alias("bad_bound"))


QUERIES = {
    "op1_quality_classifier": op1_quality_classifier,
    "op2_mixing": op2_mixing,
    "op3_sharding": op3_sharding,
    "op4_line_dedup": op4_line_dedup,
    "op5_minhash_dedup": op5_minhash_dedup,
    "op6_license_scan": op6_license_scan,
    "op7_sentencepiece": op7_sentencepiece,
    "op8_quality_rules": op8_quality_rules,
    "op9_media_columns": op9_media_columns,
    "op10_url_filters": op10_url_filters,
}

ORACLES: dict[str, str] = {
    "op2_mixing": mixing.oracle_sql(),
    "op10_url_filters": url_filters.oracle_sql(RULES),
}
