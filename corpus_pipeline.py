"""A corpus pipeline over `documents`: each stage calls one operator of tintworks.llm.

Every stage takes (spark, docs, sf_dir), where docs is what the stage before kept,
and all but the last return the columns of `documents`.  Any column may be null, other
columns are left behind whatever their names, and an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tintworks.llm.common import DOCUMENT_COLUMNS, durable, table
from tintworks.llm.line_dedup import dedup_lines
from tintworks.llm.minhash_dedup import drop_near_duplicates
from tintworks.llm.mixing import mix
from tintworks.llm.quality_rules import quality_rules
from tintworks.llm.sentencepieces import PieceModel, default_model_path, encode_pieces


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules; null, empty and very short texts don't.

    Rows are judged one by one, so repeated rows stay or go together.
    """
    judged = quality_rules(docs.select(*DOCUMENT_COLUMNS))
    return judged.where("quality.kept").select(*DOCUMENT_COLUMNS)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with one line of each group of similar lines; n_chars follows the text.

    A document of which no word is left says nothing that others don't, and goes.  One
    that lost nothing stays as it is, a null, empty or blank text too.  Of equal lines
    the smallest id's stays, null ids last; rows that repeat id and text keep the same lines.
    """
    cut = dedup_lines(docs.select(*DOCUMENT_COLUMNS))
    left = cut.where((F.col("n_removed") == 0) | F.rlike("text", F.lit(r"[^\x20\x09-\x0D]")))
    return left.withColumn("n_chars", F.when(F.col("n_removed") == 0, F.col("n_chars")).otherwise(F.length("text").cast("bigint"))).select(*DOCUMENT_COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity 0.8 or more).

    It is the one of the smallest id, null ids last; of rows that repeat id and text one
    stays.  Null and blank texts are near nothing but rows that repeat them.
    """
    return drop_near_duplicates(docs.select(*DOCUMENT_COLUMNS))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, once or twice.

    Null and blank texts have no words to take, and go.  A null source is a source of its own, the last.
    """
    mixed = mix(docs.select(*DOCUMENT_COLUMNS))
    # a share of a document (rows that repeat an id at a threshold) rounds to whole copies
    times = F.when(F.col("size") > 0, F.round(F.col("taken") / F.col("size"))).otherwise(0).cast("int")
    return mixed.withColumn("copy", F.explode(F.array_repeat(F.lit(1), times))).select(*DOCUMENT_COLUMNS)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's piece ids; null and empty texts have none.  Each row is encoded by itself, repeated ones too."""
    model = PieceModel.load(default_model_path())
    return encode_pieces(docs.select(*DOCUMENT_COLUMNS), model).select("doc_id", "lang", "source", "piece_ids", "n_pieces", "round_trip")


STAGES = [
    ("quality_rules", quality_stage),
    ("line_dedup", line_stage),
    ("minhash_dedup", near_duplicate_stage),
    ("mix_sources", mixing_stage),
    ("sentencepiece", encoding_stage),
]

#: The stages keep rows by learned distances, similarity links and hashes of whole texts; tests hold each against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; what a stage returns is cut from its lineage before the next."""
    docs = table(spark, sf_dir, "documents")
    for position, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs if not position else durable(docs), sf_dir)
    return docs
