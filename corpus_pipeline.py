"""A corpus pipeline of five stages: quality, exact copies, near copies, benchmark passages, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read
again as the next stage's docs. All but the last keep the columns of docs.

Documents are named by doc_id. Rows that repeat a doc_id are one document where a stage looks for
copies; a stage that drops a document drops all its rows. Rows without a doc_id are one document in that sense too.

A null or empty text has no quality and goes in the first stage. Very long texts are treated whole. Of equal texts the
largest doc_id stays, of near copies the smallest. Empty tables give no rows; other columns stay up to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakwork.llm.common import materialise, table
from cloakwork.llm.decontaminate import decontaminate
from cloakwork.llm.exact_dedup import exact_dedup
from cloakwork.llm.piece_codec import encode_decode
from cloakwork.llm.quality import quality
from cloakwork.llm.queries import piece_model
from cloakwork.llm.simhash_dedup import near_duplicates


def _without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """docs without the rows whose doc_id is in dropped(doc_id)."""
    return docs.join(dropped.select(F.col("doc_id").alias("_dropped")).distinct(), docs["doc_id"].eqNullSafe(F.col("_dropped")), "left_anti")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality classifier rejects."""
    return _without(docs, quality(docs, table(spark, sf_dir, "labels")).filter("not accepted"))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of equal texts, that with the largest doc_id."""
    return _without(docs, exact_dedup(docs).filter("not kept"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies, that with the smallest doc_id."""
    return _without(docs, near_duplicates(docs).filter("doc_id <> component_id"))


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a window of any benchmark item: one whole passage is a leak."""
    return _without(docs, decontaminate(docs, table(spark, sf_dir, "benchmark")).filter("n_hit > 0"))


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each document that is left, checked by decoding."""
    return encode_decode(docs, piece_model())


STAGES = [
    ("quality classifier", quality_classifier),
    ("exact dedup", exact_copies),
    ("SimHash near-dedup", near_copies),
    ("benchmark decontamination", benchmark_passages),
    ("SentencePiece encoding and decoding", pieces),
]

#: The classifier and the tokenizer have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialise(docs, f"stage{i}")
    return docs
