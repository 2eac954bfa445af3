"""Redaction of a stream of documents: public and audit mode keep no state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakwork.operators.redact import redact

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def read_stream(spark: SparkSession, folder: str, schema: str = DOCUMENTS) -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)


def redact_stream(docs: DataFrame, mode: str, **more) -> DataFrame:
    """docs, redacted as by operators.redact; research mode numbers over a whole job and takes no stream."""
    if mode == "research":
        raise ValueError("research mode needs the whole job: run it in batches")
    return redact(docs, mode, **more)


def counts_stream(redacted: DataFrame) -> DataFrame:
    """pii_type, n: running counts by type."""
    return redacted.select(F.explode("stats").alias("pii_type", "n")).groupBy("pii_type").agg(F.sum("n").alias("n"))
