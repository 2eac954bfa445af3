"""A redaction job: read, scan, redact, write, log."""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakwork.functions.text import not_blank
from cloakwork.operators import audit, context, rules
from cloakwork.operators.redact import redact
from cloakwork.sources import files, sinks
from cloakwork.storage import materialise


@dataclass
class Job:
    """What a job came to."""

    job_id: str
    status: str
    names: list[str] = field(default_factory=list)
    redacted: DataFrame | None = None
    row: DataFrame | None = None
    log: DataFrame | None = None
    unknown_fields: DataFrame | None = None


def submit(spark: SparkSession, docs: DataFrame, mode: str, *, words=None, schema=None, ner=None, scan_limit=None, skip_blank=False, run_by="-") -> Job:
    """Redacts docs (doc_id, file_ord, name, text, …). An error gives a job with its row, not an exception.

    The corpus is scanned for names whatever its size; a web service that must answer soon may give a scan_limit.
    """
    job_id, schema = str(uuid.uuid4())[:8], schema or {}
    rules.active(mode)
    try:
        if skip_blank:
            docs = docs.filter(not_blank(F.col("text")))
        names = context.scan(docs, words, scan_limit)
        known = spark.createDataFrame([(k,) for k in schema], "field string")
        unknown = context.unknown_fields(docs, known)
        done = materialise(redact(docs, mode, names, schema, words, ner), "redacted")
        now = F.current_timestamp()
        return Job(job_id, "done", names, done, audit.job_row(done, job_id, mode, now, run_by), audit.log_rows(done, mode, now), unknown)
    except Exception as e:  # noqa: BLE001  the job table keeps the error
        return Job(job_id, "error", row=audit.failed_job(spark, job_id, mode, str(e), run_by))


def run_folder(spark: SparkSession, source: str, target: str, mode: str, **more) -> Job:
    """Redacts the files of a folder into another; both must be visible to all executors."""
    job = submit(spark, files.read(spark, source), mode, **more)
    if job.status == "done":
        sinks.write_files(sinks.outputs(job.redacted, mode), target)
        sinks.write_log(job.log, target)
    return job
