"""Redacted documents to files: one file each, written by the executors, and the audit log."""

from __future__ import annotations

import io
import json
import os
import zipfile

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloakwork.operators.audit import output_name
from cloakwork.sources import office


def encoded(ext: str, text: str, original: bytes | None) -> tuple[str, bytes]:
    """Suffix and bytes of a redacted text in its format; what a format cannot take becomes text."""
    if ext == ".docx":
        return ext, office.docx_bytes(text)
    if ext == ".xlsx":
        sheets = office.safely(office.xlsx_sheets, original, None) if original else None
        return (ext, office.xlsx_bytes(office.rejoined(sheets, text))) if sheets else (".txt", text.encode())
    return (".txt" if ext == ".pdf" else ext), text.encode()


def outputs(redacted: DataFrame, mode: str) -> DataFrame:
    """doc_id, output_file, content for redacted (doc_id, name, ext, content, redacted)."""

    def run(batches):
        for pdf in batches:
            rows = []
            for doc, out, ext, data, text in zip(pdf["doc_id"], pdf["output_file"], pdf["ext"], pdf["content"], pdf["redacted"]):
                to, body = encoded(ext, text, data)
                rows.append((doc, out if to == ext else out[: len(out) - len(ext)] + to, body))
            yield pd.DataFrame(rows, columns=["doc_id", "output_file", "content"])

    rows = redacted.select("doc_id", output_name(F.col("name"), mode).alias("output_file"), "ext", "content", "redacted")
    return rows.mapInPandas(run, "doc_id long, output_file string, content binary")


def write_files(rows: DataFrame, folder: str) -> None:
    """Each row's content (output_file, content) to its own file of a folder that all executors see.

    A file appears whole or not at all, so a task that runs twice does no harm.
    """

    def run(part):
        os.makedirs(folder, exist_ok=True)
        for r in part:
            to = os.path.join(folder, os.path.basename(r["output_file"]))
            with open(f"{to}.{os.getpid()}.part", "wb") as f:
                f.write(bytes(r["content"]))
            os.replace(f.name, to)

    rows.select("output_file", "content").foreachPartition(run)


def write_log(log: DataFrame, folder: str) -> None:
    """The log as CSV with a header, in file order; one part, since it has a row a file of one job."""
    log.coalesce(1).write.csv(f"{folder}/redaction_log", header=True, mode="overwrite")


def save_schema(schema: dict, path: str) -> None:
    with open(path, "w", encoding="utf-8") as f:
        json.dump(schema, f, indent=2)


def bundles(rows: DataFrame) -> DataFrame:
    """job_id, content: a flat zip of each job's files (job_id, output_file, content)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for name, body in sorted(zip(pdf["output_file"], pdf["content"])):
                z.writestr(zipfile.ZipInfo(name), body)
        return pd.DataFrame({"job_id": [pdf["job_id"].iloc[0]], "content": [out.getvalue()]})

    return rows.select("job_id", "output_file", "content").groupBy("job_id").applyInPandas(run, "job_id string, content binary")
