"""Documents from files: text, CSV, SQL dumps, DOCX, XLSX and PDF."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from cloakwork.functions.text import newlines, rejoined_literals, visible
from cloakwork.operators.audit import suffix
from cloakwork.sources import office
from cloakwork.storage import materialise

EXTENSIONS = (".txt", ".pdf", ".docx", ".csv", ".xlsx", ".sql")
#: Bytes of one upload to a service; a folder's files may be larger.
MOST_BYTES = 100 * 1024 * 1024


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """path, length, name, ext, content of the folder's files (not of folders in it) that can be read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    return found.select("path", "length", name.alias("name"), suffix(name).alias("ext"), "content").filter(F.col("ext").isin(*EXTENSIONS))


def uploads(spark: SparkSession, folder: str, most: int = MOST_BYTES) -> DataFrame:
    """path, name, length, accepted of what a service was sent: whether it is of a known kind and not too large."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    return found.select("path", name.alias("name"), "length", (suffix(name).isin(*EXTENSIONS) & (F.col("length") <= most)).alias("accepted"))


def with_order(files: DataFrame) -> DataFrame:
    """files with file_ord, from 0 by path.

    Only paths are sorted: dealt out by range, ranked in each part, and moved up by what the parts before it hold.
    """
    parts = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = materialise(files.select("path").repartitionByRange(parts, "path").withColumn("part", F.spark_partition_id()), "file-order")
    sizes = dealt.groupBy("part").agg(F.count("*").alias("rows"))
    # One row for each part.
    before = sizes.select("part", (F.sum("rows").over(Window.orderBy("part")) - F.col("rows")).alias("before"))
    ranked = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("part").orderBy("path")))
    order = ranked.join(F.broadcast(before), "part").select("path", (F.col("rank") + F.col("before") - 1).cast("int").alias("file_ord"))
    return files.join(order, "path")


@F.pandas_udf(StringType())
def _utf8(content: pd.Series) -> pd.Series:
    """Bytes that are not UTF-8 are dropped."""
    return content.map(lambda b: b.decode("utf-8", "ignore"))


def _reader(read):
    @F.pandas_udf(StringType())
    def run(content: pd.Series) -> pd.Series:
        return content.map(lambda b: office.safely(read, b, ""))

    return run


def read_text(files: DataFrame) -> DataFrame:
    return files.withColumn("text", newlines(_utf8("content")))


def read_csv(files: DataFrame) -> DataFrame:
    """As one text, not cell by cell."""
    return files.withColumn("text", visible(newlines(_utf8("content"))))


def read_sql(files: DataFrame) -> DataFrame:
    return files.withColumn("text", rejoined_literals(newlines(_utf8("content"))))


def read_docx(files: DataFrame) -> DataFrame:
    return files.withColumn("text", _reader(office.docx_text)("content"))


def read_xlsx(files: DataFrame) -> DataFrame:
    return files.withColumn("text", _reader(office.xlsx_text)("content"))


def read_pdf(files: DataFrame) -> DataFrame:
    return files.withColumn("text", _reader(office.pdf_text)("content"))


READERS = {".txt": read_text, ".pdf": read_pdf, ".docx": read_docx, ".csv": read_csv, ".xlsx": read_xlsx, ".sql": read_sql}


def read(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, file_ord, path, name, ext, content, text of a folder's files, whatever their size; doc_id is file_ord."""
    files = with_order(listing(spark, folder))
    out = None
    for ext, reader in READERS.items():
        part = reader(files.filter(F.col("ext") == ext))
        out = part if out is None else out.unionByName(part)
    return out.select(F.col("file_ord").cast("long").alias("doc_id"), "file_ord", "path", "name", "ext", "content", "text")


def cells(files: DataFrame) -> DataFrame:
    """doc_id, sheet, sheet_ord, row, col, value of every cell of workbooks (doc_id, content)."""

    def run(batches):
        for pdf in batches:
            rows = [
                (doc, title, k, i, j, v)
                for doc, data in zip(pdf["doc_id"], pdf["content"])
                for k, (title, grid) in enumerate(office.safely(office.xlsx_sheets, data, []))
                for i, row in enumerate(grid)
                for j, v in enumerate(row)
            ]
            yield pd.DataFrame(rows, columns=["doc_id", "sheet", "sheet_ord", "row", "col", "value"])

    return files.select("doc_id", "content").mapInPandas(run, "doc_id long, sheet string, sheet_ord int, row int, col int, value string")


def rejoined_cells(grid: DataFrame, texts: DataFrame) -> DataFrame:
    """grid (cells) with the values of texts (doc_id, text): line i to row i, tab piece j to cell j; missing: empty."""
    rows = grid.select("doc_id", "sheet_ord", "row").distinct()
    rows = rows.withColumn("line", F.row_number().over(Window.partitionBy("doc_id").orderBy("sheet_ord", "row")) - 1)
    lines = texts.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "raw"))
    put = rows.join(lines, ["doc_id", "line"], "left").select("doc_id", "sheet_ord", "row", F.split("raw", "\t").alias("parts"))
    out = grid.drop("value").join(put, ["doc_id", "sheet_ord", "row"])
    return out.select("doc_id", "sheet", "sheet_ord", "row", "col", F.coalesce(F.get("parts", F.col("col")), F.lit("")).alias("value"))


def words(files: DataFrame) -> DataFrame:
    """Word boxes of PDF files (doc_id, content), for operators/geometry.py."""
    columns = ["doc_id", "page", "word_idx", "text", "x0", "x1", "top", "bottom", "page_height"]

    def run(batches):
        for pdf in batches:
            rows = [{"doc_id": d} | w for d, data in zip(pdf["doc_id"], pdf["content"]) for w in office.safely(office.pdf_words, data, [])]
            yield pd.DataFrame(rows, columns=columns)

    return files.select("doc_id", "content").mapInPandas(run, "doc_id long, page int, word_idx int, text string, x0 double, x1 double, top double, bottom double, page_height double")


def streams(files: DataFrame) -> DataFrame:
    """Content streams of PDF files (doc_id, content), for operators/streams.py."""

    def run(batches):
        for pdf in batches:
            rows = [(d, *s) for d, data in zip(pdf["doc_id"], pdf["content"]) for s in office.safely(office.pdf_streams, data, [])]
            yield pd.DataFrame(rows, columns=["doc_id", "page", "stream_idx", "content"])

    return files.select("doc_id", "content").mapInPandas(run, "doc_id long, page int, stream_idx int, content binary")


def load_schema(spark: SparkSession, path: str) -> dict:
    """The learned fields of a JSON file; none if it is not there."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", path.rsplit("/", 1)[-1]).load(path.rsplit("/", 1)[0]).select("content").collect()
    return json.loads(bytes(found[0][0])) if found else {}
