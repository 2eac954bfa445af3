"""Statistics, the audit log, and the job and user tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LOG = "timestamp string, original_file string, output_file string, mode string, pii_types_redacted string, total_redactions bigint"
JOBS = "job_id string, timestamp timestamp, mode string, file_count int, total_redactions bigint, summary map<string,bigint>, files array<struct<name:string,stats:map<string,bigint>>>, status string, error string, run_by string"
USERS = "username string, password_hash string, role string, created_at timestamp"


def stem(name):
    return F.regexp_replace(name, r"(?s)(.)\.[^.]*\z", "$1")


def suffix(name):
    return F.lower(F.regexp_extract(name, r"(?s).(\.[^.]+)\z", 1))


def output_name(name, mode: str):
    """{stem}_{mode}{suffix}; the suffix keeps its case."""
    return F.concat(stem(name), F.lit(f"_{mode}"), F.regexp_extract(name, r"(?s).(\.[^.]+)\z", 1))


def file_totals(stats: DataFrame) -> DataFrame:
    """job_id, file_ord, name, total over stats (job_id, file_ord, name, pii_type, n)."""
    return stats.groupBy("job_id", "file_ord", "name").agg(F.sum("n").alias("total"))


def job_summary(stats: DataFrame) -> DataFrame:
    """job_id, pii_type, n."""
    return stats.groupBy("job_id", "pii_type").agg(F.sum("n").alias("n"))


def job_totals(stats: DataFrame) -> DataFrame:
    """job_id, file_count, total_redactions, types."""
    return stats.groupBy("job_id").agg(F.count_distinct("file_ord").alias("file_count"), F.sum("n").alias("total_redactions"), F.count_distinct("pii_type").alias("types"))


def result_cards(jobs: DataFrame) -> DataFrame:
    """job_id, file_count, total, types of job rows (files with their stats maps): what a finished job shows."""
    total = F.aggregate("files", F.lit(0).cast("long"), lambda a, f: a + file_sum(f["stats"]))
    return jobs.select("job_id", F.size("files").cast("long").alias("file_count"), total.alias("total"), F.size(F.map_keys("summary")).cast("long").alias("types"))


def file_sum(stats):
    """The sum over a stats map."""
    return F.aggregate(F.map_values(stats), F.lit(0).cast("long"), lambda a, n: a + n)


def shown(n):
    """A number with commas between its thousands."""
    return F.format_number(n, 0)


def type_list(stats):
    """Sorted type names of a stats map, or none."""
    return F.when(F.size(stats) > 0, F.array_join(F.array_sort(F.map_keys(stats)), ", ")).otherwise("none")


def log_rows(redacted: DataFrame, mode: str, at) -> DataFrame:
    """One log row for each file of redacted (file_ord, name, stats, total), in file order."""
    rows = redacted.orderBy("file_ord")
    return rows.select(F.date_format(at, "yyyy-MM-dd HH:mm:ss").alias("timestamp"), F.col("name").alias("original_file"), output_name(F.col("name"), mode).alias("output_file"), F.lit(mode).alias("mode"), type_list(F.col("stats")).alias("pii_types_redacted"), F.col("total").alias("total_redactions"))


def job_row(redacted: DataFrame, job_id: str, mode: str, at, run_by: str) -> DataFrame:
    """The row of a finished job over redacted (file_ord, name, stats, total)."""
    files = redacted.agg(F.count("*").cast("int").alias("file_count"), F.coalesce(F.sum("total"), F.lit(0)).alias("total_redactions"), F.transform(F.array_sort(F.collect_list(F.struct("file_ord", "name", F.map_entries("stats").alias("stats")))), lambda x: F.struct(x["name"].alias("name"), F.map_from_entries(x["stats"]).alias("stats"))).alias("files"))
    types = redacted.select(F.explode("stats").alias("t", "n")).groupBy("t").agg(F.sum("n").alias("n"))
    summary = types.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("t", "n")))).alias("summary"))
    return files.crossJoin(summary).select(F.lit(job_id).alias("job_id"), at.alias("timestamp"), F.lit(mode).alias("mode"), "file_count", "total_redactions", "summary", "files", F.lit("done").alias("status"), F.lit("").alias("error"), F.lit(run_by).alias("run_by"))


def failed_job(spark: SparkSession, job_id: str, mode: str, error: str, run_by: str) -> DataFrame:
    """The row of a failed job: no files, no redactions."""
    return spark.createDataFrame([(job_id, None, mode, 0, 0, {}, [], "error", error, run_by)], JOBS).withColumn("timestamp", F.current_timestamp())


def progress(files: DataFrame) -> DataFrame:
    """files (job_id, file_ord) with the percentage at which each begins."""
    w = Window.partitionBy("job_id")
    return files.withColumn("progress", F.floor((F.row_number().over(w.orderBy("file_ord")) - 1) / F.count("*").over(w) * 100).cast("int"))


def dashboard(jobs: DataFrame) -> DataFrame:
    return jobs.agg(F.count("*").alias("jobs"), F.coalesce(F.sum("file_count"), F.lit(0)).alias("files"), F.coalesce(F.sum("total_redactions"), F.lit(0)).alias("redactions"), F.count_distinct("run_by").alias("users"))


def upsert(rows: DataFrame, new: DataFrame, key: str = "job_id") -> DataFrame:
    """rows with those of new put in, the last one of a key staying; new may hold a key once."""
    return rows.join(new.select(key), key, "left_anti").select(*rows.columns).unionByName(new.select(*rows.columns))


def insert_user(users: DataFrame, new: DataFrame) -> DataFrame:
    """users and new; a name that is there already is an error."""
    if not new.join(users, "username", "left_semi").isEmpty():
        raise ValueError("Username already exists")
    return users.unionByName(new.withColumn("role", F.coalesce("role", F.lit("analyst"))).select(*users.columns))


def delete_user(users: DataFrame, username: str) -> DataFrame:
    """users without the name; a name that is not there changes nothing."""
    return users.filter(~F.col("username").eqNullSafe(F.lit(username)))


def user(users: DataFrame, username: str) -> DataFrame:
    return users.filter(F.col("username") == username).limit(1)


def list_jobs(jobs: DataFrame) -> DataFrame:
    return jobs.orderBy(F.desc("timestamp"))


def list_users(users: DataFrame) -> DataFrame:
    return users.select("username", "role", "created_at").orderBy("created_at")


def seeded(users: DataFrame, first: DataFrame) -> DataFrame:
    """users, or the rows of first where there are none; which row that is, the caller says: there is no built-in account."""
    n = users.limit(1).agg(F.count("*").alias("_n"))
    return users.unionByName(first.join(F.broadcast(n), F.col("_n") == 0).select(*users.columns))


def empty(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)
