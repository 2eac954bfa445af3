"""Tables between steps, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame

#: Folders that this process has made, with the means to remove them.
_made: dict = {}


def shared_dir(spark) -> str:
    """spark.checkpoint.dir of the session; only a local session may go without it."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"file://{tempfile.gettempdir()}/cloakwork-checkpoints"


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Writes df and reads it again: cuts the lineage and outlives lost executors.

    The folder stays until discard() or the end of the driver's process.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    _made[path] = spark.sparkContext
    df.write.parquet(path, compression="zstd")
    out = spark.read.schema(df.schema).parquet(path)
    out._folder = path
    return out


def _remove(path: str) -> None:
    context = _made.pop(path)
    p = context._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(context._jsc.hadoopConfiguration()).delete(p, True)


def discard(df: DataFrame) -> None:
    """Removes the table that materialise() made for df; nothing that is still to be computed may read it."""
    _remove(df._folder)


@atexit.register
def _clean() -> None:
    for path in list(_made):
        with contextlib.suppress(Exception):  # the session may have ended before
            _remove(path)
