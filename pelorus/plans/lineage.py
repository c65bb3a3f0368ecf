"""Cutting lineage where a later step must see the very same rows again."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the session.

    ``spark.checkpoint.dir`` of the session decides. Where it is unset, a temporary folder is made if all tasks run on
    this machine (a ``local`` master); on a cluster each executor would write to its own disk, so that is an error.
    """
    context = spark.sparkContext
    folder = context.getCheckpointDir()
    if not folder:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not is_local(context.master):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="pelorus-checkpoint-")
        context.setCheckpointDir(folder)
    return folder


def is_local(master: str) -> bool:
    """Whether all tasks run in the driver's own process."""
    return master == "local" or master.startswith("local[")


def _tables(spark: SparkSession) -> str:
    return f"{ensure_checkpoint_dir(spark)}/pelorus-tables/{spark.sparkContext.applicationId}"


def _path(spark: SparkSession, text: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(text)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as a Parquet table to the shared checkpoint folder and return a DataFrame that reads it.

    The copy survives the loss of executors, and values that depend on task placement (such as
    ``spark_partition_id``) stay as they were. Columns are compressed, which a checkpointed RDD's rows are not, and
    the files' size is known to the planner, which broadcasts such a table in a join only below its threshold.
    A table is deleted at the end of the :func:`scratch` block that it is made in, by :func:`drop_tables`, or when the
    driver ends; a driver that is killed leaves the folder of its application id.
    """
    spark = df.sparkSession
    path = f"{_tables(spark)}/{uuid.uuid4().hex}"
    folder, files = _path(spark, path)
    files.deleteOnExit(folder)
    for open_block in _open:
        open_block.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_open: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that :func:`cut` writes in the block are deleted at its end; what reads them must be done by then."""
    made: list[str] = []
    _open.append(made)
    try:
        yield
    finally:
        _open.remove(made)
        for path in made:
            folder, files = _path(spark, path)
            files.delete(folder, True)


def drop_tables(spark: SparkSession) -> None:
    """Delete the tables that :func:`cut` wrote in this application; DataFrames that read them can't be used after it."""
    folder, files = _path(spark, _tables(spark))
    files.delete(folder, True)
