"""Folders and tables in the place that all executors share."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def work_dir(spark: SparkSession, name: str) -> str:
    """Folder for checkpoints and tables: the shared one that the session names.

    Only a session of one machine may have none; on a cluster that is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.conf.get("spark.master", "")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return f"{root.rstrip('/')}/{name}-{spark.sparkContext.applicationId}-{_next()}"


def _next(counter: list[int] = []) -> int:  # noqa: B006 - one counter per driver
    counter.append(len(counter))
    return counter[-1]


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table: what several readers use is made once and survives lost executors.

    Hashes as hexadecimal text take half the room that Parquet's default codec leaves them.
    """
    path = work_dir(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def written_for(df: DataFrame, name: str) -> Iterator[DataFrame]:
    """``written`` for the length of a block, such as a batch of a stream; then its files go."""
    table = written(df, name)
    folders = {file.rsplit("/", 1)[0] for file in table.inputFiles()}
    try:
        yield table
    finally:
        hadoop = df.sparkSession.sparkContext
        for folder in folders:
            path = hadoop._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(hadoop._jsc.hadoopConfiguration()).delete(path, True)
