"""Where intermediate tables go: the folder that driver and executors share."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset, a local run has one of its own; a cluster has none that all see."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = os.path.join(tempfile.gettempdir(), "checkpoints")
        os.makedirs(base, exist_ok=True)
    return base.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used before."""
    return f"{shared_dir(spark)}/kinlake/{name}-{uuid.uuid4().hex}"


def remove(path: str) -> None:
    """Delete a folder of `new_folder` that nothing reads any more."""
    import pyarrow.fs as pafs

    fs, folder = pafs.FileSystem.from_uri(path) if ":/" in path else (pafs.LocalFileSystem(), path)
    if fs.get_file_info(folder).type != pafs.FileType.NotFound:
        fs.delete_dir(folder)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Within, a query's shuffle files go as soon as it has ended, not when the driver happens to collect its garbage, and tables are packed closer."""
    within = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": ("true", "false"), "spark.sql.parquet.compression.codec": ("zstd", "snappy")}
    before = {key: spark.conf.get(key, default) for key, (_, default) in within.items()}
    for key, (value, _) in within.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back: lineage ends in replicated storage, so that a lost
    executor costs no recomputation and partition-dependent ids stay as they are."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
