"""Tables that cut lineage: Parquet in the folder that the whole cluster shares.

A staged table survives the loss of any executor, and each later job reads only the columns it needs.
"""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Only a local session without one gets a folder of its own."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="kinweave-")
        sc.setCheckpointDir(found)
        found = sc.getCheckpointDir()
    return f"{found.rstrip('/')}/kinweave/{sc.applicationId}"


def _on_fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


_staged: list[list[str]] = []


@contextmanager
def temporary(spark: SparkSession, keep: Callable[[], str]) -> Iterator[None]:
    """Drops the tables staged inside when it ends, but for the one whose path `keep` then gives."""
    _staged.append([])
    try:
        yield
    finally:
        inner = _staged.pop()
        kept = keep()
        for path in inner:
            if path != kept:
                drop_staged(spark, path)
        if _staged and kept in inner:
            _staged[-1].append(kept)


def stage(df: DataFrame, name: str, compression: str = "zstd", dictionary: bool = True) -> tuple[DataFrame, str]:
    """Write `df` to the shared folder; return the table read back and its path. It goes when the session ends.

    Without a dictionary for columns whose values hardly repeat.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.option("compression", compression).option("parquet.enable.dictionary", dictionary).parquet(path)
    fs, p = _on_fs(spark, path)
    fs.deleteOnExit(p)
    if _staged:
        _staged[-1].append(path)
    return spark.read.schema(df.schema).parquet(path), path


def release(spark: SparkSession) -> None:
    """Let the driver free what finished steps held: memory of their plans, and with it the shuffle files that only they read."""
    gc.collect()
    spark._jvm.System.gc()


def drop_staged(spark: SparkSession, path: str) -> None:
    """Delete a staged table that no later step reads."""
    fs, p = _on_fs(spark, path)
    fs.delete(p, True)
