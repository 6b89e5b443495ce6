"""Session helpers shared by every operator: lineage cuts, bounded lookups."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []


def checkpoint_root(spark: SparkSession) -> str:
    """Folder for lineage cuts: the cluster's ``spark.checkpoint.dir``.

    Where that is unset a folder of our own is set, in local mode only: executors
    on other machines could not read it.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir")
    current = sc._jsc.sc().getCheckpointDir()
    if named:
        if not current.isDefined():
            sc.setCheckpointDir(named)
        return named
    if current.isDefined():
        return current.get()
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="brinewell-"))
    return sc._jsc.sc().getCheckpointDir().get()


def cut_lineage(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder and read back; survives lost executors."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)


def spill_table(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a compressed Parquet table in the shared folder (smaller than a checkpoint).

    Later plans read it, so it stays until :func:`drop_spilled` or the end of the session.
    """
    spark = df.sparkSession
    path = f"{checkpoint_root(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    if not _written:
        atexit.register(drop_spilled)
    _written.append((spark, path))
    return spark.read.parquet(path)


def drop_spilled() -> None:
    """Delete every spilled table; call it once the results that were built on them are written."""
    while _written:
        spark, path = _written.pop()
        try:
            jvm = spark.sparkContext._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # the session has ended: the folder's owner clears it
            return


class TooLarge(ValueError):
    """A side that was to be held by every task is over its stated bound."""


def bounded_rows(df: DataFrame, limit: int, what: str) -> list:
    """All rows of a small table, or :class:`TooLarge`; never a silent sample."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise TooLarge(f"{what}: more than {limit} rows; use the distributed path")
    return rows
