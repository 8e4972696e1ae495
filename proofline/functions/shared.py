"""Rows that several steps of a plan read are written once, to the folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``.

    Where it is unset a temporary one takes its place if all tasks run on this machine; on a cluster that is an error.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return context.getCheckpointDir()


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new name for a folder that all executors share."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4()}"


def written(df: DataFrame) -> DataFrame:
    """``df`` as a checkpoint, so that its plan is neither run again nor lost with an executor."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def _bytes(size: str) -> int:
    """The bytes of a size as Spark's settings have it, such as 64m or 4MB; a bare number counts bytes."""
    number, unit = re.fullmatch(r"\s*(-?\d+)\s*([a-z]*)\s*", size.lower()).groups()
    return int(number) << 10 * " kmgtp".index(unit.rstrip("ib") or " ")


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, in a session that sends Python workers at most 256 rows and 2 MB at once; smaller settings of the session are left.

    A worker holds a batch several times over (as Arrow, as Python objects, as results), so what it needs must not grow with
    the rows of a task. The settings hold for later queries of the session too.
    """
    conf = df.sparkSession.conf
    rows, size = (f"spark.sql.execution.arrow.{name}" for name in ("maxRecordsPerBatch", "maxBytesPerBatch"))
    if not 0 < int(conf.get(rows)) <= 256:
        conf.set(rows, "256")
    if not 0 < _bytes(conf.get(size)) <= 2 << 20:
        conf.set(size, "2m")
    return df
