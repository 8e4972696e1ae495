"""Helpers that the corpus operators share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Word of the counting and fingerprint contracts: a run without ASCII white space.
WORD = "[^\\x20\\x09-\\x0D]+"


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Make ``checkpoint()`` usable.

    The cluster's ``spark.checkpoint.dir`` is used. Where it is unset a temporary folder takes its place if all
    tasks run on this machine (tests, a laptop); on a cluster, whose executors would not share it, that is an error.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-checkpoint-"))


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder, so that lost executors cost no recomputation."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


#: Rows of a small table that one task reads, and the least number of tasks.
ROWS_OF_TASK, LEAST_TASKS = 20_000, 4


def cut_small(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared checkpoint folder, read in no more tasks than its rows need.

    What is left of many partitions is often little. A checkpoint keeps the plan's estimate of its size, which every join
    multiplies, so in loops of joins it grows without bound and planning never ends; a table has the size of its files.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/table-{uuid.uuid4()}"
    df.write.parquet(path)
    written = spark.read.schema(df.schema).parquet(path)
    return written.coalesce(max(LEAST_TASKS, -(-written.count() // ROWS_OF_TASK)))


def _bytes(size: str) -> int:
    """The bytes of a size as Spark's settings have it, such as 64m or 4MB; a bare number counts bytes."""
    number, unit = re.fullmatch(r"\s*(-?\d+)\s*([a-z]*)\s*", size.lower()).groups()
    return int(number) << 10 * " kmgtp".index(unit.rstrip("ib") or " ")


def bounded_batches(df: DataFrame) -> DataFrame:
    """``df``, in a session that sends Python workers at most 1,024 rows and 4 MB at once.

    Spark's default of 64 MB multiplies in a worker (decoded texts, results), whatever the executor has. These are
    settings of the session, so they hold for its later queries too; smaller ones of the session's own are left.
    """
    conf = df.sparkSession.conf
    rows, size = (f"spark.sql.execution.arrow.{name}" for name in ("maxRecordsPerBatch", "maxBytesPerBatch"))
    if not 0 < int(conf.get(rows)) <= 1024:
        conf.set(rows, "1024")
    if not 0 < _bytes(conf.get(size)) <= 4 << 20:
        conf.set(size, "4m")
    return df


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have yet, compared without case as Spark does."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def held_out(id_column: Column, modulus: int, remainder: int) -> Column:
    """True where crc32 of the id's decimal text leaves ``remainder``; a null id is never held out."""
    return F.coalesce(F.crc32(id_column.cast("string")) % modulus == remainder, F.lit(False))


def pieces(column: pa.Array, rows: int = 256) -> Iterator[list]:
    """The values of an Arrow column in short lists, so that a batch of long texts is not held twice."""
    for start in range(0, len(column), rows):
        yield column.slice(start, rows).to_pylist()
