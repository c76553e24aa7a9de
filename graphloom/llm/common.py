"""Shared pieces: shared scratch tables, ranks without a single hot task, tables by path."""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.operators.skew import HOT, join_hot

__all__ = ["HOT", "WS", "arrow_rows", "discard", "join_hot", "salted_rank", "scratch_dir", "scratch_path", "staged", "table"]

#: ASCII white space, as the word rules of these operators use it.
WS = r"[\x20\x09-\x0D]+"


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; where none is named, one is set if driver and executors are one process, else this raises."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise RuntimeError("name a folder that driver and executors share in spark.checkpoint.dir")
        named = "file://" + tempfile.mkdtemp(prefix="graphloom-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):
        jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(jpath, True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when the driver ends."""
    path = f"{scratch_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back, which cuts its lineage.

    The table survives lost executors, and its file sizes let the optimizer
    decide about broadcasts from what is there.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Remove a staged table that nothing reads any more."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        _remove(df.sparkSession, path)


@contextlib.contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of at most ``rows`` rows for what is run inside, so that a worker holds few texts at once."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def salted_rank(df: DataFrame, keys: list[str], order: list[str], out: str, rows: int, per_task: int = 20_000) -> DataFrame:
    """Add ``out``: a gapless rank from 0 within ``keys``, without a task per key.

    Rows of a key are dealt over salts by a hash of ``order``; each salt is
    ranked by itself and shifted by the counts of the salts before it. The
    counts table has one row per key and salt, so a key that holds a third of
    all rows is ranked by many tasks. ``rows`` is the number of rows of ``df``
    (an upper estimate will do): about ``per_task`` rows share a salt, of which
    there are 64 at least.
    """
    salts = max(64, -(-rows // per_task))
    salt, within, shift = "__gl_salt", "__gl_within", "__gl_shift"
    dealt = df.withColumn(salt, F.pmod(F.xxhash64(*order), F.lit(salts)).cast("int"))
    counts = dealt.groupBy(*keys, salt).agg(F.count(F.lit(1)).alias("__gl_n"))
    before = Window.partitionBy(*keys).orderBy(salt).rowsBetween(Window.unboundedPreceding, -1)
    shifts = counts.select(*keys, salt, F.coalesce(F.sum("__gl_n").over(before), F.lit(0)).alias(shift))
    ranked = dealt.withColumn(within, F.row_number().over(Window.partitionBy(*keys, salt).orderBy(*order)))
    return ranked.join(shifts, [*keys, salt]).withColumn(out, (F.col(within) + F.col(shift) - 1).cast("long")).drop(salt, within, shift)
