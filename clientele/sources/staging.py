"""Intermediate results kept as Parquet in the folder the cluster shares."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from functools import wraps

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_OWNED: ContextVar[list[str] | None] = ContextVar("owned", default=None)


def staging_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``: a folder that driver and executors share."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    return folder.rstrip("/")


def staged_counted(df: DataFrame) -> tuple[DataFrame, int]:
    """Compute once, cut the lineage, read back columns as needed; and the row count.

    A table rather than a row checkpoint, so later reads prune columns and the
    planner knows the true size. Survives the loss of any executor. The rows are
    counted while they are written; recomputed tasks may count twice, so the number
    is an upper bound.
    """
    path = f"{staging_folder(df.sparkSession)}/staged/{uuid.uuid4().hex}"
    if (owned := _OWNED.get()) is not None:
        owned.append(path)
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("rows")).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), seen.get["rows"]


def staged(df: DataFrame) -> DataFrame:
    """``staged_counted`` without the count."""
    return staged_counted(df)[0]


@contextmanager
def job_scope(spark: SparkSession) -> Iterator[None]:
    """What is staged inside belongs to the job and goes when it ends, well or not.

    Nothing that leaves the scope may read it any more, so a job writes its results inside. An inner scope owns
    what is staged in it. Without a scope staged tables stay until their folder is cleaned.
    """
    owned: list[str] = []
    token = _OWNED.set(owned)
    try:
        yield
    finally:
        _OWNED.reset(token)
        conf = spark._jsc.hadoopConfiguration()
        for path in owned:
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(conf).delete(place, True)


def job(run: Callable) -> Callable:
    """A function whose first argument is the session, as a job that releases what it staged."""
    @wraps(run)
    def scoped(spark: SparkSession, *args, **options):
        with job_scope(spark):
            return run(spark, *args, **options)
    return scoped
