"""Readers and sinks. Every path is an argument; no sink writes where its plan reads."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence
from datetime import date

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clientele.functions.dates import yyyymm
from clientele.operators.kmeans import Clusters

MART_PARTS = ("transaction", "demographic", "first_last_transaction")


def read_table(spark: SparkSession, ref: str) -> DataFrame:
    """A Parquet path (anything with a slash) or a catalog table name."""
    return spark.read.parquet(ref) if "/" in ref else spark.table(ref)


def read_sources(spark: SparkSession, refs: Mapping[str, str]) -> dict[str, DataFrame]:
    return {role: read_table(spark, ref) for role, ref in refs.items()}


# -- sales mart -------------------------------------------------------------------

# A mart is a folder of its own for each write, and one small table beside them names the one to read. It is
# appended to when all parts are written, so a write that fails, or is going on, is seen by nobody.

def _pointer(base: str, suffix: str) -> str:
    return f"{base.rstrip('/')}/visible{suffix}.parquet"


def new_version(base: str) -> str:
    """The folder of a mart that nobody sees yet."""
    return f"{base.rstrip('/')}/version={uuid.uuid4().hex}"


def visible_version(spark: SparkSession, base: str, suffix: str = "") -> str:
    """The folder of the mart written last."""
    latest = spark.read.parquet(_pointer(base, suffix)).agg(F.max(F.struct("number", "folder")).alias("last")).first()["last"]
    return f"{base.rstrip('/')}/{latest['folder']}"


def publish(spark: SparkSession, version: str, base: str, suffix: str = "") -> None:
    """Make a version the one to read; the versions before stay for those who read them."""
    try:
        number = spark.read.parquet(_pointer(base, suffix)).agg(F.max("number")).first()[0] + 1
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        number = 1
    row = [(number, version.rstrip("/").rsplit("/", 1)[1])]
    spark.createDataFrame(row, "number long, folder string").coalesce(1).write.mode("append").parquet(_pointer(base, suffix))


def write_part(df: DataFrame, version: str, name: str) -> None:
    """A part of a mart; transactions by month, so dated reads skip files, and months of uneven size are split."""
    if name == "transaction":
        (df.withColumn("order_month", yyyymm(F.col("order_date"))).hint("rebalance", "order_month")
         .write.mode("errorifexists").partitionBy("order_month").parquet(f"{version}/{name}.parquet"))
    else:
        df.write.mode("errorifexists").parquet(f"{version}/{name}.parquet")


def read_part(spark: SparkSession, version: str, name: str, window: tuple[date, date] | None = None) -> DataFrame:
    part = spark.read.parquet(f"{version}/{name}.parquet")
    if name != "transaction":
        return part
    if window is not None:
        first, last = window
        month = F.col("order_month").cast("string")
        part = part.filter(month.between(f"{first:%Y%m}", f"{last:%Y%m}") & F.col("order_date").between(F.lit(first), F.lit(last)))
    return part.drop("order_month")


def write_transactions(tx: DataFrame, base: str, suffix: str = "") -> None:
    """A mart of transactions alone."""
    version = new_version(base)
    write_part(tx, version, "transaction")
    publish(tx.sparkSession, version, base, suffix)


def read_transactions(spark: SparkSession, base: str, suffix: str = "",
                      window: tuple[date, date] | None = None) -> DataFrame:
    return read_part(spark, visible_version(spark, base, suffix), "transaction", window)


def read_mart(spark: SparkSession, base: str, suffix: str = "",
              window: tuple[date, date] | None = None) -> dict[str, DataFrame]:
    """All parts of one version; ``window`` limits the months of the transactions that are read."""
    version = visible_version(spark, base, suffix)
    return {name: read_part(spark, version, name, window) for name in MART_PARTS}


# -- segments ---------------------------------------------------------------------

def segment_path(base: str, name: str, brand: str, region: str | None, as_of: date,
                 version: int) -> str:
    return (f"{base.rstrip('/')}/{name}/brand={brand}/region={region or 'all'}"
            f"/as_of={as_of:%Y-%m-%d}/version={version}")


def write_segments(df: DataFrame, base: str, name: str, brand: str, region: str | None,
                   as_of: date, version: int = 1) -> str:
    """A new version per write: an input path is never overwritten by its own plan."""
    path = segment_path(base, name, brand, region, as_of, version)
    df.write.mode("errorifexists").parquet(path)
    return path


def read_segments(spark: SparkSession, base: str, name: str, brand: str, region: str | None,
                  as_of: date, version: int = 1) -> DataFrame:
    return spark.read.parquet(segment_path(base, name, brand, region, as_of, version))


# -- features, personas, contacts ---------------------------------------------------

def write_features(df: DataFrame, base: str, name: str) -> None:
    df.write.mode("overwrite").parquet(f"{base.rstrip('/')}/features/{name}.parquet")


def read_features(spark: SparkSession, base: str, names: Sequence[str]) -> list[DataFrame]:
    """In the order asked for, so column order never depends on a directory listing."""
    return [spark.read.parquet(f"{base.rstrip('/')}/features/{n}.parquet") for n in names]


def write_personas(df: DataFrame, path: str) -> None:
    df.select("vip_main_no", F.col("persona").cast("int").alias("persona")).write.parquet(path)


def save_model(model: Clusters, scaler: DataFrame, cols: Sequence[str], base: str,
               dropped: Sequence[str] = ()) -> None:
    """Clusters, scale, and the names of the features in the order of the centres' coordinates."""
    base, spark = base.rstrip("/"), scaler.sparkSession
    rows = [(i, [float(x) for x in c], model.cost) for i, c in enumerate(model.centres)]
    spark.createDataFrame(rows, "persona int, centre array<double>, cost double").coalesce(1).write.parquet(f"{base}/clusters")
    scaler.write.parquet(f"{base}/scaler")
    names = [(i, c, True) for i, c in enumerate(cols)] + [(i, c, False) for i, c in enumerate(dropped)]
    spark.createDataFrame(names, "place int, feature string, used boolean").coalesce(1).write.parquet(f"{base}/features")


def load_model(spark: SparkSession, base: str) -> tuple[Clusters, DataFrame, list[str], list[str]]:
    """Clusters, scale, ordered features and dropped features; refuses parts that do not fit."""
    base = base.rstrip("/")
    clusters = sorted(spark.read.parquet(f"{base}/clusters").collect(), key=lambda r: r["persona"])
    scaler = spark.read.parquet(f"{base}/scaler")
    rows = sorted(spark.read.parquet(f"{base}/features").collect(), key=lambda r: r["place"])
    cols = [r["feature"] for r in rows if r["used"]]
    centres = np.array([r["centre"] for r in clusters])
    if centres.ndim != 2 or centres.shape[1] != len(cols) or not set(cols) <= set(scaler.columns):
        raise ValueError("the stored features do not fit the stored model and scale")
    return Clusters(centres, clusters[0]["cost"], 0, True), scaler, cols, [r["feature"] for r in rows if not r["used"]]


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)
