"""Scans and sinks: Parquet first, CSV and JSON as fallbacks; base copies, stages, listings, previews."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.functions import periods


def read_table(spark: SparkSession, folder: str, name: str, limit: int = -1) -> DataFrame:
    """NAME.parquet, else NAME.csv, else NAME.json in folder."""
    readers = (("parquet", lambda p: spark.read.parquet(p)), ("csv", lambda p: spark.read.option("header", True).csv(p)), ("json", lambda p: spark.read.json(p)))
    for form, read in readers:
        try:
            df = read(f"{folder}/{name}.{form}")
        except AnalysisException as e:
            if "PATH_NOT_FOUND" in str(e) or "does not exist" in str(e):
                continue
            raise
        return df.limit(limit) if limit >= 0 else df
    raise FileNotFoundError(f"no {name}.parquet, .csv or .json in {folder}")


def readable(spark: SparkSession, folder: str, name: str) -> str:
    """"absent", "empty" or "ok": a table that is there but can't be read raises."""
    try:
        return "empty" if read_table(spark, folder, name, 1).isEmpty() else "ok"
    except FileNotFoundError:
        return "absent"


def write_parquet(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Write df; what Parquet has no type for (void) is written as text."""
    df.select(*[F.col(f"`{f.name}`").cast("string").alias(f.name) if isinstance(f.dataType, T.NullType) else F.col(f"`{f.name}`") for f in df.schema.fields]).write.mode(mode).parquet(path)


def write_records(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One JSON object a line."""
    df.write.mode(mode).option("ignoreNullFields", False).json(path)


def save_managed(df: DataFrame, name: str, mode: str = "errorifexists", bucket_by: Sequence[str] = (), buckets: int = 0) -> None:
    """A catalog table; bucketed and sorted by keys if later joins should meet without a shuffle."""
    writer = df.write.mode(mode).format("parquet")
    if bucket_by and buckets:
        writer = writer.bucketBy(buckets, *bucket_by).sortBy(*bucket_by)
    writer.saveAsTable(name)


def base_copy(df: DataFrame, path: str) -> DataFrame:
    """The immutable base of a run: written once, an existing one is never touched."""
    try:
        return df.sparkSession.read.parquet(path)
    except AnalysisException:
        df.write.parquet(path)
        return df.sparkSession.read.schema(df.schema).parquet(path)


def stage(df: DataFrame, steps: Sequence[Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """The table after steps, as one lazy plan."""
    return reduce(lambda d, step: step(d), steps, df)


def current(spark: SparkSession, copies: Sequence[str], original: str) -> tuple[str, bool]:
    """The newest working copy that exists among catalog names, else the original; and whether it is a copy."""
    for name in reversed(copies):
        if spark.catalog.tableExists(name):
            return name, True
    return original, False


def listing(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """table, column, type and position of every column of the given tables, from their metadata alone."""
    rows = [(name, f.name, f.dataType.simpleString(), i) for name, path in paths.items() for i, f in enumerate(spark.read.parquet(path).schema.fields)]
    return spark.createDataFrame(rows, "table string, column string, type string, position int")


def preview(df: DataFrame, order: Sequence[str], period: str | None = None, rows: int = 10) -> DataFrame:
    """The first rows, or those of every period in time order, with the period's size as ``period_rows``; null periods are a group of their own."""
    if period is None:
        return df.orderBy(*order).limit(rows)
    form = periods.decide(df, period)
    month: Column = periods.month_index(df, period, form) if form else F.lit(0)
    sizes = df.groupBy(F.col(period).alias("__p")).agg(F.count(F.lit(1)).alias("period_rows"))
    first = df.withColumn("__month", month).withColumn("__rank", F.row_number().over(Window.partitionBy(period).orderBy(*order))).where(F.col("__rank") <= rows)
    return first.join(F.broadcast(sizes), F.col(period).eqNullSafe(F.col("__p"))).orderBy(F.col("__month").asc_nulls_last(), F.col(period).asc_nulls_last(), "__rank").drop("__p", "__month", "__rank")
