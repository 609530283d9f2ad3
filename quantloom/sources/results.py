"""Stores of results that grow from run to run: partitions by date, replaced whole and only where something is missing."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .feeds import stored, write_snapshot


def exists(spark: SparkSession, path: str) -> bool:
    """Whether the store has any partition, on whatever file system it is."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    return files.exists(folder) and any(f.isDirectory() for f in files.listStatus(folder))


def open_dates(spark: SparkSession, path: str, dates: DataFrame, horizons: Iterable[int]) -> DataFrame:
    """The distinct dates (d) for which the store lacks one of the horizons; all of them without a store.  Null dates don't count."""
    wanted = sorted(set(horizons))
    days = dates.where("d is not null").select("d").distinct()
    if not exists(spark, path):
        return days
    have = spark.read.parquet(path).where(F.col("horizon").isin(wanted)).groupBy("d").agg(F.countDistinct("horizon").alias("n"))
    return days.join(have.where(F.col("n") == len(wanted)), "d", "left_anti")


def update_results(spark: SparkSession, path: str, dates: DataFrame, horizons: tuple[int, ...], evaluate: Callable[[DataFrame, tuple[int, ...]], DataFrame]) -> int:
    """Evaluate the dates that lack a horizon and store what comes out; how many dates were evaluated.

    evaluate(dates, horizons) gives rows with d, a date, and horizon for all horizons of these dates.  A date's partition is
    replaced whole, all others keep their files; a run that is cut off leaves the store as it was, and the next one does the
    rest.  A date for which evaluate gives nothing is tried again by the next run; a row whose return is not known yet counts
    as evaluated, as does its horizon.
    """
    todo = stored(open_dates(spark, path, dates, horizons))
    n = todo.count()
    if n:
        rows = stored(evaluate(todo, tuple(sorted(set(horizons)))))
        if not rows.isEmpty():
            write_snapshot(rows.repartition("d"), path, by="d")
    return n


def day_result(spark: SparkSession, path: str, day: str, compute: Callable[[], DataFrame], again: bool = False) -> DataFrame:
    """The day's result from the store, or computed and stored in the day's partition if it isn't there or is wanted again.

    The result has no column day of its own; other days keep their files.
    """
    def own() -> DataFrame | None:
        if not exists(spark, path):
            return None
        rows = spark.read.option("basePath", path).parquet(path).where(F.col("day").cast("string") == day).drop("day")
        return None if rows.isEmpty() else rows

    if not again and (rows := own()) is not None:
        return rows
    fresh = compute()
    write_snapshot(fresh.withColumn("day", F.lit(day)), path, by="day")
    return fresh.sparkSession.read.schema(fresh.schema).parquet(f"{path}/day={day}")
