"""Adapters from raw feeds to the engine's tables: aliases, delimited and nested text, files."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Column aliases of bars, in order of preference.
BAR_ALIASES = {"d": ("d", "date", "trade_date"), "o": ("o", "open"), "h": ("h", "high"), "l": ("l", "low"), "c": ("c", "close"), "v": ("v", "volume", "vol")}


def normalize_bars(raw: DataFrame, aliases: dict[str, tuple[str, ...]] = BAR_ALIASES) -> DataFrame:
    """code, d, o, h, l, c, v from whatever names a feed uses; what is no number is null, bars without a close go."""
    have = {c.lower(): c for c in raw.columns}

    def first(names: tuple[str, ...]) -> Column:
        found = [F.col(f"`{have[n]}`") for n in names if n in have]
        return F.coalesce(*found) if found else F.lit(None)

    numbers = {k: first(v).try_cast("double") for k, v in aliases.items() if k != "d"}
    return raw.select("code", F.coalesce(F.try_to_date(first(aliases["d"]).cast("string"), "yyyyMMdd"), first(aliases["d"]).try_cast("date")).alias("d"), *(c.alias(k) for k, c in numbers.items())).where("c is not null")


def split_quotes(lines: DataFrame, separator: str, least: int, fields: dict[str, int], column: str = "value") -> DataFrame:
    """Positional fields of delimited lines with at least `least` parts; numbers by try_cast in the caller."""
    parts = F.split(F.col(column), separator)
    return lines.withColumn("_p", parts).where(F.size("_p") >= least).select(*(F.get("_p", F.lit(k)).alias(n) for n, k in fields.items()))


def quoted_records(lines: DataFrame, column: str = "value") -> DataFrame:
    """(name, body) of lines like v_name="body"."""
    pattern = r'v_(\w+)="(.+)"'
    return lines.select(F.regexp_extract(column, pattern, 1).alias("name"), F.regexp_extract(column, pattern, 2).alias("body")).where("name <> ''")


def blank_to_null(c: Column) -> Column:
    """Null for what feeds write when they have no value."""
    return F.when(~F.trim(c).isin("", "-", "None", "0", "0.00"), c)


def array_bars(lines: DataFrame, column: str = "value") -> DataFrame:
    """(d, o, h, l, c, v) of JSON arrays [date, open, close, high, low, volume]."""
    rows = lines.select(F.explode(F.from_json(column, "array<array<string>>")).alias("a")).where(F.size("a") >= 6)
    at = lambda k: F.get("a", F.lit(k)).try_cast("double")
    return rows.select(F.get("a", F.lit(0)).try_cast("date").alias("d"), at(1).alias("o"), at(3).alias("h"), at(4).alias("l"), at(2).alias("c"), at(5).alias("v"))


def code_universe(spark: SparkSession, ranges: tuple[tuple[int, int], ...]) -> DataFrame:
    """All zero-padded codes of fixed number ranges."""
    out = None
    for low, high in ranges:
        part = spark.range(low, high + 1).select(F.lpad(F.col("id").cast("string"), 6, "0").alias("code"))
        out = part if out is None else out.unionByName(part)
    return out


def write_snapshot(df: DataFrame, path: str, by: str | None = None, kind: str = "parquet") -> None:
    """An idempotent dated snapshot; with `by` only the partitions in df are replaced."""
    w = df.write.format(kind).mode("overwrite")
    if by:
        w = w.partitionBy(by).option("partitionOverwriteMode", "dynamic")
    w.save(path)


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share (spark.checkpoint.dir); a local one only for a local master."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "/tmp/checkpoints"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _forget(spark: SparkSession, path: str) -> None:
    try:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    except Exception:  # the session may have ended first; the folder is then the cluster's to clean
        pass


def stored(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read back: what is read several times, or after rounds, is computed once.

    The files go when the driver's process ends.
    """
    path = shared_path(df.sparkSession, "stored")
    df.write.parquet(path)
    atexit.register(_forget, df.sparkSession, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of a task that sorts series; partitions grow with the table, so a task's memory doesn't.
TASK_ROWS = 250_000


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """df dealt out by the keys to as many tasks as `rows` rows need."""
    return df.repartition(max(1, -(-rows // TASK_ROWS)), *keys)


def drop_partitions(spark: SparkSession, path: str, by: str, before: str) -> list[str]:
    """Delete the partitions of a dated store whose value is less than `before`; their values. The names alone are read."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    gone = []
    for folder in files.listStatus(root):
        key, _, value = folder.getPath().getName().partition("=")
        if key == by and value < before:
            files.delete(folder.getPath(), True)
            gone.append(value)
    return sorted(gone)


def fresh(stored: DataFrame, now: Column, hours: float, at: str = "stored_at") -> DataFrame:
    """Rows not older than so many hours."""
    return stored.where(F.col(at) >= now - F.make_dt_interval(hours=F.lit(int(hours))))


def last_n_per_code(bars: DataFrame, n: int, least: int) -> DataFrame:
    """(code, bars): the last n bars of each code with at least `least` of them, in date order."""
    by = Window.partitionBy("code")
    x = bars.select("code", "d", "c", F.row_number().over(by.orderBy(F.desc("d"))).alias("_n"), F.count("*").over(by).alias("_k"))
    x = x.where((F.col("_n") <= n) & (F.col("_k") >= least))
    return x.groupBy("code").agg(F.array_sort(F.collect_list(F.struct("d", "c"))).alias("bars"))
