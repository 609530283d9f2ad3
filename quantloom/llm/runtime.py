"""What all operators share: bounded Arrow batches, shared-folder tables, clash-free output columns."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path
from urllib.parse import urlparse

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: Most rows and bytes of an Arrow batch; a batch holds one row at least, however long.
BATCH_ROWS, BATCH_BYTES = 256, 32 << 20
#: Used where the session names no shared folder, as in local tests.
LOCAL_CHECKPOINTS = "/tmp/checkpoints"

#: Spark's setting that deletes the shuffle files of a query at its end.
SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_shipped: set[str] = set()


def ship_code(spark: SparkSession) -> None:
    """Give this package to the executors, which may not have it installed; once for each application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    _shipped.add(app)
    package = Path(__file__).resolve().parents[1]
    folder = tempfile.mkdtemp(prefix="quantloom-code-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    with zipfile.ZipFile(f"{folder}/{package.name}.zip", "w") as z:
        for p in sorted(package.rglob("*.py")):
            z.write(p, p.relative_to(package.parent))
    spark.sparkContext.addPyFile(f"{folder}/{package.name}.zip")


def small_batches(spark: SparkSession) -> None:
    """Prepare for Arrow functions: ship the code, and bound a batch's rows and bytes, so that long texts don't fill a worker.

    The session's settings are lowered for good, since Spark reads them when a plan runs, not when it is built.
    """
    ship_code(spark)
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{name}"
        now = spark.conf.get(key, None)
        if now is None or not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


def shared_folder(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, which all executors see; a local one only for a local master."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = LOCAL_CHECKPOINTS
    return f"{base.rstrip('/')}/quantloom-{uuid.uuid4().hex}"


def _forget(spark: SparkSession, path: str) -> None:
    try:
        if urlparse(path).scheme in ("", "file"):
            shutil.rmtree(urlparse(path).path, ignore_errors=True)
        else:
            hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)
    except Exception:  # the session may be gone at exit; the folder is then the cluster's to clean
        pass


def materialize(df: DataFrame) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back.

    Cuts the lineage and survives the loss of any executor; the files go by release(), or when the driver's process ends.
    Its exchanges' files go once the table is written, not when the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    path = shared_folder(spark)
    schema = df.schema
    was = spark.conf.get(SHUFFLES_GO, "false")
    spark.conf.set(SHUFFLES_GO, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(SHUFFLES_GO, was)
    atexit.register(_forget, spark, path)
    _tables.append(path)
    return spark.read.schema(schema).parquet(path)


#: Tables of this process that are not released.
_tables: list[str] = []


def tables() -> int:
    """How many tables there are: a mark for release()."""
    return len(_tables)


def release(spark: SparkSession, mark: int, keep: int = 0) -> None:
    """Delete the tables written since the mark, but the last `keep` of them; nothing may read the others any more."""
    last = len(_tables) - keep
    for path in _tables[mark:last]:
        _forget(spark, path)
    del _tables[mark:last]


def without(df: DataFrame, *names: str) -> DataFrame:
    """df less the columns (in any case) that an operator is about to add: the operator's win."""
    taken = {n.lower() for n in names}
    return df.select(*[df[f"`{c}`"] for c in df.columns if c.lower() not in taken])


def with_text_last(df: DataFrame, text: str) -> DataFrame:
    """df and, as a last column whose name is longer than all others, its text as a string: for operators that keep all columns."""
    return df.select("*", df[f"`{text}`"].cast("string").alias("_" * (1 + max(map(len, df.columns)))))


def extended(schema: T.StructType, *fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([*schema.fields, *[T.StructField(n, t) for n, t in fields]])


def texts(batch: pa.RecordBatch, column: str) -> list[bytes | None]:
    """The column's values as UTF-8 bytes."""
    values = batch.column(batch.schema.get_field_index(column))
    return values.cast(pa.large_binary() if pa.types.is_large_string(values.type) else pa.binary()).to_pylist()


def with_columns(batch: pa.RecordBatch, **columns: pa.Array) -> pa.RecordBatch:
    """batch with columns replaced or added at its end."""
    names, arrays = list(batch.schema.names), list(batch.columns)
    for name, array in columns.items():
        if name in names:
            arrays[names.index(name)] = array
        else:
            names.append(name)
            arrays.append(array)
    return pa.RecordBatch.from_arrays(arrays, names=names)
