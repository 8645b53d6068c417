"""The folder that all executors share, tables written there to end lineage, broadcasts of a checked size, and bounded batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of rows that may be broadcast.
BROADCAST_BYTES = 16 << 20
#: Tables and files written to be read by later steps only, by application.
_written: dict[str, list[str]] = {}
#: Temporary folders of local sessions that name no folder, by application.
_local: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares, as ``spark.checkpoint.dir`` names it; on one machine a temporary one if it is unset."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        own = spark.sparkContext.applicationId
        if own not in _local:
            _local[own] = tempfile.mkdtemp(prefix="corvane-")
        named = _local[own]
    return named.rstrip("/")


def scratch(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing is at yet, and that ``sweep`` deletes."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def sweep(spark: SparkSession) -> int:
    """Deletes what this application has written at paths of ``scratch`` and ``cut``, when the results made of them are done with; tells how many."""
    paths = _written.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        own = spark._jvm.org.apache.hadoop.fs.Path(path)
        own.getFileSystem(spark._jsc.hadoopConfiguration()).delete(own, True)
    return len(paths)


def _bytes(field: T.StructField) -> Column:
    """About what a value takes in memory."""
    c, kind = F.col(f"`{field.name}`"), field.dataType
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(c), F.lit(0)) + 16
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, (T.NumericType, T.DateType, T.TimestampType, T.BooleanType)):
        return 8 * F.greatest(F.size(c), F.lit(0)) + 32
    if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        return F.coalesce(F.octet_length(F.to_json(F.struct(c))), F.lit(0)) + 32
    return F.lit(8)


def small(df: DataFrame, most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast when the rows of ``df``, which should be a written table or cheap, take at most ``most_bytes``.

    A larger table is returned as it is: the join then shuffles, and adaptive execution splits its skewed partitions.
    """
    size = sum((_bytes(f) for f in df.schema.fields), F.lit(32)).cast("long")
    return F.broadcast(df) if (df.agg(F.sum(size)).first()[0] or 0) <= most_bytes else df


def cut(df: DataFrame, label: str, narrow: bool = False) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and return the reread table.

    Lineage ends there, so a lost executor costs no recomputation of what
    came before, and several consumers read it without repeating the work.
    ``narrow``: for tables of numbers, dealt anew and written as two files for each
    core of the cluster rather than one for each shuffle partition.
    """
    spark = df.sparkSession
    if narrow:
        df = df.repartition(2 * spark.sparkContext.defaultParallelism)
    path = scratch(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows that Python workers are handed at once: a bound on what very long texts need, some megabytes as a rule.
BATCH_ROWS = 512
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def bound_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Lower the session's number of rows in a batch to ``rows`` if it is larger; it is read when a query is planned, so it stays lowered."""
    if not 0 < int(spark.conf.get(_BATCH)) <= rows:
        spark.conf.set(_BATCH, str(rows))


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Python workers get at most so many rows at once in what runs inside; for steps that are written at once."""
    before = spark.conf.get(_BATCH)
    bound_batches(spark, rows)
    try:
        yield
    finally:
        spark.conf.set(_BATCH, before)
