"""What the operators share: scratch tables in the shared folder and size-checked broadcasts."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

from quire.operators import shared

BATCH_KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"
BATCH_ROWS = 2000
BYTES_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Bounds Arrow batches by rows and by bytes: two workers share an executor's memory, and texts may be very long.

    Plans read these settings when they run, which is after the operator returns, so they
    stay set in the session; smaller bounds that are set already are kept.
    """
    if int(spark.conf.get(BATCH_KEY)) > BATCH_ROWS:
        spark.conf.set(BATCH_KEY, str(BATCH_ROWS))
    if not 0 < int(spark.conf.get(BYTES_KEY, str(1 << 30)).rstrip("b")) <= BATCH_BYTES:
        spark.conf.set(BYTES_KEY, str(BATCH_BYTES))


class Scratch(shared.Scratch):
    """Tables in the shared folder (``quire.operators.shared``), for steps that work on texts."""

    def __init__(self, spark: SparkSession, name: str):
        small_batches(spark)
        super().__init__(spark, name)


def broadcast_if_small(df: DataFrame, max_rows: int) -> DataFrame:
    """Hint a broadcast only if ``df``, which must be materialised, has at most ``max_rows`` rows.

    Beyond that the join is left to Spark, which shuffles and splits skewed keys.
    """
    seen = df.limit(max_rows + 1).count()
    return F.broadcast(df) if seen <= max_rows else df


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column of ``df`` has it (in any case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def own_columns(df: DataFrame) -> list:
    """The columns of ``df`` by quoted name, so that dots and spaces in names do not matter."""
    return [F.col(f"`{c.replace('`', '``')}`") for c in df.columns]


def without(df: DataFrame, name: str) -> DataFrame:
    """``df`` without a column of that name in any case: results replace such a column."""
    return df.drop(*[c for c in df.columns if c.lower() == name.lower()])


def with_text_result(df: DataFrame, text_col: str, name: str, kind: str, judge: Callable[[pa.Array], pa.Array]) -> DataFrame:
    """``df`` with column ``name`` of SQL type ``kind``, which ``judge`` makes of the texts, batch by batch.

    Columns go through Arrow under names of their own, so theirs may be anything; a
    column called ``name`` is replaced.
    """
    df = without(df, name)
    names = df.columns
    at = [c.lower() for c in names].index(text_col.lower())
    plain = df.toDF(*[f"c{k}" for k in range(len(names))])

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, judge(batch.column(at).cast(pa.string()))], [*batch.schema.names, "result"])

    out = plain.mapInArrow(run, StructType([*plain.schema.fields]).add("result", _parse_datatype_string(kind)))
    return out.toDF(*names, name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of finished steps now: it does so once the driver's heap lets go of them.

    Called between steps that take minutes, never within one.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def give_back() -> None:
    """At the end of a task that held much: lets the worker, which lives on, return free memory to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)
