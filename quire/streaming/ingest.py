"""Documents read as they arrive, with the tables of ``quire.operators.documents``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from quire.sources import documents


def ingest(spark: SparkSession, path: str, table: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, *, pattern: str | None = None) -> StreamingQuery:
    """Appends ``table`` of all files not yet seen to Parquet at ``out``, each file once, then ends."""
    rows = table(documents.stream(spark, path, pattern=pattern))
    return rows.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start(out)
