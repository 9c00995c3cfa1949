"""Incremental ingestion of new documents: a file stream, each content once, appended in micro-batches.

The reference has no streaming; this is its document-wise ingestion with a status, as a stream.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import content_id
from ..operators.units import line_units


def document_stream(spark: SparkSession, folder: str, schema: str, late: str = "1 day", files: int = 100) -> DataFrame:
    """Documents of new Parquet files with content_id, each content once while its first copy is within ``late`` of the newest created_at."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)
    rows = rows.filter("text IS NOT NULL").withColumn("created_at", F.col("created_at").cast("timestamp")).withColumn("content_id", content_id(F.col("text")))
    return rows.withWatermark("created_at", late).dropDuplicatesWithinWatermark(["content_id"])


def ingest(stream: DataFrame, units_path: str, status_path: str, checkpoint: str, process: Callable[[DataFrame], DataFrame] = line_units) -> StreamingQuery:
    """Appends the units of each micro-batch, and a COMPLETED or FAILED status row a document.

    A batch number names its folder, so a batch that is run again after a failure replaces what it had written.
    """

    def batch(rows: DataFrame, number: int) -> None:
        now = rows.select(F.col("doc_id"), F.current_timestamp().alias("at"))
        try:
            process(rows).write.mode("overwrite").parquet(f"{units_path}/batch={number}")
            now.withColumn("status", F.lit("COMPLETED")).write.mode("overwrite").parquet(f"{status_path}/batch={number}")
        except Exception:
            now.withColumn("status", F.lit("FAILED")).write.mode("overwrite").parquet(f"{status_path}/batch={number}")
            raise

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
