"""Ingest of new documents as they arrive (an extension): each batch is shredded and appended to a node table, one state-free pass."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..sources.xml import nodes


def ingest(spark: SparkSession, source: str, target: str, checkpoint: str):
    """Start a query that appends the nodes of every new file under source to the Parquet table target."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").load(source)
    rows = nodes(files.select(F.col("path").alias("doc_id"), "content"))
    return rows.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
