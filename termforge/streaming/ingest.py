"""New corpus shards as a stream: stateless document features, appended to tables batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from termforge.operators.document_features import text_features
from termforge.operators.index import indexable
from termforge.sources.files import CORPUS_SCHEMA


def corpus_stream(spark: SparkSession, folder: str, files_per_batch: int = 16) -> DataFrame:
    """``doc_id, title, body`` of JSON-lines files as they arrive in a folder."""
    rows = spark.readStream.schema(CORPUS_SCHEMA).option("maxFilesPerTrigger", files_per_batch).json(folder)
    return rows.select(F.col("docid").alias("doc_id"), "title", "body")


def with_features(docs: DataFrame) -> DataFrame:
    return indexable(docs).select("doc_id", *[c.cast("float").alias(n) for n, c in text_features().items()])


def append_features(docs: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Appends the features of all files that are there; files already taken in are remembered in ``checkpoint``, so a restart repeats none."""
    return with_features(docs).writeStream.format("parquet").option("path", table).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
