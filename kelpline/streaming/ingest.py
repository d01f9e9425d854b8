"""Streaming ingest: new raw objects are parsed and upserted batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from kelpline.engine import Engine
from kelpline.sources.jsonl import object_key


def raw_objects(spark: SparkSession, root: str) -> DataFrame:
    """(key, content) of the objects under ``root``, as a stream of files."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", "*.jsonl").option("recursiveFileLookup", "true").load(root)
    return files.select(object_key(root).alias("key"), "content")


def start(spark: SparkSession, root: str, engine: Engine, checkpoint: str) -> StreamingQuery:
    """Ingest what is new under ``root``. A batch that runs twice changes nothing; files that grow are for ``Engine.poll``."""
    return raw_objects(spark, root).writeStream.foreachBatch(lambda df, _: engine.ingest_objects(df)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
