"""A directory of PDF files as a stream: new files are decoded as they come. The query keeps no state, so it needs no watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.reader import decode

BINARY = "path string, modificationTime timestamp, length long, content binary"


def stream_objects(spark: SparkSession, path: str, kind: str = "chars", max_files: int = 1000, **options) -> DataFrame:
    found = spark.readStream.format("binaryFile").schema(BINARY).option("maxFilesPerTrigger", max_files).option("pathGlobFilter", "*.pdf").load(path)
    return decode(found.select(F.xxhash64("path").alias("doc_id"), "path", "content"), kind, **options)
