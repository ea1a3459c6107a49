"""Encoding as files arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rasterflow.plans.fused import encode_files

FILE_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


def read_stream(spark: SparkSession, path: str, max_files: int = 1000) -> DataFrame:
    """PPM files that appear in a folder, at most ``max_files`` in a batch."""
    return spark.readStream.format("binaryFile").schema(FILE_SCHEMA).option("maxFilesPerTrigger", max_files).load(path)


def encode_stream(files: DataFrame, **options) -> DataFrame:
    """(image_id, content, error) of a stream of files; stateless, so it restarts from the sink's checkpoint."""
    return encode_files(files, **options)
