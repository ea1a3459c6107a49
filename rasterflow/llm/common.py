"""Helpers shared by the corpus operators."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share; one of our own only where none is set and there is one machine."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        where = getattr(shared_dir, "own", None) or tempfile.mkdtemp(prefix="rasterflow-")
        if where != getattr(shared_dir, "own", None):
            atexit.register(shutil.rmtree, where, ignore_errors=True)
        shared_dir.own = where
    return where


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write a table in the shared folder and read it back: cuts lineage, survives lost executors.

    The table is deleted when the driver ends, as results may be read from it until then.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(conf).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


def text_bytes(df: DataFrame, text: str) -> int:
    """UTF-8 bytes of a text column over all rows, from which partition counts are derived."""
    return df.select(F.sum(F.octet_length(text))).first()[0] or 0
