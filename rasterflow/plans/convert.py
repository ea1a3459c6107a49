"""PPM files to JPEG files: one call from paths to paths."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterflow.plans.fused import encode_files
from rasterflow.session import ship
from rasterflow.sources.jpeg import register, store
from rasterflow.sources.ppm import parse


class CannotOpen(OSError):
    """There is no such input, or it can't be read."""


class CannotWrite(OSError):
    """The output can't be written."""


def read_files(spark: SparkSession, source: str) -> DataFrame:
    """(path, content) of a file, folder or pattern on any store that Spark reads."""
    try:
        return spark.read.format("binaryFile").load(source).select("path", "content")
    except AnalysisException as fault:
        raise CannotOpen(f"can't open {source}: {fault.getCondition() or fault}") from fault


def faults(files: DataFrame) -> DataFrame:
    """(image_id, error) of the files that are no whole images."""
    return parse(files).where("error is not null").select("image_id", "error")


def convert_file(spark: SparkSession, source: str, target: str, preset: str = "P420", table: str = "Specification", **options) -> str | None:
    """One PPM file as one JPEG file; the fault, if it has one, and then nothing is written."""
    ship(spark)
    row = encode_files(read_files(spark, source), preset, table, **options).first()
    if row is None:
        raise CannotOpen(f"can't open {source}: no file")
    if row["error"]:
        return row["error"]
    system, path = store(target)
    try:
        if "/" in path.strip("/"):
            system.create_dir(path.rpartition("/")[0], recursive=True)
        with system.open_output_stream(path) as f:
            f.write(row["content"])
    except OSError as fault:
        raise CannotWrite(f"can't write {target}: {fault}") from fault
    return None


def convert_folder(spark: SparkSession, source: str, target: str, preset: str = "P420", table: str = "Specification", mode: str = "append", **options) -> DataFrame:
    """Every PPM file of a folder or pattern as a JPEG file in the folder ``target``; gives the faults, (image_id, error).

    Tasks write their own files, so no image passes through the driver. Files with a fault are left out.
    """
    ship(spark)
    register(spark)
    files = read_files(spark, source)
    encoded = encode_files(files, preset, table, **options).where("error is null").select("image_id", F.col("content"))
    encoded.write.format("jpeg").mode(mode).save(target)
    return faults(files)
