"""Session defaults and paths shared by the command line, bench and tests."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

PACKAGE = Path(__file__).resolve().parent
ROOT = PACKAGE.parent


def build_session(cores: int | str = "*", app: str = "rasterflow", **conf) -> SparkSession:
    """A local session with the settings that the engine expects (UTC, AQE)."""
    settings = {
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
    } | conf
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


#: Bytes of rows that reach a Python worker at once, however long they are.
ARROW_BYTES = "8m"


def ship(spark: SparkSession) -> None:
    """Send this package to Python workers, which may be on machines without it, and bound what they get at once."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)
    context = spark.sparkContext
    if re.match(r"local(\[|$)", context.master):
        paths = [p for p in context.environment.get("PYTHONPATH", "").split(":") if p]
        if str(ROOT) not in paths:  # one machine: workers read the driver's folder
            context.environment["PYTHONPATH"] = ":".join([str(ROOT), *paths])
    elif not getattr(context, "_rasterflow_sent", False):
        folder = tempfile.mkdtemp(prefix="rasterflow-")  # of the driver, whose file server gives the archive to executors
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        archive = f"{folder}/rasterflow.zip"
        with zipfile.ZipFile(archive, "w") as z:
            for source in sorted(PACKAGE.rglob("*.py")):
                z.write(source, source.relative_to(ROOT).as_posix())
        context.addPyFile(archive)
        context._rasterflow_sent = True


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
