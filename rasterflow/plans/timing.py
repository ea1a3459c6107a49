"""Times the cosine transform over a plane of 3840 by 2160, as the block operators run it.

    python -m rasterflow.plans.timing [-r ROUNDS] [-t THREADS] [-a fast|matrix|direct]
"""

from __future__ import annotations

import argparse
import os
import time

from pyspark import StorageLevel
from pyspark.sql import functions as F

from rasterflow.operators import entropy, spatial, transform
from rasterflow.plans.catalog import gradient
from rasterflow.session import build_session, ship

WIDTH, HEIGHT = 3840, 2160


def plane_blocks(spark, width: int = WIDTH, height: int = HEIGHT):
    samples = gradient(spark, width, height).select(F.lit(0).alias("image_id"), F.lit(0).alias("channel"), "x", "y", "v")
    widths = spark.createDataFrame([(0, 0, width)], "image_id int, channel int, w int")
    return spatial.reblock(samples, widths)


def times(spark, rounds: int, algorithm: str, width: int = WIDTH, height: int = HEIGHT):
    """(micros) of each round; the blocks are made once and kept."""
    blocks = plane_blocks(spark, width, height).select("block_idx", "coef").persist(StorageLevel.MEMORY_AND_DISK)
    blocks.count()
    found = []
    for _ in range(rounds):
        start = time.perf_counter_ns()
        transform.dct_2d(blocks, algorithm).write.format("noop").mode("overwrite").save()
        found.append(((time.perf_counter_ns() - start) // 1000,))
    blocks.unpersist()
    return spark.createDataFrame(found, "micros long")


def main(arguments: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="timing")
    p.add_argument("-r", "--rounds", type=int, default=20)
    p.add_argument("-t", "--threads", type=int, default=os.cpu_count())
    p.add_argument("-a", "--algorithm", choices=transform.ALGORITHMS, default="fast")
    a = p.parse_args(arguments)
    spark = build_session(a.threads)
    ship(spark)
    row = entropy.timing_stats(times(spark, a.rounds, a.algorithm)).first()
    for name in ("min", "max", "average", "deviation"):
        print(f"{name}: {row[name]} µs")


if __name__ == "__main__":
    main()
