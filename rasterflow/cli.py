"""Command line: PPM files to JPEG files.

    python -m rasterflow.cli INPUT OUTPUT [-b 8|16|32] [-p P444|P422|P420] [-t THREADS] [-q TABLE]

INPUT is a file, folder or pattern; OUTPUT a file for one image, else a folder. Nothing is written
for an image with a fault, and the exit code is then 1, as it is where a path can't be read or written.
"""

from __future__ import annotations

import argparse
import logging
import os
import sys

from pyspark.errors import PySparkException

from rasterflow.functions.tables import SUBSAMPLING, quantization_name
from rasterflow.plans.convert import convert_file, convert_folder
from rasterflow.session import build_session

log = logging.getLogger("rasterflow")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="rasterflow", description="Encodes plain-text PPM images as JPEG files.")
    p.add_argument("input_file")
    p.add_argument("output_file")
    p.add_argument("-b", "--bits-per-channel", type=int, choices=(8, 16, 32), default=8)
    p.add_argument("-p", "--chroma-subsampling-preset", choices=list(SUBSAMPLING), default="P420")
    p.add_argument("-t", "--threads", type=int, default=os.cpu_count())
    p.add_argument("-q", "--quantization-table", type=quantization_name, default="Specification")
    p.add_argument("--strict-table-ids", action="store_true", help="code table ids 0 and 1 only, as baseline decoders may ask for")
    return p


def is_single(source: str, target: str) -> bool:
    """Is the input one file? On stores that aren't local, the output's name tells."""
    local = source.removeprefix("file://")
    named = target.lower().endswith((".jpeg", ".jpg")) and not os.path.isdir(local) and not set("*?[{") & set(source)
    return os.path.isfile(local) or named


def main(arguments: list[str] | None = None) -> int:
    a = parser().parse_args(arguments)
    if a.bits_per_channel != 8:
        log.warning("only the precision byte changes; baseline decoders expect 8")
    spark = build_session(a.threads)
    options = dict(preset=a.chroma_subsampling_preset, table=a.quantization_table, bits_per_channel=a.bits_per_channel, strict_ids=a.strict_table_ids)
    try:
        if is_single(a.input_file, a.output_file):
            error = convert_file(spark, a.input_file, a.output_file, **options)
            found = [(a.input_file, error)] if error else []
        else:
            found = ((r["image_id"], r["error"]) for r in convert_folder(spark, a.input_file, a.output_file, **options).toLocalIterator())
        failed = 0
        for name, error in found:
            failed += 1
            print(f"{name}: {error}", file=sys.stderr)
    except (OSError, PySparkException) as fault:
        print(str(fault).strip().splitlines()[0], file=sys.stderr)
        return 1
    return int(failed > 0)


if __name__ == "__main__":
    sys.exit(main())
