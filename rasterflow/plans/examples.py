"""Two small runs of the coding operators.

    python -m rasterflow.plans.examples bits [-n REPEATS]
    python -m rasterflow.plans.examples huffman [TEXT]
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterflow.operators import entropy
from rasterflow.session import build_session, ship

BITS = "1011000111"


def bit_pattern(spark: SparkSession, repeats: int) -> DataFrame:
    """(byte_idx, b): a pattern of bits written one at a time, over and over, and packed."""
    n = len(BITS)
    bits = spark.range(repeats * n).select(F.lit(0).alias("image_id"), F.col("id").alias("tok_idx"), F.expr("id div 65536").alias("order_key"), F.lit(1).alias("nbits"), F.substring(F.lit(BITS), F.expr(f"cast(id % {n} as int) + 1"), F.lit(1)).cast("bigint").alias("word"))
    return entropy.pack_bits(entropy.bit_offsets(bits), pad_ones=False).select("byte_idx", "b")


def wrong_bytes(spark: SparkSession, repeats: int) -> int:
    """How many of the packed bytes aren't the pattern's."""
    n = len(BITS)
    bit = lambda k: F.when(F.col("byte_idx") * 8 + k < repeats * n, F.substring(F.lit(BITS), ((F.col("byte_idx") * 8 + k) % n).cast("int") + 1, F.lit(1)).cast("int")).otherwise(0) * (1 << (7 - k))
    expected = sum((bit(k) for k in range(1, 8)), bit(0))
    return bit_pattern(spark, repeats).where(F.col("b") != expected).count()


def round_trip(spark: SparkSession, data: bytes) -> tuple[str, bytes, bytes]:
    """(the tree of the code, the coded bytes, the bytes decoded again) of some bytes and a code of their own."""
    streams, keys = spark.createDataFrame([(0, data)], "image_id int, data binary"), ("image_id",)
    freqs = entropy.byte_counts(streams)
    codes = entropy.canonical_codes(entropy.reserve_all_ones(entropy.code_lengths(freqs, keys=keys)), keys=keys)
    coded = entropy.encode_bytes(streams, codes)
    drawn = entropy.code_tree([(r["sym"], r["len"], r["code"]) for r in codes.collect()], {r["sym"]: r["freq"] for r in freqs.collect()})
    return drawn, bytes(coded.first()["bytes"]), bytes(entropy.decode_bytes(coded, codes).first()["data"])


def main(arguments: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="examples")
    kinds = p.add_subparsers(dest="kind", required=True)
    kinds.add_parser("bits").add_argument("-n", "--repeats", type=int, default=1_000_000)
    kinds.add_parser("huffman").add_argument("text", nargs="?", default="a small text, coded and decoded")
    a = p.parse_args(arguments)
    spark = build_session()
    ship(spark)
    if a.kind == "bits":
        wrong = wrong_bytes(spark, a.repeats)
        print(f"{a.repeats * len(BITS)} bits written, {wrong} bytes wrong")
        return int(wrong > 0)
    drawn, coded, again = round_trip(spark, a.text.encode())
    print(drawn, f"coded: {coded.hex(' ')}", f"decoded: {again.decode()}", sep="\n")
    return int(again != a.text.encode())


if __name__ == "__main__":
    raise SystemExit(main())
