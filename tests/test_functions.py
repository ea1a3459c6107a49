import math

import pytest
from pyspark.sql import functions as F

from rasterflow.functions import coding, color, tables


def values(spark, column, *rows, schema="v int"):
    df = spark.createDataFrame([r if isinstance(r, tuple) else (r,) for r in rows], schema)
    return [r[0] for r in df.select(column).collect()]


def test_categories(spark):
    given = [0, 1, -1, 2, -2, 3, -3, 4, 63, 64, -64, 1000, -1000, 32767, -32767]
    assert values(spark, coding.category(F.col("v")), *given) == [abs(v).bit_length() for v in given]
    assert values(spark, coding.category_bits(F.col("v")), *given) == [v if v >= 0 else v + (1 << abs(v).bit_length()) - 1 for v in given]


def test_left_align(spark):
    assert values(spark, coding.left_align(coding.category_bits(F.col("v")), coding.category(F.col("v"))), 5, -5, 1, 0) == [0b101 << 13, 0b010 << 13, 1 << 15, 0]


def test_token_symbol(spark):
    assert values(spark, coding.token_symbol(F.lit(15), F.col("v")), 0, 3) == [0xF0, 0xF3]


def test_segment_and_stuffing(spark):
    df = spark.createDataFrame([([255, 9, 255, 255, 16],)], "b array<int>")
    row = df.select(coding.hex_of(coding.stuff(F.col("b"))).alias("s"), coding.segment("FFE0", F.lit("0102")).alias("g")).first()
    assert row["s"] == "FF0009FF00FF0010"
    assert row["g"] == "FFE000040102"


@pytest.mark.parametrize("rgb", [(0.0, 0.0, 0.0), (1.0, 1.0, 1.0), (1.0, 0.0, 0.0), (0.0, 0.0, 1.0), (0.1, 0.6, 0.9)])
def test_ycbcr(spark, rgb):
    df = spark.createDataFrame([rgb], "r float, g float, b float")
    got = df.select(*color.ycbcr(F.col("r"), F.col("g"), F.col("b"))).first()
    weigh = lambda w: sum(x * y for x, y in zip(rgb, w)) * 255
    expected = (weigh(color.LUMA) - 128, weigh(color.CHROMA_BLUE), weigh(color.CHROMA_RED))
    assert all(math.isclose(a, b, abs_tol=0.01) for a, b in zip(got, expected))


def test_normalize_and_range(spark):
    df = spark.createDataFrame([(255, 0, 51)], "r int, g int, b int")
    r, g, b = color.normalize_rgb(F.col("r"), F.col("g"), F.col("b"), F.lit(255))
    row = df.select(r, g, b, color.in_range(F.col("r"), F.col("g"), F.col("b"), F.lit(254)).alias("ok")).first()
    assert row[0] == 1.0 and row[1] == 0.0 and abs(row[2] - 0.2) < 1e-7 and row["ok"] is False


def test_zigzag_is_a_permutation():
    assert sorted(tables.ZIGZAG) == list(range(64))
    assert tables.ZIGZAG[:10] == [0, 1, 8, 16, 9, 2, 3, 10, 17, 24]
    assert tables.ZIGZAG[-3:] == [55, 62, 63]


def test_names_and_aliases():
    assert tables.quantization_name("Spec") == tables.quantization_name("0") == "Specification"
    assert tables.quantization_name("8") == "An-improved-detection-model"
    assert tables.subsampling("P420") == (2, 2, "average")
    with pytest.raises(ValueError):
        tables.quantization_name("3")
    with pytest.raises(ValueError):
        tables.subsampling("P411")


def test_tables_are_whole():
    assert all(len(t) == 64 and all(0 < q < 256 for q in t) for pair in tables.QUANTIZATION.values() for t in pair)


def test_a_segment_that_is_too_long(spark):
    with pytest.raises(Exception, match="longer than 65535"):
        spark.range(1).select(coding.segment("FFE0", F.repeat(F.lit("00"), 65534))).collect()
    assert len(spark.range(1).select(coding.segment("FFE0", F.repeat(F.lit("00"), 65533))).first()[0]) == 2 * 65537
