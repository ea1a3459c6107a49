import pytest
from pyspark.sql import functions as F

from rasterflow.operators import spatial


def plane(spark, width, height, channel=1):
    rows = [("i", channel, x, y, float(y * width + x)) for y in range(height) for x in range(width)]
    return spark.createDataFrame(rows, "image_id string, channel int, x int, y int, v float")


@pytest.mark.parametrize(("size", "multiple", "expected"), [((1, 1), (16, 8), (16, 8)), ((17, 7), (16, 16), (32, 16)), ((99, 99), (10, 10), (100, 100)), ((8, 8), (8, 8), (8, 8))])
def test_pad(spark, size, multiple, expected):
    images = spark.createDataFrame([("i", *size)], "image_id string, width int, height int")
    rows = [("i", x, y, 9, 9, 9) for y in range(size[1]) for x in range(size[0])]
    pixels = spark.createDataFrame(rows, "image_id string, x int, y int, r int, g int, b int")
    out = spatial.pad(pixels, images, *multiple).collect()
    assert len(out) == len({(r.x, r.y) for r in out}) == expected[0] * expected[1]
    assert sum(r.r == 9 for r in out) == size[0] * size[1]
    assert {(r.pw, r.ph) for r in out} == {expected}


def test_subsample_skip(spark):
    got = {(r.x, r.y): r.v for r in spatial.subsample_skip(plane(spark, 4, 4), 2, 1).collect()}
    assert got[1, 1] == 6.0 and len(got) == 8


def test_subsample_average(spark):
    got = {(r.x, r.y): r.v for r in spatial.subsample_average(plane(spark, 4, 4), 2, 2).collect()}
    assert got == {(0, 0): 2.5, (1, 0): 4.5, (0, 1): 10.5, (1, 1): 12.5}


def test_subsample_average_repeats_the_border(spark):
    got = {(r.x, r.y): r.v for r in spatial.subsample_average(plane(spark, 3, 3), 2, 2).collect()}
    assert got[1, 1] == 8.0 and got[1, 0] == (2 + 5) / 2


def test_luma_passes(spark):
    both = plane(spark, 16, 16, 0).unionAll(plane(spark, 16, 16, 1))
    counts = {r.channel: r["count"] for r in spatial.subsample(both, "P420").groupBy("channel").count().collect()}
    assert counts == {0: 256, 1: 64}


def test_reblock(spark):
    widths = spark.createDataFrame([("i", 1, 8)], "image_id string, channel int, w int")
    got = {r.block_idx: r.coef for r in spatial.reblock(plane(spark, 8, 8), widths, 4).collect()}
    assert got[1] == [4, 5, 6, 7, 12, 13, 14, 15, 20, 21, 22, 23, 28, 29, 30, 31]
    assert sorted(got) == [0, 1, 2, 3]


def quads(length, rows):
    """The quad order by its description: pairs of rows, two blocks of each at a time."""
    return [y * length + x for pair in range(0, rows, 2) for start in range(0, length, 2) for y in (pair, pair + 1) for x in (start, start + 1)]


@pytest.mark.parametrize("length", [4, 6])
def test_scan_order(spark, length):
    rows = [("i", c, x, y, y * length + x, length) for c in (0, 1) for y in range(4) for x in range(length)]
    blocks = spark.createDataFrame(rows, "image_id string, channel int, bx int, by int, block_idx int, row_blocks int")
    luma = spatial.scan_order(blocks, "P420").where("channel = 0").orderBy("scan_idx").collect()
    assert [r.block_idx for r in luma] == quads(length, 4)
    assert all(r.scan_idx == r.block_idx for r in spatial.scan_order(blocks, "P422").collect())


@pytest.mark.parametrize(("preset", "k"), [("P444", 1), ("P422", 2), ("P420", 4)])
def test_mcu_order(spark, preset, k):
    rows = [("i", c, s) for c in (0, 1, 2) for s in range(2 * k if c == 0 else 2)]
    blocks = spark.createDataFrame(rows, "image_id string, channel int, scan_idx int")
    got = [r.channel for r in spatial.mcu_order(blocks, preset).orderBy("order_key").collect()]
    assert got == 2 * ([0] * k + [1, 2])


def test_repeated_groups_of_samples_stay_apart(spark):
    both = plane(spark, 2, 2).unionAll(plane(spark, 2, 2).withColumn("image_id", F.lit("j")))
    assert spatial.subsample_average(both, 2, 2).count() == 2
