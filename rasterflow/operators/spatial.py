"""Spatial operators on pixels (image_id, x, y, r, g, b) and samples (image_id, channel, x, y, v).

Channels: 0 luma, 1 blue chroma, 2 red chroma.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterflow.functions.color import f32, normalize_rgb, ycbcr
from rasterflow.functions.tables import subsampling


def up(value, multiple: int):
    """The next multiple, in 32-bit integers."""
    return (F.ceil(value / multiple) * multiple).cast("int")


def pad(pixels: DataFrame, images: DataFrame, w_multiple: int, h_multiple: int) -> DataFrame:
    """Pixels with black ones added right and below, up to the multiples; adds pw and ph.

    Only the added pixels are generated; given ones pass through without a join.
    """
    sizes = images.select("image_id", "width", "height", up(F.col("width"), w_multiple).alias("pw"), up(F.col("height"), h_multiple).alias("ph"))
    given = pixels.join(sizes, "image_id").select("image_id", "x", "y", "r", "g", "b", "pw", "ph")
    rows = sizes.withColumn("y", F.explode(F.sequence(F.lit(0), F.col("ph") - 1)))
    first = F.when(F.col("y") < F.col("height"), F.col("width")).otherwise(0)
    added = rows.where(first < F.col("pw")).withColumn("x", F.explode(F.sequence(first, F.col("pw") - 1)))
    black = [F.lit(0).cast(pixels.schema[c].dataType).alias(c) for c in "rgb"]
    return given.unionByName(added.select("image_id", "x", "y", *black, "pw", "ph"))


def to_ycbcr(pixels: DataFrame, maximum) -> DataFrame:
    """Pixels with columns luma, cb, cr."""
    luma, cb, cr = ycbcr(*normalize_rgb(F.col("r"), F.col("g"), F.col("b"), maximum))
    return pixels.select("*", luma.alias("luma"), cb.alias("cb"), cr.alias("cr"))


def melt_channels(pixels: DataFrame) -> DataFrame:
    """One row for each sample: (…, channel, v)."""
    keep = [c for c in pixels.columns if c not in ("r", "g", "b", "luma", "cb", "cr")]
    values = F.array(*[F.struct(F.lit(k).alias("channel"), F.col(c).alias("v")) for k, c in enumerate(("luma", "cb", "cr"))])
    return pixels.select(*keep, F.inline(values))


def subsample_skip(samples: DataFrame, h: int, v: int) -> DataFrame:
    """The sample at the top left of each h by v rectangle."""
    kept = samples.where((F.col("x") % h == 0) & (F.col("y") % v == 0))
    return kept.withColumn("x", F.expr(f"x div {h}").cast("int")).withColumn("y", F.expr(f"y div {v}").cast("int"))


def subsample_average(samples: DataFrame, h: int, v: int, keys=("image_id", "channel")) -> DataFrame:
    """The mean of each h by v rectangle: columns first, top to bottom, in single precision.

    Rectangles over the border repeat the last row and column.
    """
    cell = [F.expr(f"x div {h}").cast("int").alias("cx"), F.expr(f"y div {v}").cast("int").alias("cy")]
    at = lambda i, j: F.max(F.when((F.col("x") % h == i) & (F.col("y") % v == j), F.col("v")))
    cells = samples.groupBy(*keys, *cell).agg(*[at(i, j).alias(f"v_{i}_{j}") for i in range(h) for j in range(v)])

    def value(i: int, j: int):
        nearest = [F.col(f"v_{a}_{b}") for a in range(i, -1, -1) for b in range(j, -1, -1)]
        return F.coalesce(*nearest)

    total = None
    for i in range(h):
        for j in range(v):
            total = value(i, j) if total is None else total + value(i, j)
    return cells.select(*keys, F.col("cx").alias("x"), F.col("cy").alias("y"), f32(total / f32(float(h * v))).alias("v"))


def subsample(samples: DataFrame, preset: str) -> DataFrame:
    """Chroma at the preset's rates, luma as it is."""
    h, v, method = subsampling(preset)
    if h == v == 1:
        return samples.select("image_id", "channel", "x", "y", "v")
    luma, chroma = samples.where("channel = 0").select("image_id", "channel", "x", "y", "v"), samples.where("channel > 0")
    small = subsample_skip(chroma, h, v) if method == "skip" else subsample_average(chroma, h, v)
    return luma.unionByName(small.select("image_id", "channel", "x", "y", "v"))


def reblock(samples: DataFrame, widths: DataFrame, size: int = 8) -> DataFrame:
    """(image_id, channel, bx, by, block_idx, row_blocks, coef): blocks of size * size values, row by row.

    ``widths``: (image_id, channel, w), a plane's width in samples. Planes are whole blocks.
    """
    placed = samples.join(widths, ["image_id", "channel"])
    bx, by = F.expr(f"x div {size}").cast("int"), F.expr(f"y div {size}").cast("int")
    row = F.expr(f"w div {size}").cast("int")
    pos = (F.col("y") % size) * size + F.col("x") % size
    groups = placed.groupBy("image_id", "channel", bx.alias("bx"), by.alias("by"), row.alias("row_blocks")).agg(F.array_sort(F.collect_list(F.struct(pos.alias("p"), "v"))).alias("vs"))
    index = F.col("by").cast("bigint") * F.col("row_blocks") + F.col("bx")
    return groups.where(F.size("vs") == size * size).select("image_id", "channel", "bx", "by", index.alias("block_idx"), "row_blocks", F.col("vs.v").alias("coef"))


def scan_order(blocks: DataFrame, preset: str) -> DataFrame:
    """Adds scan_idx: the order of a channel's blocks in the scan; luma of P420 goes two by two."""
    h, v, _ = subsampling(preset)
    plain = F.col("block_idx").cast("bigint")
    if v == 1:
        return blocks.withColumn("scan_idx", plain)
    row = F.col("row_blocks").cast("bigint")
    quad = F.expr("by div 2") * 2 * row + F.expr("bx div 2") * 4 + F.col("by") % 2 * 2 + F.col("bx") % 2
    return blocks.withColumn("scan_idx", F.when(F.col("channel") == 0, quad).otherwise(plain).cast("bigint"))


def mcu_order(blocks: DataFrame, preset: str) -> DataFrame:
    """Adds mcu and slot: a unit's luma blocks, then blue chroma, then red chroma; order_key puts all in order."""
    h, v, _ = subsampling(preset)
    k = h * v
    luma = F.col("channel") == 0
    mcu = F.when(luma, F.expr(f"scan_idx div {k}")).otherwise(F.col("scan_idx")).cast("bigint")
    slot = F.when(luma, F.col("scan_idx") % k).otherwise(F.lit(k - 1) + F.col("channel")).cast("int")
    return blocks.withColumn("mcu", mcu).withColumn("slot", slot).withColumn("order_key", F.col("mcu") * (k + 2) + F.col("slot"))
