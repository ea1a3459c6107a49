"""JPEG files from pixels: every step a DataFrame, many images at once.

Tables: images (image_id, width, height, max_value), pixels (image_id, x, y, r, g, b).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterflow.functions.coding import hex_bytes, segment
from rasterflow.functions.tables import ZIGZAG, quantization_pair, subsampling
from rasterflow.operators import entropy, spatial, transform

# fixed values: markers, and the order, class and id bytes of the code tables
SOI, EOI, APP0, DQT, SOF0, DHT, SOS = "FFD8", "FFD9", "FFE0", "FFDB", "FFC0", "FFC4", "FFDA"
TABLE_ORDER = ((1, 0x11), (0, 0x00), (3, 0x13), (2, 0x02))
#: With ids of 0 and 1 only, as baseline decoders may ask for.
STRICT_ORDER = ((1, 0x10), (0, 0x00), (3, 0x11), (2, 0x01))


def app0() -> Column:
    return segment(APP0, F.lit("4A46494600" + "0102" + "00" + "0048" + "0048" + "0000"))


def dqt(number: int, table: list[int]) -> Column:
    return segment(DQT, F.lit(f"{number:02X}" + "".join(f"{table[p]:02X}" for p in ZIGZAG)))


def sof0(width: Column, height: Column, preset: str, bits_per_channel: int = 8) -> Column:
    h, v, _ = subsampling(preset)
    content = F.concat(F.lit(f"{bits_per_channel:02X}"), hex_bytes(height, 2), hex_bytes(width, 2), F.lit(f"0301{h << 4 | v:02X}00" + "021101" + "031101"))
    return segment(SOF0, content)


def sos(strict_ids: bool = False) -> Column:
    chroma = "11" if strict_ids else "23"
    return segment(SOS, F.lit(f"0301{'00' if strict_ids else '01'}02{chroma}03{chroma}003F00"))


def dht(codes: DataFrame, strict_ids: bool = False) -> DataFrame:
    """(image_id, tables): the four code table segments of each image, in hex."""
    listed = codes.groupBy("image_id", "cls").agg(F.sort_array(F.collect_list(F.struct("rank", "sym", "len")), asc=False).alias("c"))
    counts = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(16)), lambda n: hex_bytes(F.size(F.filter("c", lambda x: x["len"] == n)), 1)), "")
    symbols = F.array_join(F.transform("c", lambda x: hex_bytes(x["sym"], 1)), "")
    order = STRICT_ORDER if strict_ids else TABLE_ORDER
    name = F.create_map(*[F.lit(x) for cls, number in order for x in (cls, f"{number:02X}")])
    place = F.create_map(*[F.lit(x) for k, (cls, _) in enumerate(order) for x in (cls, k)])
    tables = listed.select("image_id", place[F.col("cls")].alias("k"), segment(DHT, F.concat(name[F.col("cls")], counts, symbols)).alias("t"))
    return tables.groupBy("image_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "t"))), lambda x: x["t"]), "").alias("tables"))


def quantized_blocks(pixels: DataFrame, images: DataFrame, preset: str = "P420", table: str = "Specification", algorithm: str = "fast") -> DataFrame:
    """(image_id, channel, bx, by, block_idx, row_blocks, coef): quantized blocks of all channels."""
    h, v, _ = subsampling(preset)
    sizes = images.select("image_id", F.col("max_value").cast("int").alias("max_value"), "width", "height")
    padded = spatial.pad(pixels, sizes, 8 * h, 8 * v).join(sizes.select("image_id", "max_value"), "image_id")
    samples = spatial.melt_channels(spatial.to_ycbcr(padded, F.col("max_value")).select("image_id", "x", "y", "luma", "cb", "cr"))
    small = spatial.subsample(samples, preset)
    channel = F.explode(F.sequence(F.lit(0), F.lit(2))).alias("channel")
    widths = sizes.select("image_id", spatial.up(F.col("width"), 8 * h).alias("pw"), channel)
    widths = widths.select("image_id", "channel", F.when(F.col("channel") == 0, F.col("pw")).otherwise(F.expr(f"pw div {h}")).cast("int").alias("w"))
    blocks = spatial.reblock(small, widths)
    return transform.quantize(transform.dct_2d(blocks, algorithm), table)


def image_tokens(blocks: DataFrame, preset: str = "P420") -> DataFrame:
    """Tokens of quantized blocks, with the order of their blocks in the scan."""
    ordered = spatial.mcu_order(spatial.scan_order(blocks, preset), preset).withColumn("zz", transform.zigzag_block(F.col("coef")))
    ordered = ordered.select("image_id", "channel", "scan_idx", "order_key", "zz")
    return entropy.tokenize_blocks(entropy.dc_difference(ordered, F.col("zz")[0]), keep=("order_key",))


def image_codes(tokens: DataFrame) -> DataFrame:
    """The four code tables of each image."""
    return entropy.canonical_codes(entropy.reserve_all_ones(entropy.code_lengths(entropy.symbol_counts(tokens))))


def scan_data(tokens: DataFrame, codes: DataFrame) -> DataFrame:
    """(image_id, scan): the coded tokens of each image in hex, with a 0 after each byte of 255."""
    coded = entropy.bit_offsets(entropy.attach_codes(tokens, codes))
    return entropy.stuffed_hex(entropy.pack_bits(coded))


def segments(images: DataFrame, codes: DataFrame, scans: DataFrame, preset: str, table: str, bits_per_channel: int = 8, strict_ids: bool = False) -> DataFrame:
    """(image_id, idx, name, content): every part of each file in hex, in order."""
    luma, chroma = quantization_pair(table)
    joined = images.select("image_id", "width", "height").join(dht(codes, strict_ids), "image_id").join(scans, "image_id")
    parts = [
        ("SOI", F.lit(SOI)), ("APP0", app0()), ("DQT0", dqt(0, luma)), ("DQT1", dqt(1, chroma)), ("SOF0", sof0(F.col("width"), F.col("height"), preset, bits_per_channel)),
        ("DHT", F.col("tables")), ("SOS", sos(strict_ids)), ("SCAN", F.col("scan")), ("EOI", F.lit(EOI)),
    ]
    listed = F.array(*[F.struct(F.lit(k).alias("idx"), F.lit(name).alias("name"), content.alias("content")) for k, (name, content) in enumerate(parts)])
    return joined.select("image_id", F.inline(listed))


def assemble_jpeg(parts: DataFrame) -> DataFrame:
    """(image_id, content): the bytes of each file."""
    whole = parts.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("idx", "content"))).alias("p"))
    return whole.select("image_id", F.unhex(F.array_join(F.col("p.content"), "")).alias("content"))


def encode(pixels: DataFrame, images: DataFrame, preset: str = "P420", table: str = "Specification", algorithm: str = "fast", bits_per_channel: int = 8, strict_ids: bool = False) -> DataFrame:
    """(image_id, content): pixels of many images as JPEG files.

    Tokens feed both the code tables and the scan; they are made for each, so nothing stays on executors.
    """
    tokens = image_tokens(quantized_blocks(pixels, images, preset, table, algorithm), preset)
    codes = image_codes(tokens)
    return assemble_jpeg(segments(images, codes, scan_data(tokens, codes), preset, table, bits_per_channel, strict_ids))
