"""Fixed values of baseline JPEG coding and the dimension tables made from them."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession

# --- fixed values: quantization tables, row by row --------------------------------------
SPECIFICATION_LUMA = [
    16, 11, 10, 16, 24, 40, 51, 61,
    12, 12, 14, 19, 26, 58, 60, 55,
    14, 13, 16, 24, 40, 57, 69, 56,
    14, 17, 22, 29, 51, 87, 80, 62,
    18, 22, 37, 56, 68, 109, 103, 77,
    24, 35, 55, 64, 81, 104, 113, 92,
    49, 64, 78, 87, 103, 121, 120, 101,
    72, 92, 95, 98, 112, 100, 103, 99,
]
SPECIFICATION_CHROMA = [
    17, 18, 24, 47, 99, 99, 99, 99,
    18, 21, 26, 66, 99, 99, 99, 99,
    24, 26, 56, 99, 99, 99, 99, 99,
    47, 66, 99, 99, 99, 99, 99, 99,
    99, 99, 99, 99, 99, 99, 99, 99,
    99, 99, 99, 99, 99, 99, 99, 99,
    99, 99, 99, 99, 99, 99, 99, 99,
    99, 99, 99, 99, 99, 99, 99, 99,
]
FLAT = [16] * 64
MSSIM_LUMA = [
    12, 17, 20, 21, 30, 34, 56, 63,
    18, 20, 20, 26, 28, 51, 61, 55,
    19, 20, 21, 26, 33, 58, 69, 55,
    26, 26, 26, 30, 46, 87, 86, 66,
    31, 33, 36, 40, 46, 96, 100, 73,
    40, 35, 46, 62, 81, 100, 111, 91,
    46, 66, 76, 86, 102, 121, 120, 101,
    68, 90, 90, 96, 113, 102, 105, 103,
]
MSSIM_CHROMA = [
    8, 12, 15, 15, 86, 96, 96, 98,
    13, 13, 15, 26, 90, 96, 99, 98,
    12, 15, 18, 96, 99, 99, 99, 99,
    17, 16, 90, 96, 99, 99, 99, 99,
    96, 96, 99, 99, 99, 99, 99, 99,
    99, 99, 99, 99, 99, 99, 99, 99,
    99, 99, 99, 99, 99, 99, 99, 99,
    99, 99, 99, 99, 99, 99, 99, 99,
]
PSNR_HVS_LUMA = [
    9, 10, 12, 14, 27, 32, 51, 62,
    11, 12, 14, 19, 27, 44, 59, 73,
    12, 14, 18, 25, 42, 59, 79, 78,
    17, 18, 25, 42, 61, 92, 87, 92,
    23, 28, 42, 75, 79, 112, 112, 99,
    40, 42, 59, 84, 88, 124, 132, 111,
    42, 64, 78, 95, 105, 126, 125, 99,
    70, 75, 100, 102, 116, 100, 107, 98,
]
PSNR_HVS_CHROMA = [
    9, 10, 17, 19, 62, 89, 91, 97,
    12, 13, 18, 29, 84, 91, 88, 98,
    14, 19, 29, 93, 95, 95, 98, 97,
    20, 26, 84, 88, 95, 95, 98, 94,
    26, 86, 91, 93, 97, 99, 98, 99,
    99, 100, 98, 99, 99, 99, 99, 99,
    99, 99, 99, 99, 99, 99, 99, 99,
    97, 97, 99, 99, 99, 99, 97, 99,
]
DCTUNE = [
    7, 8, 10, 14, 23, 44, 95, 241,
    8, 8, 11, 15, 25, 47, 102, 255,
    10, 11, 13, 19, 31, 58, 127, 255,
    14, 15, 19, 27, 44, 83, 181, 255,
    23, 25, 31, 44, 72, 136, 255, 255,
    44, 47, 58, 83, 136, 255, 255, 255,
    95, 102, 127, 181, 255, 255, 255, 255,
    241, 255, 255, 255, 255, 255, 255, 255,
]
VISUAL_DETECTION = [
    15, 11, 11, 12, 15, 19, 25, 32,
    11, 13, 10, 10, 12, 15, 19, 24,
    11, 10, 14, 14, 16, 18, 22, 27,
    12, 10, 14, 18, 21, 24, 28, 33,
    15, 12, 16, 21, 26, 31, 36, 42,
    19, 15, 18, 24, 31, 38, 45, 53,
    25, 19, 22, 28, 36, 45, 55, 65,
    32, 24, 27, 33, 42, 53, 65, 77,
]
IMPROVED_DETECTION = [
    14, 10, 11, 14, 19, 25, 34, 45,
    10, 11, 11, 12, 15, 20, 26, 33,
    11, 11, 15, 18, 21, 25, 31, 38,
    14, 12, 18, 24, 28, 33, 39, 47,
    19, 15, 21, 28, 36, 43, 51, 59,
    25, 20, 25, 33, 43, 54, 64, 74,
    34, 26, 31, 39, 51, 64, 77, 91,
    45, 33, 38, 47, 59, 74, 91, 108,
]
# --- fixed values: names and aliases of the table pairs; subsampling rates and methods ---
QUANTIZATION = {
    "Specification": (SPECIFICATION_LUMA, SPECIFICATION_CHROMA),
    "Flat": (FLAT, FLAT),
    "MSSIM-Kodak-Tuned": (MSSIM_LUMA, MSSIM_CHROMA),
    "PSNR-HVS-N-Kodak-Tuned": (PSNR_HVS_LUMA, PSNR_HVS_CHROMA),
    "DCTune-Perceptual-Optimization": (DCTUNE, DCTUNE),
    "A-visual-detection-model": (VISUAL_DETECTION, VISUAL_DETECTION),
    "An-improved-detection-model": (IMPROVED_DETECTION, IMPROVED_DETECTION),
}
ALIASES = {
    "Spec": "Specification", "Default": "Specification", "0": "Specification",
    "1": "Flat", "2": "MSSIM-Kodak-Tuned", "4": "PSNR-HVS-N-Kodak-Tuned",
    "6": "DCTune-Perceptual-Optimization", "7": "A-visual-detection-model", "8": "An-improved-detection-model",
}
SUBSAMPLING = {"P444": (1, 1, "skip"), "P422": (2, 1, "average"), "P420": (2, 2, "average")}
# ------------------------------------------------------------------------------------------

#: Place in a block, row by row, of each zig-zag position.
ZIGZAG = sorted(range(64), key=lambda p: (p // 8 + p % 8, p // 8 if (p // 8 + p % 8) % 2 else p % 8))


def quantization_name(name: str) -> str:
    """The preset that a name or alias stands for."""
    name = ALIASES.get(name, name)
    if name not in QUANTIZATION:
        raise ValueError(f"unknown quantization table {name!r}; known: {', '.join(QUANTIZATION)}")
    return name


def quantization_pair(name: str) -> tuple[list[int], list[int]]:
    return QUANTIZATION[quantization_name(name)]


def subsampling(preset: str) -> tuple[int, int, str]:
    """(horizontal rate, vertical rate, method) of a chroma subsampling preset."""
    if preset not in SUBSAMPLING:
        raise ValueError(f"unknown subsampling preset {preset!r}; known: {', '.join(SUBSAMPLING)}")
    return SUBSAMPLING[preset]


def basis_value(i: int, k: int) -> float:
    """Row i, column k of the orthonormal DCT-II matrix of size 8."""
    return math.sqrt((1 if i == 0 else 2) / 8) * math.cos((2 * k + 1) * i * math.pi / 16)


# Dimension tables: at most 896 rows, so broadcasting them is safe at any scale.
def presets(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(n, *v) for n, v in SUBSAMPLING.items()], "preset string, h_rate int, v_rate int, method string")


def qtables(spark: SparkSession) -> DataFrame:
    rows = [(n, kind, p, q) for n, pair in QUANTIZATION.items() for kind, table in zip(("luma", "chroma"), pair) for p, q in enumerate(table)]
    return spark.createDataFrame(rows, "preset string, kind string, pos int, q int")


def zigzag(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(ZIGZAG)), "zz_pos int, pos int")


def basis(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, k, basis_value(i, k)) for i in range(8) for k in range(8)], "i int, k int, a double")
