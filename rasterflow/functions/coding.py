"""Scalar expressions of entropy coding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def category(value: Column) -> Column:
    """Bits of the magnitude; 0 for 0."""
    return F.when(value == 0, 0).otherwise(F.length(F.bin(F.abs(value).cast("bigint"))))


def category_bits(value: Column) -> Column:
    """The magnitude bits that follow the category: negative values count up from zero."""
    size = category(value)
    return F.when(value >= 0, value.cast("int")).otherwise(F.call_function("shiftleft", F.lit(1), size) - 1 + value.cast("int"))


def left_align(bits: Column, length: Column, width: int = 16) -> Column:
    """Bits at the top of ``width``."""
    return F.call_function("shiftleft", bits.cast("int"), F.lit(width) - length)


def token_symbol(run: Column, length: Column) -> Column:
    """The symbol of an AC token (or, with run 0, of a DC difference)."""
    return F.shiftleft(run, 4).bitwiseOR(length)


def hex_bytes(value: Column, n: int) -> Column:
    """A non-negative number as n big-endian bytes in hex."""
    return F.lpad(F.hex(value.cast("bigint")), 2 * n, "0")


def segment(marker: str, content: Column) -> Column:
    """Marker, big-endian length (two bytes more than the content), content: all in hex. A longer one is an error."""
    size = (F.length(content) / 2 + 2).cast("int")
    checked = F.when(size <= 65535, size).otherwise(F.raise_error(F.lit(f"segment {marker} is longer than 65535 bytes")).cast("int"))
    return F.concat(F.lit(marker), hex_bytes(checked, 2), content)


def stuff(array: Column) -> Column:
    """Byte values with a 0 after each 255."""
    return F.flatten(F.transform(array, lambda b: F.when(b == 255, F.array(F.lit(255), F.lit(0))).otherwise(F.array(b))))


def hex_of(array: Column) -> Column:
    """Byte values in hex."""
    return F.array_join(F.transform(array, lambda b: F.lpad(F.hex(b.cast("bigint")), 2, "0")), "")
