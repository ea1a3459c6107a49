"""Colour columns, in single precision and in a fixed order of operations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def f32(value) -> Column:
    return (value if isinstance(value, Column) else F.lit(value)).cast("float")


def normalize(component: Column, maximum: Column) -> Column:
    """component / maximum."""
    return f32(f32(component) / f32(maximum))


def normalize_rgb(r: Column, g: Column, b: Column, maximum: Column) -> tuple[Column, Column, Column]:
    return normalize(r, maximum), normalize(g, maximum), normalize(b, maximum)


def in_range(r: Column, g: Column, b: Column, maximum: Column) -> Column:
    """Is no component over the maximum?"""
    return F.greatest(r, g, b) <= maximum


def _weighted(r: Column, g: Column, b: Column, weights) -> Column:
    return r * f32(weights[0]) + g * f32(weights[1]) + b * f32(weights[2])


# fixed values: the weights of red, green and blue
LUMA, CHROMA_BLUE, CHROMA_RED = (0.299, 0.587, 0.114), (-0.1687, -0.3312, 0.5), (0.5, -0.4186, -0.0813)


def ycbcr(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """(luma, blue chroma, red chroma) of components from 0 to 1; luma is shifted by 128, nothing is clamped."""
    shift = f32(f32(128.0) / f32(255.0))
    luma = (_weighted(r, g, b, LUMA) - shift) * f32(255.0)
    return luma, _weighted(r, g, b, CHROMA_BLUE) * f32(255.0), _weighted(r, g, b, CHROMA_RED) * f32(255.0)
