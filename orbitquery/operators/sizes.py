"""Output sizes of the image preparations, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def floor_to(size: Column, factor: int) -> Column:
    return (F.floor(size / factor) * factor).cast("int")


def deskewed(corners: list[tuple[Column, Column]]) -> tuple[Column, Column]:
    """Width and height of a deskewed chip: rounded distances of its first and last corners."""
    (x0, y0), (x1, y1), (x2, y2), _ = corners
    return F.rint(F.sqrt((x2 - x1) ** 2 + (y2 - y1) ** 2)).cast("int"), F.rint(F.sqrt((x1 - x0) ** 2 + (y1 - y0) ** 2)).cast("int")


def shrunk(width: Column, height: Column, most: int, factor: int) -> tuple[Column, Column]:
    """Longer side brought down to `most` if above it, then both to multiples of `factor`."""
    large = F.greatest(width, height)
    w = F.when(large <= most, width).when(height > width, (F.lit(most) * width / height).cast("int")).otherwise(F.lit(most))
    h = F.when(large <= most, height).when(height > width, F.lit(most)).otherwise((F.lit(most) * height / width).cast("int"))
    return floor_to(w, factor), floor_to(h, factor)


def long_side(width: Column, height: Column, size: int, factor: int) -> tuple[Column, Column]:
    """Longer side brought to `size` either way, then both to multiples of `factor`."""
    scale = F.lit(float(size)) / F.greatest(width, height)
    return floor_to(F.rint(width * scale), factor), floor_to(F.rint(height * scale), factor)
