"""Slippy-map tiles and Web-Mercator maths as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Metres around the equator, and half of it.
AROUND = 40075016.68557849
HALF = AROUND / 2
RADIUS = AROUND / (2 * math.pi)


def lonlat_to_tile(lon: Column, lat: Column, zoom: Column) -> tuple[Column, Column]:
    """Tile column and row, held within [0, 2^zoom)."""
    n = F.pow(F.lit(2.0), zoom)
    rad = F.radians(lat)
    x = F.floor((lon + 180.0) / 360.0 * n)
    y = F.floor((1.0 - F.log(F.tan(rad) + 1.0 / F.cos(rad)) / math.pi) / 2.0 * n)
    return tuple(F.least(F.greatest(v, F.lit(0)), (n - 1).cast("long")).cast("long") for v in (x, y))


def tile_bounds(x: Column, y: Column, zoom: Column) -> list[Column]:
    """xmin, ymin, xmax, ymax in metres."""
    step = F.lit(AROUND) / F.pow(F.lit(2.0), zoom)
    return [x * step - HALF, HALF - (y + 1) * step, (x + 1) * step - HALF, HALF - y * step]


def range_bounds(x0: Column, y0: Column, x1: Column, y1: Column, zoom: Column) -> list[Column]:
    """Bounds in metres of all tiles from (x0, y0), the upper left one, to (x1, y1)."""
    low, high = tile_bounds(x0, y1, zoom), tile_bounds(x1, y0, zoom)
    return [low[0], low[1], high[2], high[3]]


def ground_resolution(zoom: Column, tile: int = 256) -> Column:
    return F.lit(AROUND) / F.pow(F.lit(2.0), zoom) / tile


def tms_row(y: Column, zoom: Column) -> Column:
    return (F.pow(F.lit(2.0), zoom).cast("long") - y - 1).cast("long")


def lonlat_to_metres(lon: Column, lat: Column) -> tuple[Column, Column]:
    return F.radians(lon) * RADIUS, F.log(F.tan(F.lit(math.pi / 4) + F.radians(lat) / 2)) * RADIUS


def metres_to_lonlat(x: Column, y: Column) -> tuple[Column, Column]:
    return F.degrees(x / RADIUS), F.degrees(2 * F.atan(F.exp(y / RADIUS)) - math.pi / 2)
