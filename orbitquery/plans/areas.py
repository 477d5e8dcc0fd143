"""Which windows a run looks at: each strategy turns scenes into a window table, and prepared inputs come before the matching."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import grid, raster, selection, spatial
from ..sources.config import Settings

#: A strategy: windows (scene_id, x0, y0, x1, y1 in pixels) of scenes (scene_id, width, height).
Strategy = Callable[[DataFrame], DataFrame]


def whole_scenes(settings: Settings | None = None) -> Strategy:
    """All windows of the sliding grid."""
    s = settings or Settings()

    def windows(scenes: DataFrame) -> DataFrame:
        tiles = grid.tile_grid(scenes.select("scene_id", "width", "height"), cut=s.cut_size, overlap=s.overlap, drop_last=s.drop_last)
        return tiles.select("scene_id", F.col("stx").alias("x0"), F.col("sty").alias("y0"), F.least(F.col("stx") + F.col("cut"), F.col("width")).alias("x1"), F.least(F.col("sty") + F.col("cut"), F.col("height")).alias("y1"))

    return windows


def within(areas: DataFrame, settings: Settings | None = None) -> Strategy:
    """The grid's windows that touch their scene's area of interest (scene_id and box in pixels); scenes without one keep all."""

    def windows(scenes: DataFrame) -> DataFrame:
        tiles = whole_scenes(settings)(scenes)
        box = areas.select("scene_id", *[F.col(c).alias(f"area_{c}") for c in spatial.BOX])
        both = tiles.join(box, "scene_id", "left")
        meets = (F.col("x0") <= F.col("area_x1")) & (F.col("area_x0") <= F.col("x1")) & (F.col("y0") <= F.col("area_y1")) & (F.col("area_y0") <= F.col("y1"))
        return both.where(F.col("area_x0").isNull() | meets).select(*tiles.columns)

    return windows


def around(features: DataFrame, size: float, least: float = 500.0) -> Strategy:
    """One window of `size` around each feature (id, scene_id and box in pixels) with at least that area in its scene."""

    def windows(scenes: DataFrame) -> DataFrame:
        both = scenes.select("scene_id", "width", "height").join(features, "scene_id")
        low = [F.greatest(F.col(c), F.lit(0)).cast("double") for c in ("x0", "y0")]
        high = [F.least(F.col(c), F.col(n)).cast("double") for c, n in (("x1", "width"), ("y1", "height"))]
        both = both.where((high[0] > low[0]) & (high[1] > low[1]) & ((high[0] - low[0]) * (high[1] - low[1]) >= least))
        wx, wy = (grid.centred_window(a, b, size, F.lit(0.0), F.col(n).cast("double")) for a, b, n in zip(low, high, ("width", "height"), strict=True))
        return both.select("scene_id", wx[0].alias("x0"), wy[0].alias("y0"), wx[1].alias("x1"), wy[1].alias("y1"))

    return windows


def pyramid(pixels: DataFrame, levels: Sequence[int]) -> DataFrame:
    """Pixels at every level: nearest neighbour at half the size each, level 0 as they are."""
    out = None
    for level in levels:
        part = raster.overview(pixels, 2**level).withColumn("level", F.lit(level))
        out = part if out is None else out.unionByName(part)
    return out


def prepared_chips(chips: DataFrame, sidecars: DataFrame, settings: Settings | None = None) -> DataFrame:
    """Each chip at the levels and in the four turns that it is matched in, with its corner box, the whole extent by default."""
    s = settings or Settings()
    boxed = selection.with_default(chips, sidecars, ["chip_id"], "width", "height")
    return grid.rotations(grid.chip_levels(boxed, s.levels, s.base_resolution, s.least_side))
