"""Rasters in long form (keys, x, y, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..tables import Table


def downsampled(pixels: DataFrame, keys: list[str], k: int) -> DataFrame:
    return pixels.groupBy(*keys, F.floor(F.col("x") / k).alias("x"), F.floor(F.col("y") / k).alias("y")).agg(F.avg("value").alias("value"))


def overview(pixels: DataFrame, k: int) -> DataFrame:
    """Nearest neighbour at 1/k."""
    return pixels.where((F.col("x") % k == 0) & (F.col("y") % k == 0)).withColumn("x", F.floor(F.col("x") / k)).withColumn("y", F.floor(F.col("y") / k))


def valid_bounds(pixels: DataFrame, keys: list[str], nodata: float = 0.0) -> DataFrame:
    """Extent of pixels other than nodata, and the first valid place of its first row and first column."""
    valid = pixels.where(F.col("value") != nodata)
    return valid.groupBy(*keys).agg(
        F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"),
        F.min(F.struct("y", "x"))["x"].alias("first_x"), F.min(F.struct("x", "y"))["y"].alias("first_y"),
    )


def turned(x: Column, y: Column, rot: Column, width: Column, height: Column) -> tuple[Column, Column]:
    """Where a pixel goes under 0 to 3 quarter turns clockwise."""
    return (
        F.when(rot == 1, height - 1 - y).when(rot == 2, width - 1 - x).when(rot == 3, y).otherwise(x),
        F.when(rot == 1, x).when(rot == 2, height - 1 - y).when(rot == 3, width - 1 - x).otherwise(y),
    )


def footprint_cells(pixels: DataFrame, keys: list[str], size: int, nodata: float = 0.0) -> DataFrame:
    """keys, cx, cy, n: cells of a raster with valid pixels, and how many. Parts of the footprint that touch share an edge of cells."""
    valid = pixels.where(F.col("value") != nodata)
    return valid.groupBy(*keys, F.floor(F.col("x") / size).alias("cx"), F.floor(F.col("y") / size).alias("cy")).agg(F.count("*").alias("n"))


def skew_corners(edges: DataFrame) -> list[Column]:
    """Four corners of skewed content from where its first row and first column begin, counted within its extent.

    edges: width, height, first_x, first_y, last_x, last_y: first valid places from the start and, reversed, from the end.
    Upright content (either first place is zero) has its extent's corners, from the origin along y.  Eight columns, x and y in turn.
    Skewed content touches each side of its extent once.  If its first column begins earlier
    than its first row, it leans to the right; else it is the mirror image in the diagonal,
    that is, the same with both axes exchanged and the corners walked the other way round.
    """
    w, h = F.col("width") - 1, F.col("height") - 1
    across, down = (F.col("first_x"), F.col("last_x"), w), (F.col("first_y"), F.col("last_y"), h)

    def lean(along, other):
        """Corners on the near side of `along`, the near side of `other`, and the far sides, as (along, other)."""
        (_, last, size), (first, _, height) = along, other
        return [(F.lit(0), first), (size - last, F.lit(0)), (size, height - first), (last, height)]

    right = lean(across, down)
    first, *others = [(x, y) for y, x in lean(down, across)]
    mirrored = [first, *reversed(others)]
    upright = [(F.lit(0), F.lit(0)), (F.lit(0), h), (w, h), (w, F.lit(0))]
    straight, leans = (F.col("first_x") == 0) | (F.col("first_y") == 0), F.col("first_x") > F.col("first_y")
    return [F.when(straight, u).when(leans, r).otherwise(m) for us, rs, ms in zip(upright, right, mirrored, strict=True) for u, r, m in zip(us, rs, ms, strict=True)]


def inside_ring(x: Column, y: Column, ring: Column) -> Column:
    """A point lies within a ring (array of (x, y), closed or not): an odd number of edges is crossed to its right."""
    n = F.size(ring)

    def crossed(k: Column) -> Column:
        a, b = F.get(ring, k), F.get(ring, (k + 1) % n)
        upward = (a["y"] > y) != (b["y"] > y)
        return upward & (x < (b["x"] - a["x"]) * (y - a["y"]) / F.nullif(b["y"] - a["y"], F.lit(0.0)) + a["x"])

    return F.when(n > 2, F.size(F.filter(F.sequence(F.lit(0), n - 1), crossed)) % 2 == 1).otherwise(False)


def masked(pixels: DataFrame, rings: DataFrame, keys: list[str], fill: float = 0.0) -> DataFrame:
    """Crops: keys, x, y (from the ring's upper left pixel) and value of the pixels in each ring's box, `fill` outside the ring.

    rings: keys, ring.  A pixel counts by its middle.
    """
    xs, ys = F.transform("ring", lambda p: p["x"]), F.transform("ring", lambda p: p["y"])
    box = rings.select(*keys, "ring", *[F.floor(f(v)).alias(n) for n, f, v in (("x0", F.array_min, xs), ("y0", F.array_min, ys))], F.ceil(F.array_max(xs)).alias("x1"), F.ceil(F.array_max(ys)).alias("y1"))
    near = pixels.join(box, keys).where((F.col("x") >= F.col("x0")) & (F.col("x") < F.col("x1")) & (F.col("y") >= F.col("y0")) & (F.col("y") < F.col("y1")))
    # In a step of its own: beside the new x and y, a lambda would take those for the old ones.
    near = near.withColumn("value", F.when(inside_ring(F.col("x") + 0.5, F.col("y") + 0.5, F.col("ring")), F.col("value")).otherwise(F.lit(fill)))
    return near.select(*keys, (F.col("x") - F.col("x0")).alias("x"), (F.col("y") - F.col("y0")).alias("y"), "value")


def connected_parts(cells: DataFrame, keys: list[str], most_rounds: int = 1000) -> DataFrame:
    """cells (keys, cx, cy) with part: the smallest (cy, cx) of the cells that are joined edge to edge.

    A cell takes the least label among itself and its neighbours' labels, whose own labels
    are followed as well, so paths halve from round to round; every round is written.
    """
    own = cells.select(*keys, "cx", "cy").distinct().withColumn("part", F.struct(F.col("cy").alias("y"), F.col("cx").alias("x")))
    now = Table(own, "parts")
    for _ in range(most_rounds):
        moves = F.array(*[F.struct((F.col("cx") + dx).alias("cx"), (F.col("cy") + dy).alias("cy")) for dx, dy in ((0, 0), (1, 0), (-1, 0), (0, 1), (0, -1))])
        sent = now.df.select(*keys, F.explode(moves).alias("to"), "part").select(*keys, "to.cx", "to.cy", "part")
        least = now.df.drop("part").join(sent.groupBy(*keys, "cx", "cy").agg(F.min("part").alias("part")), [*keys, "cx", "cy"])
        # The label is a cell itself: take on what that cell is labelled with now.
        onward = now.df.select(*keys, F.struct(F.col("cy").alias("y"), F.col("cx").alias("x")).alias("part"), F.col("part").alias("onward"))
        after = Table(least.join(onward, [*keys, "part"], "left").select(*keys, "cx", "cy", F.least("part", F.coalesce("onward", "part")).alias("part")), "parts")
        changed = after.df.alias("a").join(now.df.alias("b"), [*keys, "cx", "cy"]).where("a.part <> b.part").limit(1).count()
        now.drop()
        now = after
        if not changed:
            break
    return now.df.select(*keys, "cx", "cy", F.col("part.x").alias("part_x"), F.col("part.y").alias("part_y"))


def placed(wanted: DataFrame, tiles: DataFrame, keys: list[str], size: int = 256, missing: float = 0.0) -> DataFrame:
    """Mosaic of map tiles: keys, x, y, px, py and value of every wanted tile, `missing` where none was fetched.

    wanted: keys, x, y; tiles: x, y, value. px, py: place in the mosaic of the key's tiles.
    """
    first = wanted.groupBy(*keys).agg(F.min("x").alias("__x"), F.min("y").alias("__y"))
    out = wanted.join(tiles, ["x", "y"], "left").join(first, keys)
    return out.select(*keys, "x", "y", ((F.col("x") - F.col("__x")) * size).alias("px"), ((F.col("y") - F.col("__y")) * size).alias("py"), F.coalesce("value", F.lit(missing)).alias("value"))
