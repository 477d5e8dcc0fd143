"""Box joins by cell, footprint ownership and extents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import affine, quad

BOX = ("x0", "y0", "x1", "y1")


def cells_of(box: list[Column], size: float) -> Column:
    """The grid cells that a closed box touches."""
    xs = F.sequence(F.floor(box[0] / size), F.floor(box[2] / size))
    ys = F.sequence(F.floor(box[1] / size), F.floor(box[3] / size))
    return F.flatten(F.transform(xs, lambda x: F.transform(ys, lambda y: F.struct(x.alias("cx"), y.alias("cy")))))


def overlap_join(left: DataFrame, right: DataFrame, size: float, prefixes: tuple[str, str] = ("a_", "b_"), salts: int = 1) -> DataFrame:
    """Pairs of boxes (x0, y0, x1, y1) that touch or overlap, columns prefixed.

    Boxes are dealt to the cells they touch and meet by equality of cells; a pair
    counts in the cell of its intersection's lower corner only.  `salts` copies the
    right side so that crowded cells spread over that many tasks.
    """
    def dealt(df: DataFrame, prefix: str) -> DataFrame:
        out = df.select(*[F.col(c).alias(prefix + c) for c in df.columns])
        return out.withColumn("__cell", F.explode(cells_of([F.col(prefix + c) for c in BOX], size)))

    a, b = dealt(left, prefixes[0]), dealt(right, prefixes[1])
    keys = ["__cell"]
    if salts > 1:
        a = a.withColumn("__salt", F.pmod(F.xxhash64(*[F.col(prefixes[0] + c) for c in left.columns]), F.lit(salts)).cast("int"))
        b = b.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        keys = ["__cell", "__salt"]
    both = a.join(b, keys)
    box_a, box_b = [F.col(prefixes[0] + c) for c in BOX], [F.col(prefixes[1] + c) for c in BOX]
    owner = (F.floor(F.greatest(box_a[0], box_b[0]) / size) == F.col("__cell.cx")) & (F.floor(F.greatest(box_a[1], box_b[1]) / size) == F.col("__cell.cy"))
    return both.where(quad.overlaps(box_a, box_b) & owner).drop(*keys)


def bounded_sample(df: DataFrame, group: list[str], by: Column, most: int = 10) -> DataFrame:
    """At most `most` rows of each group, first by the given order; the sampling operator of the matcher."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*group).orderBy(by))).where(F.col("__n") <= most).drop("__n")


def common_extent(boxes: DataFrame, keys: list[str]) -> DataFrame:
    """Intersection of all boxes of a key; null where they are disjoint."""
    out = boxes.groupBy(*keys).agg(F.max("x0").alias("x0"), F.max("y0").alias("y0"), F.min("x1").alias("x1"), F.min("y1").alias("y1"))
    empty = (F.col("x0") > F.col("x1")) | (F.col("y0") > F.col("y1"))
    return out.select(*keys, *[F.when(~empty, F.col(c)).alias(c) for c in BOX])


def limit_area(extents: DataFrame, areas: DataFrame, keys: list[str]) -> DataFrame:
    """Extents cut to their area of interest: kept whole without one, null if disjoint."""
    other = areas.select(*keys, *[F.col(c).alias(f"__{c}") for c in BOX], F.lit(True).alias("__has"))
    out = extents.join(other, keys, "left")
    cut = {"x0": F.greatest("x0", "__x0"), "y0": F.greatest("y0", "__y0"), "x1": F.least("x1", "__x1"), "y1": F.least("y1", "__y1")}
    empty = (cut["x0"] > cut["x1"]) | (cut["y0"] > cut["y1"])
    return out.select(*keys, *[F.when(F.col("__has").isNull(), F.col(c)).when(~empty, cut[c]).alias(c) for c in BOX])


def finest(inputs: DataFrame, keys: list[str], step: str, order: str) -> DataFrame:
    """The input with the smallest positive pixel step of each key, the first in order of equal ones."""
    size = F.abs(F.col(step))
    return inputs.where(size > 0).groupBy(*keys).agg(F.min_by(order, F.struct(size, F.col(order))).alias("base"), F.min(size).alias("step"))


def owned_cells(boxes: DataFrame, order: str, size: int) -> DataFrame:
    """cx, cy, owner: the first scene in order owns each cell that it covers in full extent of whole cells."""
    cells = boxes.withColumn("__cell", F.explode(_inner_cells(size)))
    return cells.groupBy("__cell").agg(F.min(order).alias("owner")).select("__cell.cx", "__cell.cy", "owner")


def _inner_cells(size: int) -> Column:
    """Cells whose lower corner lies in the half-open box."""
    xs = F.sequence(F.ceil(F.col("x0") / size), F.ceil(F.col("x1") / size) - 1)
    ys = F.sequence(F.ceil(F.col("y0") / size), F.ceil(F.col("y1") / size) - 1)
    some = (F.ceil(F.col("x0") / size) < F.ceil(F.col("x1") / size)) & (F.ceil(F.col("y0") / size) < F.ceil(F.col("y1") / size))
    grid = F.flatten(F.transform(xs, lambda x: F.transform(ys, lambda y: F.struct(x.alias("cx"), y.alias("cy")))))
    return F.when(some, grid).otherwise(F.array().cast("array<struct<cx:bigint,cy:bigint>>"))


def burned(boxes: DataFrame, code: str, order: str, size: int) -> DataFrame:
    """cx, cy, code: class boxes burned on a grid, later ones over earlier ones."""
    cells = boxes.withColumn("__cell", F.explode(_inner_cells(size)))
    return cells.groupBy("__cell").agg(F.max_by(code, order).alias("code")).select("__cell.cx", "__cell.cy", "code")


def grouped(features: DataFrame, code: str, value: str) -> DataFrame:
    """code, n and the sorted list of values of each class: for layers whose classes fit in a row."""
    return features.groupBy(code).agg(F.count("*").alias("n"), F.array_sort(F.collect_list(value)).alias("items"))


def change_pairs(layer: DataFrame, scenes: DataFrame, key: str, before: str = "before", after: str = "after") -> DataFrame:
    """Features of a change layer with the columns of the scene that they belong to: change ("before-after") and output (1 if they differ).

    A null class counts as one of its own; features without a scene go.
    """
    same = F.col(before).eqNullSafe(F.col(after))
    rows = layer.join(scenes, key)
    return rows.withColumn("change", F.concat(F.coalesce(F.col(before), F.lit("")), F.lit("-"), F.coalesce(F.col(after), F.lit("")))).withColumn("output", F.when(same, 0).otherwise(1))


def paired_windows(windows: DataFrame, inputs: DataFrame, key: str, size: float) -> DataFrame:
    """Each window with the other inputs of its key whose extent it touches: where it lies in their pixels.

    windows: id, key and box in map units; inputs: id, key, gt (six numbers), width, height.
    Gives window_id, input_id, x, y, w, h (pixels, as far as the window goes) and inside, true
    if the input covers it whole.
    """
    extent = affine.pixel_rect_to_box([F.col("gt")[k] for k in range(6)], F.lit(0), F.lit(0), F.col("width"), F.col("height"))
    placed = inputs.select("id", key, "gt", "width", "height", *[v.alias(c) for v, c in zip(extent, BOX, strict=True)])
    both = overlap_join(windows.select("id", key, *BOX), placed, size).where(F.col(f"a_{key}") == F.col(f"b_{key}"))
    rect = affine.box_to_pixel_rect([F.col("b_gt")[k] for k in range(6)], [F.col(f"a_{c}") for c in BOX])
    out = both.select(F.col("a_id").alias("window_id"), F.col("b_id").alias("input_id"), *[v.alias(n) for v, n in zip(rect, "xywh", strict=True)], "b_width", "b_height")
    inside = (F.col("x") >= 0) & (F.col("y") >= 0) & (F.col("x") + F.col("w") <= F.col("b_width")) & (F.col("y") + F.col("h") <= F.col("b_height"))
    return out.withColumn("inside", inside).drop("b_width", "b_height")
