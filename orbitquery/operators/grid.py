"""Row-producing operators: tile grids, splits, windows and sequential ids."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..tables import Table, free_name

CUT, OVERLAP, DROP_LAST = 512, 0.1, 0.2


def clamp_cut(cut: int, width: Column, height: Column) -> Column:
    """A cut no larger than the image's sides rounded down to multiples of 128."""
    return F.least(F.lit(cut), F.floor(height / 128) * 128, F.floor(width / 128) * 128).cast("int")


def axis_offsets(start: Column, extent: Column, cut: Column, overlap: float = OVERLAP, drop_last: float | None = DROP_LAST) -> Column:
    """Window starts along one axis: steps of the cut less the overlap, and the last one flush with the end.

    A last start nearer to the one before it than `drop_last` of a cut is left out.
    """
    step = F.greatest((cut * F.lit(1 - overlap)).cast("int"), F.lit(1))
    last = (start + extent - cut).cast("int")
    steps = F.when(extent > cut, F.filter(F.sequence(start.cast("int"), F.greatest(last, start.cast("int")), step), lambda v: v < last)).otherwise(F.array().cast("array<int>"))
    every = F.when(cut > extent, F.array(start.cast("int"))).otherwise(F.concat(steps, F.array(last)))
    if drop_last is None:
        return every
    gap = F.try_element_at(every, F.lit(-1)) - F.try_element_at(every, F.lit(-2))
    return F.when((F.size(every) > 1) & (F.abs(gap) / cut.cast("double") < drop_last), F.slice(every, F.lit(1), F.size(every) - 1)).otherwise(every)


def tile_grid(scenes: DataFrame, width: str = "width", height: str = "height", cut: Column | int = CUT, overlap: float = OVERLAP, drop_last: float | None = DROP_LAST) -> DataFrame:
    """scenes with stx and sty: one row for each window, x outside, y inside."""
    size = F.lit(cut) if isinstance(cut, int) else cut
    xs = axis_offsets(F.lit(0), F.col(width), size, overlap, drop_last)
    ys = axis_offsets(F.lit(0), F.col(height), size, overlap, drop_last)
    return scenes.withColumn("cut", size.cast("int")).withColumn("stx", F.explode(xs)).withColumn("sty", F.explode(ys))


def _ordered(df: DataFrame, order: Sequence[str]) -> tuple[DataFrame, str, str]:
    """The rows in order, written once, with the part and the place in it as columns (and their names).

    Parts are ranges of the order, so a part's rows all come before the next part's.  They
    are settled by writing: whatever reads them sees the same parts.
    """
    part, place = free_name(df, "part"), free_name(df, "place")
    # The upper bits of a row's running number are its partition, the lower ones its place there.
    number = F.monotonically_increasing_id()
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(place, number)
    rows = rows.withColumn(part, F.shiftright(place, 33).cast("int")).withColumn(place, F.col(place).bitwiseAND(F.lit((1 << 33) - 1)))
    return Table(rows, "ordered").df, part, place


def _starts(totals: DataFrame, part: str, total: str, start: str) -> DataFrame:
    """part and what all parts before it hold; one row for each range partition, however many rows they have."""
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    return F.broadcast(totals.select(part, F.coalesce(F.sum(total).over(before), F.lit(0)).alias(start)))


def sequential_ids(df: DataFrame, order: Sequence[str], name: str = "id") -> DataFrame:
    """Numbers 0, 1, ... in the given order: one range shuffle, and a count for each of its parts.

    Rows that are equal in the order are numbered one after the other, in any order.
    """
    rows, part, place = _ordered(df, order)
    total, start = free_name(rows, "total"), free_name(rows, "start")
    starts = _starts(rows.groupBy(part).agg(F.count("*").alias(total)), part, total, start)
    return rows.join(starts, part).withColumn(name, (F.col(start) + F.col(place)).cast("long")).select(*df.columns, name)


def numbered_tiles(scenes: DataFrame, order: Sequence[str], width: str = "width", height: str = "height", cut: Column | int = CUT, overlap: float = OVERLAP,
                   drop_last: float | None = DROP_LAST, name: str = "id") -> DataFrame:
    """tile_grid() with ids 0, 1, ... by scene in the given order, then by stx and sty.

    A scene's tiles are its starts along x times those along y, so only scenes are ordered
    and summed up; tiles get their ids where they are made, without a shuffle.
    """
    size = F.lit(cut) if isinstance(cut, int) else cut
    part, place, total, start, first, xs, ys, x, y, ix = (free_name(scenes, n) for n in ("part", "place", "total", "start", "first", "xs", "ys", "x", "y", "ix"))
    axes = scenes.withColumn("cut", size.cast("int"))
    axes = axes.withColumn(xs, axis_offsets(F.lit(0), F.col(width), F.col("cut"), overlap, drop_last)).withColumn(ys, axis_offsets(F.lit(0), F.col(height), F.col("cut"), overlap, drop_last))
    rows, part, place = _ordered(axes, order)
    tiles = (F.size(xs) * F.size(ys)).cast("long")
    starts = _starts(rows.groupBy(part).agg(F.sum(tiles).alias(total)), part, total, start)
    inside = Window.partitionBy(part).orderBy(place).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn(first, F.coalesce(F.sum(tiles).over(inside), F.lit(0))).join(starts, part)
    rows = rows.withColumn(first, F.col(first) + F.col(start))
    rows = rows.select("*", F.posexplode(xs).alias(ix, "stx"))
    rows = rows.select("*", F.posexplode(ys).alias(y, "sty"))
    return rows.withColumn(name, F.col(first) + F.col(ix) * F.size(ys) + F.col(y)).select(*[c for c in scenes.columns if c != "cut"], "cut", "stx", "sty", name)


def with_levels(df: DataFrame, levels: Sequence[int], cut: int = CUT) -> DataFrame:
    """Each row at each pyramid level, with the cut at full resolution."""
    return df.withColumn("level", F.explode(F.array(*[F.lit(v) for v in levels]))).withColumn("level_cut", (F.pow(F.lit(2.0), F.col("level")) * cut).cast("int"))


def centred_window(low: Column, high: Column, size: float, least: Column, most: Column) -> tuple[Column, Column]:
    """An interval shorter than `size` (or than the bounds, if these are shorter) widened to that length.

    It keeps its middle as far as the bounds allow; a longer interval stays as it is.
    """
    length = F.least(F.lit(float(size)), most - least)
    start = F.greatest(least, F.least(most - length, (low + high - length) / 2.0))
    widen = high - low < length
    return F.when(widen, start).otherwise(low), F.when(widen, start + length).otherwise(high)


def aspect_split(chips: DataFrame, width: str = "width", height: str = "height", ratio: float = 1.7) -> DataFrame:
    """Square pieces along the longer side of chips at least `ratio` times as long as wide; others stay whole.

    Adds part (null for whole chips), the piece's box and where the chip's corners lie seen from it.
    """
    w, h = F.col(width), F.col(height)
    long, short = F.greatest(w, h), F.least(w, h)
    pieces = F.when(long / short < ratio, F.array(F.lit(-1))).otherwise(F.sequence(F.lit(0), F.rint(long / short).cast("int") - 1))
    out = chips.withColumn("__p", F.explode(pieces))
    at = F.when(F.col("__p") < 0, 0).otherwise(F.least(F.col("__p") * short, long - short)).cast("int")
    size = F.when(F.col("__p") < 0, long).otherwise(short).cast("int")
    tall = h > w
    out = out.withColumn("x0", F.when(tall, 0).otherwise(at)).withColumn("y0", F.when(tall, at).otherwise(0))
    out = out.withColumn("x1", F.when(tall, w).otherwise(F.col("x0") + size).cast("int")).withColumn("y1", F.when(tall, F.col("y0") + size).otherwise(h).cast("int"))
    out = out.withColumn("cx0", -F.col("x0")).withColumn("cy0", -F.col("y0")).withColumn("cx1", w - F.col("x0")).withColumn("cy1", h - F.col("y0"))
    return out.withColumn("part", F.when(F.col("__p") >= 0, F.col("__p"))).drop("__p")


def block_split(chips: DataFrame, width: str = "width", height: str = "height", cut: int = 512) -> DataFrame:
    """Blocks of `cut`; edge blocks move back to fit, and go if over half of them is outside.

    A chip smaller than a block on some side gives its whole extent there.
    """

    def axis(n: Column) -> Column:
        starts = F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(cut)), lambda v: F.struct(
            F.when(v + cut > n, n - cut - 1).otherwise(v).cast("int").alias("a"), F.when(v + cut > n, n - 1).otherwise(v + cut).cast("int").alias("b"), ((v + cut - n) / cut).alias("out")))
        kept = F.filter(starts, lambda s: s["out"] <= 0.5)
        whole = F.array(F.struct(F.lit(0).alias("a"), n.cast("int").alias("b"), F.lit(0.0).alias("out")))
        return F.when(n <= cut, whole).otherwise(kept)

    out = chips.withColumn("__x", F.explode(axis(F.col(width)))).withColumn("__y", F.explode(axis(F.col(height))))
    return out.select(*chips.columns, F.col("__x.a").alias("x0"), F.col("__y.a").alias("y0"), F.col("__x.b").alias("x1"), F.col("__y.b").alias("y1"))


def chip_levels(chips: DataFrame, levels: Sequence[int], base: float, least: int = 250, width: str = "width", height: str = "height", res: str = "res") -> DataFrame:
    """Each chip at the levels it is written to: no enlarging, and none below the one whose shorter side falls under `least`.

    A level is told by its own arithmetic: sides shrink from level to level, so it is enough
    that the level before it is an enlargement or still long enough.  Equal chips each get
    all of theirs.
    """
    rising = sorted(levels)
    step = free_name(chips, "step")
    pairs = [F.struct(F.lit(v).alias("level"), F.lit(before).cast("int").alias("before")) for v, before in zip(rising, [None, *rising], strict=False)]
    out = chips.withColumn(step, F.explode(F.array(*pairs)))

    def scale(level: Column) -> Column:
        return F.col(res) / (F.lit(float(base)) * F.pow(F.lit(2.0), level))

    def side(name: str, by: Column) -> Column:
        return F.rint(F.col(name) * by).cast("int")

    earlier = scale(F.col(f"{step}.before"))
    goes_on = F.col(f"{step}.before").isNull() | (earlier > 1.0) | (F.least(side(width, earlier), side(height, earlier)) >= least)
    out = out.where((scale(F.col(f"{step}.level")) <= 1.0) & goes_on).withColumn("level", F.col(f"{step}.level")).withColumn("scale", scale(F.col("level")))
    return out.withColumn("out_width", side(width, F.col("scale"))).withColumn("out_height", side(height, F.col("scale"))).drop(step)


def tile_range(df: DataFrame, x0: str, y0: str, x1: str, y1: str) -> DataFrame:
    """One row for each map tile of a range, with x, y and its place ix, iy in it; a range without tiles gives none."""
    some = (F.col(x0) <= F.col(x1)) & (F.col(y0) <= F.col(y1))
    out = df.where(some).withColumn("ix", F.explode(F.sequence(F.lit(0).cast("long"), F.col(x1) - F.col(x0)))).withColumn("iy", F.explode(F.sequence(F.lit(0).cast("long"), F.col(y1) - F.col(y0))))
    return out.withColumn("x", F.col(x0) + F.col("ix")).withColumn("y", F.col(y0) + F.col("iy"))


def rotations(df: DataFrame) -> DataFrame:
    return df.withColumn("rot", F.explode(F.array(*[F.lit(k) for k in range(4)])))


def neighbourhood(df: DataFrame, x: str, y: str, size: int) -> DataFrame:
    """The size x size cells around a point, with their place in the window."""
    half = size // 2
    out = df.withColumn("dy", F.explode(F.sequence(F.lit(-half), F.lit(half)))).withColumn("dx", F.explode(F.sequence(F.lit(-half), F.lit(half))))
    return out.withColumn("nx", F.col(x) + F.col("dx")).withColumn("ny", F.col(y) + F.col("dy"))
