"""One query for each operator family, with the SQL that it is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import affine, mercator, names, quad, vector
from ..operators import grid, homography, matching, raster, search, selection, sizes, spatial
from ..sources import files, geojson, sinks
from . import fixtures as fx
from . import matching as plan
from .fixtures import with_sql

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _round(df: DataFrame, *columns: str, places: int = 6) -> DataFrame:
    # Adding zero turns -0.0 into 0.0.
    return df.withColumns({c: F.round(c, places) + F.lit(0.0) for c in columns})


_UNIT = "e AS (SELECT vec_id, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) AS u FROM vectors)"
_RANKED = f"""{with_sql('vectors')}, {_UNIT},
d AS (SELECT q.vec_id AS query_id, b.vec_id AS tile_id, list_sum(list_transform(list_zip(q.u, b.u), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d2 FROM e q, e b WHERE q.vec_id % 20 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(d2, 9), tile_id) AS INTEGER) AS rank, tile_id, round(d2, 6) AS d2 FROM d)
SELECT query_id, rank, tile_id, d2 FROM r"""


@query(_RANKED + " WHERE rank <= 10")
def knn_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = fx.table(spark, sf_dir, "embeddings")
    return _round(search.rank_tiles(base, base.where("vec_id % 20 = 0"), k=10), "d2")


@query(_RANKED)
def rank_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = fx.table(spark, sf_dir, "embeddings")
    return search.rank_tiles(base, base.where("vec_id % 20 = 0"), places=6)


@query(f"""{with_sql('vectors')}, l AS (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) - 1 AS pos FROM vectors)
SELECT label, CAST(pos AS INTEGER) AS pos, round(avg(x), 6) + 0.0 AS mean FROM l GROUP BY label, pos""")
def centroid_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(search.pooled(fx.vectors(spark, sf_dir), "label", "v"), "mean")


@query(f"""{with_sql('vectors')}, t AS (SELECT vec_id AS tile_id, CAST(vec_id % 4 AS INTEGER) AS level, v FROM vectors),
r AS (SELECT vec_id AS tile_id, row_number() OVER (ORDER BY vec_id * 7919 % 10007, vec_id) AS rank FROM vectors)
SELECT t.tile_id, r.rank, p.p_size AS sty, CAST(k - 1 AS INTEGER) AS pos, round(t.v[k], 6) + 0.0 AS f FROM t JOIN r USING (tile_id) JOIN part p ON p.p_partkey = t.tile_id, (SELECT unnest(range(1, 65)) AS k) WHERE t.level = 2""")
def feature_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles and whole feature vectors of one level, for a ranking, with the rank."""
    ids = fx.vectors(spark, sf_dir)
    features = ids.select(F.col("vec_id").alias("tile_id"), (F.col("vec_id") % 4).cast("int").alias("level"), "v")
    tiles = fx.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % 4).cast("int").alias("level"), F.col("p_size").alias("sty"))
    ranked = grid.sequential_ids(ids.select(F.col("vec_id").alias("tile_id"), (F.col("vec_id") * 7919 % 10007).alias("d2")), ["d2", "tile_id"], "rank").withColumn("rank", F.col("rank") + 1)
    found = search.features_in_rank_order(ranked, tiles, features, level=2)
    return _round(found.select("tile_id", "rank", "sty", F.posexplode("v").alias("pos", "f")), "f")


@query(f"""{with_sql('vectors')} SELECT vec_id, CAST(k - 1 AS INTEGER) AS pos, round((v[k] * 100 / 255 - [0.485, 0.456, 0.406][(k - 1) % 3 + 1]) / [0.229, 0.224, 0.225][(k - 1) % 3 + 1], 6) + 0.0 AS x
FROM vectors, (SELECT unnest(range(1, 65)) AS k)""")
def pixel_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    pixels = fx.vectors(spark, sf_dir).select("vec_id", F.transform("v", lambda x: x * 100).alias("p"))
    out = vector.pixel_normalised(F.col("p"), (0.485, 0.456, 0.406), (0.229, 0.224, 0.225))
    return _round(pixels.select("vec_id", F.posexplode(out).alias("pos", "x")), "x")


def _both(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    v = fx.vectors(spark, sf_dir).withColumn("v", vector.normalised(F.col("v")))
    left = v.where("vec_id % 2 = 0").select("label", F.col("vec_id").alias("i"), "v")
    return left, v.where("vec_id % 2 = 1").select("label", F.col("vec_id").alias("j"), "v")


def _sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.similarities(*_both(spark, sf_dir), "label")


_SIMS = f"""{with_sql('vectors')}, u AS (SELECT vec_id, label, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) AS v FROM vectors),
s AS (SELECT a.label, a.vec_id AS i, b.vec_id AS j, list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2])) AS dot FROM u a JOIN u b ON a.label = b.label WHERE a.vec_id % 2 = 0 AND b.vec_id % 2 = 1)"""
_CONF = f"""{_SIMS}, x AS (SELECT *, exp(dot / 0.05) AS e FROM s),
c AS (SELECT label, i, j, e / sum(e) OVER (PARTITION BY label, i) * e / sum(e) OVER (PARTITION BY label, j) AS conf FROM x)"""


@query(f"""{_CONF}, m AS (SELECT *, row_number() OVER (PARTITION BY label, i ORDER BY conf DESC, j) AS rn, max(conf) OVER (PARTITION BY label, j) AS cm FROM c)
SELECT label, i, j, round(conf, 6) AS conf FROM m WHERE rn = 1 AND conf = cm AND conf > 0.2""")
def mutual_nn_softmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    conf = matching.double_softmax(_sides(spark, sf_dir), "label", temperature=0.05)
    return _round(matching.mutual_nearest(conf, "label").select("label", "i", "j", "conf"), "conf")


@query(f"""{_SIMS}, k0 AS (SELECT *, exp((dot - max(dot) OVER (PARTITION BY label)) / 0.1) AS p FROM s),
a1 AS (SELECT label, i, j, p / sum(p) OVER (PARTITION BY label, i) AS p FROM k0), b1 AS (SELECT label, i, j, p / sum(p) OVER (PARTITION BY label, j) AS p FROM a1),
a2 AS (SELECT label, i, j, p / sum(p) OVER (PARTITION BY label, i) AS p FROM b1), b2 AS (SELECT label, i, j, p / sum(p) OVER (PARTITION BY label, j) AS p FROM a2),
a3 AS (SELECT label, i, j, p / sum(p) OVER (PARTITION BY label, i) AS p FROM b2), b3 AS (SELECT label, i, j, p / sum(p) OVER (PARTITION BY label, j) AS p FROM a3)
SELECT label, i, j, round(p, 6) AS conf FROM b3""")
def sinkhorn3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(matching.sinkhorn(_sides(spark, sf_dir), "label", 3).select("label", "i", "j", "conf"), "conf")


@query("""WITH h AS (SELECT CAST((max(vec_id) + 1) // 10 AS BIGINT) AS rows FROM embeddings)
SELECT vec_id, vec_id % 10 * 8 AS px, vec_id // 10 * 8 AS py FROM embeddings, h WHERE vec_id % 10 BETWEEN 2 AND 7 AND vec_id // 10 BETWEEN 2 AND rows - 3""")
def border_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = fx.table(spark, sf_dir, "embeddings").select("vec_id")
    rows = (v.agg(F.max("vec_id").alias("m")).first()["m"] + 1) // 10
    x, y = matching.cell_to_pixel(F.col("vec_id"), 10, 8)
    return v.where(matching.off_border(F.col("vec_id"), 10, rows)).select("vec_id", x.cast("long").alias("px"), y.cast("long").alias("py"))


@query(f"""{with_sql('vectors')}, l AS (SELECT vec_id, unnest(v) AS x, generate_subscripts(v, 1) - 1 AS pos FROM vectors),
p AS (SELECT vec_id, pos, exp(x / 0.1) / sum(exp(x / 0.1)) OVER (PARTITION BY vec_id) AS p, pos % 8 / 3.5::DOUBLE - 1 AS gx, pos // 8 / 3.5::DOUBLE - 1 AS gy FROM l),
s AS (SELECT vec_id, sum(p * gx) AS ex, sum(p * gy) AS ey, sum(p * gx * gx) AS xx, sum(p * gy * gy) AS yy FROM p GROUP BY vec_id)
SELECT vec_id, round(ex, 6) + 0.0 AS ex, round(ey, 6) + 0.0 AS ey, round(sqrt(greatest(xx - ex * ex, 1e-10)) + sqrt(greatest(yy - ey * ey, 1e-10)), 6) AS std,
  round(vec_id % 10 * 8 + ex * 4 * 2, 6) + 0.0 AS x1, round(vec_id // 10 * 8 + ey * 4 * 2, 6) + 0.0 AS y1 FROM s""")
def fine_expectation(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = fx.vectors(spark, sf_dir)
    heat = v.select("vec_id", F.transform("v", lambda x: F.exp(x / 0.1)).alias("e"))
    heat = heat.withColumn("total", F.aggregate("e", F.lit(0.0), lambda s, x: s + x)).select("vec_id", "total", F.posexplode("e").alias("pos", "x"))
    found = matching.expectation(heat.select("vec_id", "pos", (F.col("x") / F.col("total")).alias("p")), ["vec_id"], 8)
    x, y = matching.cell_to_pixel(F.col("vec_id"), 10, 8)
    coarse = v.select("vec_id", x.cast("double").alias("x1"), y.cast("double").alias("y1"))
    return _round(matching.refine(coarse, found, ["vec_id"], 8, 2.0).select("vec_id", "ex", "ey", "std", "x1", "y1"), "ex", "ey", "std", "x1", "y1")


@query("""SELECT vec_id, CAST(dx AS INTEGER) AS dx, CAST(dy AS INTEGER) AS dy, vec_id % 10 + dx AS nx, vec_id // 10 + dy AS ny FROM embeddings,
(SELECT unnest(range(-2, 3)) AS dx), (SELECT unnest(range(-2, 3)) AS dy)""")
def window_unfold(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = fx.table(spark, sf_dir, "embeddings").selectExpr("vec_id", "vec_id % 10 AS x", "vec_id div 10 AS y")
    return grid.neighbourhood(v, "x", "y", 5).select("vec_id", "dx", "dy", "nx", "ny")


@query("SELECT l_returnflag, CAST(sum(least(l_linenumber * 3 * (l_suppkey % 5), l_linenumber * l_partkey % 11)) AS BIGINT) AS most FROM lineitem GROUP BY 1")
def most_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    masks = fx.table(spark, sf_dir, "lineitem").selectExpr("l_returnflag", "l_linenumber * 3 AS h0", "l_suppkey % 5 AS w0", "l_linenumber * l_partkey % 11 AS h1", "1 AS w1")
    return masks.groupBy("l_returnflag").agg(matching.most_candidates(masks).cast("long").alias("most"))


def _axis_sql(extent: str, cut: str) -> str:
    """Starts along an axis, by the definition: steps, the last start, less a last one too near."""
    step = f"greatest(CAST(trunc({cut} * (1 - 0.1::DOUBLE)) AS INTEGER), 1)"
    full = f"CASE WHEN {cut} > {extent} THEN [0] ELSE list_append(range(0, {extent} - {cut}, {step}), {extent} - {cut}) END"
    return f"(SELECT CASE WHEN len(f) > 1 AND (f[len(f)] - f[len(f) - 1]) / {cut} < 0.2 THEN f[1:len(f) - 1] ELSE f END FROM (SELECT {full} AS f))"


def _grid_sql(source: str, cut: str) -> str:
    return f"SELECT s.*, CAST(x AS INTEGER) AS stx, CAST(y AS INTEGER) AS sty FROM (SELECT *, {cut} AS cut FROM {source}) s, unnest({_axis_sql('width', 'cut')}) AS a(x), unnest({_axis_sql('height', 'cut')}) AS b(y)"


@query(f"""{with_sql('scenes')}, g AS ({_grid_sql('scenes', '512')})
SELECT row_number() OVER (ORDER BY scene_id, stx, sty) - 1 AS id, scene_id, stx, sty FROM g""")
def tile_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.numbered_tiles(fx.scenes(spark, sf_dir), ["scene_id"]).select("id", "scene_id", "stx", "sty")


_CLAMPED = "CAST(least(512, height // 128 * 128, width // 128 * 128) AS INTEGER)"


@query(f"{with_sql('small_scenes')}, g AS ({_grid_sql('small_scenes', _CLAMPED)}) SELECT scene_id, cut, stx, sty FROM g")
def tile_grid_clamped(spark: SparkSession, sf_dir: str) -> DataFrame:
    scenes = fx.scenes(spark, sf_dir, small=True)
    return grid.tile_grid(scenes, cut=grid.clamp_cut(512, F.col("width"), F.col("height"))).select("scene_id", "cut", "stx", "sty")


_LEVELS = f"""{with_sql('scenes')}, l AS (SELECT s.*, level, CAST(512 * pow(2, level) AS INTEGER) AS lcut FROM scenes s, (SELECT CAST(unnest(range(3)) AS INTEGER) AS level)),
g AS ({_grid_sql('l', 'lcut')})"""


def _level_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    leveled = grid.with_levels(fx.scenes(spark, sf_dir), (0, 1, 2))
    return grid.tile_grid(leveled, cut=F.col("level_cut"))


@query(f"{_LEVELS} SELECT level, scene_id, stx, sty, CAST(trunc(stx / pow(2, level)) AS INTEGER) AS lx, CAST(trunc(sty / pow(2, level)) AS INTEGER) AS ly FROM g")
def tile_grid_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows at each level with their start in the overview's own pixels, cut to whole ones."""
    scale = F.pow(F.lit(2.0), F.col("level"))
    tiles = _level_tiles(spark, sf_dir)
    return tiles.select("level", "scene_id", "stx", "sty", (F.col("stx") / scale).cast("int").alias("lx"), (F.col("sty") / scale).cast("int").alias("ly"))


@query(f"{_LEVELS} SELECT level, count(*) AS n FROM g GROUP BY level")
def counts_by_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _level_tiles(spark, sf_dir).groupBy("level").agg(F.count("*").alias("n"))


def _centred_sql(a: str, b: str, most: str) -> tuple[str, str]:
    w = f"least(300.0, CAST({most} AS DOUBLE))"
    start = f"greatest(0, least({most} - {w}, ({a} + {b} - {w}) / 2))"
    return f"CASE WHEN {b} - {a} < {w} THEN {start} ELSE {a} END", f"CASE WHEN {b} - {a} < {w} THEN {start} + {w} ELSE {b} END"


_CX, _CY = _centred_sql("ix0", "ix1", "width"), _centred_sql("iy0", "iy1", "height")


@query(f"""{with_sql('scenes', 'boxes')}, s AS (SELECT *, scene_id * 6000 AS ox FROM scenes), f AS (SELECT id, x0 + id * 120000 AS x0, y0, x1 + id * 120000 AS x1, y1 FROM boxes),
j AS (SELECT s.scene_id, f.id, s.width, s.height, CAST(greatest(f.x0 - ox, 0) AS DOUBLE) AS ix0, CAST(greatest(f.y0, 0) AS DOUBLE) AS iy0, CAST(least(f.x1 - ox, s.width) AS DOUBLE) AS ix1, CAST(least(f.y1, s.height) AS DOUBLE) AS iy1
  FROM s JOIN f ON f.x0 <= ox + s.width AND f.x1 >= ox AND f.y0 <= s.height AND f.y1 >= 0)
SELECT scene_id, id, {_CX[0]} AS wx0, {_CY[0]} AS wy0, {_CX[1]} AS wx1, {_CY[1]} AS wy1 FROM j WHERE (ix1 - ix0) * (iy1 - iy0) >= 500""")
def grid_feature_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One window for each vector feature that overlaps a scene by 500 pixels at least; scenes stand in a row, a feature in each 20th."""
    scenes = fx.scenes(spark, sf_dir).selectExpr("scene_id", "width", "height", "scene_id * 6000 AS x0", "0L AS y0", "scene_id * 6000 + width AS x1", "CAST(height AS BIGINT) AS y1")
    features = fx.boxes(spark, sf_dir).selectExpr("id", "x0 + id * 120000 AS x0", "y0", "x1 + id * 120000 AS x1", "y1")
    pairs = spatial.overlap_join(scenes, features, 2048)
    origin = {"x": F.col("a_x0"), "y": F.lit(0)}
    low = {c: F.greatest(F.col(f"b_{c}0") - origin[c], F.lit(0)).cast("double") for c in "xy"}
    high = {c: F.least(F.col(f"b_{c}1") - origin[c], F.col(n)).cast("double") for c, n in (("x", "a_width"), ("y", "a_height"))}
    pairs = pairs.where((high["x"] - low["x"]) * (high["y"] - low["y"]) >= 500)
    wx = grid.centred_window(low["x"], high["x"], 300, F.lit(0.0), F.col("a_width").cast("double"))
    wy = grid.centred_window(low["y"], high["y"], 300, F.lit(0.0), F.col("a_height").cast("double"))
    return pairs.select(F.col("a_scene_id").alias("scene_id"), F.col("b_id").alias("id"), wx[0].alias("wx0"), wy[0].alias("wy0"), wx[1].alias("wx1"), wy[1].alias("wy1"))


@query(f"""{with_sql('chips')}, k AS (SELECT *, greatest(width, height) AS l, least(width, height) AS s FROM chips),
p AS (SELECT chip_id, width, height, NULL::INTEGER AS part, 0 AS a, l AS size FROM k WHERE l / s < 1.7
  UNION ALL SELECT chip_id, width, height, CAST(i AS INTEGER), CAST(least(i * s, l - s) AS INTEGER), s FROM k, unnest(range(CAST(round_even(l / s, 0) AS BIGINT))) AS r(i) WHERE l / s >= 1.7)
SELECT chip_id, part, CASE WHEN height > width THEN 0 ELSE a END AS x0, CASE WHEN height > width THEN a ELSE 0 END AS y0,
  CASE WHEN height > width THEN width ELSE a + size END AS x1, CASE WHEN height > width THEN a + size ELSE height END AS y1,
  -(CASE WHEN height > width THEN 0 ELSE a END) AS cx0, width - (CASE WHEN height > width THEN 0 ELSE a END) AS cx1 FROM p""")
def chip_aspect_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.aspect_split(fx.chips(spark, sf_dir)).select("chip_id", "part", "x0", "y0", "x1", "y1", "cx0", "cx1")


def _block_sql(n: str, k: str) -> str:
    return f"unnest(CASE WHEN {n} <= 512 THEN [0] ELSE list_filter(range(0, {n}, 512), lambda v: (v + 512 - {n}) / 512 <= 0.5) END) AS {k}(v)"


@query(f"""{with_sql('scenes')} SELECT scene_id, CAST(CASE WHEN width <= 512 THEN 0 WHEN a.v + 512 > width THEN width - 513 ELSE a.v END AS INTEGER) AS x0, CAST(CASE WHEN height <= 512 THEN 0 WHEN b.v + 512 > height THEN height - 513 ELSE b.v END AS INTEGER) AS y0,
  CAST(CASE WHEN width <= 512 THEN width WHEN a.v + 512 > width THEN width - 1 ELSE a.v + 512 END AS INTEGER) AS x1, CAST(CASE WHEN height <= 512 THEN height WHEN b.v + 512 > height THEN height - 1 ELSE b.v + 512 END AS INTEGER) AS y1
FROM scenes, {_block_sql('width', 'a')}, {_block_sql('height', 'b')}""")
def chip_block_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.block_split(fx.scenes(spark, sf_dir)).select("scene_id", "x0", "y0", "x1", "y1")


@query(f"""{with_sql('chips')}, l AS (SELECT chip_id, name, level, CAST(split_part(replace(name, '.png', ''), '_', 3) AS DOUBLE) / 100 / (0.5 * pow(2, level)) AS scale, width, height FROM chips, (SELECT CAST(unnest(range(5)) AS INTEGER) AS level)),
o AS (SELECT *, CAST(round_even(width * scale, 0) AS INTEGER) AS out_width, CAST(round_even(height * scale, 0) AS INTEGER) AS out_height FROM l WHERE scale <= 1),
w AS (SELECT *, min(least(out_width, out_height)) OVER (PARTITION BY chip_id ORDER BY level ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM o)
SELECT chip_id, level, round(scale, 6) AS scale, out_width, out_height FROM w WHERE seen IS NULL OR seen >= 250""")
def chip_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    chips = fx.chips(spark, sf_dir).withColumn("res", names.resolution(F.col("name")))
    return _round(grid.chip_levels(chips, range(5), 0.5).select("chip_id", "level", "scale", "out_width", "out_height"), "scale")


@query(f"""{with_sql('chips')}, n AS (SELECT chip_id, CASE WHEN chip_id % 3 = 0 THEN '2-' || name ELSE name END AS file FROM chips)
SELECT chip_id, file, CASE WHEN contains(file, '-') THEN split_part(file, '-', 2) ELSE file END AS orgname, CASE WHEN contains(file, '-') THEN CAST(split_part(file, '-', 1) AS INTEGER) END AS part,
  CAST(split_part(regexp_replace(file, '\\.[^.]*$', ''), '_', 3) AS DOUBLE) / 100 AS res FROM n""")
def chip_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    chips = fx.chips(spark, sf_dir).select("chip_id", F.expr("CASE WHEN chip_id % 3 = 0 THEN concat('2-', name) ELSE name END").alias("file"))
    file = F.col("file")
    return chips.where(names.has_extension(file, [".PNG", ".jpg"])).select("chip_id", "file", names.original_name(file).alias("orgname"), names.part(file).alias("part"), names.resolution(file).alias("res"))


@query(f"""{with_sql('chips')} SELECT chip_id, rot, CAST(CASE rot WHEN 0 THEN width // 4 WHEN 1 THEN height - 1 - height // 5 WHEN 2 THEN width - 1 - width // 4 ELSE height // 5 END AS BIGINT) AS rx,
  CAST(CASE rot WHEN 0 THEN height // 5 WHEN 1 THEN width // 4 WHEN 2 THEN height - 1 - height // 5 ELSE width - 1 - width // 4 END AS BIGINT) AS ry FROM chips, (SELECT CAST(unnest(range(4)) AS INTEGER) AS rot)""")
def rotation_corners(spark: SparkSession, sf_dir: str) -> DataFrame:
    chips = grid.rotations(fx.chips(spark, sf_dir)).selectExpr("chip_id", "rot", "width div 4 AS x", "height div 5 AS y", "width - 1 AS w", "height - 1 AS h")
    rx, ry = affine.rotate_corner(F.col("rot"), F.col("x"), F.col("y"), F.col("w"), F.col("h"))
    return chips.select("chip_id", "rot", rx.cast("long").alias("rx"), ry.cast("long").alias("ry"))


@query(f"""{with_sql('points')}, g AS (SELECT event_id, px, py, 100 + px * 0.5::DOUBLE AS gx, 40 - py * 0.25::DOUBLE AS gy FROM points)
SELECT event_id, gx, gy, CAST(trunc(-100.2::DOUBLE / 0.7::DOUBLE + gx * (1 / 0.7::DOUBLE)) AS INTEGER) AS qx, CAST(trunc(-39.7::DOUBLE / -0.3::DOUBLE + gy * (1 / -0.3::DOUBLE)) AS INTEGER) AS qy,
  100 + px * 0.5::DOUBLE AS bx0, 40 - (py + 30) * 0.25::DOUBLE AS by0, 100 + (px + 20) * 0.5::DOUBLE AS bx1, 40 - py * 0.25::DOUBLE AS by1 FROM g""")
def pixel_geo_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = fx.points(spark, sf_dir)
    gt, other = affine.lit_gt(fx.GT), affine.lit_gt((100.2, 0.7, 0, 39.7, 0, -0.3))
    x, y = affine.pixel_to_geo(gt, F.col("px"), F.col("py"))
    qx, qy = affine.geo_to_pixel(other, x, y)
    box = affine.pixel_rect_to_box(gt, F.col("px"), F.col("py"), F.lit(20), F.lit(30))
    return points.select("event_id", x.alias("gx"), y.alias("gy"), qx.alias("qx"), qy.alias("qy"), *[v.alias(f"b{c}") for v, c in zip(box, spatial.BOX, strict=True)])


@query(f"""{with_sql('points')} SELECT event_id, 100 + px * 0.5::DOUBLE AS ox, 40 - py * 0.25::DOUBLE AS oy, px AS x, py AS y, 20 AS w, 30 AS h,
 100 + (px + 20) * 0.5::DOUBLE AS rx1, 40 - (py + 30) * 0.25::DOUBLE AS ry1, 2.0::DOUBLE AS ia, -200.0::DOUBLE AS ixoff FROM points""")
def window_transforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Origin of a window, its bounds as pixels again, and the inverse coefficients on a ring."""
    gt = affine.lit_gt(fx.GT)
    px, py = F.col("px"), F.col("py")
    shifted = affine.shift_origin(gt, px, py)
    box = affine.pixel_box_to_box(gt, [px, py, px + 20, py + 30])
    rect = affine.box_to_pixel_rect(gt, box)
    back = affine.inverse_axes(gt)
    ring = affine.ring_affine(F.array(F.struct(px.alias("x"), py.alias("y")), F.struct((px + 20).alias("x"), (py + 30).alias("y"))), gt[1], gt[2], gt[4], gt[5], gt[0], gt[3])
    out = fx.points(spark, sf_dir).select("event_id", shifted[0].alias("ox"), shifted[3].alias("oy"), *[v.cast(t).alias(n) for v, n, t in zip(rect, "xywh", ("long", "long", "int", "int"), strict=True)],
                                          ring[1]["x"].alias("rx1"), ring[1]["y"].alias("ry1"), back[0].alias("ia"), back[4].alias("ixoff"))
    return out


@query(f"""{with_sql('points', 'scenes')}, p AS (SELECT p.event_id, px * 3 AS x, py * 2 AS y, width, height FROM points p JOIN scenes ON scene_id = event_id)
SELECT event_id, greatest(x - 16, 0) AS x0, greatest(y - 16, 0) AS y0, least(x + 528, width) AS x1, least(y + 528, height) AS y1,
  greatest(16 - x, 0) AS pad_left, greatest(16 - y, 0) AS pad_top, greatest(x + 528 - width, 0) AS pad_right, greatest(y + 528 - height, 0) AS pad_bottom FROM p""")
def window_pad(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.points(spark, sf_dir).join(fx.scenes(spark, sf_dir), F.col("event_id") == F.col("scene_id"))
    pads = affine.window_pad(F.col("px") * 3, F.col("py") * 2, 512, 16, F.col("width"), F.col("height"))
    return rows.select("event_id", *[v.cast("long").alias(k) for k, v in pads.items()])


@query(f"""{with_sql('points', 'scenes')}, p AS (SELECT event_id, px * 3 AS x, py * 2 AS y, width, height FROM points JOIN scenes ON scene_id = event_id),
c AS (SELECT event_id, greatest(x, 0) AS x0, greatest(y, 0) AS y0, least(x + 333, width - 1) AS x1, least(y + 222, height - 1) AS y1 FROM p)
SELECT event_id, x0, y0, x0 + CAST(floor((x1 - x0) / 8) AS BIGINT) * 8 AS x1, y0 + CAST(floor((y1 - y0) / 8) AS BIGINT) * 8 AS y1 FROM c""")
def clip_to_factor(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.points(spark, sf_dir).join(fx.scenes(spark, sf_dir), F.col("event_id") == F.col("scene_id"))
    x, y = F.col("px") * 3, F.col("py") * 2
    box = affine.clip_box([x, y, x + 333, y + 222], F.col("width"), F.col("height"), 8)
    return rows.select("event_id", *[v.cast("long").alias(c) for v, c in zip(box, spatial.BOX, strict=True)])


@query(f"""{with_sql('points')} SELECT event_id, round_even(px * 0.3::DOUBLE * 8, 0) + 100 AS x0, round_even(py * 0.7::DOUBLE * 8, 0) + 50 AS y0, round_even(px * 0.9::DOUBLE * 8, 0) + 100 AS x1, round_even(py * 1.1::DOUBLE * 8, 0) + 50 AS y1 FROM points""")
def level_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    px, py = F.col("px"), F.col("py")
    box = affine.level_box([px * F.lit(0.3), py * F.lit(0.7), px * F.lit(0.9), py * F.lit(1.1)], F.lit(3), F.lit(100), F.lit(50))
    return fx.points(spark, sf_dir).select("event_id", *[v.alias(c) for v, c in zip(box, spatial.BOX, strict=True)])


@query(f"""{with_sql('chips')}, s AS (SELECT chip_id, width * 3 AS w, height * 3 AS h, greatest(width, height) * 3 AS l FROM chips),
t AS (SELECT *, CASE WHEN l <= 1400 THEN w WHEN h > w THEN CAST(trunc(1400 * w / h) AS INTEGER) ELSE 1400 END AS sw, CASE WHEN l <= 1400 THEN h WHEN h > w THEN 1400 ELSE CAST(trunc(1400 * h / w) AS INTEGER) END AS sh FROM s)
SELECT chip_id, CAST(sw // 14 * 14 AS INTEGER) AS sw, CAST(sh // 14 * 14 AS INTEGER) AS sh, CAST(floor(round_even(w * (1536.0::DOUBLE / l), 0) / 8) * 8 AS INTEGER) AS lw, CAST(floor(round_even(h * (1536.0::DOUBLE / l), 0) / 8) * 8 AS INTEGER) AS lh,
  CAST(round_even(sqrt(CAST((w - 7) * (w - 7) + 25 AS DOUBLE)), 0) AS INTEGER) AS dw, CAST(round_even(sqrt(CAST(h * h + 16 AS DOUBLE)), 0) AS INTEGER) AS dh FROM t""")
def resize_dims(spark: SparkSession, sf_dir: str) -> DataFrame:
    chips = fx.chips(spark, sf_dir).selectExpr("chip_id", "width * 3 AS w", "height * 3 AS h")
    w, h = F.col("w"), F.col("h")
    sw, sh = sizes.shrunk(w, h, 1400, 14)
    lw, lh = sizes.long_side(w, h, 1536, 8)
    corners = [(F.lit(0), F.lit(0)), (F.lit(4), h), (w - 3, h - 5), (w, F.lit(0))]
    dw, dh = sizes.deskewed(corners)
    return chips.select("chip_id", sw.alias("sw"), sh.alias("sh"), lw.alias("lw"), lh.alias("lh"), dw.alias("dw"), dh.alias("dh"))


_TILE_XY = """CAST(least(greatest(floor((lon + 180) / 360 * pow(2, z)), 0), pow(2, z) - 1) AS BIGINT) AS x,
  CAST(least(greatest(floor((1 - ln(tan(radians(lat)) + 1 / cos(radians(lat))) / pi()) / 2 * pow(2, z)), 0), pow(2, z) - 1) AS BIGINT) AS y"""


@query(f"""{with_sql('lonlat')}, t AS (SELECT event_id, z, {_TILE_XY} FROM (SELECT *, 18 AS z FROM lonlat))
SELECT event_id, x, y, CAST(pow(2, z) AS BIGINT) - y - 1 AS tms, round(x * (40075016.68557849::DOUBLE / pow(2, z)) - 20037508.342789244::DOUBLE, 3) AS xmin, round(20037508.342789244::DOUBLE - y * (40075016.68557849::DOUBLE / pow(2, z)), 3) AS ymax,
  round(40075016.68557849::DOUBLE / pow(2, z) / 256, 9) AS res FROM t""")
def xyz_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = F.lit(18)
    x, y = mercator.lonlat_to_tile(F.col("lon"), F.col("lat"), z)
    tiles = fx.lonlat(spark, sf_dir).select("event_id", x.alias("x"), y.alias("y"))
    box = mercator.tile_bounds(F.col("x"), F.col("y"), z)
    out = tiles.select("event_id", "x", "y", mercator.tms_row(F.col("y"), z).alias("tms"), box[0].alias("xmin"), box[3].alias("ymax"), F.round(mercator.ground_resolution(z), 9).alias("res"))
    return _round(out, "xmin", "ymax", places=3)


@query(f"""{with_sql('lonlat')}, b AS (SELECT event_id, lon, lat, least(lon + 0.05, 179.9) AS lon1, greatest(lat - 0.05, -84.9) AS lat1, 12 AS z FROM lonlat),
a AS (SELECT event_id, {_TILE_XY} FROM b), c AS (SELECT event_id, {_TILE_XY} FROM (SELECT event_id, lon1 AS lon, lat1 AS lat, z FROM b))
SELECT a.event_id, gx - a.x AS ix, gy - a.y AS iy, gx AS x, gy AS y, round(a.x * (40075016.68557849::DOUBLE / 4096) - 20037508.342789244::DOUBLE, 3) AS xmin, round(20037508.342789244::DOUBLE - (c.y + 1) * (40075016.68557849::DOUBLE / 4096), 3) AS ymin
FROM a JOIN c ON a.event_id = c.event_id, unnest(range(a.x, c.x + 1)) AS r(gx), unnest(range(a.y, c.y + 1)) AS s(gy)""")
def tile_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Map tiles of a box at a zoom, from its upper left to its lower right, with their place in the range and the range's lower left corner."""
    z = F.lit(12)
    rows = fx.lonlat(spark, sf_dir).selectExpr("event_id", "lon", "lat", "least(lon + 0.05D, 179.9D) AS lon1", "greatest(lat - 0.05D, -84.9D) AS lat1")
    x0, y0 = mercator.lonlat_to_tile(F.col("lon"), F.col("lat"), z)
    x1, y1 = mercator.lonlat_to_tile(F.col("lon1"), F.col("lat1"), z)
    rows = rows.select("event_id", x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"))
    box = mercator.range_bounds(*[F.col(c) for c in ("x0", "y0", "x1", "y1")], z)
    tiles = grid.tile_range(rows.withColumn("xmin", box[0]).withColumn("ymin", box[1]), "x0", "y0", "x1", "y1")
    return _round(tiles.select("event_id", "ix", "iy", "x", "y", "xmin", "ymin"), "xmin", "ymin", places=3)


@query(f"""{with_sql('lonlat')} SELECT event_id, round(radians(lon) * 6378137.0::DOUBLE, 3) + 0.0 AS mx, round(ln(tan(pi() / 4 + radians(lat) / 2)) * 6378137.0::DOUBLE, 3) + 0.0 AS my, round(lon, 6) + 0.0 AS lon, round(lat, 6) + 0.0 AS lat FROM lonlat""")
def mercator_metres(spark: SparkSession, sf_dir: str) -> DataFrame:
    """To metres and back."""
    mx, my = mercator.lonlat_to_metres(F.col("lon"), F.col("lat"))
    rows = fx.lonlat(spark, sf_dir).select("event_id", mx.alias("mx"), my.alias("my"))
    lon, lat = mercator.metres_to_lonlat(F.col("mx"), F.col("my"))
    return _round(_round(rows.select("event_id", "mx", "my", lon.alias("lon"), lat.alias("lat")), "mx", "my", places=3), "lon", "lat")


@query(f"""{with_sql('boxes')} SELECT id, CAST(x0 AS DOUBLE) AS bx0, CAST(y0 AS DOUBLE) AS by0, CAST(x1 AS DOUBLE) AS bx1, CAST(y1 AS DOUBLE) AS by1, 5 AS n FROM boxes""")
def geojson_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes written as GeoJSON, alone or in a collection, and read again."""
    text = geojson.box_polygon(*[F.col(c) for c in spatial.BOX])
    collection = F.concat(F.lit('{"type":"FeatureCollection","features":[{"type":"Feature","properties":{"k":"1"},"geometry":'), text, F.lit("}]}"))
    rows = fx.boxes(spark, sf_dir).select("id", F.when(F.col("id") % 2 == 0, text).otherwise(collection).alias("doc"))
    rows = rows.select("id", geojson.area_of_interest(inline=F.col("doc")).alias("ring"))
    return rows.select("id", *[v.alias(f"b{c}") for v, c in zip(geojson.ring_bounds(F.col("ring")), spatial.BOX, strict=True)], F.size("ring").alias("n"))


@query(f"""{with_sql('boxes')}, e AS (SELECT cls, max(x0 // 8) AS x0, max(y0 // 8) AS y0, min(x1 * 6) AS x1, min(y1 * 3) AS y1 FROM boxes GROUP BY cls)
SELECT cls, CASE WHEN x0 <= x1 AND y0 <= y1 THEN x0 END AS x0, CASE WHEN x0 <= x1 AND y0 <= y1 THEN y0 END AS y0, CASE WHEN x0 <= x1 AND y0 <= y1 THEN x1 END AS x1, CASE WHEN x0 <= x1 AND y0 <= y1 THEN y1 END AS y1 FROM e""")
def extent_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = fx.boxes(spark, sf_dir).selectExpr("cls", "x0 div 8 AS x0", "y0 div 8 AS y0", "x1 * 6 AS x1", "y1 * 3 AS y1")
    return spatial.common_extent(boxes, ["cls"])


@query(f"""{with_sql('boxes')}, a AS (SELECT id, id * 53 % 1000 AS x0, id * 17 % 1000 AS y0, id * 53 % 1000 + 400 AS x1, id * 17 % 1000 + 500 AS y1 FROM boxes WHERE id % 3 <> 0),
j AS (SELECT b.id, a.id IS NULL AS free, b.x0 AS bx0, b.y0 AS by0, b.x1 AS bx1, b.y1 AS by1, greatest(a.x0, b.x0) AS x0, greatest(a.y0, b.y0) AS y0, least(a.x1, b.x1) AS x1, least(a.y1, b.y1) AS y1 FROM boxes b LEFT JOIN a ON a.id = b.id)
SELECT id, CASE WHEN free THEN bx0 WHEN x0 <= x1 AND y0 <= y1 THEN x0 END AS x0, CASE WHEN free THEN by0 WHEN x0 <= x1 AND y0 <= y1 THEN y0 END AS y0,
  CASE WHEN free THEN bx1 WHEN x0 <= x1 AND y0 <= y1 THEN x1 END AS x1, CASE WHEN free THEN by1 WHEN x0 <= x1 AND y0 <= y1 THEN y1 END AS y1 FROM j""")
def area_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = fx.boxes(spark, sf_dir).select("id", *spatial.BOX)
    areas = boxes.where("id % 3 <> 0").selectExpr("id", "id * 53 % 1000 AS x0", "id * 17 % 1000 AS y0", "id * 53 % 1000 + 400 AS x1", "id * 17 % 1000 + 500 AS y1")
    return spatial.limit_area(boxes, areas, ["id"])


@query("""WITH i AS (SELECT s_nationkey AS cls, s_suppkey AS id, (s_suppkey % 7 - 3) * 0.5::DOUBLE AS g1 FROM supplier),
r AS (SELECT cls, id, abs(g1) AS step, row_number() OVER (PARTITION BY cls ORDER BY abs(g1), id) AS n FROM i WHERE g1 <> 0)
SELECT cls, id AS base, step FROM r WHERE n = 1""")
def finest_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    inputs = fx.table(spark, sf_dir, "supplier").selectExpr("s_nationkey AS cls", "s_suppkey AS id", "(s_suppkey % 7 - 3) * 0.5D AS g1")
    return spatial.finest(inputs, ["cls"], "g1", "id")


def _cells_sql(agg: str) -> str:
    return f"""{with_sql('boxes')} SELECT cx, cy, {agg} FROM boxes, unnest(range(CAST(ceil(x0 / 20) AS BIGINT), CAST(ceil(x1 / 20) AS BIGINT))) AS a(cx), unnest(range(CAST(ceil(y0 / 20) AS BIGINT), CAST(ceil(y1 / 20) AS BIGINT))) AS b(cy) GROUP BY cx, cy"""


@query(_cells_sql("min(id) AS owner"))
def footprint_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.owned_cells(fx.boxes(spark, sf_dir), "id", 20)


@query(_cells_sql("arg_max(cls, id) AS code"))
def rasterize_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.burned(fx.boxes(spark, sf_dir), "cls", "id", 20)


@query(f"{with_sql('boxes')} SELECT cls, count(*) AS n, array_to_string(list_sort(list(id)), ',') AS ids FROM boxes GROUP BY cls")
def class_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.grouped(fx.boxes(spark, sf_dir), "cls", "id").select("cls", "n", F.array_join(F.transform("items", lambda x: x.cast("string")), ",").alias("ids"))


_OVERLAPS = f"{with_sql('boxes')}, o AS (SELECT a.id AS a_id, b.id AS b_id FROM boxes a JOIN boxes b ON a.id < b.id AND a.x0 <= b.x1 AND b.x0 <= a.x1 AND a.y0 <= b.y1 AND b.y0 <= a.y1)"


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = fx.boxes(spark, sf_dir).drop("cls")
    return spatial.overlap_join(boxes, boxes, 128, salts=2).where("a_id < b_id")


@query(f"{_OVERLAPS} SELECT a_id, b_id FROM o")
def spatial_overlap_binned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).select("a_id", "b_id")


@query(f"{_OVERLAPS} SELECT o.a_id, o.b_id, round(CAST((least(a.x1, b.x1) - greatest(a.x0, b.x0)) * (least(a.y1, b.y1) - greatest(a.y0, b.y0)) AS DOUBLE) / (9600 - (least(a.x1, b.x1) - greatest(a.x0, b.x0)) * (least(a.y1, b.y1) - greatest(a.y0, b.y0))), 6) AS iou FROM o JOIN boxes a ON a.id = a_id JOIN boxes b ON b.id = b_id")
def overlap_iou(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = ([F.col(p + c).cast("double") for c in spatial.BOX] for p in ("a_", "b_"))
    return _round(_pairs(spark, sf_dir).select("a_id", "b_id", quad.box_iou(a, b).alias("iou")), "iou")


@query(f"{_OVERLAPS}, r AS (SELECT *, row_number() OVER (PARTITION BY a_id % 7 ORDER BY (a_id * 7919 + b_id * 104729) % 10007, a_id, b_id) AS n FROM o) SELECT a_id, b_id FROM r WHERE n <= 10")
def bounded_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = _pairs(spark, sf_dir).select("a_id", "b_id").withColumn("g", F.col("a_id") % 7)
    by = F.struct((F.col("a_id") * 7919 + F.col("b_id") * 104729) % 10007, "a_id", "b_id")
    return spatial.bounded_sample(pairs, ["g"], by).drop("g")


_QUAD = f"""{with_sql('quads')}, m AS (SELECT *, abs(ax * fy - fx * ay + fx * cy - cx * fy + cx * dy - dx * cy + dx * ay - ax * dy) / 2 AS area,
  (greatest(ax, fx, cx, dx) - least(ax, fx, cx, dx)) * (greatest(ay, fy, cy, dy) - least(ay, fy, cy, dy)) AS bb,
  ((fx - ax) * (cy - ay) - (fy - ay) * (cx - ax)) AS s1, ((fx - ax) * (dy - ay) - (fy - ay) * (dx - ax)) AS s2, ((dx - cx) * (ay - cy) - (dy - cy) * (ax - cx)) AS s3, ((dx - cx) * (fy - cy) - (dy - cy) * (fx - cx)) AS s4,
  ((cx - fx) * (dy - fy) - (cy - fy) * (dx - fx)) AS t1, ((cx - fx) * (ay - fy) - (cy - fy) * (ax - fx)) AS t2, ((ax - dx) * (fy - dy) - (ay - dy) * (fx - dx)) AS t3, ((ax - dx) * (cy - dy) - (ay - dy) * (cx - dx)) AS t4 FROM quads),
r AS (SELECT ok, ln, pk, sk, area / (bb + 1e-10) AS score, NOT ((s1 * s2 < 0 AND s3 * s4 < 0) OR (t1 * t2 < 0 AND t3 * t4 < 0)) AS simple FROM m)"""


def _scored_quads(spark: SparkSession, sf_dir: str) -> DataFrame:
    corners = [tuple(F.col(f"{p}{c}").cast("double") for c in "xy") for p in "afcd"]
    return fx.quads(spark, sf_dir).select("ok", "ln", "pk", "sk", quad.rectangularity(corners).alias("score"), quad.is_simple(corners).alias("simple"))


@query(f"{_QUAD} SELECT ok, ln, pk, sk, round(score, 6) AS score, CASE WHEN score > 0.9 THEN 'accepted' WHEN score > 0.4 THEN 'candidate' ELSE 'rejected' END AS status FROM r WHERE simple")
def quad_rectangularity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(sinks.with_status(_scored_quads(spark, sf_dir).where("simple")).select("ok", "ln", "pk", "sk", "score", "status"), "score")


@query(f"{_QUAD} SELECT CASE WHEN NOT simple THEN 'crossed' WHEN score > 0.9 THEN 'accepted' WHEN score > 0.4 THEN 'candidate' ELSE 'rejected' END AS status, count(*) AS n FROM r GROUP BY 1")
def route_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    routed = _scored_quads(spark, sf_dir).select(F.when(~F.col("simple"), "crossed").otherwise(quad.route(F.col("score"))).alias("status"))
    return routed.groupBy("status").agg(F.count("*").alias("n"))


@query(f"{_QUAD}, b AS (SELECT ok, max(CASE WHEN score > 0.9 THEN 1 ELSE 0 END) AS done FROM r GROUP BY ok) SELECT r.ok, ln, pk, sk FROM r JOIN b ON b.ok = r.ok WHERE done = 1 AND score > 0.4 AND score <= 0.9")
def purge_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.superseded(sinks.with_status(_scored_quads(spark, sf_dir)), "ok").select("ok", "ln", "pk", "sk")


_H = "SELECT l_orderkey AS ok, l_linenumber AS ln, l_partkey AS pk, l_suppkey AS sk, 1 + pk % 5 / 10 AS h0, sk % 7 / 20 AS h1, CAST(pk % 100 AS DOUBLE) AS h2, -(sk % 11) / 15 AS h3, 1 + ok % 3 / 10 AS h4, CAST(sk % 50 AS DOUBLE) AS h5, pk % 3 / 1e5 AS h6, sk % 3 / 1e5 AS h7 FROM lineitem"


def _homographies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.lines(spark, sf_dir).selectExpr("ok", "ln", "pk", "sk", "1 + pk % 5 / 10D AS h0", "sk % 7 / 20D AS h1", "CAST(pk % 100 AS DOUBLE) AS h2", "-(sk % 11) / 15D AS h3", "1 + ok % 3 / 10D AS h4", "CAST(sk % 50 AS DOUBLE) AS h5", "pk % 3 / 1e5 AS h6", "sk % 3 / 1e5 AS h7", "1D AS h8")


def _projected_sql() -> str:
    xs = ", ".join(f"(h0 * {x} + h1 * {y} + h2) / (h6 * {x} + h7 * {y} + 1)" for x, y in ((0, 0), (511, 0), (511, 511), (0, 511)))
    ys = ", ".join(f"(h3 * {x} + h4 * {y} + h5) / (h6 * {x} + h7 * {y} + 1)" for x, y in ((0, 0), (511, 0), (511, 511), (0, 511)))
    return f"round(least({xs}), 6) + 0.0 AS x0, round(least({ys}), 6) + 0.0 AS y0, round(greatest({xs}), 6) + 0.0 AS x1, round(greatest({ys}), 6) + 0.0 AS y1"


@query(f"WITH h AS ({_H}) SELECT ok, ln, pk, sk, {_projected_sql()} FROM h")
def homography_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = [F.col(f"h{k}") for k in range(9)]
    corners = [(F.lit(x), F.lit(y)) for x, y in ((0, 0), (511, 0), (511, 511), (0, 511))]
    box = affine.projected_box(h, corners)
    return _round(_homographies(spark, sf_dir).select("ok", "ln", "pk", "sk", *[v.alias(c) for v, c in zip(box, spatial.BOX, strict=True)]), *spatial.BOX)


@query(f"WITH h AS ({_H}) SELECT ok, ln, pk, sk, round(degrees(atan2(h3, h0)), 6) + 0.0 AS angle FROM h WHERE abs(degrees(atan2(h3, h0))) <= 20")
def homography_angle(spark: SparkSession, sf_dir: str) -> DataFrame:
    angle = affine.homography_angle([F.col(f"h{k}") for k in range(9)])
    return _round(_homographies(spark, sf_dir).select("ok", "ln", "pk", "sk", angle.alias("angle")).where("abs(angle) <= 20"), "angle")


@query(f"{with_sql('planted')} SELECT g, CASE WHEN count(*) > 2 THEN 2.0::DOUBLE END AS a, CASE WHEN count(*) > 2 THEN 0.1::DOUBLE END AS b, CASE WHEN count(*) > 2 THEN 3.0::DOUBLE END AS c FROM planted GROUP BY g")
def affine_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(homography.affine_fit(fx.planted(spark, sf_dir), ["g"], "u", "v", "x"), "a", "b", "c")


@query("SELECT l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 2) AS intercept, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2 FROM lineitem GROUP BY 1")
def line_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    price, n = "l_extendedprice", "l_quantity"
    return fx.table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(
        F.round(F.regr_slope(price, n), 4).alias("slope"), F.round(F.regr_intercept(price, n), 2).alias("intercept"), F.round(F.regr_r2(price, n), 6).alias("r2")
    )


@query(f"""{with_sql('planted')}, n AS (SELECT g, CAST(count(*) AS INTEGER) AS n, CAST(count(*) FILTER (id % 4 <> 3) AS INTEGER) AS good, avg(id % 10 / 10::DOUBLE) FILTER (id % 4 <> 3) AS conf FROM planted GROUP BY g)
SELECT g, n, CASE WHEN good < 4 THEN 0 ELSE good END AS inliers, CASE WHEN good >= 4 THEN round(conf, 6) END AS mean_conf, CAST(k - 1 AS INTEGER) AS pos, CASE WHEN good >= 4 THEN [2.0, 0.1, 3.0, -0.1, 2.0, 7.0, 0.0, 0.0, 1.0][k]::DOUBLE END AS h FROM n, (SELECT unnest(range(1, 10)) AS k)""")
def homography_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A planted transform with a quarter of outliers: its coefficients, inliers and their confidence."""
    wrong = F.col("id") % 4 == 3
    matches = fx.planted(spark, sf_dir).select("g", F.col("u").alias("x0"), F.col("v").alias("y0"), F.when(wrong, F.col("v") * 30 + 5000).otherwise(F.col("x")).alias("x1"),
                                               F.when(wrong, F.col("u") * 17 + F.col("id") * 97).otherwise(F.col("y")).alias("y1"), (F.col("id") % 10 / 10.0).alias("conf"))
    fitted = homography.fit_homographies(matches, ["g"])
    none = F.array_repeat(F.lit(None).cast("double"), 9)
    out = fitted.select("g", "n", "inliers", "mean_conf", F.posexplode(F.coalesce("h", none)).alias("pos", "h"))
    return _round(_round(out, "mean_conf"), "h", places=4)


_ORDER = "cand, rot, pk, sk"


@query(f"{with_sql('attempts')}, r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY {_ORDER}) AS n FROM attempts WHERE score > 0.9 AND abs(ang) <= 45) SELECT q, cand, rot, pk, sk, score FROM r WHERE n = 1")
def first_success(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.first_success(selection.gated(fx.attempts(spark, sf_dir)), "q", _ORDER.split(", ")).select("q", "cand", "rot", "pk", "sk", "score")


@query(f"{with_sql('ranked')}, r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, ln, pk, sk) AS n FROM ranked) SELECT q, ln, pk, sk, score FROM r WHERE n = 1")
def best_candidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.best_candidate(fx.ranked(spark, sf_dir), "q", "score", ["ln", "pk", "sk"]).select("q", "ln", "pk", "sk", "score")


@query(f"""{with_sql('ranked')}, r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY ln, pk, sk) AS rk FROM ranked),
s AS (SELECT q, min(rk) AS stop FROM r WHERE score > 0.99 GROUP BY q), k AS (SELECT r.* FROM r LEFT JOIN s USING (q) WHERE stop IS NULL OR rk <= stop),
b AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, rk) AS n FROM k) SELECT q, ln, pk, sk, score FROM b WHERE n = 1""")
def best_until_stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.best_until_stop(fx.ranked(spark, sf_dir), "q", "score", ["ln", "pk", "sk"]).select("q", "ln", "pk", "sk", "score")


@query(f"{with_sql('attempts')}, r AS (SELECT *, row_number() OVER (PARTITION BY q, cand ORDER BY rot, pk, sk) AS n FROM attempts WHERE score > 0.9 AND abs(ang) <= 45) SELECT q, cand, rot, pk, sk, score FROM r WHERE n = 1 AND cand = (SELECT min(cand) FROM r r2 WHERE r2.q = r.q AND r2.n = 1)")
def batched_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The early exit in batches of two candidates: the same result as trying them one by one."""
    attempts = fx.attempts(spark, sf_dir)

    def verify(batch: DataFrame) -> DataFrame:
        passed = selection.gated(batch)
        return passed.withColumn("key", F.struct("q", "cand")).transform(lambda d: selection.first_success(d, "key", ["rot", "pk", "sk"])).drop("key")

    return selection.match_in_batches(attempts, verify, "q", "cand", size=2).select("q", "cand", "rot", "pk", "sk", "score")


@query("SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'A')")
def resume_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = fx.table(spark, sf_dir, "lineitem").where("l_returnflag = 'A'").select(F.col("l_orderkey").alias("o_orderkey"))
    return selection.pending(fx.table(spark, sf_dir, "orders").select("o_orderkey"), done, ["o_orderkey"])


@query(f"{with_sql('chips')} SELECT chip_id, CASE WHEN chip_id % 3 = 0 THEN 5 ELSE 0 END AS cx0, CASE WHEN chip_id % 3 = 0 THEN 6 ELSE 0 END AS cy0, CASE WHEN chip_id % 3 = 0 THEN 70 ELSE width END AS cx1, CASE WHEN chip_id % 3 = 0 THEN 80 ELSE height END AS cy1 FROM chips")
def sidecar_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    chips = fx.chips(spark, sf_dir)
    known = chips.where("chip_id % 3 = 0").selectExpr("chip_id", "5 AS cx0", "6 AS cy0", "70 AS cx1", "80 AS cy1")
    return selection.with_default(chips, known, ["chip_id"], "width", "height").select("chip_id", "cx0", "cy0", "cx1", "cy1")


@query(f"{with_sql('pixels')} SELECT img, x // 4 AS x, y // 4 AS y, round(avg(value), 6) AS value FROM pixels GROUP BY 1, 2, 3")
def downsample_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(raster.downsampled(fx.pixels(spark, sf_dir), ["img"], 4), "value")


@query(f"{with_sql('pixels')} SELECT img, x // 4 AS x, y // 4 AS y, value FROM pixels WHERE x % 4 = 0 AND y % 4 = 0")
def overview_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.overview(fx.pixels(spark, sf_dir), 4)


@query(f"""{with_sql('pixels')}, v AS (SELECT * FROM pixels WHERE value <> 0)
SELECT img, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1, (SELECT min(w.x) FROM v w WHERE w.img = v.img AND w.y = min(v.y)) AS first_x, (SELECT min(w.y) FROM v w WHERE w.img = v.img AND w.x = min(v.x)) AS first_y FROM v GROUP BY img""")
def valid_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.valid_bounds(fx.pixels(spark, sf_dir), ["img"])


@query(f"{with_sql('pixels')} SELECT img, rot, CASE rot WHEN 0 THEN x WHEN 1 THEN 47 - y WHEN 2 THEN 63 - x ELSE y END AS x, CASE rot WHEN 0 THEN y WHEN 1 THEN x WHEN 2 THEN 47 - y ELSE 63 - x END AS y, value FROM pixels, (SELECT CAST(unnest(range(4)) AS INTEGER) AS rot)")
def rotated_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    turned = grid.rotations(fx.pixels(spark, sf_dir))
    x, y = raster.turned(F.col("x"), F.col("y"), F.col("rot"), F.lit(64), F.lit(48))
    return turned.select("img", "rot", x.cast("long").alias("x"), y.cast("long").alias("y"), "value")


@query(f"""{with_sql('points')} SELECT event_id, 'chip' || event_id || ' ' || printf('%.7f', 100 + px * 0.5::DOUBLE) || ' ' || printf('%.7f', 40 - (py + 30) * 0.25::DOUBLE) || ' ' || printf('%.7f', 100 + (px + 20) * 0.5::DOUBLE) || ' ' || printf('%.7f', 40 - (py + 30) * 0.25::DOUBLE)
 || ' ' || printf('%.7f', 100 + (px + 20) * 0.5::DOUBLE) || ' ' || printf('%.7f', 40 - py * 0.25::DOUBLE) || ' ' || printf('%.7f', 100 + px * 0.5::DOUBLE) || ' ' || printf('%.7f', 40 - py * 0.25::DOUBLE) AS line FROM points""")
def result_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    x0, y0, x1, y1 = affine.pixel_rect_to_box(affine.lit_gt(fx.GT), F.col("px"), F.col("py"), F.lit(20), F.lit(30))
    name = F.concat(F.lit("chip"), F.col("event_id").cast("string"))
    return fx.points(spark, sf_dir).select("event_id", sinks.result_line(name, [(x0, y0), (x1, y0), (x1, y1), (x0, y1)]).alias("line"))


@query("SELECT p_partkey AS id, 0 AS src FROM part UNION ALL SELECT s_suppkey, 1 FROM supplier")
def mosaic_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = fx.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.lit(0).alias("src"))
    b = fx.table(spark, sf_dir, "supplier").select(F.lit(1).alias("src"), F.col("s_suppkey").alias("id"))
    return files.mosaic(a, b)


@query(f"""{with_sql('lonlat')}, t AS (SELECT DISTINCT z, {_TILE_XY} FROM (SELECT *, 6 AS z FROM lonlat)) SELECT z, x, y FROM t WHERE (x + y) % 3 <> 0""")
def missing_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = mercator.lonlat_to_tile(F.col("lon"), F.col("lat"), F.lit(6))
    wanted = fx.lonlat(spark, sf_dir).select(F.lit(6).alias("z"), x.alias("x"), y.alias("y")).distinct()
    return files.missing_tiles(wanted, wanted.where("(x + y) % 3 = 0"))


@query("""WITH w AS (SELECT e.event_id % 20 AS area, e.event_id % 13 AS x, e.event_id % 11 AS y FROM events e), d AS (SELECT DISTINCT area, x, y FROM w),
t AS (SELECT DISTINCT x, y, (x * 3 + y) / 2 AS value FROM d WHERE (x + y) % 4 <> 0), f AS (SELECT area, min(x) AS mx, min(y) AS my FROM d GROUP BY area)
SELECT d.area, d.x, d.y, (d.x - mx) * 256 AS px, (d.y - my) * 256 AS py, coalesce(value, 0) AS value FROM d JOIN f ON f.area = d.area LEFT JOIN t ON t.x = d.x AND t.y = d.y""")
def tile_mosaic(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = fx.table(spark, sf_dir, "events").selectExpr("event_id % 20 AS area", "event_id % 13 AS x", "event_id % 11 AS y").distinct()
    fetched = wanted.where("(x + y) % 4 <> 0").selectExpr("x", "y", "(x * 3 + y) / 2D AS value").distinct()
    return raster.placed(wanted, fetched, ["area"])


@query(f"""{with_sql('chips', 'boxes')} SELECT chip_id, CAST(x0 AS DOUBLE) AS g0, 80.0::DOUBLE / width AS g1, CAST(y1 AS DOUBLE) AS g3, -(60.0::DOUBLE / height) AS g5 FROM chips JOIN boxes ON id = chip_id""")
def chip_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.chips(spark, sf_dir).join(fx.boxes(spark, sf_dir), F.col("id") == F.col("chip_id"))
    gt = affine.chip_transform([F.col(c).cast("double") for c in spatial.BOX], F.col("width"), F.col("height"))
    return rows.select("chip_id", *[gt[k].alias(f"g{k}") for k in (0, 1, 3, 5)])


@query("""SELECT x, y, c, round(CASE c % 4 WHEN 0 THEN sin((x + 1) * exp(-2.0::DOUBLE * (c // 4))) WHEN 1 THEN cos((x + 1) * exp(-2.0::DOUBLE * (c // 4))) WHEN 2 THEN sin((y + 1) * exp(-2.0::DOUBLE * (c // 4))) ELSE cos((y + 1) * exp(-2.0::DOUBLE * (c // 4))) END, 6) + 0.0 AS pe
FROM (SELECT CAST(vec_id % 10 AS INTEGER) AS x, CAST(vec_id // 10 AS INTEGER) AS y FROM embeddings), (SELECT CAST(unnest(range(16)) AS INTEGER) AS c)""")
def position_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = fx.table(spark, sf_dir, "embeddings").selectExpr("CAST(vec_id % 10 AS INT) AS x", "CAST(vec_id div 10 AS INT) AS y")
    cells = cells.withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(15))))
    return _round(cells.withColumn("pe", matching.position_encoding(F.col("x"), F.col("y"), F.col("c"))), "pe")


@query("WITH h AS (SELECT (max(vec_id) + 1) // 10 AS rows FROM embeddings) SELECT vec_id FROM embeddings, h WHERE vec_id % 10 BETWEEN 2 AND label % 5 + 4 - 1 AND vec_id // 10 BETWEEN 2 AND rows - 2 - 1")
def masked_border(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = fx.table(spark, sf_dir, "embeddings")
    rows = (v.agg(F.max("vec_id").alias("m")).first()["m"] + 1) // 10
    return v.where(matching.off_padding(F.col("vec_id"), 10, F.col("label") % 5 + 6, F.lit(rows))).select("vec_id")


@query(f"""{with_sql('chips')} SELECT chip_id, p_partkey AS crop_id FROM chips JOIN part ON replace(name, '.png', '') = p_partkey || '_SAT_' || lpad((44 + p_size * 3)::VARCHAR, 3, '0') WHERE p_partkey % 2 = 0""")
def crop_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base-map crops meet their chips by name, whatever the extension."""
    chips = fx.chips(spark, sf_dir).select("chip_id", names.stem(F.col("name")).alias("stem"))
    crops = fx.chips(spark, sf_dir).where("chip_id % 2 = 0").select(F.col("chip_id").alias("crop_id"), names.stem(F.concat(names.stem(F.col("name")), F.lit(".tif"))).alias("stem"))
    return chips.join(crops, "stem").select("chip_id", "crop_id")


@query(f"""{with_sql('lonlat')} SELECT event_id, CAST(round_even(1000.0::DOUBLE * (event_id % 97 + 1) / (40075016.68557849::DOUBLE / pow(2, 14) / 256), 0) AS INTEGER) AS width FROM lonlat""")
def area_raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels across an area in metres at a zoom."""
    metres = (F.col("event_id") % 97 + 1) * 1000.0
    return fx.lonlat(spark, sf_dir).select("event_id", F.rint(metres / mercator.ground_resolution(F.lit(14))).cast("int").alias("width"))


@query(f"{with_sql('pixels')} SELECT img, x // 8 AS cx, y // 8 AS cy, count(*) AS n FROM pixels WHERE value <> 0 GROUP BY 1, 2, 3")
def footprint_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.footprint_cells(fx.pixels(spark, sf_dir), ["img"], 8)


@query("""WITH q AS (SELECT s_suppkey AS query_id, CAST(s_suppkey % 5 AS INTEGER) AS level FROM supplier WHERE s_suppkey % 20 = 0), t AS (SELECT p_partkey AS tile_id, CAST(p_partkey % 5 AS INTEGER) AS level FROM part)
SELECT query_id, tile_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY tile_id) AS INTEGER) AS rank FROM q JOIN t USING (level)""")
def every_tile(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries = fx.table(spark, sf_dir, "supplier").where("s_suppkey % 20 = 0").selectExpr("s_suppkey AS query_id", "CAST(s_suppkey % 5 AS INT) AS level")
    return plan.without_retrieval(queries, fx.table(spark, sf_dir, "part").selectExpr("p_partkey AS id", "CAST(p_partkey % 5 AS INT) AS level"))


@query("""WITH l AS (SELECT s_suppkey AS id, s_nationkey AS scene, CAST(s_suppkey % 4 AS VARCHAR) AS before, CAST(s_suppkey % 3 AS VARCHAR) AS after FROM supplier)
SELECT l.id, n_name AS scene_name, before || '-' || after AS change, CASE WHEN before = after THEN 0 ELSE 1 END AS output FROM l JOIN nation ON n_nationkey = scene""")
def change_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of a change layer with the scene that they belong to."""
    layer = fx.table(spark, sf_dir, "supplier").selectExpr("s_suppkey AS id", "s_nationkey AS n_nationkey", "CAST(s_suppkey % 4 AS STRING) AS before", "CAST(s_suppkey % 3 AS STRING) AS after")
    rows = spatial.change_pairs(layer, fx.table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("scene_name")), "n_nationkey")
    return rows.select("id", "scene_name", "change", "output")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank the base tiles of each query by descriptor, then route their quads."""
    base = fx.table(spark, sf_dir, "embeddings")
    top = search.rank_tiles(base, base.where("vec_id % 20 = 0"), k=10)
    scored = _scored_quads(spark, sf_dir).where("simple").groupBy((F.col("pk") % 500).alias("tile_id")).agg(F.max("score").alias("score"))
    return _round(sinks.with_status(top.join(scored, "tile_id", "left").fillna(0.0, ["score"])).select("query_id", "rank", "tile_id", "d2", "score", "status"), "d2", "score")
