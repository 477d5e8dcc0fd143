"""More catalogue queries: polygons, areas, parts, plans from end to end, sinks that are read back."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import affine, mercator, names, quad
from ..operators import grid, matching, raster, search, selection, spatial
from ..sources import geojson, sinks
from ..sources.config import Settings
from ..tables import fresh_path
from . import areas, fixtures as fx
from . import matching as plan
from .catalogue import _LEVELS, _RANKED, _SIMS, _TILE_XY, _axis_sql, _both, _round, query
from .fixtures import with_sql


def _diamond(x, y, r) -> list:
    return [(x - r, y), (x, y - r), (x + r, y), (x, y + r)]


_DIAMONDS = f"{with_sql('boxes')}, d AS (SELECT id, x0 + 40 AS cx, y0 + 30 AS cy, 20 + id % 30 AS r FROM boxes)"


def _diamonds(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = fx.boxes(spark, sf_dir).selectExpr("id", "x0 + 40 AS cx", "y0 + 30 AS cy", "20 + id % 30 AS r")
    return d.selectExpr("id", "cx", "cy", "r", "cx - r AS x0", "cy - r AS y0", "cx + r AS x1", "cy + r AS y1")


@query(f"""{_DIAMONDS}, p AS (SELECT a.id AS a_id, b.id AS b_id, a.r AS ra, b.r AS rb,
  least(a.cx + a.cy + a.r, b.cx + b.cy + b.r) - greatest(a.cx + a.cy - a.r, b.cx + b.cy - b.r) AS u, least(a.cx - a.cy + a.r, b.cx - b.cy + b.r) - greatest(a.cx - a.cy - a.r, b.cx - b.cy - b.r) AS v
  FROM d a JOIN d b ON a.id < b.id AND abs(a.cx - b.cx) <= a.r + b.r AND abs(a.cy - b.cy) <= a.r + b.r),
s AS (SELECT *, CAST(greatest(u, 0) * greatest(v, 0) AS DOUBLE) / 2 AS shared FROM p) SELECT a_id, b_id, round(shared / (2 * ra * ra + 2 * rb * rb - shared), 6) + 0.0 AS iou FROM s""")
def polygon_iou(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shared over united area of squares that stand on a corner, by clipping."""
    d = _diamonds(spark, sf_dir)
    pairs = spatial.overlap_join(d, d, 128, salts=2).where("a_id < b_id")
    rings = [quad.ring_of(_diamond(*[F.col(p + c) for c in ("cx", "cy", "r")])) for p in ("a_", "b_")]
    return _round(pairs.select("a_id", "b_id", quad.polygon_iou(*rings).alias("iou")), "iou")


@query(f"""{with_sql('boxes')} SELECT id, CAST(k AS INTEGER) AS part, CAST(x0 + 200 * k AS DOUBLE) AS px0, CAST(y1 AS DOUBLE) AS py1, 4800.0 AS area FROM boxes, (SELECT unnest(range(2)) AS k) WHERE k = 0 OR id % 3 <> 0""")
def polygon_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Polygons and multi-polygons as parts; a part that encloses nothing goes."""
    def corners(shift: int) -> str:
        x0, x1 = f"x0 + {shift}", f"x1 + {shift}"
        return f"concat('[[[', {x0}, ',', y0, '],[', {x1}, ',', y0, '],[', {x1}, ',', y1, '],[', {x0}, ',', y1, '],[', {x0}, ',', y0, ']]]')"

    text = f"""CASE WHEN id % 3 = 0 THEN concat('{{"type":"Polygon","coordinates":', {corners(0)}, '}}')
      ELSE concat('{{"type":"MultiPolygon","coordinates":[', {corners(0)}, ',', {corners(200)}, ',[[[1,1],[2,2],[1,1]]]]}}') END"""
    rows = fx.boxes(spark, sf_dir).select("id", F.posexplode(geojson.parts(F.expr(text))).alias("part", "ring"))
    ring = geojson.open_ring(F.col("ring"))
    box = geojson.ring_bounds(F.col("ring"))
    return rows.where(quad.non_empty(ring)).select("id", "part", box[0].alias("px0"), box[3].alias("py1"), F.abs(quad.signed_area(ring)).alias("area"))


@query(f"""{with_sql('pixels')}, r AS (SELECT img, x, y, value, 10.25 + img AS r FROM pixels)
SELECT img, CAST(x - floor(32 - r) AS BIGINT) AS x, CAST(y - floor(24 - r) AS BIGINT) AS y, CASE WHEN abs(x + 0.5 - 32) + abs(y + 0.5 - 24) < r THEN value ELSE 0 END AS value FROM r
WHERE x >= floor(32 - r) AND x < ceil(32 + r) AND y >= floor(24 - r) AND y < ceil(24 + r)""")
def masked_crop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images cropped to a polygon."""
    pixels = fx.pixels(spark, sf_dir)
    rings = pixels.select("img").distinct().select("img", quad.ring_of(_diamond(F.lit(32.0), F.lit(24.0), F.col("img") + 10.25)).alias("ring"))
    return raster.masked(pixels, rings, ["img"]).select("img", F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"), "value")


_OTHERS = "i AS (SELECT s_suppkey AS id, s_nationkey AS cls, s_suppkey * 13 % 700 + s_suppkey // 1000 * 1100 AS gx, s_suppkey * 29 % 700 + 400 AS gy, 1 << (s_suppkey % 3) AS step FROM supplier)"


@query(f"""{with_sql('boxes')}, {_OTHERS},
p AS (SELECT b.id AS window_id, i.id AS input_id, b.*, gx, gy, step FROM boxes b JOIN i ON b.cls = i.cls AND b.x0 <= gx + 300 * step AND gx <= b.x1 AND b.y0 <= gy AND gy - 200 * step <= b.y1),
r AS (SELECT window_id, input_id, CAST(trunc((x0 - gx) / step) AS INTEGER) AS x, CAST(trunc((gy - y1) / step) AS INTEGER) AS y, CAST(trunc((x1 - gx) / step) AS INTEGER) AS xe, CAST(trunc((gy - y0) / step) AS INTEGER) AS ye FROM p)
SELECT window_id, input_id, x, y, xe - x AS w, ye - y AS h, CAST(x >= 0 AND y >= 0 AND xe <= 300 AND ye <= 200 AS INTEGER) AS inside FROM r""")
def paired_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows with the other inputs of their class, in those inputs' pixels."""
    inputs = fx.table(spark, sf_dir, "supplier").selectExpr("s_suppkey AS id", "s_nationkey AS cls", "s_suppkey * 13 % 700 + s_suppkey div 1000 * 1100 AS gx", "s_suppkey * 29 % 700 + 400 AS gy", "shiftleft(1, CAST(s_suppkey % 3 AS INT)) AS step")
    gt = F.array(*[F.expr(e).cast("double") for e in ("gx", "step", "0", "gy", "0", "-step")])
    found = spatial.paired_windows(fx.boxes(spark, sf_dir), inputs.select("id", "cls", gt.alias("gt"), F.lit(300).alias("width"), F.lit(200).alias("height")), "cls", 256)
    return found.withColumn("inside", F.col("inside").cast("int"))


_SLACK = f"""{_SIMS}, t AS (SELECT label, i, j, exp(dot / 0.1 - greatest(max(dot / 0.1) OVER (PARTITION BY label), 5)) AS p, exp(5 - greatest(max(dot / 0.1) OVER (PARTITION BY label), 5)) AS s FROM s),
n AS (SELECT label, count(DISTINCT i)::DOUBLE AS m, count(DISTINCT j)::DOUBLE AS n FROM t GROUP BY label),
a0 AS (SELECT t.*, m, n, 1.0::DOUBLE AS c, 1.0::DOUBLE AS c0 FROM t JOIN n USING (label))"""


def _slack_round(k: int) -> str:
    return f""", r{k} AS (SELECT * EXCLUDE (c, c0), c, c0, 1 / (sum(p * c) OVER (PARTITION BY label, i) + s * c0) AS r, n / (s * (sum(c) OVER (PARTITION BY label) / m + c0)) AS r0 FROM a{k}),
a{k + 1} AS (SELECT label, i, j, p, s, m, n, 1 / (sum(p * r) OVER (PARTITION BY label, j) + s * r0) AS c, m / (s * (sum(r) OVER (PARTITION BY label) / n + r0)) AS c0, r FROM r{k})"""


@query(_SLACK + _slack_round(0) + ", b1 AS (SELECT * EXCLUDE (r) FROM a1), " + _slack_round(1).lstrip(", ").replace("FROM a1", "FROM b1") + " SELECT label, i, j, round(p * r * c, 6) AS conf FROM a2")
def sinkhorn_slack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.transport_with_slack(*_both(spark, sf_dir), "label", 0.5, 2, places=6)


@query("SELECT l_orderkey, l_linenumber, l_discount AS mconf FROM lineitem WHERE l_discount <> 0")
def non_padding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.real_matches(fx.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_discount").alias("mconf")))


@query(f"""{with_sql('lonlat')}, b AS (SELECT event_id, lon, lat, least(lon + 0.05, 179.9) AS lon1, greatest(lat - 0.05, -84.9) AS lat1, 12 AS z FROM lonlat),
a AS (SELECT event_id, {_TILE_XY} FROM b), c AS (SELECT event_id, {_TILE_XY} FROM (SELECT event_id, lon1 AS lon, lat1 AS lat, z FROM b)),
t AS (SELECT a.event_id, gx AS x, gy AS y, (a.x + c.x + 1) / 2::DOUBLE AS mx, (a.y + c.y + 1) / 2::DOUBLE AS my FROM a JOIN c ON a.event_id = c.event_id, unnest(range(a.x, c.x + 1)) AS r(gx), unnest(range(a.y, c.y + 1)) AS s(gy))
SELECT event_id, x, y FROM t WHERE greatest(x - mx, mx - x - 1, 0) + greatest(y - my, my - y - 1, 0) < 0.75""")
def tile_cover_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the tiles over a box, those that an area of interest in its middle (a square on its corner) reaches."""
    z = F.lit(12)
    rows = fx.lonlat(spark, sf_dir).selectExpr("event_id", "lon", "lat", "least(lon + 0.05D, 179.9D) AS lon1", "greatest(lat - 0.05D, -84.9D) AS lat1")
    x0, y0 = mercator.lonlat_to_tile(F.col("lon"), F.col("lat"), z)
    x1, y1 = mercator.lonlat_to_tile(F.col("lon1"), F.col("lat1"), z)
    rows = rows.select("event_id", x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"))
    tiles = grid.tile_range(rows, "x0", "y0", "x1", "y1")
    middle = [(F.col("x0") + F.col("x1") + 1) / 2.0, (F.col("y0") + F.col("y1") + 1) / 2.0]
    x, y = F.col("x"), F.col("y")
    tile = quad.ring_of([(x, y), (x + 1, y), (x + 1, y + 1), (x, y + 1)])
    meets = F.abs(quad.signed_area(quad.clipped(tile, quad.ring_of(_diamond(*middle, F.lit(0.75)))))) > 1e-12
    return tiles.where(meets).select("event_id", "x", "y")


_CELLS = f"{with_sql('pixels')}, c AS (SELECT img, x // 4 AS cx, y // 4 AS cy FROM pixels WHERE value > 35 GROUP BY 1, 2, 3)"


@query(f"""{_CELLS.replace('WITH ', 'WITH RECURSIVE ', 1)}, r AS (SELECT img, cx, cy, cx AS tx, cy AS ty FROM c UNION SELECT r.img, r.cx, r.cy, n.cx, n.cy FROM r JOIN c n ON n.img = r.img AND abs(n.cx - r.tx) + abs(n.cy - r.ty) = 1)
SELECT img, cx, cy, arg_min(tx, ty * 1000 + tx) AS part_x, min(ty) AS part_y FROM r GROUP BY img, cx, cy""")
def footprint_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Connected parts of the bright cells of each image."""
    cells = raster.footprint_cells(fx.pixels(spark, sf_dir).where("value > 35"), ["img"], 4)
    return raster.connected_parts(cells, ["img"])


@query(f"""{with_sql('scenes')}, g AS (SELECT s.scene_id, CAST(x AS INTEGER) AS x0, CAST(y AS INTEGER) AS y0, least(CAST(x AS INTEGER) + 512, width) AS x1, least(CAST(y AS INTEGER) + 512, height) AS y1
  FROM scenes s, unnest({_axis_sql('width', '512')}) AS a(x), unnest({_axis_sql('height', '512')}) AS b(y))
SELECT * FROM g WHERE scene_id % 4 = 0 OR (x0 <= 700 + scene_id % 50 AND 300 <= x1 AND y0 <= 640 AND 200 <= y1)""")
def area_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grid windows within each scene's area of interest; a fourth of the scenes has none."""
    scenes = fx.scenes(spark, sf_dir)
    boxes = scenes.where("scene_id % 4 <> 0").selectExpr("scene_id", "300 AS x0", "200 AS y0", "700 + scene_id % 50 AS x1", "640 AS y1")
    return areas.within(boxes)(scenes)


_BASE_CUT = "CAST(least(CAST(512 * pow(2, level) AS INTEGER), height // 128 * 128, width // 128 * 128) AS INTEGER)"


@query(f"""{with_sql('scenes')}, l AS (SELECT s.*, level, {_BASE_CUT} AS cut FROM scenes s, (SELECT CAST(unnest(range(5)) AS INTEGER) AS level)),
g AS (SELECT level, scene_id, CAST(x AS INTEGER) AS stx, CAST(y AS INTEGER) AS sty, cut FROM l, unnest({_axis_sql('width', 'cut')}) AS a(x), unnest({_axis_sql('height', 'cut')}) AS b(y))
SELECT level, scene_id, stx, sty, cut, row_number() OVER (ORDER BY level, scene_id, stx, sty) - 1 AS id FROM g""")
def base_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan.base_tiles(fx.scenes(spark, sf_dir))


@query(f"{_LEVELS} SELECT level, count(*) AS n, CAST(sum(stx) AS BIGINT) AS stx FROM g GROUP BY level")
def stored_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tile table written by level and read again."""
    path = fresh_path(spark, "tiles")
    tiles = grid.tile_grid(grid.with_levels(fx.scenes(spark, sf_dir), (0, 1, 2)), cut=F.col("level_cut"))
    sinks.write_tiles(tiles.select("level", "scene_id", "stx", "sty"), path)
    return spark.read.parquet(path).groupBy("level").agg(F.count("*").alias("n"), F.sum("stx").alias("stx"))


@query(f"{with_sql('vectors')} SELECT vec_id AS id, CAST(vec_id % 3 AS INTEGER) AS level, CAST(k - 1 AS INTEGER) AS pos, round(v[k] / sqrt(list_sum(list_transform(v, lambda x: x * x))), 6) + 0.0 AS x, round(v[k], 6) + 0.0 AS f FROM vectors, (SELECT unnest(range(1, 65)) AS k)")
def descriptor_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Descriptors and features of tiles by an extractor hook, those of a former run kept; stored and read again."""
    tiles = fx.vectors(spark, sf_dir).select(F.col("vec_id").alias("id"), (F.col("vec_id") % 3).cast("int").alias("level"), "v")

    def extract(rows: DataFrame) -> DataFrame:
        def run(batches):
            for b in batches:
                yield pd.DataFrame({"level": b["level"], "id": b["id"], "embedding": [v / (v @ v) ** 0.5 for v in b["v"]], "features": b["v"]})

        return rows.mapInPandas(run, "level int, id long, embedding array<double>, features array<double>")

    done = extract(tiles.where("id % 5 = 0"))
    path = fresh_path(spark, "descriptors")
    sinks.write_descriptors(plan.descriptor_index(tiles, extract, done), path)
    stored = spark.read.parquet(path)
    pairs = F.posexplode(F.arrays_zip("embedding", "features"))
    return _round(stored.select("id", "level", pairs.alias("pos", "z")).select("id", "level", "pos", F.col("z.embedding").alias("x"), F.col("z.features").alias("f")), "x", "f")


@query(f"""{_RANKED.replace('SELECT query_id, rank, tile_id, d2 FROM r', '')}, k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS n FROM r WHERE (query_id * 31 + tile_id * 17) % 23 = 0)
SELECT query_id, rank, tile_id FROM k WHERE n = 1""")
def located_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Early exit over the complete ranking: the first tile of each query that a verifier accepts."""
    base = fx.table(spark, sf_dir, "embeddings")
    ranks = lambda some, k: search.rank_tiles(base, some, k=k)
    verify = lambda some: some.where("(query_id * 31 + tile_id * 17) % 23 = 0")
    return selection.match_as_needed(ranks, base.where("vec_id % 20 = 0"), verify).select("query_id", "rank", "tile_id")


_REMATCH = """a AS (SELECT l_orderkey AS q, l_linenumber AS place, l_partkey AS pk, l_suppkey AS sk, CASE WHEN l_partkey % 6 <> 0 THEN (l_partkey * 7 + l_suppkey * 3) % 101 / 100 END AS score FROM lineitem),
w AS (SELECT DISTINCT q, place FROM a), c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY place * 7919 % 11, place) AS k FROM w) WHERE k <= 4),
t AS (SELECT a.*, row_number() OVER (PARTITION BY q ORDER BY place, pk, sk) AS rk FROM a JOIN c USING (q, place) WHERE score IS NOT NULL),
e AS (SELECT q, min(rk) AS stop FROM t WHERE score > 0.99 GROUP BY q),
b AS (SELECT t.*, row_number() OVER (PARTITION BY t.q ORDER BY score DESC, rk) AS n FROM t LEFT JOIN e ON e.q = t.q WHERE stop IS NULL OR rk <= stop),
m AS (SELECT q, place, pk, sk, score, CASE WHEN score > 0.9 THEN 'accepted' WHEN score > 0.4 THEN 'candidate' ELSE 'rejected' END AS status FROM b WHERE n = 1)"""


def _rematched(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    attempts = fx.lines(spark, sf_dir).selectExpr("ok AS q", "ln AS place", "pk", "sk", "CASE WHEN pk % 6 <> 0 THEN (pk * 7 + sk * 3) % 101 / 100D END AS score")
    by = F.struct(F.col("place") * 7919 % 11, "place")
    found = plan.rematch(attempts, attempts.select("q", "place"), "q", ["place", "pk", "sk"], by, Settings(most_windows=4))
    return found.select("q", "place", "pk", "sk", "score", "status"), attempts


@query(f"WITH {_REMATCH} SELECT * FROM m")
def fine_rematch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fine re-match with its bounded windows, early stop and three-way router."""
    return _rematched(spark, sf_dir)[0]


@query(f"""WITH {_REMATCH}, f AS (SELECT q // 3 AS q, place, pk, sk, score, status FROM m),
x AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, place, pk, sk) AS n FROM f WHERE status = 'accepted'),
y AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, place, pk, sk) AS n FROM f WHERE status = 'candidate' AND q NOT IN (SELECT q FROM x))
SELECT q, place, pk, sk, score, status FROM x WHERE n = 1 UNION ALL SELECT q, place, pk, sk, score, status FROM y WHERE n = 1""")
def refined_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of several runs (here, three orders are one query): accepted ones first, candidates where there is none."""
    found, attempts = _rematched(spark, sf_dir)
    found = found.withColumn("q", F.expr("q div 3"))
    shown, _ = plan.refined(found, attempts.select(F.expr("q div 3").alias("q")), "q", ["place", "pk", "sk"])
    return shown.select("q", "place", "pk", "sk", "score", "status")


@query("""SELECT user_id AS job, arg_max(event_type, (ts, event_type)) AS state, count(*) AS entries, round(CAST(epoch_us(max(ts)) - epoch_us(min(ts)) AS DOUBLE) / 1e6, 3) AS seconds FROM events GROUP BY user_id""")
def job_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = fx.table(spark, sf_dir, "events").select(F.col("user_id").alias("job"), F.col("ts").alias("time"), F.col("event_type").alias("state"))
    return _round(sinks.job_states(log).drop("time"), "seconds", places=3)


@query("SELECT o_orderkey, 'o' || o_orderkey || '_' || strftime(o_orderdate, '%Y%m%d_%H%M%S') AS name, date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) AS days FROM orders")
def stamped_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = names.stamped(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")), F.col("o_orderdate"))
    return fx.table(spark, sf_dir, "orders").select("o_orderkey", name.alias("name"), F.datediff(F.to_date("o_orderdate"), F.lit("1992-01-01").cast("date")).cast("long").alias("days"))


@query(f"{with_sql('points')} SELECT event_id, 0.5::DOUBLE AS a, CAST(px AS DOUBLE) AS c, -0.25::DOUBLE AS e, CAST(py AS DOUBLE) AS f FROM points")
def affine_reorder(spark: SparkSession, sf_dir: str) -> DataFrame:
    gt = [F.col("px").cast("double"), F.lit(0.5), F.lit(0.0), F.col("py").cast("double"), F.lit(0.0), F.lit(-0.25)]
    turned = affine.reorder_gdal(gt)
    return fx.points(spark, sf_dir).select("event_id", *[turned[k].alias(n) for k, n in ((0, "a"), (2, "c"), (4, "e"), (5, "f"))])


@query(f"{with_sql('pixels')} SELECT img, CAST(level AS INTEGER) AS level, x >> level AS x, y >> level AS y, value FROM pixels, (SELECT unnest(range(3)) AS level) WHERE x % (1 << level) = 0 AND y % (1 << level) = 0")
def pyramid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return areas.pyramid(fx.pixels(spark, sf_dir), (0, 1, 2)).select("img", "level", F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"), "value")


@query(f"""{with_sql('chips')}, c AS (SELECT *, CAST(split_part(replace(name, '.png', ''), '_', 3) AS DOUBLE) / 100 AS res FROM chips),
l AS (SELECT c.*, CAST(level AS INTEGER) AS level, res / (0.5 * pow(2, level)) AS scale FROM c, (SELECT unnest(range(5)) AS level)),
o AS (SELECT *, least(CAST(round_even(width * scale, 0) AS INTEGER), CAST(round_even(height * scale, 0) AS INTEGER)) AS side FROM l WHERE scale <= 1),
w AS (SELECT *, lag(side) OVER (PARTITION BY chip_id ORDER BY level) AS before FROM o)
SELECT chip_id, level, CAST(rot AS INTEGER) AS rot, CASE WHEN chip_id % 3 = 0 THEN 70 ELSE width END AS cx1 FROM w, (SELECT unnest(range(4)) AS rot) WHERE before IS NULL OR before >= 250""")
def chip_preparation(spark: SparkSession, sf_dir: str) -> DataFrame:
    chips = fx.chips(spark, sf_dir).withColumn("res", names.resolution(F.col("name")))
    known = chips.where("chip_id % 3 = 0").selectExpr("chip_id", "5 AS cx0", "6 AS cy0", "70 AS cx1", "80 AS cy1")
    return areas.prepared_chips(chips, known, Settings(base_resolution=0.5)).select("chip_id", "level", "rot", "cx1")
