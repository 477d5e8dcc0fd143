import json
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from orbitquery import tables
from orbitquery.functions import affine, mercator, quad
from orbitquery.operators import grid, homography, matching, raster, search, selection, spatial
from orbitquery.plans import catalogue, geometry  # noqa: F401  geometry adds its queries to the catalogue
from orbitquery.sources import files, geojson, sinks
from orbitquery.sources.config import Settings
from orbitquery.streaming import chips


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_affine_round_trip(spark):
    for gt in ((100.0, 0.5, 0.0, 40.0, 0.0, -0.25), (5.0, 0.5, 0.25, 3.0, 0.125, -1.0)):
        g = affine.lit_gt(gt)
        x, y = affine.pixel_to_geo(g, F.lit(-7), F.lit(12))
        back = affine.geo_to_pixel(g, x, y)
        assert tuple(one(spark, *[v.alias(n) for v, n in zip(back, "xy", strict=True)])) == (-7, 12)


def test_truncation_is_toward_zero(spark):
    g = affine.lit_gt((0, 1, 0, 0, 0, 1))
    assert tuple(one(spark, *affine.geo_to_pixel(g, F.lit(-1.9), F.lit(1.9)))) == (-1, 1)


def test_four_quarter_turns_are_none(spark):
    x, y, w, h = F.lit(3), F.lit(5), F.lit(11), F.lit(7)
    for k in range(4):
        x, y = affine.rotate_corner(F.lit(1), x, y, w if k % 2 == 0 else h, h if k % 2 == 0 else w)
    assert tuple(one(spark, x.alias("x"), y.alias("y"))) == (3, 5)


@given(n=st.integers(100, 3000), cut=st.sampled_from([128, 300, 512]))
@settings(max_examples=15, deadline=None)
def test_grid_covers_the_axis(spark, n, cut):
    got = one(spark, grid.axis_offsets(F.lit(0), F.lit(n), F.lit(cut)).alias("a"))["a"]
    assert got == sorted(set(got)) and got[0] == 0
    assert all(b - a <= cut for a, b in zip(got, got[1:], strict=False))
    if cut <= n:
        assert n - (got[-1] + cut) <= 0.2 * cut


def test_sequential_ids_are_gapless(spark):
    df = grid.sequential_ids(spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v")), ["v"])
    assert all(r["id"] == r["v"] for r in df.collect())
    some = spark.range(20_000).selectExpr("id % 3 AS a", "CAST(id * 7919 % 20011 AS STRING) AS b")
    want = {tuple(r): k for k, r in enumerate(sorted(some.collect()))}
    assert all(r["id"] == want[r["a"], r["b"]] for r in grid.sequential_ids(some, ["a", "b"]).collect())
    clash = spark.range(50).selectExpr("id % 7 AS _part", "id AS _place")
    assert sorted(r["id"] for r in grid.sequential_ids(clash, ["_part"]).collect()) == list(range(50))
    assert grid.sequential_ids(spark.range(0).select(F.col("id").alias("v")), ["v"]).count() == 0


def test_mercator_round_trip(spark):
    x, y = mercator.lonlat_to_metres(F.lit(13.4), F.lit(52.5))
    lon, lat = one(spark, *[v.alias(n) for v, n in zip(mercator.metres_to_lonlat(x, y), "xy", strict=True)])
    assert math.isclose(lon, 13.4, abs_tol=1e-9) and math.isclose(lat, 52.5, abs_tol=1e-9)


def test_quads(spark):
    def pts(*p):
        return [(F.lit(float(x)), F.lit(float(y))) for x, y in p]

    square, bow, kite = pts((0, 0), (4, 0), (4, 4), (0, 4)), pts((0, 0), (4, 4), (4, 0), (0, 4)), pts((2, 0), (4, 2), (2, 4), (0, 2))
    assert one(spark, quad.is_simple(square), quad.is_simple(bow), F.round(quad.rectangularity(square), 6), F.round(quad.rectangularity(kite), 6)) == (True, False, 1.0, 0.5)
    assert [r[0] for r in spark.createDataFrame([(0.95,), (0.9,), (0.4,), (0.41,)], "s double").select(quad.route(F.col("s"))).collect()] == ["accepted", "candidate", "rejected", "candidate"]


def test_overlap_join_is_symmetric_and_counts_once(spark):
    rng = np.random.default_rng(5)
    rows = [(i, int(x), int(y), int(x + w), int(y + h)) for i, (x, y, w, h) in enumerate(rng.integers(-50, 50, (60, 4)) * [1, 1, 0, 0] + rng.integers(0, 30, (60, 4)) * [0, 0, 1, 1])]
    boxes = spark.createDataFrame(rows, "id int, x0 int, y0 int, x1 int, y1 int")
    want = sorted((a[0], b[0]) for a in rows for b in rows if a[1] <= b[3] and b[1] <= a[3] and a[2] <= b[4] and b[2] <= a[4])
    for salts in (1, 3):
        assert sorted((r["a_id"], r["b_id"]) for r in spatial.overlap_join(boxes, boxes, 16, salts=salts).collect()) == want


def test_mutual_nearest_is_a_partial_matching(spark):
    rng = np.random.default_rng(1)
    rows = [(0, i, j, float(np.round(v, 1))) for (i, j), v in np.ndenumerate(rng.random((9, 7)))]
    conf = spark.createDataFrame(rows, "p int, i int, j int, conf double")
    got = matching.mutual_nearest(conf, "p", 0.5).collect()
    assert len({r["i"] for r in got}) == len(got) > 0
    for r in got:
        assert r["conf"] == max(x[3] for x in rows if x[1] == r["i"]) == max(x[3] for x in rows if x[2] == r["j"])


def test_planted_homography_with_outliers():
    rng = np.random.default_rng(3)
    h = np.array([[1.1, 0.2, 5], [-0.1, 0.9, 7], [1e-4, -2e-4, 1]])
    a = rng.random((60, 2)) * 400
    b = homography._apply(h, a)
    b[::3] += rng.random((20, 2)) * 300 + 40
    got, inside = homography.robust(a, b, threshold=1.0)
    assert np.allclose(got, h, atol=1e-6) and inside.sum() == 40
    assert homography.robust(a[:3], b[:3])[0] is None
    assert homography.robust(np.ones((9, 2)), np.ones((9, 2)), iterations=50)[0] is None


def test_homographies_per_key_survive_poor_sets(spark):
    rows = [("a", float(x), float(y), 2.0 * x + 1, 2.0 * y - 3, 0.5) for x in range(4) for y in range(4)] + [("b", 0.0, 0.0, 1.0, 1.0, 0.1)]
    got = {r["k"]: r for r in homography.fit_homographies(spark.createDataFrame(rows, "k string, x0 double, y0 double, x1 double, y1 double, conf double"), ["k"]).collect()}
    assert np.allclose(got["a"]["h"], [2, 0, 1, 0, 2, -3, 0, 0, 1], atol=1e-6) and got["a"]["inliers"] == 16
    assert got["b"]["h"] is None and got["b"]["mean_conf"] is None


def test_search_waves_agree_and_nulls_stay_out(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.random(6).tolist()) for i in range(40)] + [(99, None), (98, [1.0, 2.0])]
    base = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    asked = base.where("vec_id < 10")
    one_wave = sorted(map(tuple, search.rank_tiles(base, asked, k=5).collect()))
    assert one_wave == sorted(map(tuple, search.rank_tiles(base, asked, k=5, wave_bytes=100).collect())) and len(one_wave) == 50
    full = search.rank_tiles(base, asked).collect()
    assert sorted(r["rank"] for r in full if r["query_id"] == 3) == list(range(1, 41))
    assert search.rank_tiles(base.limit(0), asked, k=5).count() == 0


def test_batched_early_exit_is_the_sequential_result(spark):
    rows = [(q, r, (q * 31 + r * 17) % 10) for q in range(20) for r in range(1, 9)]
    ranked = spark.createDataFrame(rows, "query_id int, rank int, s int")
    want = {q: min((r for a, r, s in rows if a == q and s == 7), default=None) for q in range(20)}
    got = {r["query_id"]: r["rank"] for r in selection.match_in_batches(ranked, lambda b: b.where("s = 7"), size=3).collect()}
    assert got == {q: r for q, r in want.items() if r is not None}


def test_unusable_vectors_take_no_part(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 1.0]), (None, [1.0, 1.0]), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (7, None), (8, []), (1, [1.0, 0.0])]
    base = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for k in (None, 5):
        got = sorted(map(tuple, search.rank_tiles(base, base, k=k).collect()))
        assert got == [(1, 1, 1, 0.0), (1, 2, 1, 0.0), (1, 3, 2, 2.0), (2, 1, 2, 0.0), (2, 2, 1, 2.0), (2, 3, 1, 2.0)]
    plain = search.rank_tiles(base, base.where("vec_id = 3"), normalise=False).collect()
    assert sorted((r["tile_id"], r["d2"]) for r in plain) == [(1, 1.0), (1, 1.0), (2, 1.0), (3, 0.0)]


def test_equal_chips_get_the_same_levels(spark):
    one = spark.createDataFrame([(1, 1000, 1000, 0.5)], "chip_id int, width int, height int, res double")
    levels = [r["level"] for r in grid.chip_levels(one, [3, 0, 1, 2, 4], 0.25).collect()]
    assert sorted(levels) == [1, 2, 3, 4]
    assert sorted(r["level"] for r in grid.chip_levels(one.unionByName(one), range(5), 0.25).collect()) == sorted(levels * 2)


def test_tiles_are_numbered_like_sorted_rows(spark):
    rows = [(int(i), int(w), int(h), "x") for i, (w, h) in enumerate(np.random.default_rng(4).integers(100, 3000, (200, 2)))]
    scenes = spark.createDataFrame(rows, "scene_id int, width int, height int, _part string").repartition(7)
    got = grid.numbered_tiles(scenes, ["scene_id"]).collect()
    want = sorted((r["scene_id"], r["stx"], r["sty"]) for r in grid.tile_grid(scenes).collect())
    assert [(r["scene_id"], r["stx"], r["sty"]) for r in sorted(got, key=lambda r: r["id"])] == want
    assert [r["id"] for r in sorted(got, key=lambda r: r["id"])] == list(range(len(want)))
    assert grid.numbered_tiles(scenes.limit(0), ["scene_id"]).count() == 0


def test_centred_windows_stay_inside_and_around(spark):
    rng = np.random.default_rng(6)
    rows = [(float(a), float(a + w), float(n)) for a, w, n in zip(rng.integers(0, 500, 200), rng.integers(0, 400, 200), rng.integers(50, 1200, 200), strict=True) if a + w <= n]
    low, high = grid.centred_window(F.col("a"), F.col("b"), 300, F.lit(0.0), F.col("n"))
    for r in spark.createDataFrame(rows, "a double, b double, n double").select("a", "b", "n", low.alias("lo"), high.alias("hi")).collect():
        assert 0 <= r["lo"] <= r["a"] and r["b"] <= r["hi"] <= r["n"] and r["hi"] - r["lo"] == max(min(300, r["n"]), r["b"] - r["a"])


def test_batches_do_not_run_again(spark):
    """Each batch scans the candidates once, however many came before it."""
    ranked = spark.createDataFrame([(q, r) for q in range(3) for r in range(1, 13)], "query_id int, rank int")
    got = selection.match_in_batches(ranked, lambda b: b.where("rank = 11 AND query_id = 2"), size=2)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert [(r["query_id"], r["rank"]) for r in got.collect()] == [(2, 11)] and plan.count("Scan ExistingRDD") == 0 and plan.count("FileScan") <= 6


def test_clipped_polygons(spark):
    def inside(p, ring):
        turn = np.sign(sum(ring[k - 1][0] * ring[k][1] - ring[k][0] * ring[k - 1][1] for k in range(len(ring))))
        return all(turn * ((b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0])) >= 0 for a, b in zip(ring, [*ring[1:], ring[0]], strict=True))

    rng = np.random.default_rng(9)
    at = np.stack(np.meshgrid(np.arange(0, 10, 0.05), np.arange(0, 10, 0.05)), -1).reshape(-1, 2) + 0.025
    rows = []
    for _ in range(8):
        rings = []
        for n in (4, 3):
            angles = np.sort(rng.random(n) * 2 * np.pi)
            rings.append([(5 + 4 * np.cos(t) + rng.normal() * 0.1, 5 + 4 * np.sin(t)) for t in angles][:: rng.choice([1, -1])])
        a, b = (np.array([inside(p, r) for p in at]) for r in rings)
        rows.append((*[[{"x": float(x), "y": float(y)} for x, y in r] for r in rings], float((a & b).sum() * 0.0025), float((a & b).sum() / (a | b).sum())))
    rows.append(([{"x": 0.0, "y": 0.0}, {"x": 1.0, "y": 0.0}, {"x": 0.0, "y": 1.0}], [{"x": 5.0, "y": 5.0}, {"x": 6.0, "y": 5.0}, {"x": 5.0, "y": 6.0}], 0.0, 0.0))
    df = spark.createDataFrame(rows, "a array<struct<x:double,y:double>>, b array<struct<x:double,y:double>>, area double, iou double")
    got = df.select("area", "iou", F.abs(quad.signed_area(quad.clipped(F.col("a"), F.col("b")))).alias("area2"), quad.polygon_iou(F.col("a"), F.col("b")).alias("iou2")).collect()
    assert all(abs(r["area"] - r["area2"]) < 0.2 and abs(r["iou"] - r["iou2"]) < 0.02 for r in got) and sum(r["area"] > 1 for r in got) >= 4


def test_parts_of_geometries(spark):
    docs = ['{"type":"Polygon","coordinates":[[[0,0],[1,0],[1,1]],[[0,0],[0.1,0],[0.1,0.1]]]}', '{"type":"MultiPolygon","coordinates":[[[[0,0],[2,0],[2,2]]],[[[5,5],[6,5],[6,6],[5,5]]]]}', '{"type":"Point","coordinates":[1,2]}', '{"type":"MultiPolygon","coordinates":[]}', None]
    got = [r["p"] for r in spark.createDataFrame([(k, d) for k, d in enumerate(docs)], "k int, d string").orderBy("k").select(geojson.parts(F.col("d")).alias("p")).collect()]
    assert [None if p is None else [len(r) for r in p] for p in got] == [[3], [3, 4], [], [], None]
    assert one(spark, quad.non_empty(F.lit(None).cast("array<struct<x:double,y:double>>")).alias("e"))["e"] is False


def test_slack_takes_what_matches_nothing(spark):
    rng = np.random.default_rng(2)
    dots = rng.normal(size=(5, 4)) * 0.3
    df = spark.createDataFrame([(0, i, j, float(v)) for (i, j), v in np.ndenumerate(dots)], "p int, i int, j int, dot double")
    full = np.exp(np.pad(dots, ((0, 1), (0, 1)), constant_values=0.1) / 0.1)
    rows, columns = np.append(np.ones(5), 4.0), np.append(np.ones(4), 5.0)
    c = np.ones(5)
    for _ in range(3):
        r = rows / (full @ c)
        c = columns / (full.T @ r)
    want = (full * r[:, None] * c)[:5, :4]
    got = {(x["i"], x["j"]): x["conf"] for x in matching.sinkhorn_with_slack(df, "p", 0.1, 3, 0.1).collect()}
    assert all(math.isclose(got[i, j], v, rel_tol=1e-9) for (i, j), v in np.ndenumerate(want))


def test_shared_folder(spark, monkeypatch):
    class Session:
        class conf:
            get = staticmethod(lambda key, default: default)

        class sparkContext:
            master = "yarn"

            class _jsc:
                class sc:
                    class getCheckpointDir:
                        isDefined = staticmethod(lambda: False)

    with pytest.raises(ValueError):
        tables.shared_dir(Session)
    assert tables.free_name(spark.range(1).selectExpr("id AS _Part", "id AS __part"), "part") == "___part"


def test_connected_parts(spark):
    cells = [(0, x, 0) for x in range(9)] + [(0, 8, y) for y in range(5)] + [(0, 3, 4), (1, 0, 0), (1, 1, 1)]
    got = {(r["k"], r["cx"], r["cy"]): (r["part_x"], r["part_y"]) for r in raster.connected_parts(spark.createDataFrame(cells, "k int, cx int, cy int"), ["k"]).collect()}
    assert {v for k, v in got.items() if k[0] == 0 and k[1:] != (3, 4)} == {(0, 0)} and got[0, 3, 4] == (3, 4) and got[1, 1, 1] == (1, 1)


def test_geojson(spark):
    text = geojson.box_polygon(*[F.lit(float(v)) for v in (1, 2, 3, 4)])
    assert json.loads(one(spark, text.alias("t"))["t"])["type"] == "Polygon"
    ring = geojson.first_ring(text)
    assert tuple(one(spark, *geojson.ring_bounds(ring))) == (1.0, 2.0, 3.0, 4.0)
    assert one(spark, geojson.first_ring(F.lit("nonsense")).alias("r"))["r"] is None
    doc = '{"type":"FeatureCollection","features":[{"type":"Feature","properties":{"code":"5"},"geometry":{"type":"Polygon","coordinates":[[[0,0],[1,0],[1,1]]]}}]}'
    rows = geojson.features(spark.createDataFrame([(1, doc)], "id int, doc string"), "doc", "id").collect()
    assert len(rows) == 1 and rows[0]["properties"] == {"code": "5"} and len(rows[0]["ring"]) == 3


def test_files_and_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for n in ("a_SAT_056.PNG", "1-b_SAT_100.png", "c.txt"):
        (tmp_path / "in" / n).write_bytes(b"x")
    listed = files.list_files(spark, str(tmp_path / "in"), [".png"], remove="_SAT")
    assert sorted(r["name"] for r in listed.collect()) == ["1-b_100.png", "a_056.PNG"]
    images = files.images(spark, str(tmp_path / "in"), lambda raw: {"n": len(raw)} if raw else None, "n int")
    assert images.count() == 3
    for _ in range(2):  # the second run finds nothing new
        chips.match_stream(chips.incoming_chips(spark, str(tmp_path / "in")), lambda d: d, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    (tmp_path / "in" / "2-b_SAT_100.png").write_bytes(b"y")  # a piece of a chip that is solved, and a new chip
    (tmp_path / "in" / "d_SAT_100.png").write_bytes(b"y")
    chips.match_stream(chips.incoming_chips(spark, str(tmp_path / "in")), lambda d: d, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert sorted(r["name"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["1-b_SAT_100.png", "a_SAT_056.PNG", "d_SAT_100.png"]
    got = {r["orgname"]: (r["part"], r["res"]) for r in spark.read.parquet(str(tmp_path / "out")).where("batch = 0").collect()}
    assert got == {"b_SAT_100.png": (1, 1.0), "a_SAT_056.PNG": (None, 0.56)}


def test_sinks(spark, tmp_path):
    tiles = spark.createDataFrame([(0, 1), (1, 2)], "level int, id int")
    sinks.write_tiles(tiles, str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).where("level = 1").count() == 1
    rows = sinks.with_status(spark.createDataFrame([("a", 0.95), ("b", 0.5)], "name string, score double")).withColumn("line", F.col("name"))
    sinks.write_report(rows, str(tmp_path / "r"))
    assert [r["value"] for r in spark.read.text(str(tmp_path / "r")).collect()] == ["a"]


def test_scenes_hook_and_settings(spark, tmp_path):
    (tmp_path / "s.TIF").write_bytes(b"x")
    got = files.scenes(spark, str(tmp_path), lambda p: {"width": 5, "height": 6, "gt": [0.0] * 6, "crs": "EPSG:4326"}).collect()
    assert len(got) == 1 and got[0]["width"] == 5
    s = Settings.load({"cut_size": 256, "levels": [0, 1], "other": 1})
    assert s.cut_size == 256 and s.levels == (0, 1) and s.more == {"other": 1}
    text = "# base\ncut_size: 256\nlevels:\n  - 0\n  - 2\nextensions: ['.tif', .png]\nstage:  # nested\n  path: /a/b\n  deep:\n    on: true\nempty:\nrate: 0.5\n"
    (tmp_path / "s.yaml").write_text(text)
    s = Settings.read(str(tmp_path / "s.yaml"))
    assert s.cut_size == 256 and s.levels == (0, 2) and s.extensions == (".tif", ".png")
    assert s.more == {"stage": {"path": "/a/b", "deep": {"on": True}}, "empty": None, "rate": 0.5}


def test_fetching_logging_and_footprints(spark, tmp_path):
    wanted = spark.createDataFrame([(1, 0, 0), (1, 1, 0), (1, 1, 1), (1, 1, 1)], "z int, x int, y int")
    cached = spark.createDataFrame([(1, 0, 0, b"old"), (9, 9, 9, b"far")], "z int, x int, y int, content binary")
    got = {(r["x"], r["y"]): bytes(r["content"]) for r in files.fetched(wanted, cached, lambda z, x, y: None if y else b"new").collect()}
    assert got == {(0, 0): b"old", (1, 0): b"new"}
    log = spark.createDataFrame([("a", "2024-01-01 10:00:00", "start"), ("a", "2024-01-02 10:00:30", "done"), ("b", "2024-01-01 11:00:00", "start")], "job string, time string, state string").withColumn("time", F.to_timestamp("time"))
    sinks.write_log(log, str(tmp_path / "log"))
    assert sorted(p.name for p in (tmp_path / "log").iterdir() if p.name.startswith("day=")) == ["day=2024-01-01", "day=2024-01-02"]
    assert {r["job"]: (r["state"], r["seconds"]) for r in sinks.job_states(log).collect()} == {"a": ("done", 86430.0), "b": ("start", 0.0)}
    rings = spark.createDataFrame([(1, [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0)]), (2, [(0.0, 0.0), (1.0, 1.0), (0.0, 0.0)]), (3, None)], "scene_id int, ring array<struct<x:double,y:double>>")
    sinks.write_footprints(rings, str(tmp_path / "f"))
    assert [r["scene_id"] for r in spark.read.parquet(str(tmp_path / "f")).collect()] == [1]


def test_complete_rankings_shuffle_no_pairs(spark):
    """Queries are dealt, the base travels: rows of several slices, repeated ids, ties and other dimensions rank as by sorting."""
    rng = np.random.default_rng(12)
    rows = [(int(i), [float(x) for x in rng.integers(-2, 3, 3)]) for i in rng.integers(0, 150, 300)] + [(200 + i, [1.0, float(i)]) for i in range(4)] + [(7, None), (None, [1.0, 1.0, 1.0])]
    base = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    usable = [(i, np.array(v) / np.linalg.norm(v)) for i, v in rows if i is not None and v is not None and any(v)]
    asked = {}
    for i, v in rows:
        if i is not None and i % 20 == 0 and v is not None and any(v):
            asked[i] = min(asked.get(i, v), v)
    want = []
    for q, v in asked.items():
        u = np.array(v) / np.linalg.norm(v)
        found = sorted((round(float(((x - u) ** 2).sum()), 9), i) for i, x in usable if len(x) == len(u))
        want += [(q, r, i, round(d, 6)) for r, (d, i) in enumerate(found, 1)]
    for more in ({}, {"wave_bytes": 1000}, {"held_bytes": 0}, {"places": 6}, {"held_bytes": 0, "places": 6}):
        ranked = search.rank_tiles(base, base.where("vec_id % 20 = 0"), **more)
        got = [(r["query_id"], r["rank"], r["tile_id"], round(r["d2"], 6) + 0.0) for r in ranked.collect()]
        assert sorted(got) == sorted(want) and len(want) > 1000
    plan = search.rank_tiles(base, base.where("vec_id % 20 = 0"))._jdf.queryExecution().executedPlan().toString()
    above = plan[:plan.index("MapInArrow")]
    assert "Exchange" not in above and "Sort" not in above


@given(d2=st.lists(st.sampled_from([0.0, 1e-12, 2e-9, 0.5, 0.5 + 1e-11, 3.9, 1e7, 1e300, float("inf")]), max_size=12))
@settings(max_examples=60, deadline=None)
def test_order_of_distances(d2):
    want = sorted(range(len(d2)), key=lambda i: (round(d2[i], 9), i))
    assert search._order(np.array(d2, dtype=np.float64)).tolist() == want


def test_located_ranks_are_those_of_complete_rankings(spark):
    """Successes early, late, at the edge of the first ranks and never; complete rankings only where needed."""
    rng = np.random.default_rng(13)
    base = spark.createDataFrame([(i, [float(x) for x in rng.integers(-3, 4, 4)]) for i in range(60)], "vec_id long, embedding array<double>")
    queries, asked = base.where("vec_id % 5 = 0"), []

    def ranks(some, k):
        asked.append((k, sorted(r["vec_id"] for r in some.select("vec_id").collect())))
        return search.rank_tiles(base, some, k=k)

    whole = search.rank_tiles(base, queries).collect()
    for accepts in ("tile_id % 7 = query_id % 7", "tile_id = 59", "rank = 10", "rank = 11", "rank >= 60", "false"):
        asked.clear()
        full = spark.createDataFrame(whole)
        want = sorted((r["query_id"], r["rank"], r["tile_id"]) for r in selection.first_success(full.where(accepts), "query_id", ["rank"]).collect())
        found = selection.match_as_needed(ranks, queries, lambda b, accepts=accepts: b.where(accepts), size=10)
        assert sorted((r["query_id"], r["rank"], r["tile_id"]) for r in found.collect()) == want
        early = {q for q, rank, _ in want if rank <= 10}
        assert [k for k, _ in asked] == [10, None] and asked[1][1] == [q for q in asked[0][1] if q not in early]


def test_located_ranks_query_ranks_unsolved_queries_only(spark, sf_dir, monkeypatch):
    whole, rank_tiles = [], search.rank_tiles

    def counted(base, queries, **more):
        if more.get("k") is None:
            whole.append(queries.count())
        return rank_tiles(base, queries, **more)

    monkeypatch.setattr(search, "rank_tiles", counted)
    assert catalogue.QUERIES["located_ranks"](spark, sf_dir).count() == 25 and sum(whole) < 5


def test_transport_by_blocks_is_that_of_all_cells(spark):
    """Several blocks, unequal and one-sided pairs, repeated rows, null vectors and other dimensions; no cell is shuffled."""
    rng = np.random.default_rng(14)
    rows = [(int(p), int(i), [float(x) for x in rng.normal(size=3)]) for i, p in enumerate(rng.choice([1, 1, 1, 2], 90))]
    rows += [(1, 200, None), (1, 201, None), (1, 202, [1.0, None, 0.5]), (1, 203, [0.5, 0.5]), (2, 204, [1.0]), (3, 206, [1.0, 0.0, 0.0]), (1, rows[0][1], [0.1, 0.2, 0.3]), (None, 208, [0.0, 1.0, 0.0])]
    v = spark.createDataFrame(rows, "p int, n int, v array<double>").repartition(3)
    left, right = (v.where(f"n % 2 = {k}").selectExpr("p", f"n AS {name}", "v") for k, name in ((0, "i"), (1, "j")))
    want = matching.sinkhorn_with_slack(matching.similarities(left, right, "p"), "p", 0.4, 2, 0.3)
    want = sorted((r["p"], r["i"], r["j"], -1.0 if r["conf"] is None else round(r["conf"], 9)) for r in want.collect())
    for block in (7, 1000):
        found = matching.transport_with_slack(left, right, "p", 0.4, 2, 0.3, block=block)
        got = sorted((r["p"], r["i"], r["j"], -1.0 if r["conf"] is None else round(r["conf"], 9)) for r in found.collect())
        assert len(got) == len(want) > 1000 and all(a[:3] == b[:3] and math.isclose(a[3], b[3], abs_tol=2e-9) for a, b in zip(got, want, strict=True))
    assert any(w[3] == -1.0 for w in want)


def test_sinkhorn_slack_query_orders_no_cells(spark, sf_dir):
    plan = catalogue.QUERIES["sinkhorn_slack"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Exchange" not in plan[:plan.index("MapInArrow")]
