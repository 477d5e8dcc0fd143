import numpy as np

from orbitquery.operators import raster
from orbitquery.plans import matching
from orbitquery.sources.config import Settings


def test_base_tiles_are_numbered_and_cover_levels(spark):
    scenes = spark.createDataFrame([(1, 1500, 1300), (2, 700, 600)], "scene_id int, width int, height int")
    tiles = matching.base_tiles(scenes, Settings(levels=(0, 1))).collect()
    assert sorted(r["id"] for r in tiles) == list(range(len(tiles))) and {r["level"] for r in tiles} == {0, 1}
    assert all(r["stx"] + r["cut"] <= (1500 if r["scene_id"] == 1 else 700) for r in tiles)


def test_planted_chip_is_located(spark):
    """Tile 7 shows the chip shifted by two cells; other tiles are noise."""
    rng = np.random.default_rng(0)
    columns = rows = 12
    size, dim = (96, 96), 32

    def unit(x):
        return x / np.linalg.norm(x, axis=-1, keepdims=True)

    chip = unit(rng.normal(size=(rows, columns, dim)))
    maps = {t: unit(rng.normal(size=(rows, columns, dim))) for t in (3, 5, 7)}
    maps[7][2:, 2:] = chip[:-2, :-2]
    desc = {t: unit(rng.normal(size=8)) for t in maps}
    base = spark.createDataFrame([(t, v.tolist()) for t, v in desc.items()], "vec_id long, embedding array<double>")
    asked = spark.createDataFrame([(100, unit(desc[7] + 0.3).tolist()), (101, desc[3].tolist())], "vec_id long, embedding array<double>")
    noise = unit(rng.normal(size=(rows, columns, dim)))
    chips = [(q, 0, i, m.reshape(-1, dim)[i].tolist()) for q, m in ((100, chip), (101, noise)) for i in range(rows * columns)]
    cells = [(t, j, m.reshape(-1, dim)[j].tolist()) for t, m in maps.items() for j in range(rows * columns)]
    chip_cells = spark.createDataFrame(chips, "query_id long, rot int, i int, v array<double>")
    tile_cells = spark.createDataFrame(cells, "tile_id long, j int, v array<double>")
    got = matching.locate(base, asked, chip_cells, tile_cells, size, (columns, rows), batch=2, settings=Settings(temperature=0.02)).collect()
    assert [(r["query_id"], r["tile_id"], r["rot"]) for r in got] == [(100, 7, 0)]
    assert np.allclose([got[0][c] for c in ("x0", "y0", "x1", "y1")], [16, 16, 111, 111], atol=0.5) and got[0]["score"] > 0.99
    located = spark.createDataFrame([(100, 7, 16.0, 16.0, 111.0, 111.0)], "query_id long, tile_id long, x0 double, y0 double, x1 double, y1 double")
    tiles = spark.createDataFrame([(7, 1, 3, 0, 0)], "id long, scene_id int, level int, stx int, sty int")
    fine = spark.createDataFrame([(k, 1 + k % 2, 2, 400 * (k // 2), 0, 512) for k in range(40)], "id long, scene_id int, level int, stx int, sty int, cut int")
    windows = sorted(r["id"] for r in matching.fine_windows(located, tiles, fine).collect())
    assert windows and all(k % 2 == 0 for k in windows) and len(windows) <= 10
    again = matching.locate(base, asked, chip_cells, tile_cells, size, (columns, rows), solved=spark.createDataFrame([(100,), (101,)], "query_id long"))
    assert again.count() == 0


def test_every_rank_is_verified(spark, monkeypatch):
    """The only tile that passes is the farthest of 70."""
    base = spark.createDataFrame([(t, [1.0, t / 10]) for t in range(70)], "vec_id long, embedding array<double>")
    asked = spark.createDataFrame([(100, [1.0, 0.0])], "vec_id long, embedding array<double>")
    monkeypatch.setattr(matching, "coarse_matches", lambda some, *rest: some)
    monkeypatch.setattr(matching, "verified", lambda some, *rest: some.where("tile_id = 69").selectExpr("query_id", "tile_id", "0 AS rot"))
    got = matching.locate(base, asked, None, None, (96, 96), (12, 12)).collect()
    assert [(r["query_id"], r["tile_id"], r["rank"]) for r in got] == [(100, 69, 70)]


def test_report_and_skewed_corners(spark):
    rows = spark.createDataFrame([("a", 0.95, *map(float, range(8))), ("b", 0.5, *map(float, range(8)))], "name string, score double, " + ", ".join(f"c{k} double" for k in range(8)))
    assert [r["line"] for r in matching.report(rows, [f"c{k}" for k in range(8)]).collect()] == ["a " + " ".join(f"{k}.0000000" for k in range(8))]
    edges = spark.createDataFrame([(10, 8, 0, 3, 1, 1), (10, 8, 5, 2, 3, 9), (10, 8, 2, 5, 9, 3)], "width int, height int, first_x int, first_y int, last_x int, last_y int")
    got = [list(r) for r in edges.select(*[c.alias(f"k{n}") for n, c in enumerate(raster.skew_corners(edges))]).collect()]
    assert got == [[0, 0, 0, 7, 9, 7, 9, 0], [0, 2, 6, 0, 9, 5, 3, 7], [2, 0, 9, 3, 7, 7, 0, 4]]
