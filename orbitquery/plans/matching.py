"""The two end-to-end plans: building the base grid, and locating chips on it.

Locating keeps the candidate-by-candidate meaning (first success by rank and
rotation) but verifies ranks in batches, so each batch is one distributed job.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import affine, quad
from ..operators import grid, homography, matching, search, selection, spatial
from ..sources import sinks
from ..sources.config import Settings


def base_tiles(scenes: DataFrame, settings: Settings | None = None) -> DataFrame:
    """level, id, scene_id, stx, sty, cut: the windows of all scenes at every level, numbered by level, scene and place."""
    s = settings or Settings()
    leveled = grid.with_levels(scenes.select("scene_id", "width", "height"), s.levels, s.cut_size)
    cut = F.least(F.col("level_cut"), grid.clamp_cut(1 << 30, F.col("width"), F.col("height")))
    tiles = grid.numbered_tiles(leveled, ["level", "scene_id"], cut=cut, overlap=s.overlap, drop_last=s.drop_last)
    return tiles.select("level", "scene_id", "stx", "sty", "cut", "id")


def without_retrieval(queries: DataFrame, tiles: DataFrame, salts: int = 16) -> DataFrame:
    """Every tile of a query's level as a candidate, in id order: for small bases, or where descriptors are missing.

    queries: query_id, level; tiles: id, level.  The pairs are the product within a level by
    definition; a tile's rank is its place in its level, so tiles are numbered once and the
    product is neither sorted nor kept together.  `salts` spreads a level over tasks.
    """
    numbered = grid.sequential_ids(tiles.select("level", F.col("id").alias("tile_id")).where("level is not null"), ["level", "tile_id"], "at")
    first = numbered.groupBy("level").agg(F.min("at").alias("first"))
    placed = numbered.join(first, "level").withColumn("salt", F.pmod("at", F.lit(salts)).cast("int"))
    asked = queries.select("query_id", "level", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    return asked.join(placed, ["level", "salt"]).select("query_id", "tile_id", (F.col("at") - F.col("first") + 1).cast("int").alias("rank"))


def coarse_matches(candidates: DataFrame, chip_cells: DataFrame, tile_cells: DataFrame, columns: int, rows: int, scale: float, settings: Settings | None = None) -> DataFrame:
    """Correspondences (query_id, tile_id, rot, x0, y0, x1, y1, conf) of candidate pairs in all rotations that chip_cells has.

    chip_cells: query_id, rot, i, v; tile_cells: tile_id, j, v; cells of a columns x rows map.
    """
    s = settings or Settings()
    pairs = candidates.select("query_id", "tile_id")
    left = pairs.join(chip_cells, "query_id").select(F.struct("query_id", "tile_id", "rot").alias("pair"), "i", "v")
    right = pairs.join(chip_cells.select("query_id", "rot").distinct(), "query_id").join(tile_cells, "tile_id").select(F.struct("query_id", "tile_id", "rot").alias("pair"), "j", "v")
    conf = matching.double_softmax(matching.similarities(left, right, "pair"), "pair", s.temperature)
    inside = matching.off_border(F.col("i"), columns, rows, s.border) & matching.off_border(F.col("j"), columns, rows, s.border)
    found = matching.mutual_nearest(conf, "pair", s.match_threshold, inside)
    (x0, y0), (x1, y1) = (matching.cell_to_pixel(F.col(c), columns, scale) for c in "ij")
    return found.select("pair.*", *[v.cast("double").alias(n) for v, n in zip((x0, y0, x1, y1), ("x0", "y0", "x1", "y1"), strict=True)], "conf")


def verified(matches: DataFrame, width: int, height: int, settings: Settings | None = None) -> DataFrame:
    """Match sets whose homography makes a simple, nearly rectangular quad of the chip and turns it by 45 degrees at most.

    Gives query_id, tile_id, rot, h, inliers, score, ang and the quad's box.
    """
    s = settings or Settings()
    fitted = homography.fit_homographies(matches, ["query_id", "tile_id", "rot"]).where("h is not null")
    h = [F.col("h")[k] for k in range(9)]
    corners = [(F.lit(x), F.lit(y)) for x, y in ((0, 0), (width - 1, 0), (width - 1, height - 1), (0, height - 1))]
    points = [affine.project(h, x, y) for x, y in corners]
    out = fitted.select("query_id", "tile_id", "rot", "h", "inliers", quad.rectangularity(points).alias("score"), quad.is_simple(points).alias("simple"),
                        affine.homography_angle(h).alias("ang"), *[v.alias(c) for v, c in zip(quad.bounds(points), spatial.BOX, strict=True)])
    return selection.gated(out.where("simple").drop("simple"), least=s.accepted, most=s.angle)


def locate(base: DataFrame, queries: DataFrame, chip_cells: DataFrame, tile_cells: DataFrame, size: tuple[int, int], cells: tuple[int, int], solved: DataFrame | None = None,
           top: int | None = None, batch: int = 16, settings: Settings | None = None, save: Callable[[DataFrame, int], DataFrame] | None = None) -> DataFrame:
    """The first verified candidate of each query not in `solved`, by rank and then rotation.

    All tiles are candidates; only a `top` that is given ends the search at that rank.
    """
    s = settings or Settings()
    asked = queries if solved is None else selection.pending(queries, solved.select(F.col("query_id").alias("vec_id")), ["vec_id"])
    ranked = search.rank_tiles(base, asked, k=top)
    scale = size[0] / cells[0]

    def verify(some: DataFrame) -> DataFrame:
        passed = verified(coarse_matches(some, chip_cells, tile_cells, *cells, scale, s), *size, s)
        first = passed.join(some.select("query_id", "tile_id", "rank"), ["query_id", "tile_id"])
        keyed = first.withColumn("key", F.struct("query_id", "tile_id"))
        return selection.first_success(keyed, "key", ["rot"]).drop("key")

    return selection.match_in_batches(ranked, verify, size=batch, save=save)


def fine_windows(located: DataFrame, tiles: DataFrame, fine_tiles: DataFrame, settings: Settings | None = None) -> DataFrame:
    """At most `most_windows` finer tiles under each located box, in full-resolution pixels of its scene.

    Boxes meet tiles by cells, scene by scene; small overlaps (100 pixels) are left out.
    """
    s = settings or Settings()
    at = located.join(tiles.select(F.col("id").alias("tile_id"), "scene_id", "level", "stx", "sty"), "tile_id")
    box = affine.level_box([F.col(c) for c in spatial.BOX], F.col("level"), F.col("stx"), F.col("sty"))
    coarse = at.select("query_id", "scene_id", *[v.alias(c) for v, c in zip(box, spatial.BOX, strict=True)])
    fine = fine_tiles.where(F.col("level") == s.fine_level).select("id", "scene_id", F.col("stx").alias("x0"), F.col("sty").alias("y0"), (F.col("stx") + F.col("cut")).alias("x1"), (F.col("sty") + F.col("cut")).alias("y1"))
    pairs = spatial.overlap_join(coarse, fine, s.cut_size * 2**s.fine_level, salts=4).where("a_scene_id = b_scene_id")
    wide = F.least("a_x1", "b_x1") - F.greatest("a_x0", "b_x0")
    high = F.least("a_y1", "b_y1") - F.greatest("a_y0", "b_y0")
    pairs = pairs.where((wide > 100) & (high > 100)).select(F.col("a_query_id").alias("query_id"), F.col("b_id").alias("id"))
    return spatial.bounded_sample(pairs, ["query_id"], F.struct(F.xxhash64("id", F.lit(s.sample_seed)), "id"), s.most_windows)


def rematch(attempts: DataFrame, windows: DataFrame, query: str, order: Sequence[str], by: Column, settings: Settings | None = None) -> DataFrame:
    """The fine re-match and its router: one row with a status for each query that has a valid attempt.

    attempts: query, place, order columns and score of each try in a finer window (score
    null where no homography fitted, which counts as no try); windows: query, place (the window).  A
    query tries at most `most_windows` of its windows, in a seeded order (`by`); the best
    score wins, and the search ends with the first above `early_stop`.  Then accepted,
    candidate or rejected.
    """
    s = settings or Settings()
    chosen = spatial.bounded_sample(windows.select(query, "place").distinct(), [query], by, s.most_windows)
    tried = attempts.join(chosen, [query, "place"]).where(F.col("score").isNotNull())
    best = selection.best_until_stop(tried, query, "score", order, s.early_stop)
    return best.withColumn("status", F.when(F.col("score") > s.accepted, "accepted").when(F.col("score") > s.candidate, "candidate").otherwise("rejected"))


def refined(found: DataFrame, windows: DataFrame, query: str, order: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """After a run: results to show (accepted rows, and of the other queries the best candidate), and what an accepted row makes void.

    found: the rows of rematch() of several runs; windows are the places that it was looked for in.
    """
    accepted = selection.first_success(found.where("status = 'accepted'"), query, [F.desc("score"), *order])
    rest = selection.pending(found.where("status = 'candidate'"), accepted, [query])
    shown = accepted.unionByName(selection.best_candidate(rest, query, "score", order))
    return shown.join(windows.select(query).distinct(), query, "left_semi"), sinks.superseded(found, query)


def descriptor_index(tiles: DataFrame, extract: Callable[[DataFrame], DataFrame], done: DataFrame | None = None) -> DataFrame:
    """level, id, embedding and features of every tile not in `done`: the entry that feeds the ranking and the matcher.

    extract gives id, level, embedding and features of the tiles it gets; tiles that are
    described already are left out before it, so that a run can go on where one ended.
    """
    left = tiles if done is None else selection.pending(tiles, done, ["level", "id"])
    made = extract(left).select("level", "id", "embedding", "features")
    return made if done is None else done.select("level", "id", "embedding", "features").unionByName(made)


def report(results: DataFrame, corners: Sequence[str]) -> DataFrame:
    """Accepted results as lines; corners names the eight corner columns in order."""
    pairs = [(F.col(corners[k]), F.col(corners[k + 1])) for k in range(0, 8, 2)]
    return sinks.with_status(results).where("status = 'accepted'").withColumn("line", sinks.result_line(F.col("name"), pairs))
