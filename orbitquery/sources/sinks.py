"""Sinks: partitioned Parquet for tables, text for the report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import quad
from . import geojson


def write_tiles(tiles: DataFrame, path: str) -> None:
    """The tile table, one folder per level, so that a level's readers prune the rest."""
    tiles.repartition("level", F.pmod(F.xxhash64(*[F.col(c) for c in tiles.columns]), F.lit(16))).write.mode("overwrite").partitionBy("level").parquet(path)


def write_descriptors(features: DataFrame, path: str) -> None:
    features.write.mode("append").partitionBy("level").parquet(path)


def with_status(results: DataFrame, score: str = "score") -> DataFrame:
    """One result table instead of folders: accepted, candidate or rejected."""
    return results.withColumn("status", quad.route(F.col(score)))


def superseded(results: DataFrame, query: str) -> DataFrame:
    """Candidate rows of queries that also have an accepted row: what a success purges."""
    done = results.where("status = 'accepted'").select(query).distinct()
    return results.where("status = 'candidate'").join(done, query, "left_semi")


def result_line(name: Column, corners: list[tuple[Column, Column]], places: int = 7) -> Column:
    """name x1 y1 ... x4 y4, rounded."""
    values = [F.format_string(f"%.{places}f", F.bround(v, places)) for p in corners for v in p]
    return F.concat_ws(" ", name, *values)


def write_report(results: DataFrame, path: str) -> None:
    """Lines of accepted results; needs a column `line`."""
    results.where("status = 'accepted'").select("line").write.mode("overwrite").text(path)


def write_footprints(footprints: DataFrame, path: str) -> None:
    """Scene footprints (scene_id, ring), those that enclose something, as Parquet in scene order."""
    footprints.where(quad.non_empty(geojson.open_ring(F.col("ring")))).repartitionByRange("scene_id").sortWithinPartitions("scene_id").write.mode("overwrite").parquet(path)


def write_log(entries: DataFrame, path: str) -> None:
    """Job log entries (job, time, state and whatever else) as JSON lines, one folder a day: new entries are added, old days can go."""
    entries.withColumn("day", F.to_date("time")).write.mode("append").partitionBy("day").json(path)


def job_states(log: DataFrame) -> DataFrame:
    """job, state, time, entries, seconds: the last state of each job, and how long it has been logged."""
    last = F.max(F.struct("time", "state"))
    times = F.max("time").cast("timestamp").cast("double") - F.min("time").cast("timestamp").cast("double")
    return log.groupBy("job").agg(last["state"].alias("state"), last["time"].alias("time"), F.count("*").alias("entries"), times.alias("seconds"))
