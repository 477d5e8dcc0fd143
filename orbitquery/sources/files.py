"""File listings, chip names and pluggable readers of pixels and descriptors."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names


def list_files(spark: SparkSession, folder: str, extensions: Sequence[str], remove: str = "", recursive: bool = False) -> DataFrame:
    """path, name, size of the files with one of the extensions, any case; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(folder)
    files = files.where(names.has_extension(F.col("path"), extensions)).select("path", F.col("length").alias("size"))
    name = F.element_at(F.split("path", "/"), -1)
    return files.select("path", F.replace(name, F.lit(remove), F.lit("")).alias("name") if remove else name.alias("name"), "size")


def images(spark: SparkSession, folder: str, decode: Callable[[bytes], dict | None], schema: str, recursive: bool = False) -> DataFrame:
    """Files decoded in Arrow batches; a file that decode() rejects (None) is left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(folder).select("path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            got = [{"path": p, **d} for p, c in zip(rows["path"], rows["content"], strict=True) if (d := decode(bytes(c))) is not None]
            if got:
                yield pd.DataFrame(got)

    return files.mapInPandas(run, f"path string, {schema}")


def extract(windows: DataFrame, function: Callable[[pd.DataFrame], pd.DataFrame], schema: str, group: str | None = None) -> DataFrame:
    """Hook for feature extractors and per-window preprocessing; windows of one source file come together if `group` names it."""
    if group:
        windows = windows.repartition(group).sortWithinPartitions(group)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            yield function(rows)

    return windows.mapInPandas(run, schema)


def scenes(spark: SparkSession, folder: str, read_info: Callable[[str], dict], recursive: bool = True, extensions: Sequence[str] = (".tif", ".tiff")) -> DataFrame:
    """Scene table from a metadata reader: read_info(path) gives width, height, gt (six numbers) and crs."""
    paths = list_files(spark, folder, extensions, recursive=recursive).select("path")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            yield pd.DataFrame([{"path": p, **read_info(p)} for p in rows["path"]], columns=["path", "width", "height", "gt", "crs"])

    return paths.mapInPandas(run, "path string, width int, height int, gt array<double>, crs string")


def mosaic(*tables: DataFrame) -> DataFrame:
    """Scene tables as one, by column name."""
    out = tables[0]
    for more in tables[1:]:
        out = out.unionByName(more, allowMissingColumns=True)
    return out


def missing_tiles(wanted: DataFrame, cached: DataFrame) -> DataFrame:
    """Map tiles (z, x, y) that a cache does not hold yet."""
    return wanted.join(cached.select("z", "x", "y").distinct(), ["z", "x", "y"], "left_anti")


def fetched(wanted: DataFrame, cached: DataFrame, fetch: Callable[[int, int, int], bytes | None]) -> DataFrame:
    """z, x, y, content of all wanted tiles: the cache's rows, and fetch(z, x, y) for those that it lacks.

    A tile that cannot be had (None) has no row.  The caller appends the new rows to the cache.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            got = [(z, x, y, fetch(z, x, y)) for z, x, y in rows.itertuples(index=False)]
            yield pd.DataFrame([g for g in got if g[3] is not None], columns=["z", "x", "y", "content"])

    keys = wanted.select(*[F.col(c).cast("int") for c in "zxy"]).distinct()
    new = missing_tiles(keys, cached).mapInPandas(run, "z int, x int, y int, content binary")
    old = cached.join(keys, ["z", "x", "y"], "left_semi").select(*[F.col(c).cast("int") for c in "zxy"], "content")
    return old.unionByName(new)


def store_options(spark: SparkSession, prefix: str = "spark.hadoop.fs.s3a.") -> list[str]:
    """Names (never values) of the object-store settings that the session carries."""
    return sorted(k for k, _ in spark.sparkContext.getConf().getAll() if k.startswith(prefix))
