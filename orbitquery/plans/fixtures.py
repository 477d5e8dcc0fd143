"""Tables of the geolocation domain derived from the test tables by plain arithmetic.

Each fixture has a DataFrame form and the same in SQL, for the oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"), "label")


def scenes(spark: SparkSession, sf_dir: str, small: bool = False) -> DataFrame:
    w, h = ("p_size * 37 + 200", "p_size * 29 + 180") if small else ("p_size * 97 + 600", "p_size * 61 + 500")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("scene_id"), F.expr(w).alias("width"), F.expr(h).alias("height"))


def chips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr(
        "p_partkey AS chip_id", "p_size * 41 + 200 AS width", "CAST(p_partkey % 97 * 11 + 150 AS INT) AS height",
        "concat(CAST(p_partkey AS STRING), '_SAT_', lpad(CAST(44 + p_size * 3 AS STRING), 3, '0'), '.png') AS name",
    )


def lonlat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr("event_id", "event_id * 7919 % 360000 / 1000D - 180 AS lon", "event_id * 104729 % 170000 / 1000D - 85 AS lat")


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = table(spark, sf_dir, "supplier").selectExpr("s_suppkey AS id", "s_nationkey AS cls", "s_suppkey * 37 % 1000 + s_suppkey div 1000 * 1100 AS x0", "s_suppkey * 91 % 1000 AS y0")
    return out.selectExpr("*", "x0 + 80 AS x1", "y0 + 60 AS y1")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr("event_id", "event_id % 1013 - 200 AS px", "event_id % 977 - 300 AS py")


GT = (100.0, 0.5, 0.0, 40.0, 0.0, -0.25)

_KEYS = "l_orderkey AS ok, l_linenumber AS ln, l_partkey AS pk, l_suppkey AS sk"


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr(*_KEYS.split(", "))


def quads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir).selectExpr(
        "ok", "ln", "pk", "sk", "pk % 17 AS ax", "sk % 13 AS ay", "200 + pk % 29 - pk % 7 * 25 AS fx", "ok % 31 AS fy", "190 + sk % 41 AS cx", "150 + ok % 23 AS cy", "ok % 19 AS dx", "140 + pk % 37 - sk % 5 * 40 AS dy"
    )


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines(spark, sf_dir).withColumn("rot", F.explode(F.array(*[F.lit(k) for k in range(4)])))
    return out.selectExpr("ok AS q", "ln AS cand", "rot", "pk", "sk", "(pk * 7 + sk * 3 + rot * 11) % 100 / 100D AS score", "CAST((sk * 5 + rot * 90) % 360 - 180 AS DOUBLE) AS ang")


def ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir).selectExpr("ok AS q", "ln", "pk", "sk", "(pk * 7 + sk * 3) % 101 / 100D AS score")


def planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = table(spark, sf_dir, "supplier").selectExpr("s_suppkey AS id", "s_suppkey % 5 AS g", "CAST(s_suppkey * 37 % 101 AS DOUBLE) AS u", "CAST(s_suppkey * 53 % 97 AS DOUBLE) AS v")
    return out.selectExpr("*", "2 * u + 0.1D * v + 3 AS x", "-0.1D * u + 2 * v + 7 AS y")


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sparse image for each line number: one value for each place, some of them nodata."""
    out = table(spark, sf_dir, "lineitem").selectExpr("l_linenumber AS img", "l_partkey % 64 AS x", "l_suppkey % 48 AS y", "CAST(l_quantity AS DOUBLE) - 10 AS v")
    return out.groupBy("img", "x", "y").agg(F.max(F.greatest("v", F.lit(0.0))).alias("value"))


SQL = {
    "vectors": "SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v, label FROM embeddings",
    "scenes": "SELECT p_partkey AS scene_id, p_size * 97 + 600 AS width, p_size * 61 + 500 AS height FROM part",
    "small_scenes": "SELECT p_partkey AS scene_id, p_size * 37 + 200 AS width, p_size * 29 + 180 AS height FROM part",
    "chips": "SELECT p_partkey AS chip_id, p_size * 41 + 200 AS width, CAST(p_partkey % 97 * 11 + 150 AS INTEGER) AS height, p_partkey::VARCHAR || '_SAT_' || lpad((44 + p_size * 3)::VARCHAR, 3, '0') || '.png' AS name FROM part",
    "lonlat": "SELECT event_id, event_id * 7919 % 360000 / 1000 - 180 AS lon, event_id * 104729 % 170000 / 1000 - 85 AS lat FROM events",
    "boxes": "SELECT s_suppkey AS id, s_nationkey AS cls, s_suppkey * 37 % 1000 + s_suppkey // 1000 * 1100 AS x0, s_suppkey * 91 % 1000 AS y0, x0 + 80 AS x1, y0 + 60 AS y1 FROM supplier",
    "points": "SELECT event_id, event_id % 1013 - 200 AS px, event_id % 977 - 300 AS py FROM events",
    "quads": "SELECT l_orderkey AS ok, l_linenumber AS ln, l_partkey AS pk, l_suppkey AS sk, pk % 17 AS ax, sk % 13 AS ay, 200 + pk % 29 - pk % 7 * 25 AS fx, ok % 31 AS fy, 190 + sk % 41 AS cx, 150 + ok % 23 AS cy, ok % 19 AS dx, 140 + pk % 37 - sk % 5 * 40 AS dy FROM lineitem",
    "attempts": "SELECT l_orderkey AS q, l_linenumber AS cand, rot, l_partkey AS pk, l_suppkey AS sk, (pk * 7 + sk * 3 + rot * 11) % 100 / 100 AS score, CAST((sk * 5 + rot * 90) % 360 - 180 AS DOUBLE) AS ang FROM lineitem, (SELECT CAST(unnest(range(4)) AS INTEGER) AS rot)",
    "ranked": "SELECT l_orderkey AS q, l_linenumber AS ln, l_partkey AS pk, l_suppkey AS sk, (pk * 7 + sk * 3) % 101 / 100 AS score FROM lineitem",
    "planted": "SELECT s_suppkey AS id, s_suppkey % 5 AS g, CAST(s_suppkey * 37 % 101 AS DOUBLE) AS u, CAST(s_suppkey * 53 % 97 AS DOUBLE) AS v, 2 * u + 0.1::DOUBLE * v + 3 AS x, -0.1::DOUBLE * u + 2 * v + 7 AS y FROM supplier",
    "pixels": "SELECT l_linenumber AS img, l_partkey % 64 AS x, l_suppkey % 48 AS y, max(greatest(CAST(l_quantity AS DOUBLE) - 10, 0)) AS value FROM lineitem GROUP BY 1, 2, 3",
}


def with_sql(*names: str) -> str:
    """WITH clause of the named fixtures."""
    return "WITH " + ", ".join(f"{n} AS ({SQL[n]})" for n in names)
