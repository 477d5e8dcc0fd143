"""GeoJSON in and out, with an explicit schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import mercator

POLYGON = "struct<type:string,coordinates:array<array<array<double>>>>"
FEATURE = f"struct<type:string,properties:map<string,string>,geometry:{POLYGON}>"
COLLECTION = f"struct<type:string,features:array<{FEATURE}>,geometry:{POLYGON},coordinates:array<array<array<double>>>>"


def parts(geometry: Column) -> Column:
    """Outer rings of a Polygon's or MultiPolygon's JSON text, as arrays of (x, y); empty for other geometries, null for no JSON."""
    doc = F.from_json(geometry, "type string, coordinates string")
    one = F.array(F.from_json(doc["coordinates"], "array<array<array<double>>>"))
    many = F.from_json(doc["coordinates"], "array<array<array<array<double>>>>")
    none = F.array().cast("array<array<array<array<double>>>>")
    polygons = F.when(doc["type"] == "MultiPolygon", many).when(doc["type"] == "Polygon", one).when(doc.isNotNull(), none)
    rings = F.filter(F.transform(polygons, lambda p: F.get(p, F.lit(0))), lambda r: r.isNotNull())
    return F.transform(rings, lambda r: F.transform(r, lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))))


def open_ring(ring: Column) -> Column:
    """Without the last point, if that repeats the first."""
    return F.when(F.get(ring, F.lit(0)) == F.try_element_at(ring, F.lit(-1)), F.slice(ring, F.lit(1), F.greatest(F.size(ring) - 1, F.lit(0)))).otherwise(ring)


def first_ring(text: Column) -> Column:
    """Outer ring, as an array of (x, y), of a polygon, a feature or a collection's first feature."""
    doc = F.from_json(text, COLLECTION)
    rings = F.coalesce(F.get(doc["features"], F.lit(0))["geometry"]["coordinates"], doc["geometry"]["coordinates"], doc["coordinates"])
    return F.transform(F.get(rings, F.lit(0)), lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))


def ring_bounds(ring: Column) -> list[Column]:
    xs, ys = F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"])
    return [F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys)]


def features(df: DataFrame, column: str, *keep: str) -> DataFrame:
    """One row for each feature of a collection: keep, properties, ring."""
    doc = F.from_json(F.col(column), COLLECTION)
    rows = df.select(*keep, F.explode(doc["features"]).alias("f"))
    ring = F.transform(F.get(F.col("f.geometry.coordinates"), F.lit(0)), lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))
    return rows.select(*keep, F.col("f.properties").alias("properties"), ring.alias("ring"))


def area_of_interest(polygon: Column | None = None, inline: Column | None = None, stored: Column | None = None, in_metres: bool = False) -> Column:
    """First of: a ring given as such, an inline document, a document read from storage; in Web Mercator metres if asked for (from longitude and latitude)."""
    options = [x for x in (polygon, None if inline is None else first_ring(inline), None if stored is None else first_ring(stored)) if x is not None]
    ring = F.coalesce(*options)
    if not in_metres:
        return ring

    def metres(p: Column) -> Column:
        x, y = mercator.lonlat_to_metres(p["x"], p["y"])
        return F.struct(x.alias("x"), y.alias("y"))

    return F.transform(ring, metres)


def box_polygon(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """GeoJSON text of a box, counter-clockwise from its upper right corner's foot."""
    ring = F.array(F.array(x1, y0), F.array(x1, y1), F.array(x0, y1), F.array(x0, y0), F.array(x1, y0))
    return F.to_json(F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates")))
