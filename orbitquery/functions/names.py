"""Metadata carried by chip names: [part-]scene_SENSOR_resolution.extension."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def stem(name: Column) -> Column:
    return F.regexp_replace(name, r"\.[^.]*$", "")


def resolution(name: Column) -> Column:
    """Metres of a pixel: the third token over 100."""
    return F.split(stem(name), "_")[2].cast("double") / 100.0


def original_name(name: Column) -> Column:
    """Name of the chip that a piece was cut from."""
    parts = F.split(name, "-")
    return F.when(F.size(parts) > 1, parts[1]).otherwise(parts[0])


def part(name: Column) -> Column:
    parts = F.split(name, "-")
    return F.when(F.size(parts) > 1, parts[0].try_cast("int"))


def has_extension(path: Column, extensions: Sequence[str]) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1)).isin([e.lower() for e in extensions])


def from_gbk(raw: Column) -> Column:
    return F.decode(raw, "GBK")


def stamped(name: Column, time: Column) -> Column:
    """A result's name with the time of its run, to the second."""
    return F.concat_ws("_", name, F.date_format(time, "yyyyMMdd_HHmmss"))
