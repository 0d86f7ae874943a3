"""Coordinates: parsing, keys and integer grid cells.

Cells are whole numbers (coordinate x 10^decimals, halves up), never rounded
doubles, so that equal places get equal keys on every engine.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import joined_key, lenient

# Bounding box of the studied area.
LAT_RANGE = (48.80, 48.92)
LON_RANGE = (2.20, 2.50)
KEY_DECIMALS = 4


def scaled(col: Column, decimals: int = KEY_DECIMALS) -> Column:
    """Coordinate as a whole number of 10^-decimals degrees."""
    return F.round(col * (10 ** decimals)).cast("bigint")


def grid_cell(col: Column, decimals: int = 2) -> Column:
    """Whole-number cell index at `decimals`, halves up, from 4-decimal coordinates."""
    step = 10 ** (KEY_DECIMALS - decimals)
    return F.floor((scaled(col) + step // 2) / F.lit(step)).cast("bigint")


def geo_key(lat: Column, lon: Column) -> Column:
    """'lat_lon' text at four decimals, NULL when a coordinate is missing."""
    unit = 10.0 ** KEY_DECIMALS
    return joined_key(
        (scaled(lat) / F.lit(unit)).cast("string"), (scaled(lon) / F.lit(unit)).cast("string"))


def split_geo_key(col: Column) -> tuple[Column, Column]:
    """'lat_lon' text back to two doubles."""
    parts = F.split(col, "_", 2)
    return (
        lenient(F.try_element_at(parts, F.lit(1)), "double"),
        lenient(F.try_element_at(parts, F.lit(2)), "double"),
    )


def parse_point(col: Column) -> tuple[Column, Column]:
    """(lat, lon) from JSON, single-quoted JSON or 'lat,lon' text; else NULLs."""
    text = F.trim(col)
    braces = text.startswith("{")
    point = F.from_json(F.when(braces, text), "lat double, lon double")
    parts = F.split(text, ",")
    lat_plain = lenient(F.trim(F.try_element_at(parts, F.lit(1))), "double")
    lon_plain = lenient(F.trim(F.try_element_at(parts, F.lit(2))), "double")
    pair = ~braces & (F.size(parts) == 2) & lat_plain.isNotNull() & lon_plain.isNotNull()
    lat = F.when(braces, point["lat"]).when(pair, lat_plain)
    lon = F.when(braces, point["lon"]).when(pair, lon_plain)
    return lat, lon


def in_box(lat: Column, lon: Column) -> Column:
    return lat.between(*LAT_RANGE) & lon.between(*LON_RANGE)
