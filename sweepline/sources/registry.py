"""The fixed-width export of radar stations."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.values import FEET_TO_METRES

# Where the columns that are used lie (0-based, end excluded).
PLACES = {"icao": (9, 13), "name": (20, 50), "state": (72, 74), "lat": (106, 115), "lon": (116, 126), "elev_ft": (127, 133), "stntype": (140, 190)}


def moved_columns(ruler: str) -> list[str]:
    """Columns of PLACES under which the ruler line has no run of dashes of just their width."""
    ruled = {m.span() for m in re.finditer("-+", ruler)}
    return [name for name, place in PLACES.items() if place not in ruled]


def read_station_registry(spark: SparkSession, path: str, kind: str = "NEXRAD") -> DataFrame:
    """Stations of one kind: id, name, state, lat, lon, elevation_m, sorted by id.

    The second line rules the columns; a layout that has moved is an error, as are repeated ids.
    Feet become metres, halves rounded to even. Fields that are no numbers are null.
    """
    lines = spark.read.text(path)
    ruler = lines.where("value rlike '^[- ]*-[- ]*$'").limit(1).collect()
    if moved := moved_columns(ruler[0]["value"] if ruler else ""):
        raise ValueError(f"the columns have moved: {', '.join(moved)}")
    field = lambda k: F.trim(F.substring("value", PLACES[k][0] + 1, PLACES[k][1] - PLACES[k][0]))
    rows = lines.where(field("stntype") == kind)
    number = lambda k: field(k).try_cast("double")
    out = rows.select(field("icao").alias("id"), field("name").alias("name"), field("state").alias("state"), number("lat").alias("lat"), number("lon").alias("lon"), F.bround(number("elev_ft") * FEET_TO_METRES).cast("int").alias("elevation_m"))
    twice = [r["id"] for r in out.groupBy("id").count().where("count > 1").limit(5).collect()]
    if twice:
        raise ValueError(f"ids occur twice: {', '.join(twice)}")
    return out.orderBy("id")
