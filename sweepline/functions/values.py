"""Column expressions for time, gate values, geometry and text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0
FEET_TO_METRES = 0.3048


def nexrad_timestamp(date: Column, ms: Column) -> Column:
    """Day number (1 = 1970-01-01) and milliseconds of the day, as a UTC timestamp."""
    return F.timestamp_millis((date.cast("long") - 1) * 86_400_000 + ms.cast("long"))


def physical(raw: Column, scale: Column, offset: Column) -> Column:
    """(raw - offset) / scale; null for the flags 0 and 1."""
    return F.when(raw >= 2, (raw - offset.cast("double")) / scale.cast("double"))


def gate_flag(raw: Column) -> Column:
    return F.when(raw == 0, "below_snr").when(raw == 1, "range_folded").when(raw.isNotNull(), "data")


def gate_range_km(first_gate_m: Column, gate_width_m: Column, gate: Column) -> Column:
    return first_gate_m / 1000.0 + gate * gate_width_m / 1000.0


def azimuth_difference(a: Column, b: Column) -> Column:
    """Shorter way round the circle, in degrees."""
    d = F.abs(a - b)
    return F.when(d > 180.0, 360.0 - d).otherwise(d)


def polar_to_xy(azimuth_deg: Column, range_km: Column) -> tuple[Column, Column]:
    """(east, north) in km; azimuth clockwise from north."""
    a = F.radians(azimuth_deg)
    return range_km * F.sin(a), range_km * F.cos(a)


def xy_to_polar(x_km: Column, y_km: Column) -> tuple[Column, Column]:
    """(azimuth 0 to 360, range)."""
    a = F.degrees(F.atan2(x_km, y_km))
    return F.when(a < 0, a + 360.0).otherwise(a), F.sqrt(x_km * x_km + y_km * y_km)


def angles(lat: Column, lon: Column) -> tuple[Column, Column, Column]:
    """Sine and cosine of the latitude, and the longitude in radians: what project_angles() needs of a place."""
    return F.sin(F.radians(lat)), F.cos(F.radians(lat)), F.radians(lon)


def project_angles(point: tuple[Column, Column, Column], site: tuple[Column, Column, Column]) -> tuple[Column, Column]:
    """project_az_eq() of angles()."""
    (sin_la, cos_la, lon), (sin_la0, cos_la0, lon0) = point, site
    dlon = lon - lon0
    cos_c = F.greatest(F.least(sin_la0 * sin_la + cos_la0 * cos_la * F.cos(dlon), F.lit(1.0)), F.lit(-1.0))
    c = F.acos(cos_c)
    k = F.when(c < 1e-10, F.lit(1.0)).otherwise(c / F.sin(c))
    x = k * cos_la * F.sin(dlon)
    y = k * (cos_la0 * sin_la - sin_la0 * cos_la * F.cos(dlon))
    return x * EARTH_KM, y * EARTH_KM


def project_az_eq(lat: Column, lon: Column, site_lat: Column, site_lon: Column) -> tuple[Column, Column]:
    """Azimuthal equidistant (east, north) in km around the site, on a sphere of 6371 km."""
    return project_angles(angles(lat, lon), angles(site_lat, site_lon))


def percent_encode(text: Column, keep_slash: bool = False) -> Column:
    """RFC 3986: all but unreserved characters as %XX; null where the text has a CR or LF."""
    out = F.url_encode(text)
    for a, b in (("+", "%20"), ("*", "%2A"), ("%7E", "~"), *([("%2F", "/")] if keep_slash else [])):
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.when(~text.rlike("[\\r\\n]"), out)


def listing_query(prefix: Column, start_after: Column | None = None, token: Column | None = None, delimiter: Column | None = None) -> Column:
    """Path and query of a bucket listing request; parts that are null are left out. Null where an input has a CR or LF."""
    out = F.concat(F.lit("/?list-type=2&prefix="), percent_encode(prefix))
    for name, part in (("start-after", start_after), ("continuation-token", token), ("delimiter", delimiter)):
        if part is not None:
            out = F.concat(out, F.when(part.isNull(), F.lit("")).otherwise(F.concat(F.lit(f"&{name}="), percent_encode(part))))
    return out


def object_path(key: Column) -> Column:
    return F.concat(F.lit("/"), percent_encode(key, keep_slash=True))


def beam_height_km(range_km: Column, elevation_deg: Column, antenna_m: Column) -> Column:
    """Height of the beam's centre above sea level, 4/3-earth model."""
    r = 4.0 / 3.0 * EARTH_KM
    return F.sqrt(range_km * range_km + r * r + 2.0 * range_km * r * F.sin(F.radians(elevation_deg))) - r + antenna_m / 1000.0
