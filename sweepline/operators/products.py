"""Derived products in polar columns: echo tops, vertically integrated liquid, storm-relative velocity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import beam_height_km


def latest_cuts(gates: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Of cuts at the same angle (to 0.1 degree) keep the highest elevation_number, the latest one."""
    top = gates.groupBy(*keys, F.round("elevation_deg", 1).alias("angle")).agg(F.max("elevation_number").alias("elevation_number"))
    return gates.withColumn("angle", F.round("elevation_deg", 1)).join(top, [*keys, "angle", "elevation_number"], "left_semi").drop("angle")


def columns(gates: DataFrame, antenna_m: Column, az_bin_deg: float = 1.0, range_bin_km: float = 1.0) -> DataFrame:
    """Add az_bin, range_bin (along the ground) and height_km to gates with a value."""
    ground = F.col("range_km") * F.cos(F.radians("elevation_deg"))
    return gates.where("value is not null").withColumns({"az_bin": F.floor(F.col("azimuth_deg") / az_bin_deg), "range_bin": F.floor(ground / range_bin_km), "height_km": beam_height_km(F.col("range_km"), F.col("elevation_deg"), antenna_m)})


def echo_tops(binned: DataFrame, keys: tuple[str, ...], threshold: float = 18.0) -> DataFrame:
    """Greatest height with a value of at least the threshold, per column."""
    return binned.where(F.col("value") >= threshold).groupBy(*keys, "az_bin", "range_bin").agg(F.max("height_km").alias("echo_top_km"))


def vil(binned: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Vertically integrated liquid per column, kg per square metre.

    Sum over layers of 3.44e-6 * (mean of the two reflectivities in mm^6/m^3) ^ (4/7) * depth in m,
    from the mean value of each elevation in the column.
    """
    z = F.avg(F.pow(F.lit(10.0), F.col("value") / 10.0)).alias("z")
    levels = binned.groupBy(*keys, "az_bin", "range_bin", "elevation_number").agg(z, F.avg("height_km").alias("h"))
    w = Window.partitionBy(*keys, "az_bin", "range_bin").orderBy("h", "elevation_number")
    layer = 3.44e-6 * F.pow((F.col("z") + F.lead("z").over(w)) / 2.0, F.lit(4.0 / 7.0)) * (F.lead("h").over(w) - F.col("h")) * 1000.0
    return levels.withColumn("layer", layer).groupBy(*keys, "az_bin", "range_bin").agg(F.coalesce(F.sum("layer"), F.lit(0.0)).alias("vil"), F.count("*").alias("n_levels"))


def storm_relative_velocity(gates: DataFrame, u_mps: float, v_mps: float) -> DataFrame:
    """Add srv: velocity less the component of the motion (u east, v north) along the beam."""
    a, e = F.radians("azimuth_deg"), F.radians("elevation_deg")
    return gates.withColumn("srv", F.col("value") - (u_mps * F.sin(a) + v_mps * F.cos(a)) * F.cos(e))
