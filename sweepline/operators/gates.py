"""From moments to gates: exploding, calibrating, flagging, selecting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.codes import product_name
from ..functions.values import gate_flag, gate_range_km, physical


def explode_gates(moments: DataFrame, raw_col: str = "raw") -> DataFrame:
    """One row per gate: gate_idx and raw in place of the array."""
    return moments.select("*", F.posexplode(raw_col).alias("gate_idx", "gate_raw")).drop(raw_col).withColumnRenamed("gate_raw", "raw")


def calibrate(gates: DataFrame) -> DataFrame:
    """Add value from raw, scale and offset."""
    return gates.withColumn("value", physical(F.col("raw"), F.col("scale"), F.col("offset")))


def flag_gates(gates: DataFrame) -> DataFrame:
    """Add flag: below_snr, range_folded or data."""
    return gates.withColumn("flag", gate_flag(F.col("raw")))


def with_range(gates: DataFrame) -> DataFrame:
    """Add range_km from first_gate_m, gate_width_m and gate_idx."""
    return gates.withColumn("range_km", gate_range_km(F.col("first_gate_m"), F.col("gate_width_m"), F.col("gate_idx")))


def select_sweep(gates: DataFrame, elevation: int, product: str) -> DataFrame:
    """Rows of one elevation and product; the product may go by an alias."""
    return gates.where((F.col("elevation_number") == elevation) & (F.col("product") == product_name(F.lit(product))))


def available(gates: DataFrame) -> DataFrame:
    """What select_sweep could choose from: products of each elevation, as sorted text."""
    return gates.groupBy("elevation_number").agg(F.array_join(F.array_sort(F.collect_set("product")), ",").alias("products"))


def mask_below(gates: DataFrame, product: str, threshold: float = 0.0) -> DataFrame:
    """Drop values of the product below the displayable minimum, and null ones."""
    return gates.where((F.col("product") != product) | (F.col("value") >= threshold))


def base_product(gates: DataFrame, product: str) -> DataFrame:
    """Calibrated and coloured gates of one product that has a palette."""
    from .grid import colorize

    return colorize(flag_gates(calibrate(gates.where(F.col("product") == product))), product)
