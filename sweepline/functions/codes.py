"""Labels of the codes that radar messages carry, and the constants of the format."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the format.
RADIAL_STATUS = {0: "StartOfElevation", 1: "Intermediate", 2: "EndOfElevation", 3: "StartOfVolume", 4: "EndOfVolume", 5: "StartOfLastElevation"}
CLOSING = (2, 4)
WAVEFORM = {1: "Contiguous Surveillance", 2: "Contiguous Doppler with ambiguity resolution", 3: "Contiguous Doppler", 4: "Batch", 5: "Staggered Pulse Pair"}
CHANNEL = {0: "Constant Phase", 1: "Random Phase", 2: "SZ2 Phase"}
SPACING = {1: "0.5 deg", 2: "1.0 deg"}
SUPER_RES = ("half_degree", "doppler_300km", "dual_pol", "dual_pol_300km")  # bits 0 to 3
# Message types by the names of the public interface document between radar and product generator.
MESSAGE_TYPE = {
    1: "Digital Radar Data", 2: "RDA Status Data", 3: "Performance/Maintenance Data", 4: "Console Message - RDA to RPG", 5: "Volume Coverage Pattern - RDA to RPG", 6: "RDA Control Commands",
    7: "Volume Coverage Pattern - RPG to RDA", 8: "Clutter Censor Zones", 9: "Request for Data", 10: "Console Message - RPG to RDA", 11: "Loop Back Test - RDA to RPG", 12: "Loop Back Test - RPG to RDA",
    13: "Clutter Filter Bypass Map", 14: "Spare", 15: "Clutter Filter Map", 16: "Reserved - RDA to RPG", 17: "Reserved - RPG to RDA", 18: "RDA Adaptation Data", 29: "Model Data",
    31: "Digital Radar Data Generic Format", 32: "RDA PRF Data", 33: "RDA Log Data",
}
# Volume coverage patterns by the weather that they are for.
CLEAR_AIR, PRECIPITATION, MAINTENANCE = (31, 32, 35), (11, 12, 21, 112, 121, 211, 212, 215, 221), (80,)
VCP = {n: name for numbers, name in ((CLEAR_AIR, "clear air"), (PRECIPITATION, "precipitation"), (MAINTENANCE, "maintenance")) for n in numbers}
PRODUCTS = ("DREF", "DVEL", "DSW", "DZDR", "DPHI", "DRHO", "DCFP")
PRODUCT_ALIASES = {
    "DREF": "DREF", "REF": "DREF", "Z": "DREF", "DBZ": "DREF", "DVEL": "DVEL", "VEL": "DVEL", "V": "DVEL", "DSW": "DSW", "SW": "DSW", "W": "DSW",
    "DZDR": "DZDR", "ZDR": "DZDR", "DPHI": "DPHI", "PHI": "DPHI", "KDP": "DPHI", "DRHO": "DRHO", "RHO": "DRHO", "CC": "DRHO",
}
#: scale and offset of each product, as observed
SCALE_OFFSET = {"DREF": (2.0, 66.0), "DVEL": (2.0, 129.0), "DSW": (2.0, 129.0), "DZDR": (32.0, 418.0), "DPHI": (2.8361, 2.0), "DRHO": (300.0, -60.5), "DCFP": (1.0, 8.0)}


def label(code: Column, names: dict[int, str]) -> Column:
    """The code's name; 'Unknown(n)' for any other code, null for null."""
    table = F.create_map(*[x for k, v in names.items() for x in (F.lit(k), F.lit(v))])
    return F.when(code.isNotNull(), F.coalesce(table[code.cast("int")], F.concat(F.lit("Unknown("), code.cast("string"), F.lit(")"))))


def code_table(spark: SparkSession, names: dict[int, str]) -> DataFrame:
    return spark.createDataFrame(list(names.items()), "code int, label string")


def super_res_flags(mask: Column) -> Column:
    """Names of the bits that are set, in bit order."""
    return F.array_compact(F.array(*[F.when(F.getbit(mask.cast("int"), F.lit(i)) == 1, F.lit(n)) for i, n in enumerate(SUPER_RES)]))


def product_name(alias: Column) -> Column:
    """The product that an alias (any case) means; null for an unknown one."""
    table = F.create_map(*[F.lit(x) for kv in PRODUCT_ALIASES.items() for x in kv])
    return table[F.upper(alias)]


def product_keys(products: Column) -> Column:
    """Names of the products that a map holds, in the format's order; null for a null map."""
    return F.when(products.isNotNull(), F.filter(F.array(*map(F.lit, PRODUCTS)), lambda p: F.array_contains(F.map_keys(products), p)))


def has_product(products: Column, alias: Column) -> Column:
    """Whether a map of products holds the one that the alias means; false for an unknown alias, null for a null map."""
    return F.when(products.isNotNull(), F.coalesce(F.map_contains_key(products, product_name(alias)), F.lit(False)))


def product_of(products: Column, alias: Column) -> Column:
    """The map's entry for the product that the alias means; null if there is none."""
    return F.try_element_at(products, product_name(alias))


def label_codes(df: DataFrame, **columns: str) -> DataFrame:
    """Add <column>_label for each given column, e.g. label_codes(df, status="radial_status").

    Keys: status, waveform, channel, spacing, message, vcp.
    """
    tables = {"status": RADIAL_STATUS, "waveform": WAVEFORM, "channel": CHANNEL, "spacing": SPACING, "message": MESSAGE_TYPE, "vcp": VCP}
    return df.withColumns({f"{c}_label": label(F.col(c), tables[kind]) for kind, c in columns.items()})
