"""Summaries of radials, moments, messages, chunks, sweeps and volumes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.codes import MESSAGE_TYPE, RADIAL_STATUS, label


def with_site(df: DataFrame, sites: DataFrame, id_col: str = "site_id") -> DataFrame:
    """Left join with the sites table by id in any case; unknown ids get nulls.

    The registry of sites has some hundred rows, and is broadcast only if Spark's size check allows.
    """
    by_id = sites.select(F.upper("id").alias("site_key"), *[c for c in sites.columns if c != "id"])
    return df.withColumn("site_key", F.upper(id_col)).join(by_id, "site_key", "left").drop("site_key")


def bucket_vs_registry(prefixes: DataFrame, sites: DataFrame) -> DataFrame:
    """(id, side): ids only in the feed (feed_only) or only in the registry (registry_only)."""
    feed, known = prefixes.select(F.upper("id").alias("id")).distinct(), sites.select(F.upper("id").alias("id")).distinct()
    return feed.join(known, "id", "left_anti").withColumn("side", F.lit("feed_only")).union(known.join(feed, "id", "left_anti").withColumn("side", F.lit("registry_only")))


def sweep_inventory(moments: DataFrame) -> DataFrame:
    """Per elevation: mean angle, number of radials, moments with the gate count first seen.

    moments: elevation_number, radial_id (orders radials), elevation_deg, product, gate_count.
    """
    first = moments.groupBy("elevation_number", "product").agg(F.min_by("gate_count", "radial_id").alias("gates"))
    named = first.groupBy("elevation_number").agg(F.array_join(F.array_sort(F.collect_list(F.concat("product", F.lit(":"), F.col("gates").cast("string")))), ",").alias("moments"))
    radials = moments.groupBy("elevation_number", "radial_id").agg(F.first("elevation_deg").alias("elevation_deg"))
    per = radials.groupBy("elevation_number").agg(F.avg("elevation_deg").alias("mean_deg"), F.count("*").alias("n_radials"))
    return per.join(named, "elevation_number")


def status_counts(radials: DataFrame, keys: tuple[str, ...] = ("site", "chunk_no")) -> DataFrame:
    """Per chunk the number of radials of each status class, and a text of the non-zero ones."""
    s = F.col("radial_status")
    counts = {n: F.count_if(s == k).alias(n) for k, n in RADIAL_STATUS.items()} | {"Unknown": F.count_if(~s.isin(*RADIAL_STATUS)).alias("Unknown")}
    out = radials.groupBy(*keys).agg(*counts.values())
    text = F.concat_ws(" ", *[F.when(F.col(n) > 0, F.concat(F.lit(f"{n}="), F.col(n).cast("string"))) for n in counts])
    return out.withColumn("summary", text)


def scan_geometry(radials: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Per sweep: mean angle, azimuth range, mean spacing, super resolution, first non-zero Nyquist
    velocity and range, first VCP. radial_idx orders the radials of a sweep.

    The mean of sorted differences telescopes to (max - min) / (n - 1), 0 below two radials.
    """
    first = lambda c: F.min_by(c, F.when(F.coalesce(F.col(c), F.lit(0)) != 0, F.col("radial_idx"))).alias(c)
    out = radials.groupBy(*keys).agg(F.avg("elevation_deg").alias("mean_deg"), F.count("*").alias("n_radials"), F.min("azimuth_deg").alias("az_min"), F.max("azimuth_deg").alias("az_max"), first("nyquist"), first("unamb_range"), first("rvol_vcp"))
    out = out.withColumn("az_spacing", F.when(F.col("n_radials") < 2, F.lit(0.0)).otherwise((F.col("az_max") - F.col("az_min")) / (F.col("n_radials") - 1)))
    return out.withColumn("super_res", F.col("az_spacing") < 0.75)


def moment_geometry(moments: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Per sweep and product the gate geometry of its first radial."""
    g = F.min_by(F.struct("gate_count", "first_gate_m", "gate_width_m", "scale", "offset"), "radial_idx").alias("geometry")
    return moments.groupBy(*keys, "product").agg(g).select(*keys, "product", "geometry.*")


def moment_stats(gates: DataFrame, keys: tuple[str, ...] = ("product",)) -> DataFrame:
    """Number of gates and of valid ones, their share, and min, max, mean, population deviation."""
    v = F.col("value")
    return gates.groupBy(*keys).agg(F.count("*").alias("n_gates"), F.count(v).alias("n_valid"), (F.count(v) * 100.0 / F.count("*")).alias("valid_pct"), F.min(v).alias("min_value"), F.max(v).alias("max_value"), F.avg(v).alias("mean_value"), F.stddev_pop(v).alias("std_value"))


def message_census(messages: DataFrame) -> DataFrame:
    """Messages by type, and the total under type null."""
    out = messages.rollup("msg_type").agg(F.count("*").alias("n"))
    return out.withColumn("label", F.coalesce(label(F.col("msg_type"), MESSAGE_TYPE), F.lit("Total")))


def chunk_sizes(chunks: DataFrame) -> DataFrame:
    """raw_bytes, message_bytes and their ratio, from columns content and stream (decompressed)."""
    out = chunks.withColumns({"raw_bytes": F.octet_length("content").cast("long"), "message_bytes": F.octet_length("stream").cast("long")})
    return out.withColumn("ratio", F.try_divide("message_bytes", "raw_bytes")).drop("content", "stream")


def max_range(moments: DataFrame) -> DataFrame:
    """Greatest range per elevation and product, km."""
    return moments.groupBy("elevation_number", "product").agg(F.max((F.col("first_gate_m") + F.col("gate_count") * F.col("gate_width_m")) / 1000.0).alias("max_range_km"))


def volume_summary(sweeps: DataFrame, chunks: DataFrame) -> DataFrame:
    """Per (site, epoch): sweeps, complete sweeps, mean radials per sweep, first to last arrival in seconds."""
    s = sweeps.groupBy("site", "epoch").agg(F.count("*").alias("n_sweeps"), F.count_if("complete").alias("n_complete"), F.avg("n_radials").alias("mean_radials"))
    c = chunks.groupBy("site", "epoch").agg(F.count("*").alias("n_chunks"), ((F.unix_micros(F.max("arrival").cast("timestamp")) - F.unix_micros(F.min("arrival").cast("timestamp"))) / 1e6).alias("duration_s"))
    return c.join(s, ["site", "epoch"], "left").withColumns({"n_sweeps": F.coalesce("n_sweeps", F.lit(0)), "n_complete": F.coalesce("n_complete", F.lit(0))})


def repeated_cuts(cuts: DataFrame) -> DataFrame:
    """Cuts (vcp_number, cut, elevation_deg, waveform) with what they repeat.

    split_cut: same angle as the cut right before. inserted: the angle occurred before, but the cut
    right before has another one.
    """
    angle = F.round("elevation_deg", 2)
    by_cut = Window.partitionBy("vcp_number").orderBy("cut")
    out = cuts.withColumn("angle", angle).withColumn("before", F.lag("angle").over(by_cut))
    out = out.withColumn("first_cut", F.min("cut").over(Window.partitionBy("vcp_number", "angle")))
    same = F.coalesce(F.col("before") == F.col("angle"), F.lit(False))
    return out.withColumns({"split_cut": same, "inserted": (F.col("first_cut") < F.col("cut")) & ~same}).drop("before")


def commanded_vs_measured(sweeps: DataFrame, cuts: DataFrame) -> DataFrame:
    """Sweeps with the angle that their VCP's cut of the same number commands, and the difference."""
    c = cuts.select("vcp_number", F.col("cut").alias("elevation_number"), F.col("elevation_deg").alias("commanded_deg"))
    return sweeps.join(c, ["vcp_number", "elevation_number"]).withColumn("difference_deg", F.col("elevation_deg") - F.col("commanded_deg"))


def volume_vcp(volumes: DataFrame, vcps: DataFrame, radials: DataFrame) -> DataFrame:
    """Volumes (site, epoch) with vcp_number: that of message 5, else the last RVOL number, else 0."""
    last = radials.groupBy("site", "epoch").agg(F.max_by("rvol_vcp", F.when(F.col("rvol_vcp").isNotNull(), F.col("pos"))).alias("rvol"))
    out = volumes.join(vcps, ["site", "epoch"], "left").join(last, ["site", "epoch"], "left")
    return out.withColumn("vcp_number", F.coalesce("msg5", "rvol", F.lit(0))).drop("msg5", "rvol")


def azimuth_coverage(radials: DataFrame, keys: tuple[str, ...], gap_deg: float = 1.0) -> DataFrame:
    """Per sweep: gaps wider than gap_deg between neighbouring azimuths, round the circle."""
    w = Window.partitionBy(*keys).orderBy("azimuth_deg")
    first = F.first("azimuth_deg").over(w)
    gap = F.coalesce(F.lead("azimuth_deg").over(w), first + 360.0) - F.col("azimuth_deg")
    wide = F.when(F.col("gap") > gap_deg, F.col("gap"))
    return radials.withColumn("gap", gap).groupBy(*keys).agg(F.count(wide).alias("n_gaps"), F.coalesce(F.sum(wide), F.lit(0.0)).alias("missing_deg"), F.max("gap").alias("widest_deg"))


def by_azimuth(radials: DataFrame, keys: tuple[str, ...] = ("site", "elevation_number")) -> DataFrame:
    """Radials in the order of their azimuths round each sweep, with place from 1.

    Equal azimuths keep the radials' order; radials without an azimuth (null or NaN) are left out.
    """
    valid = radials.where(F.col("azimuth_deg").isNotNull() & ~F.isnan("azimuth_deg"))
    return valid.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy("azimuth_deg", "radial_idx")))
