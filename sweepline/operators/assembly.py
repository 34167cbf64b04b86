"""Assembles chunks and radials into sweeps and volumes with window functions.

chunks: site, chunk_no, kind (S, I, E), arrival, vcp (of message 5, nullable).
radials: site, chunk_no, radial_idx, elevation_number, radial_status, and for some operators
elevation_deg, nyquist, unamb_range, julian_date, scan_time_ms, rvol_vcp, latitude, longitude,
site_amsl_m (the last four null where the radial has no RVOL block).
Only readable chunks belong in either table: an undecodable one changes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.codes import CLOSING
from . import scan


def _silent(arrival: Column, before: Column, timeout: str) -> Column:
    return arrival >= before + F.expr(f"interval {timeout}")


def volume_epochs(chunks: DataFrame, timeout: str = "12 minutes") -> DataFrame:
    """Add epoch: counts up per site at every S, after an E, after silence, and at the first chunk.

    Also adds next_kind and next_silent, what follows the chunk at its site. A site's history is cut
    into blocks: a block counts the starts behind its first chunk, and whether that one starts an
    epoch follows from the last chunk of the block before.
    """
    w = scan.inside("chunk_no")
    mine = F.struct("kind", "arrival")

    def starts(now: Column, before: Column) -> Column:
        return (now["kind"] == "S") | before.isNull() | (before["kind"] == "E") | F.coalesce(_silent(now["arrival"], before["arrival"], timeout), F.lit(False))

    rows = scan.cut(chunks, "chunk_no").withColumns({"_before": F.lag(mine).over(w), "_after": F.lead(mine).over(w)})
    inner = F.when(F.col("_before").isNotNull(), starts(mine, F.col("_before")).cast("int")).otherwise(0)
    rows = rows.withColumn("_inner", inner).withColumn("_so_far", F.sum("_inner").over(scan.upto(w)))

    def carried(blocks: DataFrame, w: WindowSpec) -> DataFrame:
        out = blocks.withColumns({"_last_before": F.lag("last").over(w), "_next": F.lead("first").over(w)})
        out = out.withColumn("_opens", starts(F.col("first"), F.col("_last_before")).cast("int"))
        return out.withColumn("_starts_before", F.coalesce(F.sum(F.col("inner") + F.col("_opens")).over(scan.earlier(w)), F.lit(0)))

    rows = scan.carry(rows, [F.min_by(mine, "chunk_no").alias("first"), F.max_by(mine, "chunk_no").alias("last"), F.sum("_inner").alias("inner")], carried)
    after = F.coalesce("_after", "_next")
    epoch = (F.col("_starts_before") + F.col("_opens") + F.col("_so_far")).cast("long")
    return rows.select(*chunks.columns, after["kind"].alias("next_kind"), _silent(after["arrival"], F.col("arrival"), timeout).alias("next_silent"), epoch.alias("epoch"))


def placed_radials(radials: DataFrame, epochs: DataFrame) -> DataFrame:
    """Radials with their epoch and their position in it, and what became of them.

    Adds pos, first_pos (of the elevation), next_first (first position of the next new elevation),
    close_at (first closing status), closed_pos and accepted. An elevation is open from its first
    radial to its first closing status or, if that comes earlier, to the next new elevation.
    """
    of = epochs.where("kind <> 'S'").select("site", "chunk_no", "epoch")
    inside = Window.partitionBy("site", "epoch")
    out = radials.join(of, ["site", "chunk_no"]).withColumn("pos", F.row_number().over(inside.orderBy("chunk_no", "radial_idx")))
    # where each elevation begins, closes, and is followed by a new one: all by the epoch's partitioning
    each = Window.partitionBy("site", "epoch", "elevation_number")
    out = out.withColumns({"first_pos": F.min("pos").over(each), "close_at": F.min(F.when(F.col("radial_status").isin(*CLOSING), F.col("pos"))).over(each)})
    out = out.withColumn("next_first", F.min("first_pos").over(inside.orderBy("first_pos").rangeBetween(1, Window.unboundedFollowing)))
    complete = F.col("close_at").isNotNull() & (F.col("next_first").isNull() | (F.col("close_at") < F.col("next_first")))
    out = out.withColumn("complete", complete)
    accepted = F.when(F.col("complete"), F.col("pos") <= F.col("close_at")).otherwise(F.col("next_first").isNull() | (F.col("pos") < F.col("next_first")))
    return out.withColumn("accepted", accepted)


def close_sweeps(placed: DataFrame) -> DataFrame:
    """One row per sweep: site, epoch, elevation_number, complete, n_radials, n_late, first_pos,
    trigger_pos, and angle, Nyquist velocity and range of its first radial.

    trigger_pos is the radial that closed it: its closing one, the next elevation's first, or null
    where the sweep stayed open to the end of its epoch.
    """
    good = F.col("accepted")
    hoist = [F.min_by(c, "pos").alias(c) for c in ("elevation_deg", "nyquist", "unamb_range") if c in placed.columns]
    trigger = F.when(F.first("complete"), F.first("close_at")).otherwise(F.first("next_first")).alias("trigger_pos")
    return placed.groupBy("site", "epoch", "elevation_number").agg(F.first("complete").alias("complete"), F.count_if(good).alias("n_radials"), F.count_if(~good).alias("n_late"), F.first("first_pos").alias("first_pos"), trigger, *hoist)


def late_radials(placed: DataFrame) -> DataFrame:
    """Radials that came after their sweep had closed, per chunk and elevation."""
    return placed.where("not accepted").groupBy("site", "epoch", "chunk_no", "elevation_number").agg(F.count("*").alias("n_late"))


def close_volumes(epochs: DataFrame, placed: DataFrame) -> DataFrame:
    """One row per epoch with its status: Complete, TimedOut, Superseded, InProgress, or Silent.

    Silent: an S follows an epoch without any radial, which then ends without a word.
    """
    last = Window.partitionBy("site", "epoch")
    ends = epochs.withColumn("last_no", F.max("chunk_no").over(last)).where("chunk_no = last_no")
    seen = placed.groupBy("site", "epoch").agg(F.count_if("accepted").alias("n_accepted"))
    out = ends.join(seen, ["site", "epoch"], "left").withColumn("n_accepted", F.coalesce("n_accepted", F.lit(0)))
    return out.select("site", "epoch", _status(F.col("kind"), F.col("next_silent"), F.col("next_kind"), F.col("n_accepted")).alias("status"), "n_accepted", F.col("chunk_no").alias("last_chunk"))


def _status(kind: Column, next_silent: Column, next_kind: Column, n_accepted: Column) -> Column:
    """The status of an epoch by its last chunk."""
    return F.when(kind == "E", "Complete").when(next_silent, "TimedOut").when(next_kind == "S", F.when(n_accepted > 0, "Superseded").otherwise("Silent")).otherwise("InProgress")


def _msg5() -> Column:
    return F.max_by(F.when(F.col("kind") == "S", F.col("vcp")), F.when((F.col("kind") == "S") & F.col("vcp").isNotNull(), F.col("chunk_no"))).alias("msg5")


def message5_vcp(epochs: DataFrame) -> DataFrame:
    """(site, epoch, msg5): the VCP that the epoch's S chunk announced, null if it had none."""
    return epochs.groupBy("site", "epoch").agg(_msg5())


def volume_context(placed: DataFrame, epochs: DataFrame) -> DataFrame:
    """One row per epoch that has an accepted radial: its id from the first of them, position and
    VCP from the last one with an RVOL block. Message 5 goes before RVOL; defaults are 0."""
    good = placed.where("accepted")
    rvol = F.when(F.col("rvol_vcp").isNotNull(), F.col("pos"))
    of = good.groupBy("site", "epoch").agg(
        F.min_by("julian_date", "pos").alias("julian_date"), F.min_by("scan_time_ms", "pos").alias("scan_time_ms"),
        *[F.max_by(c, rvol).alias(c) for c in ("rvol_vcp", "latitude", "longitude", "site_amsl_m")],
    )
    of = of.join(message5_vcp(epochs), ["site", "epoch"])
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("latitude", "longitude", "site_amsl_m")}
    return of.withColumn("vcp_number", F.coalesce("msg5", "rvol_vcp", F.lit(0))).drop("msg5", "rvol_vcp").withColumns(zero)


def sweep_vcp(placed: DataFrame, sweeps: DataFrame, epochs: DataFrame) -> DataFrame:
    """Sweeps with vcp_number: of message 5, else of the last RVOL block up to the closing radial.

    The radial that closes a sweep counts even if it belongs to the next one. A sweep that its
    epoch left open sees all accepted radials.
    """
    inside = Window.partitionBy("site", "epoch").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    so_far = placed.where("accepted").select("site", "epoch", "pos", F.last("rvol_vcp", ignorenulls=True).over(inside).alias("rvol_so_far"))
    ends = so_far.groupBy("site", "epoch").agg(F.max("pos").alias("last_pos"))
    out = sweeps.join(ends, ["site", "epoch"]).withColumn("pos", F.coalesce("trigger_pos", "last_pos")).drop("last_pos")
    out = out.join(so_far, ["site", "epoch", "pos"], "left").join(message5_vcp(epochs), ["site", "epoch"])
    return out.withColumn("vcp_number", F.coalesce("msg5", "rvol_so_far", F.lit(0))).drop("msg5", "rvol_so_far").withColumnRenamed("pos", "emit_pos")


def missing_start(epochs: DataFrame) -> DataFrame:
    """(site, epoch, chunk_no) of the epochs that do not begin with an S."""
    first = epochs.groupBy("site", "epoch").agg(F.min("chunk_no").alias("chunk_no"), F.min_by("kind", "chunk_no").alias("kind"))
    return first.where("kind <> 'S'").select("site", "epoch", "chunk_no")


def assembly_events(epochs: DataFrame, placed: DataFrame) -> DataFrame:
    """All events in order: site, chunk_no (where it happens), epoch, event_type, elevation_number,
    complete, count, status, vcp_number, event_no (running number per site).

    Within a chunk: MissingStart, sweeps as they close, late radials by elevation, a sweep that an E
    chunk leaves open, the volume. A sweep or volume that a later S or silence ends is reported at
    the epoch's last chunk, after everything else.
    """
    return numbered_events(event_rows(epochs, placed))


def numbered_events(rows: DataFrame) -> DataFrame:
    """Events of event_rows() with event_no. Rows are read twice: on large tables, write them first."""
    return scan.numbered(rows, "event_no", "chunk_no", "phase", "place", "complete", "elevation_number").drop("phase", "place")


#: What placed radials need for events.
OF_RADIAL = ("site", "chunk_no", "radial_idx", "elevation_number", "radial_status", "rvol_vcp")


def event_rows(epochs: DataFrame, placed: DataFrame) -> DataFrame:
    """Events without their number; phase and place order those of a chunk.

    Radials are shuffled once, by epoch. What a sweep's event says is known at the radial that ends it: its own closing one, the
    first of the next elevation, or the last accepted one of the epoch. Sweeps then meet their epoch's chunks in one join.
    """
    epoch, good, pos = Window.partitionBy("site", "epoch"), F.col("accepted"), F.col("pos")
    so_far = F.last(F.when(good, F.col("rvol_vcp")), ignorenulls=True).over(epoch.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    seen = placed.select("site", "epoch", "elevation_number", "pos", "accepted", "complete", "first_pos", "close_at", "next_first", F.struct("chunk_no", so_far.alias("rvol")).alias("here"))
    sweeps = seen.groupBy("site", "epoch", "elevation_number").agg(
        *[F.first(c).alias(c) for c in ("complete", "first_pos", "close_at", "next_first")], F.count_if(good).alias("n_radials"), F.max(F.when(good, pos)).alias("last_pos"),
        *[F.max_by("here", F.when(at, pos)).alias(name) for name, at in (("opening", pos == F.col("first_pos")), ("closing", pos == F.col("close_at")), ("last_good", good))],
    )
    sweeps = sweeps.withColumns({
        "opens_epoch": F.lag("first_pos").over(epoch.orderBy("first_pos")).isNull(), "next_opening": F.lead("opening").over(epoch.orderBy("first_pos")),
        "n_accepted": F.sum("n_radials").over(epoch), "end_pos": F.max("last_pos").over(epoch), "end": F.max_by("last_good", "last_pos").over(epoch),
    })
    trigger = F.when(F.col("complete"), F.col("close_at")).otherwise(F.col("next_first"))
    sweeps = sweeps.withColumns({"trigger_pos": trigger, "emit": F.when(F.col("complete"), F.col("closing")).when(F.col("next_first").isNotNull(), F.col("next_opening")).otherwise(F.col("end"))})

    mine = epochs.groupBy("site", "epoch").agg(F.max_by(F.struct("kind", "next_silent", "next_kind"), "chunk_no").alias("z"), F.max("chunk_no").alias("last_chunk"), F.min("chunk_no").alias("first_chunk"), F.min_by("kind", "chunk_no").alias("first_kind"), _msg5())
    out = mine.join(sweeps, ["site", "epoch"], "left").withColumn("n_accepted", F.coalesce("n_accepted", F.lit(0)))
    out = out.withColumn("volume_status", _status(F.col("z.kind"), F.col("z.next_silent"), F.col("z.next_kind"), F.col("n_accepted")))

    def event(when: Column, kind: str, phase: Column | int, chunk_no: Column, **more: Column) -> Column:
        given = {"place": F.lit(0)} | more
        of = {"chunk_no": "long", "event_type": "string", "phase": "int", "place": "int", "elevation_number": "int", "complete": "boolean", "count": "long", "vcp_number": "int", "status": "string"}
        given |= {"chunk_no": chunk_no, "event_type": F.lit(kind), "phase": phase if isinstance(phase, Column) else F.lit(phase)}
        return F.when(when, F.struct(*[given.get(c, F.lit(None)).cast(t).alias(c) for c, t in of.items()]))

    once, open_end, last = F.coalesce("opens_epoch", F.lit(True)), F.col("trigger_pos").isNull(), F.col("last_chunk")
    status, of_site = F.col("volume_status"), F.col("site").isNotNull()
    vcp = lambda here: F.coalesce("msg5", F.col(here)["rvol"], F.lit(0))
    made = [
        event(once & (F.col("first_kind") != "S"), "MissingStart", 1, F.col("first_chunk")),
        event(F.col("first_pos").isNotNull() & ~(open_end & (status == "InProgress")), "SweepClosed", F.when(open_end, 4).otherwise(2), F.when(open_end, last).otherwise(F.col("emit")["chunk_no"]), place=F.coalesce("trigger_pos", "end_pos"), elevation_number=F.col("elevation_number"), complete=F.col("complete"), count=F.col("n_radials"), vcp_number=vcp("emit")),
        event(once & of_site & status.isin("Complete", "TimedOut", "Superseded"), "VolumeClosed", 5, last, vcp_number=vcp("end"), status=status),
    ]
    out = out.select("site", "epoch", F.inline(F.array_compact(F.array(*made))))
    late = late_radials(placed).select("site", "chunk_no", "epoch", F.lit("LateRadialsDiscarded").alias("event_type"), F.lit(3).alias("phase"), F.col("elevation_number").cast("int").alias("place"), "elevation_number", F.col("n_late").alias("count"))
    return out.select("site", "chunk_no", "epoch", "event_type", "phase", "place", "elevation_number", "complete", "count", "vcp_number", "status").unionByName(late, allowMissingColumns=True)
