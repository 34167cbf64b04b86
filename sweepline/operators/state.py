"""The latest state of every site, from its ordered assembly events.

events: site, event_no (order of arrival), event_type, elevation_number, volume (a number or struct
that orders volumes), vcp_number, status. RESET events empty a site's state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from . import scan


def _applied(events: DataFrame) -> DataFrame:
    """Add block, life (counts resets), vcp_epoch (counts VCP changes) and applied to every event.

    Blocks of a site are worked on apart; what a block inherits (resets, turns, the last VCP, each
    elevation's newest volume) comes from a scan of the blocks' summaries.
    """
    w = scan.inside("event_no")
    sweep, reset = F.col("event_type") == "SweepClosed", F.col("event_type") == "RESET"
    vcp = F.when(sweep, F.col("vcp_number"))
    out = scan.cut(events, "event_no").withColumn("_life", F.sum(reset.cast("int")).over(scan.upto(w)))
    # a sweep's turn shows inside its block, but for the first one of the block's first life
    alone = Window.partitionBy("site", "block", "_life").orderBy("event_no")
    out = out.withColumn("_vcp_before", F.last(vcp, ignorenulls=True).over(scan.earlier(alone)))
    out = out.withColumn("_turn", F.coalesce((sweep & (F.col("vcp_number") != F.col("_vcp_before"))).cast("int"), F.lit(0)))
    out = out.withColumns({"_turns": F.sum("_turn").over(scan.upto(w)), "_follows": F.coalesce(F.max(F.when(sweep & (F.col("_life") == 0), 1)).over(scan.upto(w)), F.lit(0))})
    summary = [F.max("_life").alias("resets"), F.sum("_turn").alias("turns"), F.min_by(vcp, F.when(sweep & (F.col("_life") == 0), F.col("event_no"))).alias("first_vcp"), F.max_by(F.struct("_life", "vcp_number"), F.when(sweep, F.col("event_no"))).alias("last_sweep")]

    def lives(blocks: DataFrame, w: WindowSpec) -> DataFrame:
        out = blocks.withColumn("_lives_before", F.coalesce(F.sum("resets").over(scan.earlier(w)), F.lit(0)))
        held = F.when(F.col("last_sweep").isNotNull(), F.struct((F.col("_lives_before") + F.col("last_sweep._life")).alias("life"), F.col("last_sweep.vcp_number").alias("vcp")))
        out = out.withColumn("_held", F.last(held, ignorenulls=True).over(scan.earlier(w)))
        turned = (F.col("_held.life") == F.col("_lives_before")) & (F.col("first_vcp") != F.col("_held.vcp"))
        out = out.withColumn("_first_turn", F.coalesce(turned.cast("int"), F.lit(0)))
        return out.withColumn("_turns_before", F.coalesce(F.sum(F.col("turns") + F.col("_first_turn")).over(scan.earlier(w)), F.lit(0))).drop("_held")

    out = scan.carry(out, summary, lives)
    out = out.withColumns({"life": F.col("_lives_before") + F.col("_life"), "vcp_epoch": F.col("_turns_before") + F.col("_turns") + F.col("_first_turn") * F.col("_follows")})

    # the newest volume so far of an elevation in its VCP epoch: of the block by a window, of earlier blocks by a map
    same = Window.partitionBy("site", "block", "life", "vcp_epoch", "event_type", "elevation_number").orderBy("event_no")
    key = F.concat_ws(":", "life", "vcp_epoch", "elevation_number")
    out = out.withColumn("_newest", F.max(F.when(sweep, F.col("volume"))).over(scan.earlier(same)))
    tops = out.where(sweep).groupBy("site", "block", "life", "vcp_epoch", "elevation_number").agg(F.max("volume").alias("top"))
    so_far = Window.partitionBy("site", "life", "vcp_epoch", "elevation_number").orderBy("block")
    tops = tops.withColumn("top", F.max("top").over(scan.earlier(so_far))).where("top is not null")
    tops = tops.groupBy(F.col("site").alias("_site"), F.col("block").alias("_block")).agg(F.map_from_entries(F.collect_list(F.struct(key, "top"))).alias("_tops"))
    out = out.join(tops, F.col("site").eqNullSafe(F.col("_site")) & F.col("block").eqNullSafe(F.col("_block")), "left")
    newest = F.greatest("_newest", F.try_element_at("_tops", key))
    fresh = newest.isNull() | (F.col("volume") >= newest)
    applied = F.when(sweep, fresh).when(F.col("event_type") == "VolumeClosed", F.col("status") == "Complete").otherwise(reset)
    return out.select(*events.columns, "block", "life", "vcp_epoch", F.coalesce(applied, F.lit(False)).alias("applied"))


def revisions(events: DataFrame) -> DataFrame:
    """Events with applied and the running revision of their site."""
    out = _applied(events).withColumn("_here", F.sum(F.col("applied").cast("int")).over(scan.upto(scan.inside("event_no"))))
    out = scan.carry(out, [F.sum(F.col("applied").cast("int")).alias("n")], lambda b, w: b.withColumn("_earlier", F.coalesce(F.sum("n").over(scan.earlier(w)), F.lit(0))))
    return out.select(*events.columns, "applied", (F.col("_earlier") + F.col("_here")).alias("revision"))


def current_sweeps(events: DataFrame) -> DataFrame:
    """The latest sweep of each (site, elevation).

    A VCP change empties the set, even if the arriving sweep is of an older volume; an older volume
    never replaces a newer one; of equal ones the later arrival stays.
    """
    out = _applied(events)
    last = out.groupBy("site").agg(F.max("life").alias("life"))
    now = out.join(last, ["site", "life"]).where("event_type = 'SweepClosed'")
    top = now.groupBy("site").agg(F.max("vcp_epoch").alias("vcp_epoch"))
    now = now.join(top, ["site", "vcp_epoch"])
    best = F.max_by(F.struct("event_no", "volume", "vcp_number"), F.struct("volume", "event_no")).alias("s")
    return now.groupBy("site", "elevation_number").agg(best).select("site", "elevation_number", "s.*")


def last_complete(events: DataFrame) -> DataFrame:
    """(site, event_no, volume): the Complete volume that arrived last, whatever its number."""
    out = _applied(events)
    last = out.groupBy("site").agg(F.max("life").alias("life"))
    done = out.join(last, ["site", "life"]).where("event_type = 'VolumeClosed' and status = 'Complete'")
    return done.groupBy("site").agg(F.max("event_no").alias("event_no"), F.max_by("volume", "event_no").alias("volume"))


def snapshot(events: DataFrame) -> DataFrame:
    """One row per site: sweeps ordered by elevation, the last complete volume, the revision."""
    sweeps = current_sweeps(events).groupBy("site").agg(F.sort_array(F.collect_list(F.struct("elevation_number", "volume", "vcp_number"))).alias("sweeps"))
    revision = _applied(events).groupBy("site").agg(F.sum(F.col("applied").cast("int")).alias("revision"))
    return revision.join(sweeps, "site", "left").join(last_complete(events).select("site", F.col("volume").alias("last_complete")), "site", "left")


def revision_changes(snapshots: DataFrame) -> DataFrame:
    """Snapshots (site, seq, revision) whose revision differs from the one before, and each first one."""
    out = scan.neighbours(snapshots, F.col("revision"), "seq")
    return out.where("before is null or revision <> before").select(*snapshots.columns)


def recent_events(events: DataFrame, n: int = 64) -> DataFrame:
    """The newest n events of each site. Spark filters by rank before it shuffles."""
    w = Window.partitionBy("site").orderBy(F.desc("event_no"))
    return events.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)
