"""Health of the chunk feed: anchors, gaps, poll states, recovery."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from . import scan

#: Fixed values of the feed's rules, in polls.
STALLED_AFTER, REANCHOR_AFTER, STUCK_AFTER = 5, 12, 60


def keys_after(keys: DataFrame, progress: DataFrame) -> DataFrame:
    """Keys of (site, volume_seq, key) behind the last seen one (column last_key; none yet: all)."""
    seen = progress.select("site", "volume_seq", "last_key")
    return keys.join(seen, ["site", "volume_seq"], "left").where("last_key is null or key > last_key").drop("last_key")


def cold_start_anchor(folders: DataFrame) -> DataFrame:
    """(site, anchor): one before the newest volume number, at least 0."""
    return folders.groupBy("site").agg(F.greatest(F.coalesce(F.max("volume_seq"), F.lit(0)) - 1, F.lit(0)).alias("anchor"))


def sequence_gaps(folders: DataFrame) -> DataFrame:
    """(site, volume_seq, next_volume, skipped) where numbers are missing in between."""
    out = scan.neighbours(folders.select("site", "volume_seq").distinct(), F.col("volume_seq"), "volume_seq").select("site", "volume_seq", F.col("after").alias("next_volume"))
    return out.withColumn("skipped", F.col("next_volume") - F.col("volume_seq") - 1).where("skipped > 0")


def ingest_state(polls: DataFrame, stalled_after: int = STALLED_AFTER) -> DataFrame:
    """polls (site, seq, is_error, reanchored) with attempts and state.

    attempts: errors in a row up to here. State: ReAnchoring where the poll re-anchored, else
    Polling, Retrying(n), or Stalled from stalled_after errors on.
    """
    out = scan.streak(polls, F.col("is_error"), "seq").drop("missed").withColumnRenamed("streak", "attempts")
    state = F.when(F.col("reanchored"), "ReAnchoring").when(F.col("attempts") == 0, "Polling").when(F.col("attempts") >= stalled_after, "Stalled").otherwise(F.concat(F.lit("Retrying("), F.col("attempts").cast("string"), F.lit(")")))
    return out.withColumn("state", state)


def data_age(status: DataFrame, now: Column) -> DataFrame:
    """(site, last_success, age_s) from polls with columns site, polled_at, is_error."""
    last = status.groupBy("site").agg(F.max(F.when(~F.col("is_error"), F.col("polled_at"))).alias("last_success"))
    return last.withColumn("age_s", F.unix_micros(now.cast("timestamp")) / 1e6 - F.unix_micros(F.col("last_success").cast("timestamp")) / 1e6)


def next_action(df: DataFrame) -> DataFrame:
    """The decision after an empty poll, from target, empty_polls, seen_any_key and newest (the
    highest folder number, null if none was listed). Adds action and new_target.

    Nothing seen for REANCHOR_AFTER polls: re-anchor to one before the newest folder, only ever
    forward. Data seen, but none for STUCK_AFTER polls: advance by one. Else continue.
    """
    ahead = F.greatest(F.col("newest") - 1, F.lit(0))
    waiting = ~F.col("seen_any_key") & (F.col("empty_polls") >= REANCHOR_AFTER)
    jump = waiting & (F.coalesce(ahead, F.col("target")) > F.col("target"))
    stuck = F.col("seen_any_key") & (F.col("empty_polls") >= STUCK_AFTER)
    return df.withColumns({"action": F.when(jump, "ReAnchor").when(stuck, "Advance").otherwise("Continue"), "new_target": F.when(jump, ahead).when(stuck, F.col("target") + 1).otherwise(F.col("target"))})


def recovery_actions(polls: DataFrame) -> DataFrame:
    """All actions over a site's polls: each one moves the target that later ones start from.

    polls: site, seq, n_keys (new keys of the volume polled; null is none), newest (nullable), start
    (the site's first target). One row per poll: site, seq, target, action, new_target, empty_polls
    (in a row since the last decision, this one included).

    When a decision is due follows from the run of empty polls alone: every REANCHOR_AFTER of them,
    but after STUCK_AFTER first where data was seen before the run. Advancing adds one to the target
    and re-anchoring takes the greater of two, so the target is the number of advances so far, plus
    the greatest of what re-anchoring offered, each less the advances before it: a running sum and a
    running maximum, which come in blocks of a site's history.
    """
    empty = F.coalesce(F.col("n_keys"), F.lit(0)) <= 0
    runs = scan.streak(polls.select("site", "seq", "n_keys", "newest", "start"), empty, "seq")
    stuck_first = F.when(F.col("missed"), STUCK_AFTER).otherwise(0)
    beyond = F.col("streak") - stuck_first  # polls of the run in which nothing counts as seen
    runs = runs.withColumns({
        "empty_polls": F.when(F.col("streak") == 0, 0).when(beyond > 0, (beyond - 1) % REANCHOR_AFTER + 1).otherwise(F.col("streak")),
        "_advance": (F.col("missed") & (F.col("streak") == STUCK_AFTER)).cast("int"),
        "_ahead": F.when((beyond > 0) & (beyond % REANCHOR_AFTER == 0), F.greatest(F.col("newest") - 1, F.lit(0))),
    })
    w = scan.inside("seq")
    runs = scan.cut(runs, "seq").withColumn("_advances", F.sum("_advance").over(scan.upto(w)))
    offer = F.col("_ahead") - F.col("_advances")
    runs = runs.withColumns({"_best": F.max(offer).over(scan.upto(w)), "_best_before": F.max(offer).over(scan.earlier(w))})

    def carried(blocks: DataFrame, w: WindowSpec) -> DataFrame:
        out = blocks.withColumn("_earlier", F.coalesce(F.sum("advances").over(scan.earlier(w)), F.lit(0)))
        return out.withColumn("_best_earlier", F.max(F.col("best") - F.col("_earlier")).over(scan.earlier(w)))

    runs = scan.carry(runs, [F.sum("_advance").alias("advances"), F.max("_best").alias("best")], carried)
    starts = polls.groupBy(F.col("site").alias("_site")).agg(F.min_by("start", "seq").alias("_start"))
    runs = runs.join(starts, F.col("site").eqNullSafe(F.col("_site")))
    total = F.col("_earlier") + F.col("_advances")
    target = total - F.col("_advance") + F.greatest("_start", "_best_earlier", F.col("_best_before") - F.col("_earlier"))
    new_target = total + F.greatest("_start", "_best_earlier", F.col("_best") - F.col("_earlier"))
    action = F.when(F.col("_advance") == 1, "Advance").when(new_target > target, "ReAnchor").otherwise("Continue")
    return runs.select("site", F.col("seq").cast("long").alias("seq"), target.cast("long").alias("target"), action.alias("action"), new_target.cast("long").alias("new_target"), F.col("empty_polls").cast("long").alias("empty_polls"))
