"""Queries on sequences of chunks and radials: assembly, state, feed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import assembly, feed, inspect, state
from ..runtime import written
from .adapters import cte, view
from .registry import query

TIMEOUT = "14 hours"  # events lie far apart; tests use 12 minutes


def assembled(spark: SparkSession, sf_dir: str, read_once: bool = False, needed: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(epochs, placed radials) of the events. What is read several times is written once, with all columns or the needed ones of the radials."""
    radials = view(spark, sf_dir, "radials")
    radials = written(radials.select(*needed, "kind", "ts", "msg5_vcp") if needed else radials)
    epochs = assembly.volume_epochs(view(spark, sf_dir, "chunks", radials=radials), TIMEOUT)
    epochs = epochs if read_once else written(epochs)
    placed = assembly.placed_radials(radials.where("kind <> 'S'").drop("kind", "msg5_vcp"), epochs)
    return epochs, placed if read_once else written(placed)


def assembly_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of the radials, without the columns that no event has; they are written before they are numbered."""
    return assembly.numbered_events(written(assembly.event_rows(*assembled(spark, sf_dir, needed=assembly.OF_RADIAL))))


def arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assembly events for the state operators; a volume is its epoch, made late now and then."""
    return written(assembly_events(spark, sf_dir)).withColumn("volume", F.col("epoch") - F.when(F.col("event_no") % 9 == 0, 2).otherwise(0))


EPOCHS = cte("chunks") + f""",
ep as (select *, sum(s) over (partition by site order by chunk_no) as epoch from (select *, case when kind = 'S' or lag(kind) over w is null or lag(kind) over w = 'E' or arrival >= lag(arrival) over w + interval {TIMEOUT} then 1 else 0 end as s,
  lead(kind) over w as next_kind, lead(arrival) over w >= arrival + interval {TIMEOUT} as next_silent from chunks window w as (partition by site order by chunk_no)))"""
PLACED = EPOCHS + """,
p0 as (select r.*, e.epoch, row_number() over (partition by r.site, e.epoch order by r.chunk_no, r.radial_idx) as pos from radials r join ep e on r.site = e.site and r.chunk_no = e.chunk_no where e.kind <> 'S'),
sp as (select *, lead(first_pos) over (partition by site, epoch order by first_pos) as next_first from (select site, epoch, elevation_number, min(pos) as first_pos, min(pos) filter (radial_status in (2, 4)) as close_at from p0 group by 1, 2, 3)),
p1 as (select p0.*, first_pos, close_at, next_first, close_at is not null and (next_first is null or close_at < next_first) as complete from p0 join sp using (site, epoch, elevation_number)),
p as (select *, case when complete then pos <= close_at else next_first is null or pos < next_first end as accepted from p1)"""
MSG5 = """,
m5 as (select site, epoch, max(case when kind = 'S' then vcp end) as msg5 from ep group by site, epoch)"""
SWEEPS = PLACED + """,
sw as (select site, epoch, elevation_number, bool_or(complete) as complete, count(*) filter (accepted) as n_radials, count(*) filter (not accepted) as n_late, min(first_pos) as first_pos,
  min(case when complete then close_at else next_first end) as trigger_pos, arg_min(elevation_deg, pos) as elevation_deg, arg_min(coalesce(nyquist, -1), pos) as nyquist, arg_min(unamb_range, pos) as unamb_range from p group by 1, 2, 3)"""
VOLUMES = SWEEPS + MSG5 + """,
na as (select site, epoch, count(*) filter (accepted) as n_accepted from p group by 1, 2),
vol as (select e.site, e.epoch, case when e.kind = 'E' then 'Complete' when e.next_silent then 'TimedOut' when e.next_kind = 'S' then case when coalesce(n_accepted, 0) > 0 then 'Superseded' else 'Silent' end else 'InProgress' end as status,
  coalesce(n_accepted, 0) as n_accepted, e.chunk_no as last_chunk from ep e join (select site, epoch, max(chunk_no) as chunk_no from ep group by 1, 2) l on e.site = l.site and e.chunk_no = l.chunk_no
  left join na on na.site = e.site and na.epoch = e.epoch)"""
SWEEP_VCP = VOLUMES + """,
rv as (select site, epoch, pos, last_value(rvol_vcp ignore nulls) over (partition by site, epoch order by pos rows between unbounded preceding and current row) as rvol from p where accepted),
ends as (select site, epoch, max(pos) as last_pos from rv group by 1, 2),
sv as (select sw.*, coalesce(trigger_pos, last_pos) as emit_pos, coalesce(msg5, rvol, 0) as vcp_number from sw join ends using (site, epoch) left join rv on rv.site = sw.site and rv.epoch = sw.epoch and rv.pos = coalesce(trigger_pos, last_pos) join m5 on m5.site = sw.site and m5.epoch = sw.epoch)"""
CONTEXT = """,
ctx as (select p.site, p.epoch, arg_min(julian_date, pos) as julian_date, arg_min(scan_time_ms, pos) as scan_time_ms, coalesce(arg_max(latitude, pos) filter (rvol_vcp is not null), 0) as latitude,
  coalesce(arg_max(longitude, pos) filter (rvol_vcp is not null), 0) as longitude, coalesce(arg_max(site_amsl_m, pos) filter (rvol_vcp is not null), 0) as site_amsl_m,
  coalesce(any_value(msg5), arg_max(rvol_vcp, pos) filter (rvol_vcp is not null), 0) as vcp_number from p join m5 on p.site = m5.site and p.epoch = m5.epoch where accepted group by 1, 2)"""
EVENTS = SWEEP_VCP + CONTEXT + """,
ev0 as (
select site, chunk_no, epoch, 'MissingStart' as event_type, 1 as phase, 0 as place, null::int as elevation_number, null::boolean as complete, null::bigint as count, null::int as vcp_number, null::varchar as status from (select site, epoch, min(chunk_no) as chunk_no, arg_min(kind, chunk_no) as kind from ep group by 1, 2) where kind <> 'S'
union all select sv.site, case when trigger_pos is null then last_chunk else p.chunk_no end, sv.epoch, 'SweepClosed', case when trigger_pos is null then 4 else 2 end, emit_pos, sv.elevation_number, sv.complete, n_radials, vcp_number, null from sv join p on p.site = sv.site and p.epoch = sv.epoch and p.pos = emit_pos join vol on vol.site = sv.site and vol.epoch = sv.epoch where not (trigger_pos is null and vol.status = 'InProgress')
union all select site, chunk_no, epoch, 'LateRadialsDiscarded', 3, elevation_number, elevation_number, null, count(*), null, null from p where not accepted group by site, chunk_no, epoch, elevation_number
union all select vol.site, last_chunk, vol.epoch, 'VolumeClosed', 5, 0, null, null, null, coalesce(ctx.vcp_number, msg5, 0), vol.status from vol left join ctx on ctx.site = vol.site and ctx.epoch = vol.epoch join m5 on m5.site = vol.site and m5.epoch = vol.epoch where vol.status in ('Complete', 'TimedOut', 'Superseded')),
ev as (select *, row_number() over (partition by site order by chunk_no, phase, place, complete nulls first, elevation_number nulls first) as event_no from ev0)"""
APPLIED = EVENTS + """,
a0 as (select *, epoch - case when event_no % 9 = 0 then 2 else 0 end as volume from ev),
a1 as (select *, last_value(case when event_type = 'SweepClosed' then vcp_number end ignore nulls) over (partition by site order by event_no rows between unbounded preceding and 1 preceding) as before from a0),
a2 as (select *, sum(case when event_type = 'SweepClosed' and vcp_number <> before then 1 else 0 end) over (partition by site order by event_no) as vcp_epoch from a1),
a3 as (select *, max(volume) over (partition by site, vcp_epoch, event_type, elevation_number order by event_no rows between unbounded preceding and 1 preceding) as newest from a2),
a as (select *, coalesce(case when event_type = 'SweepClosed' then newest is null or volume >= newest when event_type = 'VolumeClosed' then status = 'Complete' else false end, false) as applied from a3)"""
CURRENT = APPLIED + """,
cur as (select site, elevation_number, arg_max(struct_pack(event_no := event_no, volume := volume, vcp_number := vcp_number), struct_pack(v := volume, n := event_no)) as s from a join (select site, max(vcp_epoch) as top from a where event_type = 'SweepClosed' group by 1) t using (site)
  where event_type = 'SweepClosed' and vcp_epoch = top group by 1, 2)"""


@query(EPOCHS + " select site, chunk_no, kind, epoch::bigint as epoch from ep")
def w1_volume_epochs(spark, sf_dir):
    return assembly.volume_epochs(view(spark, sf_dir, "chunks"), TIMEOUT).select("site", "chunk_no", "kind", "epoch")


@query(SWEEPS + " select site, epoch::bigint as epoch, elevation_number, complete, n_radials, n_late, first_pos, trigger_pos, round(elevation_deg, 6) as elevation_deg, nyquist, unamb_range from sw")
def w2_close_sweeps(spark, sf_dir):
    out = assembly.close_sweeps(assembled(spark, sf_dir, read_once=True)[1].withColumn("nyquist", F.coalesce("nyquist", F.lit(-1.0))))
    return out.withColumns({"elevation_deg": F.round("elevation_deg", 6), "first_pos": F.col("first_pos").cast("long"), "trigger_pos": F.col("trigger_pos").cast("long")})


@query(PLACED + " select site, epoch::bigint as epoch, chunk_no, elevation_number, count(*) as n_late from p where not accepted group by all")
def w3_late_radials(spark, sf_dir):
    return assembly.late_radials(assembled(spark, sf_dir, read_once=True)[1])


@query(VOLUMES + " select site, epoch::bigint as epoch, status, n_accepted, last_chunk from vol")
def w4_close_volumes(spark, sf_dir):
    return assembly.close_volumes(*assembled(spark, sf_dir))


@query(VOLUMES + CONTEXT + " select site, epoch::bigint as epoch, julian_date, scan_time_ms, latitude, longitude, site_amsl_m, vcp_number from ctx")
def w5_volume_context(spark, sf_dir):
    epochs, placed = assembled(spark, sf_dir)
    return assembly.volume_context(placed, epochs)


@query(SWEEP_VCP + " select site, epoch::bigint as epoch, elevation_number, emit_pos::bigint as emit_pos, vcp_number from sv")
def w5_sweep_vcp(spark, sf_dir):
    epochs, placed = assembled(spark, sf_dir)
    out = assembly.sweep_vcp(placed, assembly.close_sweeps(placed), epochs)
    return out.select("site", "epoch", "elevation_number", F.col("emit_pos").cast("long").alias("emit_pos"), "vcp_number")


@query(EPOCHS + " select site, epoch::bigint as epoch, min(chunk_no) as chunk_no from ep group by site, epoch having arg_min(kind, chunk_no) <> 'S'")
def w6_missing_start(spark, sf_dir):
    return assembly.missing_start(assembly.volume_epochs(view(spark, sf_dir, "chunks"), TIMEOUT))


@query(EVENTS + " select site, chunk_no, epoch::bigint as epoch, event_type, elevation_number, complete, count, vcp_number, status, event_no::int as event_no from ev")
def w7_assembly_events(spark, sf_dir):
    return assembly_events(spark, sf_dir)


@query(CURRENT + " select site, elevation_number, s.event_no::int as event_no, s.volume::bigint as volume, s.vcp_number as vcp_number from cur")
def w8_current_sweeps(spark, sf_dir):
    return state.current_sweeps(arrivals(spark, sf_dir))


@query(APPLIED + " select site, max(event_no)::int as event_no, arg_max(volume, event_no)::bigint as volume from a where event_type = 'VolumeClosed' and status = 'Complete' group by site")
def w9_last_complete(spark, sf_dir):
    return state.last_complete(arrivals(spark, sf_dir))


@query(APPLIED + " select site, event_no::int as event_no, event_type, applied, (sum(applied::int) over (partition by site order by event_no))::bigint as revision from a")
def w10_revisions(spark, sf_dir):
    return state.revisions(arrivals(spark, sf_dir)).select("site", "event_no", "event_type", "applied", "revision")


@query(APPLIED + ", r as (select site, event_no, (sum(applied::int) over (partition by site order by event_no))::bigint as revision from a) select site, event_no::int as seq, revision from (select *, lag(revision) over (partition by site order by event_no) as b from r) where b is null or revision <> b")
def w11_revision_changes(spark, sf_dir):
    return state.revision_changes(state.revisions(arrivals(spark, sf_dir)).select("site", F.col("event_no").alias("seq"), "revision"))


@query(EVENTS + " select site, event_no::int as event_no, event_type from (select *, row_number() over (partition by site order by event_no desc) as n from ev) where n <= 64")
def w12_recent_events(spark, sf_dir):
    return state.recent_events(arrivals(spark, sf_dir)).select("site", "event_no", "event_type")


@query(cte("folders") + " select site, volume_seq, next_volume, next_volume - volume_seq - 1 as skipped from (select site, volume_seq, lead(volume_seq) over (partition by site order by volume_seq) as next_volume from folders) where next_volume - volume_seq > 1")
def w13_sequence_gaps(spark, sf_dir):
    return feed.sequence_gaps(view(spark, sf_dir, "folders"))


@query(cte("polls") + """, r as (select *, sum((not is_error)::int) over (partition by site order by seq) as run from polls), q as (select *, sum(is_error::int) over (partition by site, run order by seq) as attempts from r)
select site, seq::int as seq, attempts::bigint as attempts, case when reanchored then 'ReAnchoring' when attempts = 0 then 'Polling' when attempts >= 5 then 'Stalled' else 'Retrying(' || attempts || ')' end as state from q""")
def w14_ingest_state(spark, sf_dir):
    return feed.ingest_state(view(spark, sf_dir, "polls")).select("site", "seq", "attempts", "state")


STEP = "select event_id, start as target, cast(floor(value) % 70 as bigint) as empty_polls, event_type = 'purchase' as seen_any_key, newest from polls"


@query(cte("polls") + f""", s as ({STEP}), j as (select *, not seen_any_key and empty_polls >= 12 and coalesce(greatest(newest - 1, 0), target) > target as jump, seen_any_key and empty_polls >= 60 as stuck from s)
select event_id, case when jump then 'ReAnchor' when stuck then 'Advance' else 'Continue' end as action, case when jump then greatest(newest - 1, 0) when stuck then target + 1 else target end as new_target from j""")
def w15_next_action(spark, sf_dir):
    steps = spark.sql(STEP.replace("from polls", "from {polls}"), polls=view(spark, sf_dir, "polls"))
    return feed.next_action(steps).select("event_id", "action", "new_target")


@query(cte("polls").replace("with ", "with recursive ", 1) + """, f(site, seq, target, action, new_target, empty_polls, empty, seen) as (
select site, 0::bigint, start, 'Continue', start, 0::bigint, 0::bigint, false from polls where seq = 1
union all select site, seq, new_target, case when jump then 'ReAnchor' when stuck then 'Advance' else 'Continue' end, case when jump then greatest(newest - 1, 0) when stuck then new_target + 1 else new_target end,
  n, case when check_due or stuck then 0 else n end, case when stuck then false else seen or got end
from (select *, check_due and coalesce(greatest(newest - 1, 0), new_target) > new_target as jump, not got and seen and n >= 60 as stuck
  from (select f.site, p.seq, f.new_target, f.seen, p.newest, p.n_keys > 0 as got, case when p.n_keys > 0 then 0 else f.empty + 1 end as n, p.n_keys = 0 and not f.seen and f.empty + 1 >= 12 as check_due
    from f join polls p on p.site = f.site and p.seq = f.seq + 1)))
select site, seq, target, action, new_target, empty_polls from f where seq > 0""")
def w15_recovery_actions(spark, sf_dir):
    return feed.recovery_actions(view(spark, sf_dir, "polls"))


@query(cte("folders") + " select site, greatest(max(volume_seq) - 1, 0) as anchor from folders group by site")
def a10_cold_start_anchor(spark, sf_dir):
    return feed.cold_start_anchor(view(spark, sf_dir, "folders"))


@query(cte("polls") + " select site, max(polled_at) filter (not is_error) as last_success, epoch_us(timestamp '2030-01-01') / 1e6 - epoch_us(max(polled_at) filter (not is_error)) / 1e6 as age_s from polls group by site")
def a11_data_age(spark, sf_dir):
    return feed.data_age(view(spark, sf_dir, "polls"), F.lit("2030-01-01 00:00:00"))


@query(VOLUMES + """, c as (select site, epoch, count(*) as n_chunks, (epoch_us(max(arrival)) - epoch_us(min(arrival))) / 1e6 as duration_s from ep group by 1, 2),
s as (select site, epoch, count(*) as n_sweeps, count(*) filter (complete) as n_complete, avg(n_radials) as mean_radials from sw group by 1, 2)
select site, epoch::bigint as epoch, n_chunks, duration_s, coalesce(n_sweeps, 0) as n_sweeps, coalesce(n_complete, 0) as n_complete, round(mean_radials, 6) as mean_radials from c left join s using (site, epoch)""")
def a8_volume_summary(spark, sf_dir):
    epochs, placed = assembled(spark, sf_dir)
    return inspect.volume_summary(assembly.close_sweeps(placed), epochs).withColumn("mean_radials", F.round("mean_radials", 6))


@query(CURRENT + """, n as (select site, count(*) as n_sweeps, sum(s.volume * elevation_number)::bigint as volume_sum from cur group by 1), r as (select site, sum(applied::int)::bigint as revision from a group by 1),
l as (select site, arg_max(volume, event_no)::bigint as last_complete from a where event_type = 'VolumeClosed' and status = 'Complete' group by 1)
select site, revision, last_complete, n_sweeps, volume_sum from r left join n using (site) left join l using (site)""")
def a9_snapshot(spark, sf_dir):
    out = state.snapshot(arrivals(spark, sf_dir))
    total = F.aggregate("sweeps", F.lit(0).cast("long"), lambda s, x: s + x["volume"] * x["elevation_number"])
    return out.select("site", "revision", "last_complete", F.size("sweeps").cast("long").alias("n_sweeps"), total.alias("volume_sum"))


@query(SWEEP_VCP + """, lr as (select site, epoch, arg_max(rvol_vcp, pos) filter (rvol_vcp is not null) as rvol from p group by 1, 2)
select vol.site, vol.epoch::bigint as epoch, coalesce(msg5, rvol, 0) as vcp_number from vol join m5 on m5.site = vol.site and m5.epoch = vol.epoch left join lr on lr.site = vol.site and lr.epoch = vol.epoch""")
def j6_volume_vcp(spark, sf_dir):
    epochs, placed = assembled(spark, sf_dir)
    volumes = assembly.close_volumes(epochs, placed).select("site", "epoch")
    return inspect.volume_vcp(volumes, assembly.message5_vcp(epochs), placed)


@query(SWEEP_VCP.replace("with ", cte("cuts") + ", ", 1) + " select sv.site, sv.epoch::bigint as epoch, sv.elevation_number, sv.vcp_number, cuts.elevation_deg as commanded_deg, round(sv.elevation_deg - cuts.elevation_deg, 6) as difference_deg from sv join cuts on sv.vcp_number = cuts.vcp_number and sv.elevation_number = cuts.cut")
def j5_commanded_vs_measured(spark, sf_dir):
    epochs, placed = assembled(spark, sf_dir)
    sweeps = assembly.sweep_vcp(placed, assembly.close_sweeps(placed), epochs)
    out = inspect.commanded_vs_measured(sweeps, view(spark, sf_dir, "cuts"))
    return out.select("site", "epoch", "elevation_number", "vcp_number", "commanded_deg", F.round("difference_deg", 6).alias("difference_deg"))


@query(PLACED + """, g as (select site, epoch, elevation_number, coalesce(lead(azimuth_deg) over w, first_value(azimuth_deg) over w + 360) - azimuth_deg as gap from p where accepted window w as (partition by site, epoch, elevation_number order by azimuth_deg))
select site, epoch::bigint as epoch, elevation_number, count(*) filter (gap > 1.0) as n_gaps, round(coalesce(sum(gap) filter (gap > 1.0), 0), 4) as missing_deg, round(max(gap), 4) as widest_deg from g group by 1, 2, 3""")
def w16_azimuth_coverage(spark, sf_dir):
    out = inspect.azimuth_coverage(assembled(spark, sf_dir, read_once=True)[1].where("accepted"), ("site", "epoch", "elevation_number"))
    return out.withColumns({"missing_deg": F.round("missing_deg", 4), "widest_deg": F.round("widest_deg", 4)})


@query(PLACED + """ select site, epoch::bigint as epoch, elevation_number, round(avg(elevation_deg), 6) as mean_deg, count(*) as n_radials, min(azimuth_deg) as az_min, max(azimuth_deg) as az_max,
arg_min(nyquist, pos) filter (nyquist <> 0) as nyquist, arg_min(unamb_range, pos) filter (unamb_range <> 0) as unamb_range, arg_min(rvol_vcp, pos) filter (rvol_vcp <> 0) as rvol_vcp,
round(case when count(*) < 2 then 0 else (max(azimuth_deg) - min(azimuth_deg)) / (count(*) - 1) end, 6) as az_spacing, case when count(*) < 2 then 0 else (max(azimuth_deg) - min(azimuth_deg)) / (count(*) - 1) end < 0.75 as super_res from p where accepted group by 1, 2, 3""")
def a3_scan_geometry(spark, sf_dir):
    good = assembled(spark, sf_dir, read_once=True)[1].where("accepted").withColumn("radial_idx", F.col("pos"))
    out = inspect.scan_geometry(good, ("site", "epoch", "elevation_number"))
    return out.withColumns({"mean_deg": F.round("mean_deg", 6), "az_spacing": F.round("az_spacing", 6)})


@query(cte("radials") + """ select site, chunk_no, count(*) filter (radial_status = 0) as "StartOfElevation", count(*) filter (radial_status = 1) as "Intermediate", count(*) filter (radial_status = 2) as "EndOfElevation",
count(*) filter (radial_status = 3) as "StartOfVolume", count(*) filter (radial_status = 4) as "EndOfVolume", count(*) filter (radial_status = 5) as "StartOfLastElevation", count(*) filter (radial_status not between 0 and 5) as "Unknown",
concat_ws(' ', case when count(*) filter (radial_status = 1) > 0 then 'Intermediate=' || count(*) filter (radial_status = 1) end, case when count(*) filter (radial_status = 2) > 0 then 'EndOfElevation=' || count(*) filter (radial_status = 2) end,
case when count(*) filter (radial_status = 4) > 0 then 'EndOfVolume=' || count(*) filter (radial_status = 4) end) as summary from radials group by site, chunk_no""")
def a2_status_counts(spark, sf_dir):
    return inspect.status_counts(view(spark, sf_dir, "radials"))


@query(cte("chunks") + f""", s as (select *, sum(n) over (partition by site order by arrival, chunk_no) as session from (select *, case when arrival >= lag(arrival) over (partition by site order by arrival, chunk_no) + interval 2 hours then 1 else 0 end as n from chunks))
select site, strftime(min(arrival), '%Y-%m-%d %H:%M:%S.%f') as start, strftime(max(arrival) + interval 2 hours, '%Y-%m-%d %H:%M:%S.%f') as "end", count(*) as n_chunks from s group by site, session""")
def t6_activity_windows(spark, sf_dir):
    from ..streaming.assemble import activity_windows

    out = activity_windows(view(spark, sf_dir, "chunks"), "2 hours")
    shape = "yyyy-MM-dd HH:mm:ss.SSSSSS"
    return out.withColumns({"start": F.date_format("start", shape), "end": F.date_format("end", shape)})


@query(PLACED + " select site, epoch::bigint as epoch, elevation_number, pos::bigint as pos, row_number() over (partition by site, epoch, elevation_number order by azimuth_deg, pos)::int as place from p where accepted and k % 11 > 0")
def l1_by_azimuth(spark, sf_dir):
    """Every eleventh azimuth is missing or no number."""
    good = assembled(spark, sf_dir, read_once=True)[1].where("accepted").withColumn("radial_idx", F.col("pos"))
    lost = F.when(F.col("chunk_no") % 2 == 0, F.lit(float("nan")))
    out = inspect.by_azimuth(good.withColumn("azimuth_deg", F.when(F.col("k") % 11 > 0, F.col("azimuth_deg")).otherwise(lost)), ("site", "epoch", "elevation_number"))
    return out.select("site", "epoch", "elevation_number", F.col("pos").cast("long").alias("pos"), "place")
