"""Queries that run the driver's tables through the streams, slice by slice.

Rows come in slices by time. After each one the stream is started from its checkpoint, takes what
is new and stops, so state has to outlive both the micro-batch and the query. Streams run in a
session of their own, whose settings touch no other query.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import shared_path, written
from ..sources import chunks as chunk_files
from ..sources import tables
from ..streaming import assemble
from . import assembly_queries
from .adapters import cte, view
from .registry import SQL, query
from .source_queries import volume_bytes

SLICES = 3
#: State of the streams: a few values for each of some hundred sites need few partitions. Arrow batches are small, so that sites have several.
#: Files are many and small, in a folder for each volume: folders are listed and files opened by the hundred in a task.
#: No listing is looked up again, so the driver keeps none (250 MB of them otherwise, weighed object by object).
FILES = {"spark.sql.sources.parallelPartitionDiscovery.parallelism": "32", "spark.sql.files.openCostInBytes": "65536", "spark.sql.hive.filesourcePartitionFileCacheSize": "0"}
SETTINGS = FILES | {"spark.sql.streaming.stateStore.providerClass": assemble.ROCKSDB, "spark.sql.shuffle.partitions": "8", "spark.sql.execution.arrow.maxRecordsPerBatch": "500"}


def stream_session(spark: SparkSession) -> SparkSession:
    other = spark.newSession()
    other.conf.set("spark.sql.session.timeZone", spark.conf.get("spark.sql.session.timeZone"))
    for k, v in SETTINGS.items():
        other.conf.set(k, v)
    return other


def slices(rows: DataFrame, order: str) -> list[DataFrame]:
    """The rows in SLICES parts by `order`, a column of whole numbers that keeps a site's order."""
    low, high = rows.agg(F.coalesce(F.min(order), F.lit(0)), F.coalesce(F.max(order), F.lit(0))).first()
    part = F.floor((F.col(order) - low) * SLICES / (high - low + 1))
    return [rows.where(part == i) for i in range(SLICES)]


def streamed(rows: DataFrame, order: str, stream: Callable[[DataFrame], DataFrame], taken: str | None = None, sink: Callable | None = None) -> DataFrame | None:
    """What `stream` makes of the rows; sink(out, checkpoint) starts a query that puts it elsewhere."""
    spark = rows.sparkSession
    other = stream_session(spark)
    given, taken, marks = (shared_path(spark, name) for name in ("given", "taken", "marks"))
    rows = written(rows)
    rows.limit(0).write.parquet(given)
    out = stream(other.readStream.schema(rows.schema).parquet(given))
    for part in slices(rows, order):
        part.write.mode("append").parquet(given)
        if sink:
            sink(out, marks).awaitTermination()
        else:
            out.writeStream.format("parquet").option("path", taken).option("checkpointLocation", marks).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return None if sink else spark.read.schema(out.schema).parquet(taken)


ENDLESS = f"interval {assembly_queries.TIMEOUT}", "interval 1000000 hours"
DELAY = "30 minutes"
#: A last chunk's silence also counts once the watermark has passed it.
WATCHED = f"lead(arrival) over w >= arrival + interval {assembly_queries.TIMEOUT} as next_silent", f"coalesce(lead(arrival) over w >= arrival + interval {assembly_queries.TIMEOUT}, arrival + interval {assembly_queries.TIMEOUT} <= (select max(arrival) from chunks) - interval {DELAY}) as next_silent"
RESETS = 40  # a site is reset after each so many-th of its chunks


def sent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks with their radials, as the assembler takes them."""
    r = view(spark, sf_dir, "radials")
    each = F.struct("radial_idx", "elevation_number", "radial_status", "rvol_vcp", "julian_date", "scan_time_ms")
    return r.groupBy("site", "chunk_no").agg(F.min("kind").alias("kind"), F.max("msg5_vcp").alias("vcp"), F.max("ts").cast("timestamp").alias("arrival"), F.array_sort(F.collect_list(each)).alias("radials"))


def _events(df: DataFrame, *more: str) -> DataFrame:
    return df.select("site", "epoch", "event_type", "elevation_number", "complete", "count", "vcp_number", "status", *more)


@query(assembly_queries.EVENTS.replace(*ENDLESS) + " select site, epoch::bigint as epoch, event_type, elevation_number, complete, count, vcp_number, status from ev")
def t1_t3_assembly_stream(spark, sf_dir):
    return _events(streamed(sent(spark, sf_dir), "chunk_no", lambda chunks: assemble.assemble_stream(chunks, timeout_ms=None)))


@query(assembly_queries.EVENTS.replace(*WATCHED) + " select site, epoch::bigint as epoch, event_type, elevation_number, complete, count, vcp_number, status, event_no::bigint as event_no from ev")
def t2_watchdog_stream(spark, sf_dir):
    """The watchdog by event time: silence between two chunks, and after a site's last one."""
    hours = int(assembly_queries.TIMEOUT.split()[0])
    chunks = sent(spark, sf_dir).withColumn("second", F.unix_seconds("arrival"))
    out = streamed(chunks, "second", lambda c: assemble.assemble_stream(c, timeout_ms=hours * 3_600_000, delay=DELAY))
    return _events(out, "event_no")


_RESET = f"chunk_no % {RESETS} = {RESETS - 1}"
#: The views with every fortieth chunk a reset: it ends what is under way without a word, and what follows begins anew.
_WITH_RESETS = (
    assembly_queries.EVENTS.replace(*ENDLESS)
    .replace("select site, chunk_no, min(kind) as kind, max(ts) as arrival, max(msg5_vcp) as vcp from radials group by site, chunk_no", f"select site, chunk_no, case when {_RESET} then 'RESET' else min(kind) end as kind, max(ts) as arrival, max(msg5_vcp) as vcp from radials group by site, chunk_no")
    .replace("case when kind = 'S' or lag(kind) over w is null or lag(kind) over w = 'E'", "case when kind = 'S' or lag(kind) over w is null or lag(kind) over w in ('E', 'RESET')")
    .replace("where e.kind <> 'S')", "where e.kind not in ('S', 'RESET'))")
    .replace("case when e.kind = 'E' then 'Complete'", "case when e.kind = 'RESET' then 'Reset' when e.kind = 'E' then 'Complete'")
    .replace("vol.status = 'InProgress'", "vol.status in ('InProgress', 'Reset')")
    .replace("where kind <> 'S'\nunion", "where kind not in ('S', 'RESET')\nunion")
    .replace("from vol left join ctx", "from vol left join ctx", 1)
)


@query(_WITH_RESETS + f" select site, chunk_no, event_type, elevation_number, complete, count, vcp_number, status from ev union all select site, chunk_no, 'RESET', null, null, null, null, null from chunks where {_RESET}")
def t5_site_reset(spark, sf_dir):
    """A reset takes the place of each fortieth chunk of a site: it ends a volume without closing it, and
    what follows is assembled as if nothing had been there."""
    chunks = sent(spark, sf_dir)
    reset = F.expr(_RESET)
    chunks = chunks.withColumns({"kind": F.when(reset, "RESET").otherwise(F.col("kind")), "radials": F.when(~reset, F.col("radials"))})
    out = streamed(chunks, "chunk_no", lambda c: assemble.assemble_stream(c, timeout_ms=None))
    return out.select("site", "chunk_no", "event_type", "elevation_number", "complete", "count", "vcp_number", "status")


#: What every applied event makes of its site: sums and last values over the events so far.
STATES = """, t as (select *, (sum(applied::int) over w)::bigint as revision, coalesce(last_value(case when event_type = 'SweepClosed' then vcp_number end ignore nulls) over w, -1) as vcp,
last_value(case when event_type = 'VolumeClosed' and applied then volume end ignore nulls) over w as last_complete from a window w as (partition by site order by event_no rows between unbounded preceding and current row))
select site, elevation_number, case when event_type = 'SweepClosed' then volume::bigint end as volume, vcp as vcp_number, last_complete::bigint as last_complete, revision from t where applied"""


@query(assembly_queries.APPLIED + STATES)
def t4_current_state_stream(spark, sf_dir):
    out = streamed(assembly_queries.arrivals(spark, sf_dir), "event_no", assemble.current_state_stream)
    return out.select("site", "elevation_number", "volume", "vcp_number", "last_complete", "revision")


STATE_RESETS = 50
#: As APPLIED, with every fiftieth event of a site a reset, which begins a new life of its state.
_LIVES = (
    assembly_queries.APPLIED
    .replace("a0 as (select *, epoch", f"a0 as (select * replace (case when event_no % {STATE_RESETS} = 0 then 'RESET' else event_type end as event_type, case when event_no % {STATE_RESETS} > 0 then status end as status), sum(case when event_no % {STATE_RESETS} = 0 then 1 else 0 end) over (partition by site order by event_no) as life, epoch")
    .replace("over (partition by site order by event_no rows between unbounded preceding and 1 preceding) as before", "over (partition by site, life order by event_no rows between unbounded preceding and 1 preceding) as before")
    .replace("over (partition by site order by event_no) as vcp_epoch", "over (partition by site, life order by event_no) as vcp_epoch")
    .replace("partition by site, vcp_epoch, event_type", "partition by site, life, vcp_epoch, event_type")
    .replace("when event_type = 'VolumeClosed' then status = 'Complete' else false end", "when event_type = 'VolumeClosed' then status = 'Complete' else event_type = 'RESET' end")
)


@query(
    _LIVES
    + """, r as (select *, (sum(applied::int) over (partition by site order by event_no))::bigint as revision from a),
t as (select *, coalesce(last_value(case when event_type = 'SweepClosed' then vcp_number end ignore nulls) over w, -1) as vcp, last_value(case when event_type = 'VolumeClosed' and applied then volume end ignore nulls) over w as last_complete
from r window w as (partition by site, life order by event_no rows between unbounded preceding and current row))
select site, case event_type when 'RESET' then 'reset' when 'SweepClosed' then 'sweep' else 'complete' end as change, case when event_type = 'SweepClosed' then elevation_number end as elevation_number,
case when event_type = 'SweepClosed' then volume::bigint end as volume, vcp as vcp_number, last_complete::bigint as last_complete, revision from t where applied"""
)
def t5_state_after_reset(spark, sf_dir):
    """A reset empties the state and puts its revision up by one; what follows fills it anew."""
    reset = F.col("event_no") % STATE_RESETS == 0
    events = assembly_queries.arrivals(spark, sf_dir).withColumns({"event_type": F.when(reset, "RESET").otherwise(F.col("event_type")), "status": F.when(~reset, F.col("status"))})
    return streamed(events, "event_no", assemble.current_state_stream).drop("since")


@query(assembly_queries.CURRENT + ", r as (select site, sum(applied::int)::bigint as revision from a group by 1) select cur.site, elevation_number, s.volume::bigint as volume, s.vcp_number as vcp_number, r.revision as site_revision from cur join r using (site)")
def t4_state_tables(spark, sf_dir):
    """Keyed tables kept by the stream, each slice's last batch applied twice: the same as W8 and W10."""
    path = shared_path(spark, "state")

    def sink(changes: DataFrame, marks: str):
        return tables.keep_current_twice(changes, path, marks, {"availableNow": True})

    streamed(assembly_queries.arrivals(spark, sf_dir), "event_no", assemble.current_state_stream, sink=sink)
    live, sites = tables.current_tables(spark, path)
    return live.select("site", "elevation_number", "volume", "vcp_number").join(sites.select("site", F.col("revision").alias("site_revision")), "site")


BAD = 37  # each so many-th chunk of a site is cut short


@query(
    assembly_queries.APPLIED.replace(*ENDLESS).replace("epoch - case when event_no % 9 = 0 then 2 else 0 end as volume", "epoch as volume")
    .replace("max(msg5_vcp) as vcp from radials group by site, chunk_no", f"max(msg5_vcp) as vcp from radials where chunk_no % {BAD} <> 5 group by site, chunk_no")
    + STATES.replace("select site, elevation_number", "select site, 'state' as kind, elevation_number")
    + f" union all select site, 'TooShort', null, max(vol_no) * 1000 + chunk_no, null, null, null from radials where chunk_no % {BAD} = 5 group by site, chunk_no"
)
def t8_files_to_state(spark, sf_dir):
    """Chunk files, decoded, assembled and applied in one stream: two stateful operators behind the file source.

    A micro-batch takes at most as many files as the largest wave has, so waves are not cut apart; chunks that
    cannot be read pass through both operators, come out as errors and change nothing.
    """
    bad = F.col("chunk_no") % BAD == 5
    made = written(volume_bytes(spark, sf_dir).withColumn("content", F.when(bad, F.expr("substring(content, 1, 40)")).otherwise(F.col("content"))))
    folder, taken, marks = (shared_path(spark, name) for name in ("objects", "taken", "marks"))
    parts = slices(made, "chunk_no")
    most = max(p.count() for p in parts)
    other = stream_session(spark)
    chunk_files.write_chunks(parts[0].limit(0), folder)
    files = chunk_files.stream_chunks(other, folder, max_files=max(1, most))
    whole = chunk_files.assembly_inputs(files.where("reason is null"))
    events = assemble.assemble_stream(whole, timeout_ms=None)
    changes = assemble.current_state_stream(events.withColumn("volume", F.when(F.col("event_type") == "Unreadable", F.col("chunk_no")).otherwise(F.col("epoch"))))
    kind = F.when(F.col("revision").isNotNull(), "state").otherwise(F.col("change"))
    out = changes.select("site", kind.alias("kind"), "elevation_number", "volume", "vcp_number", "last_complete", "revision")
    for part in parts:
        chunk_files.write_chunks(part, folder)
        # one query for changes and errors: files are listed, entered in its log and decoded once
        out.writeStream.format("parquet").option("path", taken).option("checkpointLocation", marks).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(taken)


@query(SQL["t6_activity_windows"] + f""" having max(arrival) + interval 2 hours <= (select max(arrival) from chunks) - interval {DELAY}""")
def t6_activity_stream(spark, sf_dir):
    """Sessions in append mode: each is put out once, when the watermark has passed its end."""
    chunks = view(spark, sf_dir, "chunks").select("site", F.col("arrival").cast("timestamp").alias("arrival"), F.unix_seconds(F.col("arrival").cast("timestamp")).alias("second"))
    out = streamed(chunks, "second", lambda c: assemble.activity_windows(c, "2 hours", DELAY))
    shape = "yyyy-MM-dd HH:mm:ss.SSSSSS"
    return out.withColumns({"start": F.date_format("start", shape), "end": F.date_format("end", shape)})


@query(SQL["w14_ingest_state"])
def t7_feed_health_stream(spark, sf_dir):
    polls = view(spark, sf_dir, "polls").select("site", "seq", "is_error", "reanchored")
    return streamed(polls, "seq", assemble.feed_health_stream).withColumn("seq", F.col("seq").cast("int"))
