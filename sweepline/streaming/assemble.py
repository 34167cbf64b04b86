"""Assembly, current state and feed health as stateful streams, keyed by site.

State holds headers and the elevations of the volume under way, never gates; rows of a micro-batch
that have to wait for earlier ones wait in the state store. Late radials are found by state and not
by a watermark, which would drop by time. The session needs the RocksDB state store provider.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessorHandle

from ..runtime import prepare
from .ordered import HELD, Ordered, frames
from .volume import Volume

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
WATCHDOG = "12 minutes"
VOLUME = "epoch long, events long, under_way boolean, arrival long, seen array<int>, is_open boolean, taken long, msg5 int, rvol int, julian_date int, scan_time_ms long"
EVENTS = "site string, chunk_no long, event_no long, event_type string, epoch long, elevation_number int, complete boolean, count long, status string, vcp_number int, julian_date int, scan_time_ms long"


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


OF_EVENT = _names(EVENTS)[2:]
#: What placing a radial needs, in its order.
RAY = ("elevation_number", "radial_status", "rvol_vcp", "julian_date", "scan_time_ms")


def _rays(radials: Column) -> Column:
    """Radials in order as one array of whole numbers, those of RAY for each; null: -1."""
    numbers = F.transform(radials, lambda r: F.array(*[F.coalesce(r[f].cast("long"), F.lit(-1).cast("long")) for f in ("radial_idx", *RAY)]))
    return F.flatten(F.transform(F.array_sort(numbers), lambda r: F.slice(r, 2, len(RAY))))


def use_rocksdb(spark) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


class Assembler(Ordered):
    order, block_rows = "chunk_no", 512  # a chunk has some hundred radials
    columns = ("chunk_no", "kind", "vcp", "arrival_ms", "rays", "error")

    def __init__(self, timeout_ms: int | None, held: int = HELD):
        super().__init__(held)
        self.timeout_ms = timeout_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.state = handle.getValueState("volume", VOLUME)

    def _load(self) -> Volume:
        if not self.state.exists():
            return Volume()
        held = list(self.state.get())
        return Volume(*held[:4], list(held[4]), *held[5:])

    def _save(self, v: Volume) -> None:
        self.state.update((v.epoch, v.events, v.under_way, v.arrival, v.seen, v.is_open, v.taken, v.msg5, v.rvol, v.julian_date, v.scan_time_ms))

    def _rows(self, key, chunk_no: int | None, events: list[dict]) -> Iterator[tuple]:
        for e in events:
            yield (key[0], chunk_no, *[e.get(c) for c in OF_EVENT])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        v = self._load()

        def events() -> Iterator[tuple]:
            for chunk_no, kind, vcp, arrival, rays, error in self.in_order(rows):
                if error is not None:
                    yield from self._rows(key, int(chunk_no), v.unreadable(error))
                    continue
                rays = np.asarray([] if rays is None else rays, dtype=np.int64).reshape(-1, len(RAY))
                yield from self._rows(key, int(chunk_no), v.take(kind, None if vcp is None else int(vcp), rays, int(arrival or 0), self.timeout_ms))

        yield from frames(events(), _names(EVENTS))
        self._save(v)
        if self.timeout_ms is None:
            return
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        if v.under_way:
            self.handle.registerTimer(v.arrival + self.timeout_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        v = self._load()
        if v.silent(expiredTimerInfo.getExpiryTimeInMs(), self.timeout_ms):
            out = v.close("TimedOut")
            self._save(v)
            yield from frames(self._rows(key, None, out), _names(EVENTS))


def assemble_stream(chunks: DataFrame, timeout_ms: int | None = 12 * 60 * 1000, delay: str = "1 minute", held: int = HELD) -> DataFrame:
    """Assembly events as chunks come in; a sweep is reported in the micro-batch that closes it.

    chunks: site, chunk_no, kind (S, I, E or RESET), vcp, arrival, radials (array of structs with
    radial_idx, elevation_number, radial_status, rvol_vcp, julian_date, scan_time_ms), and error where
    chunks may be unreadable: such a one is an event Unreadable, its error as status, and alters no
    other event. Rows of a site are put in order within a micro-batch. event_no numbers a site's events.

    The watchdog goes by event time, so a replay gives what the live stream gave: a volume is
    closed as TimedOut where the site's next chunk arrived timeout_ms or more after the one before,
    or once the watermark (the latest arrival of any site less `delay`) has passed that moment.
    Chunks that come later than that are dropped by Spark. With timeout_ms None there is no
    watchdog and no watermark, and arrival is not needed. held: bytes of a site's rows of a
    micro-batch that a task holds before they wait in the state store; it alters no result.
    """
    prepare(chunks.sparkSession)
    timed = timeout_ms is not None
    src = chunks.withColumn("arrival", F.col("arrival").cast("timestamp")).withWatermark("arrival", delay) if timed else chunks
    arrival = F.unix_millis("arrival") if timed else F.lit(0).cast("long")
    kept = ["arrival"] * timed
    error = F.col("error") if "error" in chunks.columns else F.lit(None).cast("string")
    src = src.select("site", F.col("chunk_no").cast("long").alias("chunk_no"), "kind", F.col("vcp").cast("int").alias("vcp"), _rays(F.col("radials")).alias("rays"), error.alias("error"), arrival.alias("arrival_ms"), *kept)
    return src.groupBy("site").transformWithStateInPandas(statefulProcessor=Assembler(timeout_ms, held), outputStructType=EVENTS, outputMode="Append", timeMode="EventTime" if timed else "None")


CHANGES = "site string, change string, elevation_number int, volume long, vcp_number int, last_complete long, revision long, since long"


class CurrentState(Ordered):
    order, block_rows = "event_no", 16384
    columns = ("event_no", "event_type", "elevation_number", "volume", "vcp_number", "status")

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.site = handle.getValueState("site", "vcp int, last_complete long, revision long, since long")
        self.sweeps = handle.getMapState("sweeps", "elevation int", "volume long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        vcp, complete, revision, since = self.site.get() if self.site.exists() else (-1, None, 0, 0)
        sweeps = {int(e[0]): int(v[0]) for e, v in self.sweeps.iterator()}  # one entry per elevation of a pattern

        def changes() -> Iterator[tuple]:
            nonlocal vcp, complete, revision, since
            for _, kind, el, volume, new_vcp, status in self.in_order(rows):
                at = None
                if kind == "RESET":
                    change, vcp, complete = "reset", -1, None
                    sweeps.clear()
                    since = revision + 1
                elif kind == "SweepClosed":
                    change, at = "sweep", int(el)
                    if vcp not in (-1, int(new_vcp)):
                        sweeps.clear()
                        since = revision + 1
                    vcp = int(new_vcp)
                    if volume < sweeps.get(at, volume):
                        continue
                    sweeps[at] = int(volume)
                elif kind == "VolumeClosed" and status == "Complete":
                    change, complete = "complete", int(volume)
                elif kind == "Unreadable":
                    yield key[0], status, None, None if volume is None else int(volume), None, None, None, None
                    continue
                else:
                    continue
                revision += 1
                yield key[0], change, at, sweeps[at] if at is not None else None, vcp, complete, revision, since

        yield from frames(changes(), _names(CHANGES))
        self.site.update((vcp, complete, revision, since))
        self.sweeps.clear()
        for e, v in sweeps.items():
            self.sweeps.updateValue((e,), (v,))


def current_state_stream(events: DataFrame, held: int = HELD) -> DataFrame:
    """Changes of the current sweeps, of the last complete volume and resets, with the site's revision.

    events: site, event_no, event_type, elevation_number, volume (long), vcp_number, status. A
    site's current sweeps are the latest of each elevation among changes of revision `since` and
    later, where since is that of the site's last change: a VCP change and a reset move it on. An event
    Unreadable comes out named as its error, with its volume and no revision; it changes nothing.
    """
    prepare(events.sparkSession)
    src = events.select("site", F.col("event_no").cast("long").alias("event_no"), "event_type", "elevation_number", F.col("volume").cast("long").alias("volume"), "vcp_number", "status")
    return src.groupBy("site").transformWithStateInPandas(statefulProcessor=CurrentState(held), outputStructType=CHANGES, outputMode="Append", timeMode="None")


HEALTH = "site string, seq long, attempts long, state string"


class FeedHealth(Ordered):
    order, block_rows = "seq", 16384
    columns = ("seq", "is_error", "reanchored")

    def __init__(self, stalled_after: int, held: int = HELD):
        super().__init__(held)
        self.stalled_after = stalled_after

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.run = handle.getValueState("run", "attempts long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n = self.run.get()[0] if self.run.exists() else 0

        def states() -> Iterator[tuple]:
            nonlocal n
            for seq, bad, moved in self.in_order(rows):
                n = n + 1 if bad else 0
                yield key[0], int(seq), n, "ReAnchoring" if moved else "Polling" if n == 0 else "Stalled" if n >= self.stalled_after else f"Retrying({n})"

        yield from frames(states(), _names(HEALTH))
        self.run.update((n,))


def feed_health_stream(polls: DataFrame, stalled_after: int = 5, held: int = HELD) -> DataFrame:
    """ingest_state() on a stream of polls: site, seq, is_error, reanchored."""
    prepare(polls.sparkSession)
    src = polls.select("site", F.col("seq").cast("long").alias("seq"), "is_error", "reanchored")
    return src.groupBy("site").transformWithStateInPandas(statefulProcessor=FeedHealth(stalled_after, held), outputStructType=HEALTH, outputMode="Append", timeMode="None")


def activity_windows(chunks: DataFrame, gap: str = WATCHDOG, delay: str = WATCHDOG) -> DataFrame:
    """Sessions of activity per site (batch or stream): start, end, n_chunks; a session ends with `gap` of silence.

    As a stream a session is put out once the watermark has passed its end.
    """
    timed = chunks.withColumn("arrival", F.col("arrival").cast("timestamp"))
    if timed.isStreaming:
        timed = timed.withWatermark("arrival", delay)
    out = timed.groupBy("site", F.session_window("arrival", gap).alias("session")).agg(F.count("*").alias("n_chunks"))
    return out.select("site", F.col("session.start").alias("start"), F.col("session.end").alias("end"), "n_chunks")
