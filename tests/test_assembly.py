import datetime as dt
import random

import numpy as np
import pytest

from sweepline.operators import assembly, state
from sweepline.runtime import written
from sweepline.streaming.volume import Volume

T0 = dt.datetime(2026, 7, 28, 9, 0)
CHUNKS = "site string, chunk_no long, kind string, arrival timestamp, vcp int"
RADIALS = "site string, chunk_no long, radial_idx int, elevation_number int, radial_status int, elevation_deg double, nyquist double, unamb_range double, julian_date int, scan_time_ms long, rvol_vcp int, latitude double, longitude double, site_amsl_m int"


def tables(spark, sequence, site="KDOX", step=10):
    """sequence: (kind, vcp, [(elevation, status, rvol or None)], seconds since the last chunk or None)."""
    chunks, radials, at = [], [], T0
    for i, (kind, vcp, rays, *gap) in enumerate(sequence):
        at += dt.timedelta(seconds=gap[0] if gap else step)
        chunks.append((site, i, kind, at, vcp))
        for j, (el, status, rvol) in enumerate(rays):
            radials.append((site, i, j, el, status, el * 0.5, 8.0, 300.0, 20000, 1000 * i + j, rvol, 38.0 if rvol else None, -75.0 if rvol else None, 15 if rvol else None))
    c, r = spark.createDataFrame(chunks, CHUNKS), spark.createDataFrame(radials, RADIALS)
    epochs = written(assembly.volume_epochs(c, "600 seconds"))  # as the queries do
    return epochs, written(assembly.placed_radials(r, epochs))


def run(spark, sequence):
    events = assembly.assembly_events(*tables(spark, sequence)).orderBy("event_no").collect()
    return [(r.event_type, r.elevation_number, r.complete if r.event_type == "SweepClosed" else r["count"] if r.event_type.startswith("Late") else r.status) for r in events]


def ray(el, status=1, rvol=None):
    return (el, status, rvol)


CASES = [
    ([("S", None, [])], []),
    ([("S", None, []), ("I", None, [ray(1, 3)])], []),
    ([("S", None, []), ("I", None, [ray(1, 3), ray(1, 2)])], [("SweepClosed", 1, True)]),
    ([("S", None, []), ("I", None, [ray(1, 3)]), ("I", None, [ray(2, 0)])], [("SweepClosed", 1, False)]),
    ([("S", None, []), ("I", None, [ray(1, 3), ray(1, 2)]), ("I", None, [ray(1), ray(1)])], [("SweepClosed", 1, True), ("LateRadialsDiscarded", 1, 2)]),
    ([("S", None, []), ("I", None, [ray(1, 3)]), ("E", None, [ray(1, 4)])], [("SweepClosed", 1, True), ("VolumeClosed", None, "Complete")]),
    ([("S", None, []), ("I", None, [ray(1, 3)]), ("S", None, [])], [("SweepClosed", 1, False), ("VolumeClosed", None, "Superseded")]),
    ([("I", None, [ray(1)])], [("MissingStart", None, None)]),
    ([("S", None, []), ("S", None, []), ("E", None, [])], [("VolumeClosed", None, "Complete")]),
    ([("S", None, []), ("I", None, [ray(1, 3)]), ("I", None, [ray(2)], 700)], [("SweepClosed", 1, False), ("VolumeClosed", None, "TimedOut"), ("MissingStart", None, None)]),
    ([("S", None, []), ("I", None, [ray(1, 200), ray(1, 1)]), ("E", None, [])], [("SweepClosed", 1, False), ("VolumeClosed", None, "Complete")]),
]


@pytest.mark.parametrize("sequence,expected", CASES)
def test_cases(spark, sequence, expected):
    assert run(spark, sequence) == expected


@pytest.mark.parametrize("vcp,rvol,expected", [(35, 212, 35), (None, 212, 212), (None, None, 0)])
def test_vcp_of_volume(spark, vcp, rvol, expected):
    epochs, placed = tables(spark, [("S", vcp, []), ("I", None, [ray(1, 3, rvol), ray(1, 2, rvol)]), ("E", None, [ray(2, 4)])])
    assert assembly.volume_context(placed, epochs).first().vcp_number == expected


def test_closing_radial_of_the_next_sweep_gives_the_vcp(spark):
    epochs, placed = tables(spark, [("S", None, []), ("I", None, [ray(1, 1, 35), ray(2, 1, 212)])])
    got = {r.elevation_number: r.vcp_number for r in assembly.sweep_vcp(placed, assembly.close_sweeps(placed), epochs).collect()}
    assert got[1] == 212


def enact(sequence, step=10, timeout=600):
    """What the stream makes of the same sequence, chunk by chunk."""
    v, out, now = Volume(), [], 0
    for i, (kind, vcp, rays, *gap) in enumerate(sequence):
        now += gap[0] if gap else step
        table = np.array([(e, st, -1 if r is None else r, 20000, 1000 * i + j) for j, (e, st, r) in enumerate(rays)], dtype=np.int64).reshape(len(rays), 5)
        out += v.take(kind, vcp, table, now * 1000, timeout * 1000)
    assert [e["event_no"] for e in out] == list(range(1, len(out) + 1))
    return [(e["event_type"], e.get("elevation_number"), e.get("complete"), e.get("count"), e.get("status"), e.get("vcp_number")) for e in out]


def test_windows_agree_with_the_stream(spark):
    rng = random.Random(5)
    for _ in range(3):
        sequence = []
        for _ in range(60):
            kind = rng.choice("SIIIIIE")
            rays = [] if kind == "S" else [ray(rng.randrange(1, 4), rng.choice([1, 1, 1, 1, 0, 2, 4, 9]), rng.choice([None, 35, 212])) for _ in range(rng.randrange(5))]
            sequence.append((kind, rng.choice([None, 121]) if kind == "S" else None, rays, rng.choice([10, 10, 10, 10, 700])))
        events = assembly.assembly_events(*tables(spark, sequence)).orderBy("event_no").collect()
        got = [(r.event_type, r.elevation_number, r.complete, r["count"], r.status, r.vcp_number) for r in events]
        assert got == enact(sequence)


def test_events_take_few_passes(spark):
    """Numbering reads what it numbers twice; in each go radials are read for sweeps and for late ones, chunks once."""
    epochs, placed = tables(spark, [("S", 35, []), ("I", None, [ray(1, 1, 212), ray(1, 2), ray(1), ray(2)]), ("I", None, [ray(3)]), ("S", None, []), ("E", None, [ray(1, 4)])])
    out = assembly.assembly_events(epochs, placed)
    assert out._jdf.queryExecution().optimizedPlan().collectLeaves().size() <= 6
    got = [tuple(r)[1:] for r in out.orderBy("event_no").collect()]
    assert got == [
        (1, 1, "SweepClosed", 1, True, 2, 35, None, 1), (1, 1, "LateRadialsDiscarded", 1, None, 1, None, None, 2), (2, 1, "SweepClosed", 2, False, 1, 35, None, 3), (2, 1, "SweepClosed", 3, False, 1, 35, None, 4),
        (2, 1, "VolumeClosed", None, None, None, 35, "Superseded", 5), (4, 2, "SweepClosed", 1, True, 1, 0, None, 6), (4, 2, "VolumeClosed", None, None, None, 0, "Complete", 7),
    ]


EVENTS = "site string, event_no int, event_type string, elevation_number int, volume long, vcp_number int, status string"


def events(spark, *rows):
    return spark.createDataFrame([("KDOX", i, *r) for i, r in enumerate(rows)], EVENTS)


def sweep(el, volume, vcp=35):
    return ("SweepClosed", el, volume, vcp, None)


def test_state(spark):
    df = events(spark, sweep(1, 5), sweep(2, 5), sweep(1, 4), ("VolumeClosed", None, 5, 35, "TimedOut"), ("VolumeClosed", None, 5, 35, "Complete"), ("MissingStart", None, None, None, None), sweep(1, 6))
    assert [(r.elevation_number, r.volume) for r in state.current_sweeps(df).orderBy("elevation_number").collect()] == [(1, 6), (2, 5)]
    assert [r.revision for r in state.revisions(df).orderBy("event_no").collect()] == [1, 2, 2, 2, 3, 3, 4]
    assert state.last_complete(df).first().volume == 5
    snap = state.snapshot(df).first()
    assert snap.revision == 4 and [s.elevation_number for s in snap.sweeps] == [1, 2]


def test_vcp_change_and_reset_empty_the_set(spark):
    df = events(spark, sweep(1, 5), sweep(2, 5), sweep(3, 4, 212))
    assert [r.elevation_number for r in state.current_sweeps(df).collect()] == [3]
    df = events(spark, sweep(1, 5), ("VolumeClosed", None, 5, 35, "Complete"), ("RESET", None, None, None, None), sweep(2, 1))
    assert [r.elevation_number for r in state.current_sweeps(df).collect()] == [2] and state.last_complete(df).count() == 0


