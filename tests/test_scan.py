"""Histories cut into small blocks give what one block a site gives, and what a plain loop gives."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F
from test_assembly import CHUNKS, EVENTS, T0

from sweepline.operators import assembly, feed, scan, state


@pytest.fixture(params=[3, 4096])
def blocks(request, monkeypatch):
    monkeypatch.setattr(scan, "BLOCK", request.param)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_numbered_and_neighbours(spark, blocks):
    data = [("a" if i % 3 else None, i // 2, i) for i in range(40)]
    df = spark.createDataFrame(data, "site string, at long, n int")
    want = []
    for site in ("a", None):
        want += [(*r, k) for k, r in enumerate(sorted(r for r in data if r[0] == site), 1)]
    assert rows_of(scan.numbered(df, "place", "at", "n")) == sorted(want, key=repr)
    got = scan.neighbours(df.where("n % 2 = 0"), F.col("n"), "at").select("site", "n", "before", "after")
    want = []
    for site in ("a", None):
        mine = [r[2] for r in data if r[0] == site and r[2] % 2 == 0]
        want += [(site, n, b, a) for n, b, a in zip(mine, [None, *mine], [*mine[1:], None], strict=False)]
    assert rows_of(got) == sorted(want, key=repr)
    assert scan.numbered(df.limit(0), "place", "at").count() == 0


def test_epochs(spark, blocks):
    rng, data, want = random.Random(3), [], []
    for site in "ab":
        at, last, epoch = T0, None, 0
        mine = []
        for i in range(30):
            kind, gap = rng.choice("SIIIE"), rng.choice([10, 10, 10, 600, 599])
            at += dt.timedelta(seconds=gap)
            epoch += kind == "S" or last is None or last == "E" or gap >= 600
            last = kind
            mine.append((site, i, kind, at, epoch, gap))
            data.append((site, i, kind, at, None))
        want += [(s, i, k, e, *((n[2], n[5] >= 600) if n else (None, None))) for (s, i, k, _, e, _), n in zip(mine, [*mine[1:], None], strict=True)]
    got = assembly.volume_epochs(spark.createDataFrame(data, CHUNKS), "600 seconds").select("site", "chunk_no", "kind", "epoch", "next_kind", "next_silent")
    assert rows_of(got) == sorted(want, key=repr)


def test_state(spark, blocks):
    rng, data, want, current = random.Random(7), [], [], {}
    for site in "ab":
        vcp, newest, revision = None, {}, 0
        for i in range(60):
            kind = rng.choice(["SweepClosed"] * 5 + ["VolumeClosed", "MissingStart"] + ["RESET"] * (i % 5 == 0))
            el, volume, v, status = None, None, None, None
            applied = kind == "RESET"
            if kind == "RESET":
                vcp, newest = None, {}
            elif kind == "SweepClosed":
                el, volume, v = rng.randrange(1, 4), rng.randrange(6), rng.choice([35, 35, 35, 35, 212])
                newest = newest if vcp in (None, v) else {}
                vcp = v
                if applied := volume >= newest.get(el, (-1,))[0]:
                    newest[el] = (volume, i)
            elif kind == "VolumeClosed":
                volume, v, status = i, 35, rng.choice(["Complete", "TimedOut"])
                applied = status == "Complete"
            revision += applied
            data.append((site, i, kind, el, volume, v, status))
            want.append((site, i, applied, revision))
        current |= {(site, el): x for el, x in newest.items()}
    df = spark.createDataFrame(data, EVENTS)
    assert rows_of(state.revisions(df).select("site", "event_no", "applied", "revision")) == sorted(want, key=repr)
    assert {(r.site, r.elevation_number): (r.volume, r.event_no) for r in state.current_sweeps(df).collect()} == current
    shown = rows_of(state.revision_changes(state.revisions(df).select("site", F.col("event_no").alias("seq"), "revision")))
    assert shown == sorted(((s, i, r) for k, (s, i, a, r) in enumerate(want) if a or i == 0), key=repr)


def test_state_of_struct_volumes(spark, blocks):
    data = [("a", 0, "SweepClosed", 1, (20000, 5), 35, None), ("a", 1, "SweepClosed", 1, (19999, 9), 35, None), ("a", 2, "SweepClosed", 1, (20000, 5), 35, None)]
    df = spark.createDataFrame(data, EVENTS.replace("volume long", "volume struct<julian_date:int,scan_time_ms:long>"))
    assert [r.applied for r in state.revisions(df).orderBy("event_no").collect()] == [True, False, True]


def test_ingest_state(spark, blocks):
    rng, data, want = random.Random(2), [], []
    for site in "ab":
        n = 0
        for i in range(40):
            bad = rng.random() < 0.7
            n = n + 1 if bad else 0
            data.append((site, i, bad, False))
            want.append((site, i, n, "Polling" if not n else "Stalled" if n >= 5 else f"Retrying({n})"))
    got = feed.ingest_state(spark.createDataFrame(data, "site string, seq long, is_error boolean, reanchored boolean")).select("site", "seq", "attempts", "state")
    assert rows_of(got) == sorted(want, key=repr)


def test_recovery_actions(spark, blocks):
    """The native form against the fold that it stands for."""
    rng, data, want = random.Random(11), [], []
    for site, start in (("a", 100), ("b", 0), (None, 7)):
        target, empty, seen = start, 0, False
        for i in range(260):
            n = rng.choice([0, None] if rng.random() < 0.985 else [2])
            newest = rng.choice([None, start + rng.randrange(-30, 60)])
            data.append((site, i, n, newest, start if i == 0 else -1))
            before, action, count = target, "Continue", 0
            if n:
                empty, seen = 0, True
            else:
                empty += 1
                count = empty
                if not seen and empty >= 12:
                    empty = 0
                    if newest is not None and max(newest - 1, 0) > target:
                        action, target = "ReAnchor", max(newest - 1, 0)
                elif seen and empty >= 60:
                    action, target, empty, seen = "Advance", target + 1, 0, False
            want.append((site, i, before, action, target, count))
    got = feed.recovery_actions(spark.createDataFrame(data, "site string, seq long, n_keys int, newest long, start long"))
    assert rows_of(got) == sorted(want, key=repr)
    assert {r[3] for r in want} == {"Continue", "ReAnchor", "Advance"}


def test_no_window_over_a_whole_site(spark):
    """Raw rows are sorted by site and block; windows by site alone stand over summaries only."""
    df = spark.createDataFrame([("a", 1, "S", T0, None)], CHUNKS)
    plan = assembly.volume_epochs(df)._jdf.queryExecution().optimizedPlan().toString()
    alone = [x for x in plan.splitlines() if "Window [" in x and "block" not in x.split("windowspecdefinition")[1].split(" ASC")[0].split(" DESC")[0]]
    assert not alone and "Window [" in plan
