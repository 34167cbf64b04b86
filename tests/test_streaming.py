import datetime as dt
import random
import time

import pandas as pd
import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F
from test_assembly import enact, ray

from sweepline.operators import state
from sweepline.plans import assembly_queries, stream_queries
from sweepline.plans.adapters import view
from sweepline.sources import tables
from sweepline.streaming import assemble

T0 = dt.datetime(2026, 7, 28, 9, 0)
RAYS = "array<struct<radial_idx:int,elevation_number:int,radial_status:int,rvol_vcp:int,julian_date:int,scan_time_ms:bigint>>"
CHUNKS = f"site string, chunk_no long, kind string, vcp int, arrival timestamp, radials {RAYS}"


@pytest.fixture(autouse=True)
def rocksdb(spark):
    assemble.use_rocksdb(spark)


def rows(sequence, site):
    out, at = [], T0
    for i, (kind, vcp, rays, *gap) in enumerate(sequence):
        at += dt.timedelta(seconds=gap[0] if gap else 10)
        out.append((site, i, kind, vcp, at, [(j, e, s, v, 20000, 1000 * i + j) for j, (e, s, v) in enumerate(rays)]))
    return out


def in_files(spark, data, schema, path, n):
    """The rows in n files, oldest first."""
    size = -(-len(data) // n)
    for k in range(n):
        spark.createDataFrame(data[k * size : (k + 1) * size], schema).coalesce(1).write.mode("append").parquet(path)
        time.sleep(0.05)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def finish(df, name, path):
    q = df.writeStream.format("memory").queryName(name).option("checkpointLocation", path).outputMode("append").trigger(availableNow=True).start()
    assert q.awaitTermination(240)
    if q.exception():
        raise q.exception()


@pytest.fixture(params=[10_000, 3])
def arrow_rows(spark, request):
    """Rows to an Arrow batch: all of a site's, or so few that they wait for one another in the state store."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(request.param))
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_stream_agrees_with_the_rules(spark, tmp_path, arrow_rows):
    rng = random.Random(8)
    sequence = [(k, 121 if k == "S" else None, [] if k == "S" else [ray(rng.randrange(1, 4), rng.choice([1, 1, 1, 2, 4]), rng.choice([None, 35])) for _ in range(4)], rng.choice([10, 10, 700])) for k in (rng.choice("SIIIIE") for _ in range(40))]
    data = [r for pair in zip(rows(sequence, "KDOX"), rows(sequence, "KTLH"), strict=True) for r in pair]
    half = len(data) // 2
    data = rng.sample(data[:half], half) + rng.sample(data[half:], len(data) - half)  # in order from file to file only
    finish(assemble.assemble_stream(in_files(spark, data, CHUNKS, str(tmp_path / "in"), 2), timeout_ms=600_000), "assembled", str(tmp_path / "c"))
    for site in ("KDOX", "KTLH"):
        got = spark.sql(f"select * from assembled where site = '{site}' order by event_no").collect()
        assert [(r.event_type, r.elevation_number, r.complete, r["count"], r.status, r.vcp_number) for r in got] == enact(sequence)


def test_watchdog_and_reset(spark, tmp_path):
    """KDOX falls silent and KTLH goes on: the watermark alone ends the volume of KDOX, and nothing else."""
    data = rows([("S", None, []), ("I", None, [ray(1)])], "KDOX") + rows([("S", None, []), ("I", None, [ray(1)]), ("RESET", None, []), ("S", None, [], 700), ("I", None, [ray(2)], 100)], "KTLH")
    stream = in_files(spark, data, CHUNKS, str(tmp_path / "in"), 1)
    finish(assemble.assemble_stream(stream, timeout_ms=600_000), "watched", str(tmp_path / "c"))
    got = [(r.site, r.event_type, r.elevation_number, r.status) for r in spark.sql("select * from watched order by site, event_no").collect()]
    assert got == [("KDOX", "SweepClosed", 1, None), ("KDOX", "VolumeClosed", None, "TimedOut"), ("KTLH", "RESET", None, None)]


STATE_EVENTS = "site string, event_no long, event_type string, elevation_number int, volume long, vcp_number int, status string"
STATE_ROWS = [("K", 0, "SweepClosed", 1, 5, 35, None), ("K", 1, "SweepClosed", 1, 4, 35, None), ("K", 2, "VolumeClosed", None, 5, 35, "Complete"), ("K", 3, "SweepClosed", 2, 4, 212, None), ("K", 4, "RESET", None, None, None, None), ("K", 5, "SweepClosed", 1, 1, 35, None), ("L", 0, "SweepClosed", 3, 7, 35, None)]


def test_current_state(spark, tmp_path, arrow_rows):
    finish(assemble.current_state_stream(in_files(spark, STATE_ROWS[::-1], STATE_EVENTS, str(tmp_path / "in"), 1)), "current", str(tmp_path / "c"))
    got = [tuple(r) for r in spark.sql("select change, elevation_number, volume, vcp_number, last_complete, revision, since from current where site = 'K' order by revision").collect()]
    assert got == [("sweep", 1, 5, 35, None, 1, 0), ("complete", None, None, 35, 5, 2, 0), ("sweep", 2, 4, 212, 5, 3, 3), ("reset", None, None, -1, None, 4, 4), ("sweep", 1, 1, 35, None, 5, 4)]


@pytest.mark.parametrize("dies_at", ["before the first table", "between the tables", "after both"])
def test_killed_stream_keeps_tables_equal_to_batch(spark, tmp_path, monkeypatch, dies_at):
    """The stream dies in its second micro-batch, at any point, and is started again."""
    calls, upsert = [], tables.KeyedTable.upsert

    def failing(self, batch, number):
        calls.append(self.path.rsplit("/", 1)[-1])
        first = "dead" not in calls and number == 1
        if first and dies_at == "before the first table":
            calls.append("dead")
            raise RuntimeError("killed")
        done = upsert(self, batch, number)
        if first and dies_at == ("between the tables" if calls[-1] == "sweeps" else "after both"):
            calls.append("dead")
            raise RuntimeError("killed")
        return done

    monkeypatch.setattr(tables.KeyedTable, "upsert", failing)
    changes = assemble.current_state_stream(in_files(spark, STATE_ROWS, STATE_EVENTS, str(tmp_path / "in"), 3))
    for turn in range(2):
        q = tables.keep_current(changes, str(tmp_path / "t"), str(tmp_path / "c"), {"availableNow": True})
        try:
            q.awaitTermination()
            assert turn == 1
        except StreamingQueryException:
            assert turn == 0
    live, sites = tables.current_tables(spark, str(tmp_path / "t"))
    df = spark.createDataFrame(STATE_ROWS, STATE_EVENTS)
    assert sorted((r.site, r.elevation_number, r.volume) for r in live.collect()) == sorted((r.site, r.elevation_number, r.volume) for r in state.current_sweeps(df).collect())
    want = {r.site: (r.revision, r.last_complete) for r in state.snapshot(df).collect()}
    assert {r.site: (r.revision, r.last_complete) for r in sites.collect()} == want
    assert calls.count("dead") == 1


def test_replayed_batch_is_not_appended_twice(spark, tmp_path):
    stream = in_files(spark, [("K", i) for i in range(6)], "site string, n int", str(tmp_path / "in"), 2)
    for _ in range(2):
        q = tables.stream_table(stream, str(tmp_path / "t"), str(tmp_path / "c"))
        q.processAllAvailable()
        q.stop()
        for f in (tmp_path / "c" / "commits").glob("*1*"):  # as if it had died before the last commit
            f.unlink()
    assert sorted(r.n for r in spark.read.parquet(str(tmp_path / "t")).collect()) == list(range(6))


def test_keyed_table(spark, tmp_path):
    schema = "k string, n long, v string"
    t = tables.KeyedTable(str(tmp_path / "t"), ("k",), "n", buckets=3)
    assert t.read(spark, schema).count() == 0
    assert t.upsert(spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), (None, 5, "z"), ("b", 1, "q")], schema), 0)
    assert not t.upsert(spark.createDataFrame([("a", 9, "no")], schema), 0)
    assert t.upsert(spark.createDataFrame([], schema), 1)
    assert t.upsert(spark.createDataFrame([("a", 1, "old"), ("b", 3, "new")], schema), 2)
    assert sorted((tuple(r) for r in t.read(spark, schema).collect()), key=repr) == sorted([("a", 2, "y"), (None, 5, "z"), ("b", 3, "new")], key=repr)


def test_feed_health_agrees_with_windows(spark, tmp_path, arrow_rows):
    from sweepline.operators.feed import ingest_state

    rng = random.Random(2)
    data = [("K", i, rng.random() < 0.7, rng.random() < 0.05) for i in range(60)]
    schema = "site string, seq long, is_error boolean, reanchored boolean"
    finish(assemble.feed_health_stream(in_files(spark, data, schema, str(tmp_path / "in"), 3)), "health", str(tmp_path / "c"))
    want = ingest_state(spark.createDataFrame(data, schema)).select("seq", "attempts", "state").orderBy("seq").collect()
    assert [tuple(r) for r in spark.sql("select seq, attempts, state from health order by seq").collect()] == [tuple(r) for r in want]


def test_activity_windows(spark):
    df = spark.createDataFrame([("K", T0), ("K", T0 + dt.timedelta(minutes=11)), ("K", T0 + dt.timedelta(minutes=40))], "site string, arrival timestamp")
    assert [(r.n_chunks, r.end - r.start) for r in assemble.activity_windows(df).orderBy("start").collect()] == [(2, dt.timedelta(minutes=23)), (1, dt.timedelta(minutes=12))]


def test_small_files_share_tasks(spark, tmp_path):
    """The stream's session lists many folders and opens many small files in few tasks."""
    from sweepline.plans.stream_queries import stream_session
    from sweepline.sources import chunks

    rows = spark.range(400).selectExpr("concat('S', id % 4) as site", "id div 4 + 1 as volume_seq", "1 as chunk_no", "'I' as kind", "encode('xxxxyyyyzzzz', 'UTF-8') as content")
    folder = f"file://{tmp_path}/objects"
    chunks.write_chunks(rows, folder)
    other = stream_session(spark)
    got = chunks.read_chunks(other, folder)
    assert got.count() == 400 and got.select("path").distinct().count() == 400
    assert got.rdd.getNumPartitions() <= 2 * spark.sparkContext.defaultParallelism < chunks.read_chunks(spark, folder).rdd.getNumPartitions()


class Counted(dict):
    """A map state in memory that counts what is asked of it."""

    calls = 0

    def getValue(self, key):
        self.calls += 1
        return self[key]

    def updateValue(self, key, value):
        self.calls += 1
        self[key] = value

    def removeKey(self, key):
        self.calls += 1
        del self[key]


@pytest.mark.parametrize("held", [None, 40_000])
def test_waiting_rows_need_few_calls_of_the_state_store(held):
    """Rows of a site in no order: they are held, or wait by large blocks, and never one by one."""
    states = Counted()
    handle = type("Handle", (), {"getMapState": lambda *a: states, "getValueState": lambda *a: None})()
    p = assemble.FeedHealth(5) if held is None else assemble.FeedHealth(5, held)
    p.init(handle)
    order = random.Random(3).sample(range(40_000), 5_000)
    batches = [pd.DataFrame({"seq": order[i : i + 50], "is_error": [x % 3 == 0 for x in order[i : i + 50]], "reanchored": False}) for i in range(0, 5_000, 50)]
    assert [tuple(r) for r in p.in_order(iter(batches))] == [(x, x % 3 == 0, False) for x in sorted(order)]
    assert not states
    assert states.calls == 0 if held is None else 0 < states.calls < 1_000


def test_held_rows_and_waiting_rows_give_the_same(spark, tmp_path):
    rng = random.Random(5)
    sequence = [(k, 121 if k == "S" else None, [] if k == "S" else [ray(rng.randrange(1, 4), rng.choice([1, 1, 2, 4]), rng.choice([None, 35])) for _ in range(4)]) for k in (rng.choice("SIIIIERN").replace("R", "RESET").replace("N", "I") for _ in range(40))]
    data = rows(sequence, "KDOX")
    data[7] = (*data[7][:5], None)  # no radials at all
    stream = in_files(spark, rng.sample(data, len(data)), CHUNKS, str(tmp_path / "in"), 1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        for name, held in (("held", 1 << 20), ("waiting", 1)):
            finish(assemble.assemble_stream(stream, timeout_ms=None, held=held), name, str(tmp_path / name))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    got = [[tuple(r) for r in spark.sql(f"select * from {name} order by event_no").collect()] for name in ("held", "waiting")]
    assert got[0] == got[1] and len(got[0]) > 20


def test_files_are_listed_by_one_query(spark, monkeypatch):
    """Files to state: each wave is one query, which puts out changes and unreadable chunks, and lists the files once."""
    from pyspark.sql.streaming import DataStreamWriter

    started, start = [], DataStreamWriter.start
    monkeypatch.setattr(DataStreamWriter, "start", lambda self, *a, **b: started.append(q := start(self, *a, **b)) or q)
    monkeypatch.setattr(stream_queries, "SLICES", 2)
    got = stream_queries.t8_files_to_state(spark, "/root/testdata/sf0.001")
    assert len(started) == 2 and all(len(p.sources) == 1 for q in started for p in q.recentProgress)
    kinds = {r.kind: r["count"] for r in got.groupBy("kind").count().collect()}
    bad = view(spark, "/root/testdata/sf0.001", "radials").where(f"chunk_no % {stream_queries.BAD} = 5").select("site", "chunk_no").distinct().count()
    assert kinds["TooShort"] == bad > 0 and kinds["state"] > 0 and len(kinds) == 2


def test_state_tables_take_each_slice_s_last_batch_twice(spark, monkeypatch):
    calls, upsert = [], tables.KeyedTable.upsert

    def noted(self, batch, number):
        done = upsert(self, batch, number)
        calls.append((self.path.rsplit("/", 1)[-1], number, done, batch.count()))
        return done

    monkeypatch.setattr(tables.KeyedTable, "upsert", noted)
    got = stream_queries.t4_state_tables(spark, "/root/testdata/sf0.001")
    for n in range(stream_queries.SLICES):
        for name in ("sweeps", "sites"):
            first, second = [c[2:] for c in calls if c[:2] == (name, n)]
            assert first[0] and not second[0] and first[1] == second[1] > 0
    events = assembly_queries.arrivals(spark, "/root/testdata/sf0.001")
    want = {(r.site, r.elevation_number): r.volume for r in state.current_sweeps(events).collect()}
    assert {(r.site, r.elevation_number): r.volume for r in got.collect()} == want and want
    revisions = {r.site: r.revision for r in state.snapshot(events).collect()}
    assert {(r.site, r.site_revision) for r in got.collect()} == {(s, revisions[s]) for s, _ in want}


def test_nothing_is_taken_back_from_an_empty_checkpoint(spark, tmp_path):
    tables.take_back(spark, str(tmp_path / "none"))
    (tmp_path / "c" / "commits").mkdir(parents=True)
    tables.take_back(spark, str(tmp_path / "c"))
    for n in (9, 10):
        (tmp_path / "c" / "commits" / str(n)).write_text("v1")
    tables.take_back(spark, str(tmp_path / "c"))
    assert [p.name for p in (tmp_path / "c" / "commits").iterdir()] == ["9"]


def test_unreadable_chunks_pass_and_change_nothing(spark, tmp_path):
    sequence = [("S", 35, []), ("I", None, [ray(1), ray(1)]), ("I", None, [ray(2)]), ("E", None, [ray(2, 4)])]
    good = [(*r, None) for r in rows(sequence, "KDOX")]
    data = [(s, 2 * i, *more) for s, i, *more in good] + [("KDOX", 2 * i + 1, "I", None, T0, None, name) for i, name in enumerate(("TooShort", "KindMismatch"))]
    found = {}
    for name, given in (("good", [(s, 2 * i, *more) for s, i, *more in good]), ("all", data[::-1])):
        events = assemble.assemble_stream(in_files(spark, given, f"{CHUNKS}, error string", str(tmp_path / f"in-{name}"), 1), timeout_ms=None)
        at = F.when(F.col("event_type") == "Unreadable", F.col("chunk_no")).otherwise(F.col("epoch"))
        finish(assemble.current_state_stream(events.withColumn("volume", at)), f"unreadable_{name}", str(tmp_path / f"c-{name}"))
        found[name] = [tuple(r) for r in spark.sql(f"select * from unreadable_{name}").collect()]
    assert len(found["good"]) == 3 and [r for r in found["all"] if r[6] is not None] == found["good"]
    assert sorted(r for r in found["all"] if r[6] is None) == [("KDOX", "KindMismatch", None, 3, None, None, None, None), ("KDOX", "TooShort", None, 1, None, None, None, None)]
