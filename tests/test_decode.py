import random
import struct

import encoder as e
import pytest
from pyspark.sql import functions as F

from sweepline.operators import gates, inspect
from sweepline.sources import chunks as c

SCHEMA = "site string, volume_seq long, chunk_no int, kind string, content binary"


def frame(spark, *rows):
    return spark.createDataFrame([("KDOX", 166, i + 1, kind, content) for i, (kind, content) in enumerate(rows)], SCHEMA)


def test_round_trip(spark):
    rng = random.Random(3)
    made = []
    for i in range(40):
        raw = [rng.randrange(256) for _ in range(20)]
        made.append((i * 9 % 360 + 0.25, i // 20 + 1, raw))
    streams = [b"".join(e.radial(az=az, el_no=el, moments=[e.moment("REF", raw), e.moment("SW", raw[:5], offset=129.0), e.moment("ZDR", [450, 1, 0], 16, 32.0, 418.0)]) for az, el, raw in made[a : a + 20]) for a in (0, 20)]
    df = frame(spark, ("S", e.start_chunk(e.vcp())), ("I", e.middle_chunk(streams[0])), ("E", e.end_chunk(streams[1])))
    decoded = c.decode(df).cache()
    assert decoded.where("error is not null").count() == 0
    rows = c.radials(decoded).orderBy("chunk_no", "radial_idx").collect()
    assert [(r.azimuth_deg, r.elevation_number) for r in rows] == [(az, el) for az, el, _ in made]
    first = rows[0]
    assert first.site_id == "KDOX" and first.unamb_range == 583.75 and first.nyquist == pytest.approx(8.37)
    assert first.site_parameters.vcp_number == 35 and first.site_parameters.latitude == pytest.approx(38.8258)
    m = {x.product: x for x in first.moments}
    assert set(m) == {"DREF", "DSW", "DZDR"} and m["DREF"].raw == made[0][2] and m["DZDR"].raw == [450, 1, 0]
    g = gates.calibrate(gates.flag_gates(gates.explode_gates(c.moments(c.radials(decoded)))))
    z = {r.gate_idx: (r.flag, r.value) for r in g.where("product = 'DZDR' and chunk_no = 2 and radial_idx = 0").collect()}
    assert z == {0: ("data", 1.0), 1: ("range_folded", None), 2: ("below_snr", None)}
    v = c.vcps(decoded).first()
    assert (v.vcp_number, v.pattern_type, len(v.cuts)) == (35, 2, 2) and v.cuts[0].elevation_deg == pytest.approx(0.308, abs=0.004)
    assert c.vcp_cuts(c.vcps(decoded)).count() == 2
    census = {r.msg_type: r.n for r in inspect.message_census(c.messages(decoded)).collect()}
    assert census == {5: 1, 31: 40, None: 41}
    sizes = inspect.chunk_sizes(c.decompress_chunks(df)).collect()
    assert all(r.error is None and r.message_bytes > 0 for r in sizes)
    head = c.read_volume_headers(df).first()
    assert (head.icao, head.extension) == ("KDOX", "166") and str(head.volume_ts).startswith("2026-07-27")


def test_wanted_products_only(spark):
    s = e.radial(moments=[e.moment("REF", [2, 3]), e.moment("VEL", [4])])
    got = c.radials(c.decode(frame(spark, ("I", e.middle_chunk(s))), products=("DVEL",))).first()
    assert [m.product for m in got.moments] == ["DVEL"]


def test_soft_failures(spark):
    s = e.radial(with_rvol=False, with_rrad=False, status=200, moments=[e.moment("REF", [1], word=12), e.moment("XYZ", [1]), e.moment("RHO", [9])])
    r = c.radials(c.decode(frame(spark, ("I", e.middle_chunk(bytes(2432) + s))))).first()
    assert r.site_parameters is None and r.nyquist is None and r.radial_status == 200 and [m.product for m in r.moments] == ["DRHO"]


def test_hostile_chunks_do_not_touch_good_ones(spark):
    good = e.middle_chunk(e.radial(moments=[e.moment("REF", [5] * 30)]))
    stream = e.radial()
    bombs = bytes(3 << 20)
    bad = [
        ("I", b"\0\0\0\0", "TooShort"), ("I", bytes(40), "UnrecognizedFormat"), ("S", good, "KindMismatch"), ("I", good[:-10], "TooShort"), ("I", good[:30] + b"\xff" * 20 + good[50:], "Decompression"),
        ("E", e.end_chunk(bombs), "DecompressedTooLarge"), ("I", e.middle_chunk(bombs), "DecompressedTooLarge"), ("S", e.start_chunk(bytes(1 << 20), bytes(1 << 20), bytes(1 << 20)), "DecompressedTooLarge"),
        ("I", e.middle_chunk(stream[:70]), "Truncated"), ("I", e.middle_chunk(bytes(12) + struct.pack(">HBBHHIHH", 20, 0, 31, 0, 0, 0, 0, 0) + bytes(24)), "Truncated"), ("S", e.start_chunk(e.vcp()[:60]), "Truncated"), ("I", None, "TooShort"),
    ]
    df = frame(spark, ("I", good), *[(k, b) for k, b, _ in bad])
    decoded = c.decode(df, limit=2 << 20)
    errors = [r.error for r in c.bad_chunks(decoded).orderBy("chunk_no").collect()]
    assert errors == [x for _, _, x in bad]
    assert c.radials(decoded).count() == 1
    native = {r.chunk_no: r.error for r in c.check_chunk_kind(c.classify_chunks(df)).collect()}
    assert [native[i] for i in (1, 2, 3, 4)] == [None, "TooShort", "UnrecognizedFormat", "KindMismatch"]


def test_mutations_give_a_row_each(spark):
    rng = random.Random(11)
    stream = b"".join(e.radial(az=a, moments=[e.moment("REF", [7] * 40)]) for a in (0.5, 1.5, 2.5))
    rows = []
    for _ in range(400):
        b = bytearray(stream)
        for _ in range(rng.randrange(1, 6)):
            b[rng.randrange(len(b))] = rng.randrange(256)
        rows.append(("I", e.middle_chunk(bytes(b[: rng.randrange(1, len(b) + 1)]))))
    decoded = c.decode(frame(spark, *rows))
    assert decoded.select("chunk_no").distinct().count() == 400
    assert decoded.groupBy("chunk_no").agg(F.count("error").alias("e"), F.count("*").alias("n")).where("e > 0 and n > 1").count() == 0


def test_read_and_stream_files(spark, tmp_path):
    folder = tmp_path / "KDOX" / "166"
    folder.mkdir(parents=True)
    (folder / "20260728-095259-001-S").write_bytes(e.start_chunk(e.vcp()))
    (folder / "20260728-095303-002-I").write_bytes(e.middle_chunk(e.radial()))
    (folder / "20260728-095303-003-X").write_bytes(b"other")
    got = c.read_chunks(spark, str(tmp_path)).orderBy("chunk_no").collect()
    assert [(r.site, r.volume_seq, r.chunk_no, r.kind, r.reason) for r in got] == [("KDOX", 166, 1, "S", None), ("KDOX", 166, 2, "I", None)]
    q = c.decode(c.stream_chunks(spark, str(tmp_path))).writeStream.format("memory").queryName("decoded").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {r.msg_type for r in spark.sql("select msg_type from decoded").collect()} == {5, 31}


def test_write_table(spark, tmp_path):
    from sweepline.sources.tables import write_table

    write_table(spark.createDataFrame([("A", 1, 5), ("B", 2, 6)], "site string, volume_date int, x int"), str(tmp_path / "t"))
    back = spark.read.parquet(str(tmp_path / "t"))
    assert back.where("site = 'A'").first().x == 5 and len(back.inputFiles()) == 2


# One radial message field by field as the format's tables lay it out, written by hand: a witness apart from both encoders.
RECORD = """
000000000000000000000000
005B 08 1F 0001 50B6 021EE478 0001 0001
4B444F58 021EE478 50B6 0001 43624000 00 00 0000 02 03 01 00 3F000000 00 00 0004
00000030 0000005C 00000068 00000084
52564F4C 002C 01 00 421B0000 C2970000 000F 0022 C2300000 442F0000 442F0000 3ECCCCCD 42700000 0023 0000
52454C56 000C FFF4 C2300000
52524144 001C 123E C2A00000 C2A00000 0345 0000 0000000000000000
44524546 00000000 0005 084D 00FA 0032 0010 00 08 40000000 42840000 00 01 42 FF 5A
00
"""
PATTERN = "000000000000000000000000 0059 08 05 0002 50B6 021EE478 0001 0001 0022 0002 0023 0001 00 00 00 00 00000000 0000 0000 0000 00E0 00 01 09"


def test_records_written_by_hand(spark):
    radial = bytes.fromhex(RECORD)
    radial += bytes(-len(radial) % 4)
    pattern = (bytes.fromhex(PATTERN) + bytes(41)).ljust(2432, b"\0")
    decoded = c.decode(frame(spark, ("S", e.start_chunk(pattern + radial)))).cache()
    assert decoded.where("error is not null").count() == 0
    r = c.radials(decoded).first()
    assert (r.site_id, r.julian_date, r.scan_time_ms, r.azimuth_deg, r.elevation_deg, r.azimuth_number) == ("KDOX", 20662, 35579000, 226.25, 0.5, 1)
    assert (r.azimuth_spacing_code, r.radial_status, r.elevation_number, r.unamb_range, r.nyquist) == (2, 3, 1, 583.75, pytest.approx(8.37))
    p = r.site_parameters
    assert (p.latitude, p.longitude, p.site_amsl_m, p.feedhorn_agl_m, p.calib_dbz, p.vcp_number, p.phidp0) == (38.75, -75.5, 15, 34, -44.0, 35, 60.0)
    assert r.atmos_db_km == pytest.approx(-0.012)
    m = r.moments[0]
    assert (m.product, m.gate_count, m.first_gate_m, m.gate_width_m, m.word_size, m.scale, m.offset, m.raw) == ("DREF", 5, 2125, 250, 8, 2.0, 66.0, [0, 1, 66, 255, 90])
    v = c.vcps(decoded).first()
    assert (v.vcp_number, v.pattern_type, [(x.channel_config, x.waveform, x.super_res) for x in v.cuts]) == (35, 2, [(0, 1, 9)])
    assert v.cuts[0].elevation_deg == pytest.approx(0xE0 * 360 / 65536)


def test_groups_as_to_pylist():
    """Lists of structs read column by column are what Arrow's own conversion gives, slices, nulls and empty lists too."""
    import pyarrow as pa

    from sweepline.sources.encode import groups

    moment = lambda i: {"product": "DREF", "scale": 2.0, "raw": list(range(i))}
    rows = [[{"a": i, "b": None if i % 2 else "x", "moments": None if i == 3 else [moment(j) for j in range(i)]} for i in range(n)] for n in (3, 0, 5, 1)]
    rows.insert(1, None)
    kind = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.string()), ("moments", pa.list_(pa.struct([("product", pa.string()), ("scale", pa.float64()), ("raw", pa.list_(pa.int32()))])))]))
    plain = lambda g: g and [{**r, "moments": r["moments"] and [{**m, "raw": list(m["raw"])} for m in r["moments"]]} for r in g]
    for a in (pa.array(rows, kind), pa.array([*rows, *rows], kind).slice(2, 5)):
        assert [plain(g) for g in groups(a)] == a.to_pylist()


def test_large_batches_of_chunks(spark):
    """More chunks in a batch than are looked at together: none lost or exchanged, by decode() and by decompress_chunks()."""
    from pyspark.sql import functions as F

    from sweepline.sources import chunks, encode

    n = 12 * chunks.SLICE + 7
    r = spark.range(2 * n, numPartitions=1).selectExpr("'S' as site", "id div 2 as volume_seq", "1 as chunk_no", "'KDOX' as site_id", "20000 as julian_date", "id as scan_time_ms", "1e0 as azimuth_deg", "1e0 as elevation_deg", "1 as azimuth_number", "2 as azimuth_spacing_code", "1 as radial_status", "1 as elevation_number", "cast(null as array<struct<product:string>>) as moments")
    made = encode.encode_chunks(r).coalesce(1).withColumn("content", F.when(F.col("volume_seq") % 50 == 7, F.expr("substring(content, 1, 40)")).otherwise(F.col("content"))).cache()
    bad = {v for v in range(n) if v % 50 == 7}
    got = chunks.decode(made)
    assert sorted((x.volume_seq, x.scan_time_ms) for x in chunks.radials(got).collect()) == [(i // 2, i) for i in range(2 * n) if i // 2 not in bad]
    assert {x.volume_seq for x in got.where("error = 'TooShort'").collect()} == bad
    streams = {x.volume_seq: (x.error, x.length) for x in chunks.decompress_chunks(made).selectExpr("volume_seq", "error", "octet_length(stream) as length").collect()}
    sizes = {(e, s) for v, (e, s) in streams.items() if v not in bad}
    assert set(streams) == set(range(n)) and {v for v, (e, _) in streams.items() if e == "TooShort"} == bad and len(sizes) == 1 and sizes != {(None, None)}
    made.unpersist()


def test_sizes_are_encoded_once(spark):
    """a6_chunk_sizes makes its chunks once and reads what it has written."""
    from sweepline.plans.source_queries import a6_chunk_sizes

    plan = a6_chunk_sizes(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "lineitem" not in plan and plan.count("MapInArrow") == 2
