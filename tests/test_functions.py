import math

import pytest
from pyspark.sql import functions as F

from sweepline.functions import codes, rules, values
from sweepline.operators import feed, grid, inspect
from sweepline.sources.listing import follow_pages, parse_bucket_listing
from sweepline.sources.registry import PLACES, read_station_registry


def column(spark, expr, *values_):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values_], "x string").select(expr(F.col("x"))).collect()]


def test_percent_encoding(spark):
    assert column(spark, values.percent_encode, "aZ0-._~", "1/p+q==", "a b*é", "x\ny") == ["aZ0-._~", "1%2Fp%2Bq%3D%3D", "a%20b%2A%C3%A9", None]
    assert column(spark, values.object_path, "KDOX/166/é") == ["/KDOX/166/%C3%A9"]


def test_urls_and_hosts(spark):
    urls = ["https://h/k/1", "http://h/k", "ftp://h", "https://h", "https:///k", "https://h/", None]
    got = [(r.host, r.key, r.reason) for r in rules.split_object_url(spark.createDataFrame([(u,) for u in urls], "url string")).collect()]
    assert got == [("h", "k/1", None), (None, None, "http_scheme"), (None, None, "missing_scheme"), (None, None, "no_path"), (None, None, "empty_host"), (None, None, "empty_key"), (None, None, "missing_scheme")]
    good = rules.ALLOWED_HOSTS[0]
    hosts = [good, good.upper(), good + ".", good + ":443", "u@" + good, "x" + good, "", "a/b", None]
    ok, bad = rules.split_by_allowlist(spark.createDataFrame([(h,) for h in hosts], "host string"))
    assert [r.host for r in ok.collect()] == [good] and bad.count() == 8


def test_keys_and_folders(spark):
    keys = ["KDOX/166/20260728-095259-001-S", "KDOX/abc/20260728-095259-001-S", "KDOX/166/20260728-095259-001-X", "KDOX/166/x-S", None]
    got = [(r.volume_seq, r.kind, r.reason) for r in rules.parse_object_keys(spark.createDataFrame([(k,) for k in keys], "key string")).collect()]
    assert got == [(166, "S", None), (None, None, "bad_volume"), (None, None, "bad_suffix"), (None, None, "bad_name"), (None, None, "bad_suffix")]
    assert column(spark, lambda c: rules.parse_volume_folder(F.lit("KDOX/"), c), "KDOX/166/", "KDOX/166", "KDOX/abc/", "OTHER/166/") == [166, None, None, None]


def test_listing(spark):
    head = "<?xml version='1.0' encoding='UTF-8'?><ListBucketResult xmlns=\"http://s3.amazonaws.com/doc/2006-03-01/\"><Name>b</Name><Prefix>KDOX/</Prefix>"
    docs = [
        head + "<IsTruncated>true</IsTruncated><NextContinuationToken>a&amp;b</NextContinuationToken><Contents><Key>K/1/a</Key><Size>1</Size></Contents><Contents><Key>K/1/b&#38;c</Key></Contents></ListBucketResult>",
        head + "<IsTruncated>false</IsTruncated><CommonPrefixes><Prefix>KDOX/1/</Prefix></CommonPrefixes><CommonPrefixes><Prefix>KDOX/2/</Prefix></CommonPrefixes></ListBucketResult>",
        head + "<Contents><Key>&bogus;</Key></Contents></ListBucketResult>",
        None,
    ]
    got = [(r.keys, r.folders, r.is_truncated, r.next_token, r.malformed) for r in parse_bucket_listing(spark.createDataFrame([(d,) for d in docs], "xml string")).select("keys", "folders", "is_truncated", "next_token", "malformed").collect()]
    assert got == [(["K/1/a", "K/1/b&c"], [], True, "a&b", False), ([], ["KDOX/1/", "KDOX/2/"], False, None, False), ([], [], False, None, True), ([], [], False, None, True)]


def test_registry(spark, tmp_path):
    NAMES = ("ncdcid", "icao", "wban", "name", "country", "state", "county", "lat", "lon", "elev_ft", "utc", "stntype")

    bounds = [(0, 8), PLACES["icao"], (14, 19), PLACES["name"], (51, 71), PLACES["state"], (75, 105), PLACES["lat"], PLACES["lon"], PLACES["elev_ft"], (134, 139), PLACES["stntype"]]

    def line(**fields):
        out = [" "] * 190
        for name, (a, b) in zip(NAMES, bounds, strict=True):
            out[a:b] = fields.get(name, "").ljust(b - a)[: b - a]
        return "".join(out)

    ruler = [" "] * 190
    for a, b in bounds:
        ruler[a:b] = "-" * (b - a)
    rows = [line(icao="KTLH", name="TALLAHASSEE", state="FL", lat="30.3975", lon="-84.3289", elev_ft="176", stntype="NEXRAD"), line(icao="KDOX", name="DOVER AFB", state="DE", lat="38.8257", lon="-75.44", elev_ft="50", stntype="NEXRAD"), line(icao="TADW", name="ANDREWS", stntype="TDWR")]
    path = tmp_path / "stations.txt"
    path.write_text("\n".join(["header", "".join(ruler), *rows, ""]))
    got = [tuple(r) for r in read_station_registry(spark, str(path)).collect()]
    assert got == [("KDOX", "DOVER AFB", "DE", 38.8257, -75.44, 15), ("KTLH", "TALLAHASSEE", "FL", 30.3975, -84.3289, 54)]
    path.write_text("\n".join(["header", "".join(ruler)[1:], *rows]))
    with pytest.raises(ValueError, match="moved"):
        read_station_registry(spark, str(path))


def test_anchor_and_actions(spark):
    folders = [("a", 5), ("b", 3), ("b", 9), ("b", 7), ("c", 709), ("c", 78), ("d", 1)]
    got = {r.site: r.anchor for r in feed.cold_start_anchor(spark.createDataFrame(folders, "site string, volume_seq long")).collect()}
    assert got == {"a": 4, "b": 8, "c": 708, "d": 0}
    steps = [(90, 12, False, 165), (90, 12, False, 89), (200, 12, False, 50), (90, 60, True, None), (90, 12, True, 93), (90, 11, False, 165), (90, 12, False, None)]
    got = [(r.action, r.new_target) for r in feed.next_action(spark.createDataFrame(steps, "target long, empty_polls long, seen_any_key boolean, newest long")).collect()]
    assert got == [("ReAnchor", 164), ("Continue", 90), ("Continue", 200), ("Advance", 91), ("Continue", 90), ("Continue", 90), ("Continue", 90)]


def test_recovery_fold(spark):
    polls = [("K", i, 0, 30, 10) for i in range(12)] + [("K", 12, 3, None, 10)] + [("K", 13 + i, 0, None, 10) for i in range(60)]
    got = feed.recovery_actions(spark.createDataFrame(polls, "site string, seq long, n_keys int, newest long, start long")).where("action <> 'Continue'").orderBy("seq").collect()
    assert [(r.seq, r.target, r.action, r.new_target) for r in got] == [(11, 10, "ReAnchor", 29), (72, 29, "Advance", 30)]


def test_nearest_radial_ties_and_wrap(spark):
    radials = spark.createDataFrame([("s", 0, 10.0), ("s", 1, 12.0), ("s", 2, 12.0), ("s", 3, 359.6), ("s", 4, float("nan"))], "k string, radial_idx int, azimuth_deg double")
    points = spark.createDataFrame([("s", 1, 11.0), ("s", 2, 12.0), ("s", 3, 12.5), ("s", 4, 0.3), ("s", 5, 200.0), ("s", 6, 11.5)], "k string, point_no int, azimuth_deg double")
    got = {r.point_no: r.radial_idx for r in grid.nearest_radial(points, radials, ["k"]).collect()}
    assert got == {1: 0, 2: 1, 3: 2, 4: 3, 5: None, 6: 1}


def test_gate_index_is_cut_toward_zero(spark):
    moments = spark.createDataFrame([("s", 3, 2125, 250, 2.0, 66.0, [0, 1, 133])], "k string, gate_count int, first_gate_m int, gate_width_m int, scale double, offset double, raw array<int>")
    points = spark.createDataFrame([("s", 2.0), ("s", 2.4), ("s", 2.7), ("s", 2.9), ("s", 1.8), ("t", 2.0)], "k string, range_km double")
    got = [(r.gate, r.flag, r.value) for r in grid.gate_at(points, moments, ["k"]).orderBy("k", "range_km").collect()]
    assert got == [(None, "no_data", None), (0, "below_snr", None), (1, "range_folded", None), (2, "data", 33.5), (None, "no_data", None), (None, "no_data", None)]


def test_codes_and_labels(spark):
    df = spark.createDataFrame([(5, 200), (None, 3)], "a int, b int")
    assert [tuple(r) for r in codes.label_codes(df, status="a", vcp="b").select("a_label", "b_label").collect()] == [("StartOfLastElevation", "Unknown(200)"), (None, "Unknown(3)")]
    assert spark.range(1).select(codes.super_res_flags(F.lit(9))).first()[0] == ["half_degree", "dual_pol_300km"]
    assert column(spark, codes.product_name, "z", "CC", "nope") == ["DREF", "DRHO", None]


def test_with_site(spark):
    sites = spark.createDataFrame([("KDOX", 38.8)], "id string, lat double")
    got = inspect.with_site(spark.createDataFrame([("kdox",), ("XXXX",)], "site_id string"), sites).collect()
    assert {r.site_id: r.lat for r in got} == {"kdox": 38.8, "XXXX": None}


def test_ppi_grid_of_all_sites_by_brute_force(spark):
    from sweepline.plans import gate_queries as q

    d = "/root/testdata/sf0.001"
    moments = {(r.site, r.elevation_number, r.radial_idx): r for r in q.view(spark, d, "moments").where("product = 'DREF'").collect()}
    sweeps = {}
    for r in spark.sql(q.RADIAL_TABLE, g=q.view(spark, d, "gates")).collect():
        sweeps.setdefault((r.site, r.elevation_number), []).append(r)
    cells = [(x, y, math.degrees(math.atan2((x - 8) * 0.5, (8 - y) * 0.5)) % 360, math.hypot((x - 8) * 0.5, (8 - y) * 0.5)) for x in range(16) for y in range(16)]
    want = {}
    for sweep, radials in sweeps.items():
        for x, y, az, far in cells:
            near = []
            for r in radials:
                gap, below = abs(az - r.azimuth_deg), 0 < (az - r.azimuth_deg) % 360 < 180
                near.append((min(gap, 360 - gap), not below, -r.radial_idx if below else r.radial_idx, r.radial_idx))
            m = moments.get((*sweep, min(near)[3])) if far <= 4 and min(near)[0] <= 1 else None
            gate = int((far - m.first_gate_m / 1000) / (m.gate_width_m / 1000)) if m else -1
            if m and 0 <= gate < m.gate_count and (raw := m.raw[gate]) >= 1:
                value = (raw - m.offset) / m.scale if raw > 1 else None
                steps = [c for t, c in grid.REFLECTIVITY if value is not None and value >= t]
                rgba = grid.hex_colour(grid.FOLDED if raw == 1 else steps[-1] if steps else grid.CLEAR)
                if rgba != grid.hex_colour(grid.CLEAR):
                    want[(*sweep, x, y)] = (value if value is None else round(value, 6), rgba)
    got = {(r.site, r.elevation_number, r.x, r.y): (r.value, r.rgba) for r in q.g3_ppi_grid_all_sites(spark, d).collect()}
    assert got == want and len({k[0] for k in got}) == len({k[0] for k in sweeps}) > 1


def test_every_host_is_judged(spark, tmp_path):
    from sweepline.plans import gate_queries as q

    hosts = ["a.example.com", "www.spam-farm.example.com", "A.example.com", "a.example.com:443", "u@a.example.com", "a.example.com.", "b.test"]
    spark.createDataFrame([(i, f"https://{h}/k") for i, h in enumerate(hosts)] + [(9, None)], "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: r.host_reason for r in q.s7_allowlist_all_hosts(spark, str(tmp_path)).collect()}
    assert got == {0: "listed", 1: "not_listed", 2: "not_listed", 3: "not_a_bare_host", 4: "not_a_bare_host", 5: "trailing_dot", 6: "not_listed", 9: "missing"}


def test_recovery_streams_through_small_batches(spark):
    polls = [(s, i, 0, 30, 10) for s in "KL" for i in range(12)] + [(s, 12, 3, None, 10) for s in "KL"] + [(s, 13 + i, 0, None, 10) for s in "KL" for i in range(60)]
    df = spark.createDataFrame(polls, "site string, seq long, n_keys int, newest long, start long").orderBy(F.desc("seq"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        out = feed.recovery_actions(df)
        assert "FlatMapGroupsInPandas" not in out._jdf.queryExecution().toString()
        got = out.where("action <> 'Continue'").orderBy("site", "seq").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert [tuple(r) for r in got] == [(s, *x) for s in "KL" for x in [(11, 10, "ReAnchor", 29, 12), (72, 29, "Advance", 30, 60)]]


def test_product_maps(spark):
    df = spark.sql("select map('DREF', 1, 'DSW', 2) as m union all select map() union all select null")
    got = df.select(codes.product_keys(F.col("m")), codes.has_product(F.col("m"), F.lit("sw")), codes.has_product(F.col("m"), F.lit("nope")), codes.product_of(F.col("m"), F.lit("REF")), codes.product_of(F.col("m"), F.lit("VEL"))).collect()
    assert [tuple(r) for r in got] == [(["DREF", "DSW"], True, False, 1, None), ([], False, False, None, None), (None, None, None, None, None)]


def test_pages_are_followed_by_their_tokens(spark):
    """Chains in any order; each way in which one can break; a ring that nothing leads to."""
    chain = [("long", None if i == 0 else f"t{i}", i < 40, f"t{i + 1}" if i < 40 else "left over", False) for i in range(41)]
    rows = chain[::-1] + [
        ("one", None, False, None, False), ("cut", None, True, None, False), ("gap", None, True, "g1", False), ("gap", "g2", False, None, False),
        ("bad", None, True, "b1", False), ("bad", "b1", False, None, True), ("ring", "r1", True, "r2", False), ("ring", "r2", True, "r1", False), ("same", None, True, "first", False), ("same", "first", False, None, False), (None, None, False, None, False),
    ]
    pages = spark.createDataFrame(rows, "listing string, token string, is_truncated boolean, next_token string, malformed boolean")
    got = {(r.listing, r.token): (r.page_no, r.problem) for r in follow_pages(pages).collect()}
    assert len(got) == len(rows) and all(got["long", r[1]] == (i + 1, None) for i, r in enumerate(chain))
    assert got["one", None] == (1, None) and got[None, None] == (1, None) and got["cut", None] == (1, "no_token")
    assert got["gap", None] == (1, "next_missing") and got["gap", "g2"] == (None, "unreached")
    assert got["bad", "b1"] == (2, "malformed") and got["ring", "r1"] == got["ring", "r2"] == (None, "unreached")
    assert got["same", None] == (1, None) and got["same", "first"] == (2, None)
    assert follow_pages(pages.limit(0)).count() == 0


def test_radials_by_azimuth(spark):
    from sweepline.operators.inspect import by_azimuth

    rows = [("K", 1, 0, 5.0), ("K", 1, 1, 3.0), ("K", 1, 2, float("nan")), ("K", 1, 3, None), ("K", 1, 4, 3.0), ("K", 2, 5, 0.0)]
    got = by_azimuth(spark.createDataFrame(rows, "site string, elevation_number int, radial_idx int, azimuth_deg double"))
    assert sorted((r.elevation_number, r.place, r.radial_idx) for r in got.collect()) == [(1, 1, 1), (1, 2, 4), (1, 3, 0), (2, 1, 5)]
