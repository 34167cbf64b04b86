"""Queries on gates, moments, addresses, codes, grids and products."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import codes, rules, values
from ..operators import feed, gates, grid, inspect, products
from .adapters import cte, view
from .registry import query

GATES = cte("gates")
VALUE = "case when raw >= 2 then (raw - \"offset\") / scale end"


# The oracles' own tables, written out apart from the package's so that an error in either one shows.
STATUS_SQL = "case status when 0 then 'StartOfElevation' when 1 then 'Intermediate' when 2 then 'EndOfElevation' when 3 then 'StartOfVolume' when 4 then 'EndOfVolume' when 5 then 'StartOfLastElevation' else 'Unknown(' || status || ')' end"
WAVEFORM_SQL = "case waveform when 1 then 'Contiguous Surveillance' when 2 then 'Contiguous Doppler with ambiguity resolution' when 3 then 'Contiguous Doppler' when 4 then 'Batch' when 5 then 'Staggered Pulse Pair' else 'Unknown(' || waveform || ')' end"
CHANNEL_SQL = "case channel when 0 then 'Constant Phase' when 1 then 'Random Phase' when 2 then 'SZ2 Phase' else 'Unknown(' || channel || ')' end"
SPACING_SQL = "case spacing when 1 then '0.5 deg' when 2 then '1.0 deg' else 'Unknown(' || spacing || ')' end"
MESSAGE_SQL = """case {c} when 1 then 'Digital Radar Data' when 2 then 'RDA Status Data' when 3 then 'Performance/Maintenance Data' when 4 then 'Console Message - RDA to RPG' when 5 then 'Volume Coverage Pattern - RDA to RPG' when 6 then 'RDA Control Commands'
when 7 then 'Volume Coverage Pattern - RPG to RDA' when 8 then 'Clutter Censor Zones' when 9 then 'Request for Data' when 10 then 'Console Message - RPG to RDA' when 11 then 'Loop Back Test - RDA to RPG' when 12 then 'Loop Back Test - RPG to RDA'
when 13 then 'Clutter Filter Bypass Map' when 14 then 'Spare' when 15 then 'Clutter Filter Map' when 16 then 'Reserved - RDA to RPG' when 17 then 'Reserved - RPG to RDA' when 18 then 'RDA Adaptation Data' when 29 then 'Model Data'
when 31 then 'Digital Radar Data Generic Format' when 32 then 'RDA PRF Data' when 33 then 'RDA Log Data' else 'Unknown(' || {c} || ')' end"""
VCP_SQL = "case when vcp in (31, 32, 35) then 'clear air' when vcp in (11, 12, 21, 112, 121, 211, 212, 215, 221) then 'precipitation' when vcp = 80 then 'maintenance' else 'Unknown(' || vcp || ')' end"
SUPER_RES_SQL = "concat_ws(',', case when mask & 1 <> 0 then 'half_degree' end, case when mask & 2 <> 0 then 'doppler_300km' end, case when mask & 4 <> 0 then 'dual_pol' end, case when mask & 8 <> 0 then 'dual_pol_300km' end)"
REFLECTIVITY_SQL = """when value >= 75 then '9854C6FF' when value >= 70 then 'F800FDFF' when value >= 65 then 'BC0000FF' when value >= 60 then 'D40000FF' when value >= 55 then 'FD0000FF' when value >= 50 then 'FD9500FF' when value >= 45 then 'E5BC00FF' when value >= 40 then 'FDF802FF'
when value >= 35 then '008E00FF' when value >= 30 then '01C501FF' when value >= 25 then '02FD02FF' when value >= 20 then '0300F4FF' when value >= 15 then '019FF4FF' when value >= 10 then '04E9E7FF' when value >= 5 then '767676FF'"""
VELOCITY_SQL = """when value >= 54 then 'C80000FF' when value >= 44 then 'FF0000FF' when value >= 34 then 'FF5000FF' when value >= 24 then 'FFA000FF' when value >= 14 then 'FFFF00FF' when value >= 4 then 'AAAA00FF' when value >= 1 then '646400FF' when value >= -1 then '646464FF'
when value >= -4 then '006400FF' when value >= -14 then '00C850FF' when value >= -24 then '00FFB0FF' when value >= -34 then '00F0FFFF' when value >= -44 then '00A0FFFF' when value >= -54 then '0028FFFF' when value >= -64 then '0000C8FF'"""


def _colour_sql(arms: str) -> str:
    return f"case when raw = 1 then 'A0A0A0FF' when value is null then '00000000' {arms} else '00000000' end"


def valued(spark, sf_dir):
    return gates.with_range(gates.calibrate(view(spark, sf_dir, "gates")))


@query(cte("moments") + " select site, radial_idx, product, (generate_subscripts(raw, 1) - 1)::int as gate_idx, unnest(raw) as raw from moments")
def d10_explode_gates(spark, sf_dir):
    return gates.explode_gates(view(spark, sf_dir, "moments")).select("site", "radial_idx", "product", "gate_idx", "raw")


@query(GATES + f" select site, radial_idx, product, gate_idx, round({VALUE}, 6) as value from gates")
def d11_calibrate(spark, sf_dir):
    return gates.calibrate(view(spark, sf_dir, "gates")).select("site", "radial_idx", "product", "gate_idx", F.round("value", 6).alias("value"))


@query(GATES + " select radial_idx, product, gate_idx, case raw when 0 then 'below_snr' when 1 then 'range_folded' else 'data' end as flag from gates")
def d12_flag_gates(spark, sf_dir):
    return gates.flag_gates(view(spark, sf_dir, "gates")).select("radial_idx", "product", "gate_idx", "flag")


@query(GATES + " select radial_idx, product, gate_idx, round(first_gate_m / 1000.0 + gate_idx * gate_width_m / 1000.0, 6) as range_km from gates")
def d13_gate_range(spark, sf_dir):
    return gates.with_range(view(spark, sf_dir, "gates")).select("radial_idx", "product", "gate_idx", F.round("range_km", 6).alias("range_km"))


CODES = "select event_id, cast(event_id % 8 as int) as status, cast(event_id % 7 as int) as waveform, cast(event_id % 4 as int) as channel, cast(event_id % 3 as int) as spacing, cast(event_id % 35 as int) as message, cast(event_id % 250 as int) as vcp, cast(event_id % 16 as int) as mask from "


@query(f"with c as ({CODES} events) select event_id, {STATUS_SQL} as status_label, {WAVEFORM_SQL} as waveform_label, {CHANNEL_SQL} as channel_label, {SPACING_SQL} as spacing_label, {MESSAGE_SQL.format(c='message')} as message_label, {VCP_SQL} as vcp_label, {SUPER_RES_SQL} as super_res from c")
def d14_label_codes(spark, sf_dir):
    df = spark.sql(CODES + "{events}", events=spark.read.parquet(f"{sf_dir}/events.parquet"))
    out = codes.label_codes(df, status="status", waveform="waveform", channel="channel", spacing="spacing", message="message", vcp="vcp")
    return out.select("event_id", *[f"{k}_label" for k in ("status", "waveform", "channel", "spacing", "message", "vcp")], F.array_join(codes.super_res_flags(F.col("mask")), ",").alias("super_res"))


@query(cte("radials") + " select event_id, (julian_date - 1)::bigint * 86400000 + scan_time_ms as unix_ms, strftime(make_timestamp(((julian_date - 1)::bigint * 86400000 + scan_time_ms) * 1000), '%Y-%m-%d %H:%M:%S') as scan_time from radials")
def d15_timestamp(spark, sf_dir):
    t = values.nexrad_timestamp(F.col("julian_date"), F.col("scan_time_ms"))
    return view(spark, sf_dir, "radials").select("event_id", F.unix_millis(t).alias("unix_ms"), F.date_format(F.to_utc_timestamp(t, F.current_timezone()), "yyyy-MM-dd HH:mm:ss").alias("scan_time"))


@query(GATES + " select radial_idx, gate_idx, raw from gates where elevation_number = 3 and product = 'DREF'")
def d16_select_sweep(spark, sf_dir):
    return gates.select_sweep(view(spark, sf_dir, "gates"), 3, "ref").select("radial_idx", "gate_idx", "raw")


@query(GATES + " select elevation_number, string_agg(distinct product, ',' order by product) as products from gates group by elevation_number")
def d16_available(spark, sf_dir):
    return gates.available(view(spark, sf_dir, "gates"))


@query(GATES + f" select radial_idx, product, gate_idx, round({VALUE}, 6) as value from gates where product <> 'DREF' or {VALUE} >= 0")
def d17_mask_below(spark, sf_dir):
    return gates.mask_below(valued(spark, sf_dir), "DREF").select("radial_idx", "product", "gate_idx", F.round("value", 6).alias("value"))


KINDS = "select event_id, case when event_type = 'error' then 'Truncated' when event_id % 3 <> user_id % 3 and event_id % 5 = 0 then 'KindMismatch' end as error from "


@query(f"with k as ({KINDS} events) select error is null as good, coalesce(error, 'none') as error, count(*) as n from k group by all")
def d18_split_good_bad(spark, sf_dir):
    good, bad = rules.split_good_bad(spark.sql(KINDS + "{events}", events=spark.read.parquet(f"{sf_dir}/events.parquet")))
    both = good.select(F.lit(True).alias("good"), F.lit("none").alias("error")).union(bad.select(F.lit(False), "error"))
    return both.groupBy("good", "error").agg(F.count("*").alias("n"))


PAIRS = "select event_id, case event_id % 3 when 0 then 'S' when 1 then 'I' else 'E' end as kind, case when event_type = 'error' then 'I' else case event_id % 3 when 0 then 'S' when 1 then 'I' else 'E' end end as detected from "


@query(f"with k as ({PAIRS} events) select event_id, kind, detected from k where kind <> detected")
def d2_kind_mismatch(spark, sf_dir):
    from ..sources.chunks import check_chunk_kind

    df = check_chunk_kind(spark.sql(PAIRS + "{events}", events=spark.read.parquet(f"{sf_dir}/events.parquet")))
    return df.where("error is not null").select("event_id", "kind", "detected")


KEYS = cte("object_keys")
SHAPE = r"^([^/]+)/([^/]+)/(\d{8}-\d{6})-(\d+)-([SIE])$"


@query(KEYS + rf""", r as (select *, try_cast(split_part(key, '/', 2) as bigint) as vol from object_keys), s as (select *, case when not regexp_matches(key, '[SIE]$') then 'bad_suffix' when vol is null or vol < 0 then 'bad_volume' when not regexp_matches(key, '{SHAPE}') then 'bad_name' end as reason from r)
select event_id, reason, case when reason is null then regexp_extract(key, '{SHAPE}', 1) end as site, case when reason is null then vol end as volume_seq, case when reason is null then strftime(strptime(regexp_extract(key, '{SHAPE}', 3), '%Y%m%d-%H%M%S'), '%Y-%m-%d %H:%M:%S') end as chunk_ts,
case when reason is null then regexp_extract(key, '{SHAPE}', 4)::int end as chunk_no, case when reason is null then regexp_extract(key, '{SHAPE}', 5) end as kind from s""")
def s3_object_keys(spark, sf_dir):
    out = rules.parse_object_keys(view(spark, sf_dir, "object_keys"))
    return out.select("event_id", "reason", "site", "volume_seq", F.date_format("chunk_ts", "yyyy-MM-dd HH:mm:ss").alias("chunk_ts"), "chunk_no", "kind")


@query(KEYS + r""", k as (select event_id, split_part(key, '/', 1) as site, try_cast(split_part(key, '/', 2) as bigint) as volume_seq, key from object_keys where regexp_matches(key, '^[^/]+/[0-9]+/.*[SIE]$')),
g as (select site, volume_seq, min(key) as last_key from k where event_id % 2 = 0 group by 1, 2) select k.* from k left join g using (site, volume_seq) where last_key is null or key > last_key""")
def s5_keys_after(spark, sf_dir):
    keys = rules.parse_object_keys(view(spark, sf_dir, "object_keys")).where("reason is null").select("event_id", "site", "volume_seq", "key")
    progress = keys.where("event_id % 2 = 0").groupBy("site", "volume_seq").agg(F.min("key").alias("last_key"))
    return feed.keys_after(keys, progress).select("event_id", "site", "volume_seq", "key")


URLS = """with u as (select page_id, url, substr(url, 9) as rest, instr(substr(url, 9), '/') as slash from pages),
r as (select *, case when starts_with(url, 'http://') then 'http_scheme' when url is null or not starts_with(url, 'https://') then 'missing_scheme' when slash = 0 then 'no_path' when slash = 1 then 'empty_host' when substr(rest, slash + 1) = '' then 'empty_key' end as reason from u),
s as (select page_id, reason, case when reason is null then substr(rest, 1, slash - 1) end as host, case when reason is null then substr(rest, slash + 1) end as key from r)"""


@query(URLS + " select * from s")
def s6_object_urls(spark, sf_dir):
    return rules.split_object_url(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "reason", "host", "key")


HOSTS = URLS + r" select page_id, host, case when host is null then 'missing' when regexp_matches(host, '[@:/]') then 'not_a_bare_host' when host like '%.' then 'trailing_dot' when host not in (select host from s where regexp_matches(host, '^[a-z.]*\.example\.com$')) then 'not_listed' else 'listed' end as host_reason from s"


@query(HOSTS)
def s7_allowlist(spark, sf_dir):
    urls = rules.split_object_url(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "host")
    good, bad = rules.split_by_allow_table(urls, urls.where(r"host rlike '^[a-z.]*\\.example\\.com$'"))
    return good.withColumn("host_reason", F.lit("listed")).unionByName(bad)


@query(HOSTS)
def s7_allowlist_all_hosts(spark, sf_dir):
    """The former name of s7_allowlist, which reads all hosts as well."""
    return s7_allowlist(spark, sf_dir)


ALLOWED = ("ththble.example.net", "www.cheap-pills.example.com", "thther.example.org", "blog.tionsh.example.net")


@query(HOSTS.replace("host not in (select host from s where regexp_matches(host, '^[a-z.]*\\.example\\.com$'))", f"host not in {ALLOWED}"))
def s7_short_allowlist(spark, sf_dir):
    """The form with a short list of names, which are compared as literals."""
    urls = rules.split_object_url(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "host")
    good, bad = rules.split_by_allowlist(urls, "host", ALLOWED)
    return good.withColumn("host_reason", F.lit("listed")).unionByName(bad)


@query("with t as (select event_id, props || ' ~*/é' || event_type as s from events) select event_id, replace(replace(url_encode(s), '+', '%20'), '%7E', '~') as query_value, replace(replace(replace(url_encode(s), '+', '%20'), '%7E', '~'), '%2F', '/') as path_value, '/?list-type=2&prefix=' || url_encode(event_type) || case when event_id % 2 = 0 then '&start-after=' || replace(replace(url_encode(s), '+', '%20'), '%7E', '~') else '' end as listing from t join events using (event_id)")
def s8_percent_encode(spark, sf_dir):
    s = F.concat("props", F.lit(" ~*/é"), "event_type")
    listing = values.listing_query(F.col("event_type"), F.when(F.col("event_id") % 2 == 0, s))
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", values.percent_encode(s).alias("query_value"), values.percent_encode(s, keep_slash=True).alias("path_value"), listing.alias("listing"))


POLL_ERRORS = "select event_id, case when event_type = 'error' then case event_id % 6 when 0 then 'HTTP' when 1 then 'timeout' when 2 then 'xml' when 3 then 'tls' when 4 then 'framing' else 'connect' end end as error, cast(400 + event_id % 200 as int) as status from "


@query(f"with p as ({POLL_ERRORS} events) select event_id, case when error is null then null when error = 'HTTP' then 'Http(' || status || ')' when error in ('connect', 'tls', 'timeout') then 'Network' when error = 'xml' then 'MalformedListing' else 'Protocol' end as error_class from p")
def c1_poll_errors(spark, sf_dir):
    df = spark.sql(POLL_ERRORS + "{events}", events=spark.read.parquet(f"{sf_dir}/events.parquet"))
    return rules.classify_poll_errors(df).select("event_id", "error_class")


@query(cte("sites") + " select name, id, not regexp_matches(id, '^[A-Za-z0-9]{4}$') as bad_id, not lat between -90 and 90 as bad_lat, not lon between -180 and 180 as bad_lon, not (elevation_m >= -100 and elevation_m < 3500) as bad_elevation, regexp_matches(id, '^[A-Za-z0-9]{4}$') and lat between -90 and 90 and lon between -180 and 180 and elevation_m >= -100 and elevation_m < 3500 as ok from sites")
def c2_check_sites(spark, sf_dir):
    return rules.check_sites(view(spark, sf_dir, "sites")).select("name", "id", "bad_id", "bad_lat", "bad_lon", "bad_elevation", "ok")


REGISTRY = ", reg as (select id, min(name) as name from sites group by id), r as (select event_id, lower(site) || lpad((event_id % 150)::varchar, 2, '0') as site_id from radials)"


@query(cte("sites", "radials") + REGISTRY + " select event_id, site_id, name from r left join reg on upper(r.site_id) = upper(reg.id)")
def j1_with_site(spark, sf_dir):
    reg = view(spark, sf_dir, "sites").groupBy("id").agg(F.min("name").alias("name"))
    r = view(spark, sf_dir, "radials").select("event_id", F.concat(F.lower("site"), _two(F.col("event_id") % 150)).alias("site_id"))
    return inspect.with_site(r, reg).select("event_id", "site_id", "name")


def _two(n):
    """At least two digits: DuckDB's and Spark's lpad both cut longer texts."""
    return F.lpad(n.cast("string"), 2, "0")


@query(cte("sites", "radials") + REGISTRY + ", f as (select distinct upper(site_id) as id from r), k as (select distinct upper(id) as id from sites) select id, 'feed_only' as side from f where id not in (select id from k) union all select id, 'registry_only' from k where id not in (select id from f)")
def j7_bucket_vs_registry(spark, sf_dir):
    r = view(spark, sf_dir, "radials").select(F.concat(F.lower("site"), _two(F.col("event_id") % 150)).alias("id"))
    return inspect.bucket_vs_registry(r, view(spark, sf_dir, "sites"))


POINTS = "select event_id, concat('S', cast(user_id % 5 as string)) as site, cast(user_id % 14 + 1 as int) as elevation_number, (event_id * 7919 % 36000) / 100e0 as azimuth_deg, (event_id * 31 % 400) / 100e0 + 1e0 as range_km from "
RADIAL_TABLE = "select site, elevation_number, radial_idx, min(azimuth_deg) as azimuth_deg from {g} group by site, elevation_number, radial_idx"
NEAREST = cte("moments") + f""", pt as ({POINTS} events), ra as ({RADIAL_TABLE.replace("{g}", "gates")}),
d as (select pt.*, ra.radial_idx, ra.azimuth_deg as radial_azimuth, abs(pt.azimuth_deg - ra.azimuth_deg) as d0, (pt.azimuth_deg - ra.azimuth_deg) - 360 * floor((pt.azimuth_deg - ra.azimuth_deg) / 360) as turn from pt join ra using (site, elevation_number)),
e as (select *, case when d0 > 180 then 360 - d0 else d0 end as distance, turn > 0 and turn < 180 as below from d),
n as (select *, row_number() over (partition by event_id order by distance, below desc, case when below then -radial_idx else radial_idx end) as rn from e where distance <= 1.0),
near as (select pt.*, n.radial_idx, n.radial_azimuth, n.distance from pt left join n on n.event_id = pt.event_id and n.rn = 1)"""


def _near(spark, sf_dir):
    points = spark.sql(POINTS + "{events}", events=spark.read.parquet(f"{sf_dir}/events.parquet"))
    radials = spark.sql(RADIAL_TABLE, g=view(spark, sf_dir, "gates"))
    return grid.nearest_radial(points, radials, ["site", "elevation_number"])


@query(NEAREST + " select event_id, radial_idx, radial_azimuth, round(distance, 6) as distance from near")
def j2_nearest_radial(spark, sf_dir):
    return _near(spark, sf_dir).select("event_id", "radial_idx", "radial_azimuth", F.round("distance", 6).alias("distance"))


GATE_AT = NEAREST + """, ga as (select near.event_id, near.radial_idx, trunc((range_km - 2.125) / 0.25)::int as gate, m.raw as gates, m.gate_count, m.scale, m.offset as off from near left join moments m on m.site = near.site and m.radial_idx = near.radial_idx and m.product = 'DREF'),
gb as (select *, case when gate >= 0 and gate < gate_count then gates[gate + 1] end as raw from ga)"""


@query(GATE_AT + " select event_id, raw, case when raw is null then 'no_data' when raw = 0 then 'below_snr' when raw = 1 then 'range_folded' else 'data' end as flag, round(case when raw >= 2 then (raw - off) / scale end, 6) as value from gb")
def j3_gate_at(spark, sf_dir):
    moments = view(spark, sf_dir, "moments").where("product = 'DREF'")
    out = grid.gate_at(_near(spark, sf_dir), moments, ["site", "radial_idx"])
    return out.select("event_id", "raw", "flag", F.round("value", 6).alias("value"))


@query(GATES + f", v as (select *, {VALUE} as value from gates) select radial_idx, product, gate_idx, {_colour_sql(REFLECTIVITY_SQL)} as rgba from v where product = 'DREF' union all select radial_idx, product, gate_idx, {_colour_sql(VELOCITY_SQL)} from v where product = 'DVEL'")
def j4_colorize(spark, sf_dir):
    flagged = gates.flag_gates(gates.calibrate(view(spark, sf_dir, "gates")))
    out = None
    for product in grid.PALETTES:
        part = grid.colorize(flagged.where(F.col("product") == product), product).select("radial_idx", "product", "gate_idx", "rgba")
        out = part if out is None else out.unionByName(part)
    return out


@query(GATES + f", v as (select *, {VALUE} as value from gates) select radial_idx, product, gate_idx, round(value, 6) as value, {_colour_sql(REFLECTIVITY_SQL)} as rgba from v where product = 'DREF' union all select radial_idx, product, gate_idx, round(value, 6), {_colour_sql(VELOCITY_SQL)} from v where product = 'DVEL'")
def g7_base_product(spark, sf_dir):
    out = None
    for product in grid.PALETTES:
        part = gates.base_product(view(spark, sf_dir, "gates"), product).select("radial_idx", "product", "gate_idx", F.round("value", 6).alias("value"), "rgba")
        out = part if out is None else out.unionByName(part)
    return out


@query(cte("moments") + """, f as (select elevation_number, product, arg_min(gate_count, radial_idx) as gates from moments group by 1, 2), n as (select elevation_number, string_agg(product || ':' || gates, ',' order by product || ':' || gates) as moments from f group by 1),
r as (select elevation_number, radial_idx, any_value(elevation_deg) as d from moments group by 1, 2) select elevation_number, round(avg(d), 6) as mean_deg, count(*) as n_radials, any_value(n.moments) as moments from r join n using (elevation_number) group by 1""")
def a1_sweep_inventory(spark, sf_dir):
    m = view(spark, sf_dir, "moments").withColumn("radial_id", F.col("radial_idx"))
    return inspect.sweep_inventory(m).withColumn("mean_deg", F.round("mean_deg", 6))


@query(cte("moments") + " select site, elevation_number, product, arg_min(gate_count, radial_idx) as gate_count, min(first_gate_m) as first_gate_m, min(gate_width_m) as gate_width_m, min(scale) as scale, min(moments.offset) as offset from moments group by 1, 2, 3")
def a3_moment_geometry(spark, sf_dir):
    return inspect.moment_geometry(view(spark, sf_dir, "moments"), ("site", "elevation_number"))


@query(GATES + f", v as (select product, elevation_number, {VALUE} as value from gates) select product, elevation_number, count(*) as n_gates, count(value) as n_valid, round(count(value) * 100.0 / count(*), 6) as valid_pct, min(value) as min_value, max(value) as max_value, round(avg(value), 6) as mean_value, round(stddev_pop(value), 6) as std_value from v group by 1, 2")
def a4_moment_stats(spark, sf_dir):
    out = inspect.moment_stats(valued(spark, sf_dir), ("product", "elevation_number"))
    return out.withColumns({c: F.round(c, 6) for c in ("valid_pct", "mean_value", "std_value")})


@query(f"with m as (select cast(event_id % 35 as int) as msg_type from events) select msg_type, count(*) as n, case when grouping(msg_type) = 1 then 'Total' else {MESSAGE_SQL.format(c='msg_type')} end as label from m group by rollup (msg_type)")
def a5_message_census(spark, sf_dir):
    return inspect.message_census(spark.read.parquet(f"{sf_dir}/events.parquet").select((F.col("event_id") % 35).cast("int").alias("msg_type")))


@query(cte("moments") + " select elevation_number, product, max((first_gate_m + gate_count * gate_width_m) / 1000.0) as max_range_km from moments group by 1, 2")
def a7_max_range(spark, sf_dir):
    return inspect.max_range(view(spark, sf_dir, "moments"))


@query(cte("cuts") + """, a as (select *, round(elevation_deg, 2) as angle, lag(round(elevation_deg, 2)) over (partition by vcp_number order by cut) as b, min(cut) over (partition by vcp_number, round(elevation_deg, 2)) as first_cut from cuts)
select vcp_number, cut, elevation_deg, waveform, angle, first_cut, coalesce(b = angle, false) as split_cut, first_cut < cut and not coalesce(b = angle, false) as inserted from a""")
def a12_repeated_cuts(spark, sf_dir):
    return inspect.repeated_cuts(view(spark, sf_dir, "cuts"))


@query(cte("radials") + " select event_id, round((10 + k) * sin(radians(azimuth_deg)), 4) as x_km, round((10 + k) * cos(radians(azimuth_deg)), 4) as y_km, round(10e0 + k, 4) as range_back from radials")
def g1_polar_xy(spark, sf_dir):
    x, y = values.polar_to_xy(F.col("azimuth_deg"), F.col("k") + 10.0)
    return view(spark, sf_dir, "radials").select("event_id", F.round(x, 4).alias("x_km"), F.round(y, 4).alias("y_km"), F.round(values.xy_to_polar(x, y)[1], 4).alias("range_back"))


PROJECT = """select *, greatest(least(sin(radians(35)) * sin(radians({lat})) + cos(radians(35)) * cos(radians({lat})) * cos(radians({lon}) - radians(-90)), 1.0), -1.0) as cc from """
XY = """case when acos(cc) < 1e-10 then 1.0 else acos(cc) / sin(acos(cc)) end * cos(radians({lat})) * sin(radians({lon}) - radians(-90)) * 6371.0"""
YX = """case when acos(cc) < 1e-10 then 1.0 else acos(cc) / sin(acos(cc)) end * (cos(radians(35)) * sin(radians({lat})) - sin(radians(35)) * cos(radians({lat})) * cos(radians({lon}) - radians(-90))) * 6371.0"""


@query(cte("paths") + f", c as ({PROJECT.format(lat='lat', lon='lon')} paths) select part_id, point_idx, round({XY.format(lat='lat', lon='lon')}, 4) as x_km, round({YX.format(lat='lat', lon='lon')}, 4) as y_km from c")
def g2_project(spark, sf_dir):
    x, y = values.project_az_eq(F.col("lat"), F.col("lon"), F.lit(35.0), F.lit(-90.0))
    return view(spark, sf_dir, "paths").select("part_id", "point_idx", F.round(x, 4).alias("x_km"), F.round(y, 4).alias("y_km"))


@query(cte("paths") + " select part_id, point_idx, lon, lat, next_lon, next_lat from (select *, lead(lon) over w as next_lon, lead(lat) over w as next_lat, lead(point_idx) over w as more from paths window w as (partition by layer, part_id order by point_idx)) where more is not null")
def w17_path_segments(spark, sf_dir):
    return grid.path_segments(view(spark, sf_dir, "paths")).drop("layer")


AT = """greatest(least(sin(radians(slat)) * sin(radians({lat})) + cos(radians(slat)) * cos(radians({lat})) * cos(radians({lon}) - radians(slon)), 1.0), -1.0)"""
EAST = """case when acos({cc}) < 1e-10 then 1.0 else acos({cc}) / sin(acos({cc})) end * cos(radians({lat})) * sin(radians({lon}) - radians(slon)) * 6371.0"""
NORTH = """case when acos({cc}) < 1e-10 then 1.0 else acos({cc}) / sin(acos({cc})) end * (cos(radians(slat)) * sin(radians({lat})) - sin(radians(slat)) * cos(radians({lat})) * cos(radians({lon}) - radians(slon))) * 6371.0"""


def _pixel(sign: str, form: str, lat: str, lon: str) -> str:
    return f"round(400 {sign} ({form.format(cc='(' + AT.format(lat=lat, lon=lon) + ')', lat=lat, lon=lon)}) * (400 / 460.0))::int"


@query(cte("paths", "sites") + f""", st as (select name as site, 28 + abs(lat) % 15 as slat, -100 + abs(lon) % 22 as slon from sites),
sg as (select * from (select *, lead(lon) over w as nlon, lead(lat) over w as nlat, lead(point_idx) over w as more from paths window w as (partition by layer, part_id order by point_idx)) where more is not null),
b as (select site, part_id, point_idx, {_pixel('+', EAST, 'lat', 'lon')} as x0, {_pixel('-', NORTH, 'lat', 'lon')} as y0, {_pixel('+', EAST, 'nlat', 'nlon')} as x1, {_pixel('-', NORTH, 'nlat', 'nlon')} as y1 from sg, st)
select * from b where not ((x0 < 0 and x1 < 0) or (x0 >= 800 and x1 >= 800) or (y0 < 0 and y1 < 0) or (y0 >= 800 and y1 >= 800))""")
def g4_project_overlay(spark, sf_dir):
    """Every station, moved to where the paths lie."""
    sites = view(spark, sf_dir, "sites").select(F.col("name").alias("site"), (28 + F.abs("lat") % 15).alias("site_lat"), (-100 + F.abs("lon") % 22).alias("site_lon"))
    return grid.project_overlay(view(spark, sf_dir, "paths"), sites, 460.0, 800).drop("layer")


PPI = cte("moments") + f""", cells as (select x, y, case when a < 0 then a + 360 else a end as azimuth_deg, r as range_km from (select x, y, degrees(atan2((x - 8) * 0.5, (8 - y) * 0.5)) as a, sqrt(((x - 8) * 0.5) ** 2 + ((8 - y) * 0.5) ** 2) as r from range(16) t(x), range(16) u(y)) where r <= 4.0),
ra as ({RADIAL_TABLE.replace("{g}", "gates")}),
d as (select c.*, ra.site, ra.elevation_number, ra.radial_idx, abs(c.azimuth_deg - ra.azimuth_deg) as d0, (c.azimuth_deg - ra.azimuth_deg) - 360 * floor((c.azimuth_deg - ra.azimuth_deg) / 360) as turn from cells c, ra),
e as (select *, case when d0 > 180 then 360 - d0 else d0 end as distance, turn > 0 and turn < 180 as below from d),
n as (select * from (select *, row_number() over (partition by site, elevation_number, x, y order by distance, below desc, case when below then -radial_idx else radial_idx end) as rn from e where distance <= 1.0) where rn = 1),
ga as (select n.*, trunc((range_km - 2.125) / 0.25)::int as gate, m.raw as gates, m.gate_count, m.scale, m.offset as off from n left join moments m on m.site = n.site and m.elevation_number = n.elevation_number and m.radial_idx = n.radial_idx and m.product = 'DREF'),
gb as (select *, case when gate >= 0 and gate < gate_count then gates[gate + 1] end as raw from ga), gv as (select *, case when raw >= 2 then (raw - off) / scale end as value from gb),
gc as (select site, elevation_number, x::int as x, y::int as y, round(value, 6) as value, {_colour_sql(REFLECTIVITY_SQL)} as rgba from gv) select * from gc where rgba <> '00000000'"""


@query(PPI)
def g3_ppi_grid(spark, sf_dir):
    out = grid.ppi_grid(spark.sql(RADIAL_TABLE, g=view(spark, sf_dir, "gates")), view(spark, sf_dir, "moments"), "DREF", 4.0, 16, ["site", "elevation_number"])
    return out.select("site", "elevation_number", "x", "y", F.round("value", 6).alias("value"), "rgba")


@query(PPI)
def g3_ppi_grid_all_sites(spark, sf_dir):
    """The former name of g3_ppi_grid, which grids all sites as well."""
    return g3_ppi_grid(spark, sf_dir)


def _larger(sql: str) -> str:
    """PPI's text for velocities on 40 x 40 cells over 6 km."""
    sql = sql.replace("(x - 8) * 0.5", "(x - 20) * 0.3").replace("(8 - y) * 0.5", "(20 - y) * 0.3").replace("range(16)", "range(40)").replace("r <= 4.0", "r <= 6.0")
    return sql.replace("m.product = 'DREF'", "m.product = 'DVEL'").replace(REFLECTIVITY_SQL, VELOCITY_SQL)


@query(_larger(PPI))
def g3_velocity_grid(spark, sf_dir):
    """Velocities of every sweep of every site, on a finer grid that reaches further."""
    out = grid.ppi_grid(spark.sql(RADIAL_TABLE, g=view(spark, sf_dir, "gates")), view(spark, sf_dir, "moments"), "DVEL", 6.0, 40, ["site", "elevation_number"])
    return out.select("site", "elevation_number", "x", "y", F.round("value", 6).alias("value"), "rgba")


BINNED = GATES + f""", v0 as (select *, round(elevation_deg, 1) as angle, {VALUE} as value, first_gate_m / 1000.0 + gate_idx * gate_width_m / 1000.0 as range_km from gates where product = 'DREF'),
v1 as (select * from v0 where (site, angle, elevation_number) in (select (site, angle, max(elevation_number)) from v0 group by site, angle)),
b as (select *, floor(azimuth_deg / 10) as az_bin, floor(range_km * cos(radians(elevation_deg)) / 1.0) as range_bin, sqrt(range_km ** 2 + (4.0 / 3.0 * 6371.0) ** 2 + 2 * range_km * (4.0 / 3.0 * 6371.0) * sin(radians(elevation_deg))) - 4.0 / 3.0 * 6371.0 + 0.1 as height_km from v1 where value is not null)"""


def binned(spark, sf_dir):
    dref = valued(spark, sf_dir).where("product = 'DREF'")
    return products.columns(products.latest_cuts(dref, ("site",)), F.lit(100.0), az_bin_deg=10.0)


@query(BINNED + " select site, az_bin::bigint as az_bin, range_bin::bigint as range_bin, round(max(height_km), 4) as echo_top_km from b where value >= 18 group by 1, 2, 3")
def g5_echo_tops(spark, sf_dir):
    return products.echo_tops(binned(spark, sf_dir), ("site",)).withColumn("echo_top_km", F.round("echo_top_km", 4))


@query(BINNED + """, l as (select site, az_bin, range_bin, elevation_number, avg(10 ** (value / 10)) as z, avg(height_km) as h from b group by 1, 2, 3, 4),
y as (select *, 3.44e-6 * ((z + lead(z) over w) / 2) ** (4.0 / 7.0) * (lead(h) over w - h) * 1000 as layer from l window w as (partition by site, az_bin, range_bin order by h, elevation_number))
select site, az_bin::bigint as az_bin, range_bin::bigint as range_bin, round(coalesce(sum(layer), 0), 4) as vil, count(*) as n_levels from y group by 1, 2, 3""")
def g6_vil(spark, sf_dir):
    return products.vil(binned(spark, sf_dir), ("site",)).withColumn("vil", F.round("vil", 4))


@query(GATES + f" select radial_idx, gate_idx, round({VALUE} - (12.0 * sin(radians(azimuth_deg)) + 5.0 * cos(radians(azimuth_deg))) * cos(radians(elevation_deg)), 4) as srv from gates where product = 'DVEL'")
def g8_storm_relative_velocity(spark, sf_dir):
    out = products.storm_relative_velocity(valued(spark, sf_dir).where("product = 'DVEL'"), 12.0, 5.0)
    return out.select("radial_idx", "gate_idx", F.round("srv", 4).alias("srv"))


@query(GATES + " select distinct elevation_number, product from gates")
def u2_distinct_products(spark, sf_dir):
    return view(spark, sf_dir, "gates").select("elevation_number", "product").distinct()


@query(cte("radials") + " select site, max(chunk_no) as newest_chunk, count(*) as n_radials from radials group by site")
def u1_l4_volume_append(spark, sf_dir):
    r = view(spark, sf_dir, "radials")
    starts, others = r.where("kind = 'S'"), r.where("kind <> 'S'")
    return starts.unionByName(others).groupBy("site").agg(F.max("chunk_no").alias("newest_chunk"), F.count("*").alias("n_radials"))
