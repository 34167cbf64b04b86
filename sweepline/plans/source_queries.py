"""Queries through the sources: chunk bytes and listings made from the driver's tables and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import gates, inspect, scan
from ..runtime import shared_path, written
from ..sources import archive, chunks, encode, listing
from .adapters import cte, view
from .registry import query

PER_CHUNK = 120


def encoded(spark, sf_dir) -> DataFrame:
    """Chunks of 120 radials each, encoded from the gates of lineitem. A radial's number is its scan time."""
    m = view(spark, sf_dir, "moments")
    each = F.struct("product", "first_gate_m", "gate_width_m", "scale", "offset", "raw")
    r = m.groupBy("site", "radial_idx").agg(F.array_sort(F.collect_list(each)).alias("moments"), F.min("azimuth_deg").alias("azimuth_deg"), F.min("elevation_deg").alias("elevation_deg"), F.min("elevation_number").alias("elevation_number"))
    number = F.floor(F.col("radial_idx") / PER_CHUNK)
    r = r.select("site", F.floor(number / 80).alias("volume_seq"), (number % 80).cast("int").alias("chunk_no"), F.col("site").alias("site_id"), F.lit(20000).alias("julian_date"), F.col("radial_idx").alias("scan_time_ms"), "azimuth_deg", "elevation_deg", F.lit(1).alias("azimuth_number"), F.lit(2).alias("azimuth_spacing_code"), F.lit(1).alias("radial_status"), "elevation_number", "moments")
    return encode.encode_chunks(r)


@query(cte("gates") + " select site, radial_idx, elevation_number, product, gate_idx, raw, scale, gates.offset as offset_value, first_gate_m, gate_width_m from gates")
def d8_decode_gates(spark, sf_dir):
    radials = chunks.radials(chunks.decode(encoded(spark, sf_dir)))
    m = radials.select("site", "scan_time_ms", "elevation_number", F.explode("moments").alias("moment")).select("site", F.col("scan_time_ms").alias("radial_idx"), "elevation_number", "moment.*")
    out = gates.explode_gates(m)
    return out.select("site", "radial_idx", "elevation_number", "product", "gate_idx", "raw", F.col("scale").cast("double").alias("scale"), F.col("offset").cast("double").alias("offset_value"), "first_gate_m", "gate_width_m")


@query(cte("gates") + " select site, radial_idx as scan_time_ms, min(azimuth_deg) as azimuth_deg, count(distinct product)::int as n_moments, 31 as msg_type from gates group by 1, 2")
def d5_d6_decode_radials(spark, sf_dir):
    decoded = chunks.decode(encoded(spark, sf_dir)).where("error is null")
    return decoded.select("site", F.col("radial.scan_time_ms").alias("scan_time_ms"), F.col("radial.azimuth_deg").cast("double").alias("azimuth_deg"), F.size("radial.moments").alias("n_moments"), "msg_type")


#: Bytes of a radial message: link header and message header, radial header, pointers, moments with a byte a gate; even, then a multiple of four.
MESSAGE_BYTES = "(28 + (32 + 4 * (3 + n_moments) + 28 * n_moments + n_gates + 1) // 2 * 2 + 3) // 4 * 4"


@query(
    cte("gates")
    + f""", r as (select site, radial_idx, count(distinct product) as n_moments, count(*) as n_gates from gates group by 1, 2),
c as (select site, floor(floor(radial_idx / {PER_CHUNK}) / 80) as volume_seq, floor(radial_idx / {PER_CHUNK}) % 80 as chunk_no, count(*) as n, sum({MESSAGE_BYTES}) as b from r group by 1, 2, 3)
select site, volume_seq::bigint as volume_seq, chunk_no::int as chunk_no, n as n_radials, null::varchar as error, b::bigint as message_bytes, true as raw_is_length from c"""
)
def a6_chunk_sizes(spark, sf_dir):
    """Bytes of the messages follow from the radials; those of the chunk are the content's own length."""
    full = written(encoded(spark, sf_dir))  # read three times, made once
    counts = chunks.decode(full).groupBy("site", "volume_seq", "chunk_no").agg(F.count("radial").alias("n_radials"))
    keys = ["site", "volume_seq", "chunk_no"]
    sizes = inspect.chunk_sizes(chunks.decompress_chunks(full)).select(*keys, "error", "message_bytes", "raw_bytes")
    lengths = full.select("site", F.col("volume_seq").cast("long").alias("volume_seq"), F.col("chunk_no").cast("int").alias("chunk_no"), F.octet_length("content").alias("length"))
    return counts.join(sizes, keys).join(lengths, keys).select(*keys, "n_radials", "error", "message_bytes", (F.col("raw_bytes") == F.col("length")).alias("raw_is_length"))


def volume_bytes(spark, sf_dir) -> DataFrame:
    """S, I and E chunks of the events' radials, with RVOL and RRAD blocks and the pattern that an S announces."""
    r = view(spark, sf_dir, "radials")
    r = r.select("site", F.col("vol_no").alias("volume_seq"), "chunk_no", "kind", F.col("site").alias("site_id"), "julian_date", F.col("event_id").alias("scan_time_ms"), "azimuth_deg", "elevation_deg", (F.col("radial_idx") + 1).alias("azimuth_number"), F.lit(2).alias("azimuth_spacing_code"), "radial_status", "elevation_number", F.lit(None).cast("array<struct<product:string>>").alias("moments"), "rvol_vcp", "latitude", "longitude", "site_amsl_m", "unamb_range", "nyquist", "msg5_vcp")
    each = F.struct(F.col("cut").alias("cut"), "elevation_deg", (F.col("cut") % 3).alias("channel_config"), "waveform", (F.col("cut") % 16).alias("super_res"))
    cuts = view(spark, sf_dir, "cuts").groupBy("vcp_number").agg(F.transform(F.array_sort(F.collect_list(each)), lambda c: F.struct(c["elevation_deg"].alias("elevation_deg"), c["channel_config"].alias("channel_config"), c["waveform"].alias("waveform"), c["super_res"].alias("super_res"))).alias("cuts"))
    said = r.where("kind = 'S' and msg5_vcp is not null").groupBy("site", "volume_seq", "chunk_no").agg(F.max("msg5_vcp").alias("vcp_number"))
    return encode.encode_chunks(r.drop("msg5_vcp"), vcps=said.join(cuts, "vcp_number"))


@query(cte("radials") + """ select site, vol_no as volume_seq, chunk_no::int as chunk_no, kind, event_id as scan_time_ms, elevation_number, case when nyquist is not null then unamb_range end as unamb_range, nyquist,
latitude, longitude, site_amsl_m, rvol_vcp as vcp_number from radials""")
def d7_site_and_radial_constants(spark, sf_dir):
    out = chunks.radials(chunks.decode(volume_bytes(spark, sf_dir)))
    p = F.col("site_parameters")
    return out.select("site", "volume_seq", "chunk_no", "kind", "scan_time_ms", "elevation_number", *[F.col(c).cast("double").alias(c) for c in ("unamb_range", "nyquist")], *[p[c].cast("double").alias(c) for c in ("latitude", "longitude")], p["site_amsl_m"].alias("site_amsl_m"), p["vcp_number"].alias("vcp_number"))


@query(cte("radials", "cuts") + """, s as (select site, vol_no, chunk_no, max(msg5_vcp) as vcp_number from radials where kind = 'S' and msg5_vcp is not null group by 1, 2, 3)
select site, vol_no as volume_seq, chunk_no::int as chunk_no, vcp_number, cut, round(round(elevation_deg * 65536 / 360) * 360 / 65536, 5) as elevation_deg, cut % 3 as channel_config, waveform, cut % 16 as super_res from s join cuts using (vcp_number)""")
def d9_decode_vcp(spark, sf_dir):
    out = chunks.vcp_cuts(chunks.vcps(chunks.decode(volume_bytes(spark, sf_dir))))
    return out.withColumn("elevation_deg", F.round(F.col("elevation_deg").cast("double"), 5))


@query("""with s as (select s_suppkey, s_name, case when s_suppkey % 4 = 3 then 'TDWR' else 'NEXRAD' end as kind, s_suppkey % 90 as lat, -(s_suppkey % 180) as lon, s_suppkey * 7 % 9000 as feet from supplier)
select to_base(s_suppkey, 36, 4) as id, s_name as name, 'ST' as state, lat + 0.25e0 as lat, lon - 0.5e0 as lon, round_even(feet * 0.3048, 0)::int as elevation_m from s where kind = 'NEXRAD'""")
def s9_station_registry(spark, sf_dir):
    """A station export made of the suppliers, written as text and read back."""
    from ..sources.registry import PLACES, read_station_registry

    s = spark.read.parquet(f"{sf_dir}/supplier.parquet")  # ids have four places, which 36 ** 4 keys fit into
    n = F.col("s_suppkey")
    values = {
        "icao": F.lpad(F.conv(n.cast("string"), 10, 36), 4, "0"), "name": F.col("s_name"), "state": F.lit("ST"), "lat": (n % 90 + 0.25).cast("string"), "lon": (-(n % 180) - 0.5).cast("string"),
        "elev_ft": (n * 7 % 9000).cast("string"), "stntype": F.when(n % 4 == 3, "TDWR").otherwise("NEXRAD"),
    }
    parts, ruler, at = [], "", 0
    for name, (a, b) in PLACES.items():
        parts += [F.lit(" " * (a - at)), F.rpad(values[name], b - a, " ")]
        ruler += " " * (a - at) + "-" * (b - a)
        at = b
    rows = s.select(F.concat(*parts).alias("value"))
    path = shared_path(spark, "stations")
    rows.unionByName(spark.createDataFrame([("the header",), (ruler,)], "value string")).write.text(path)
    return read_station_registry(spark, path)


@query(cte("radials") + " select site, strftime(ts, '%Y-%m-%d') as volume_date, event_id, elevation_number from radials")
def s10_write_table(spark, sf_dir):
    from ..sources.tables import write_table

    path = shared_path(spark, "radials")
    rows = view(spark, sf_dir, "radials").select("site", F.date_format("ts", "yyyy-MM-dd").alias("volume_date"), "event_id", "elevation_number")
    write_table(rows, path)
    return spark.read.parquet(path).select("site", F.date_format("volume_date", "yyyy-MM-dd").alias("volume_date"), "event_id", "elevation_number")


BYTES = {
    "spark": "case event_id % 6 when 0 then encode(concat('AR2V0006.', 'xxx', repeat('y', 20)), 'UTF-8') when 1 then concat(unhex('000003E8'), encode('BZh91AY', 'UTF-8')) when 2 then concat(unhex('FFFFFC18'), encode('BZh91AY', 'UTF-8')) when 3 then unhex('0000') when 4 then encode(repeat('z', 40), 'UTF-8') else concat(encode(repeat('h', 28), 'UTF-8'), encode('BZh91AY', 'UTF-8')) end",
    "duck": "case event_id % 6 when 0 then 'S' when 1 then 'I' when 2 then 'E' when 5 then 'S' end",
}


@query(f"with d as (select event_id, case event_id % 3 when 0 then 'S' when 1 then 'I' else 'E' end as kind, {BYTES['duck']} as detected from events) select event_id, kind, detected, case when event_id % 6 = 3 then 'TooShort' when event_id % 6 = 4 then 'UnrecognizedFormat' when kind <> detected then 'KindMismatch' end as error from d")
def d1_classify_chunks(spark, sf_dir):
    df = spark.sql(f"select event_id, case event_id % 3 when 0 then 'S' when 1 then 'I' else 'E' end as kind, {BYTES['spark']} as content from {{events}}", events=spark.read.parquet(f"{sf_dir}/events.parquet"))
    return chunks.check_chunk_kind(chunks.classify_chunks(df)).drop("content")


@query("select event_id, 'AR2V0006.' as file_type, lpad((event_id % 1000)::varchar, 3, '0') as extension, 19000 + event_id % 1000 as volume_date, event_id % 86400 * 1000 as volume_ms, 'K' || lpad((user_id % 1000)::varchar, 3, '0') as icao, (18999 + event_id % 1000) * 86400000 + event_id % 86400 * 1000 as volume_unix_ms from events")
def d4_volume_headers(spark, sf_dir):
    text = "select event_id, concat(encode(concat('AR2V0006.', lpad(cast(event_id % 1000 as string), 3, '0')), 'UTF-8'), unhex(lpad(hex(19000 + event_id % 1000), 8, '0')), unhex(lpad(hex(event_id % 86400 * 1000), 8, '0')), encode(concat('K', lpad(cast(user_id % 1000 as string), 3, '0')), 'UTF-8')) as content from {events}"
    out = chunks.read_volume_headers(spark.sql(text, events=spark.read.parquet(f"{sf_dir}/events.parquet")))
    return out.withColumn("volume_unix_ms", F.unix_millis("volume_ts")).drop("volume_ts")


PAGE_KEYS = 1000
LISTED = "select split_part(key, '/', 1) as site, event_id, concat(key, '&', cast(event_id as string)) as key from {keys}"


@query(cte("object_keys") + f""", l as ({LISTED.format(keys='object_keys')}), n as (select *, row_number() over (partition by site order by event_id) as n, count(*) over (partition by site) as total from l)
select site, (floor((n - 1) / {PAGE_KEYS}) + 1)::bigint as page_no, n + {PAGE_KEYS} - 1 - (n - 1) % {PAGE_KEYS} < total as is_truncated, key, null::varchar as problem from n""")
def s4_bucket_listing(spark, sf_dir):
    """Every site's keys as pages of a thousand, each but the last with a token for the next, parsed and put in order."""
    keys = spark.sql(LISTED, keys=view(spark, sf_dir, "object_keys"))
    keys = scan.numbered(keys, "n", "event_id").withColumn("page", F.floor((F.col("n") - 1) / PAGE_KEYS))
    item = F.concat(F.lit("<Contents><Key>"), F.replace("key", F.lit("&"), F.lit("&amp;")), F.lit("</Key><Size>1</Size></Contents>"))
    each = keys.groupBy("site", "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", item.alias("item")))), lambda x: x["item"]), "").alias("items"))
    last = keys.groupBy("site").agg(F.max("page").alias("last"))
    more = F.col("page") < F.col("last")
    name = lambda n: F.concat(F.lit("token/"), "site", F.lit("/"), n.cast("string"))
    head = F.concat(F.lit("<ListBucketResult><Prefix>"), "site", F.lit("/</Prefix><IsTruncated>"), more.cast("string"), F.lit("</IsTruncated>"))
    following = F.when(more, F.concat(F.lit("<NextContinuationToken>"), name(F.col("page") + 1), F.lit("</NextContinuationToken>"))).otherwise("")
    docs = each.join(last, "site").select("site", F.when(F.col("page") > 0, name(F.col("page"))).alias("token"), F.concat(head, following, "items", F.lit("</ListBucketResult>")).alias("xml"))
    pages = listing.follow_pages(listing.parse_bucket_listing(docs).drop("xml"), ("site",))
    return pages.select("site", "page_no", "is_truncated", "problem", F.explode("keys").alias("key"))


@query(cte("radials") + """, s as (select distinct site, vol_no from radials where kind = 'S')
select site, event_id as scan_time_ms, elevation_number, radial_status, rvol_vcp as vcp_number, vol_no % 2 = 1 as plain from radials join s using (site, vol_no)""")
def s1_archive_volumes(spark, sf_dir):
    """Volumes of the events' radials as one file each, read in ranges so small that every file has several tasks;
    of odd volumes the messages are not compressed."""
    made = written(volume_bytes(spark, sf_dir))
    begun = made.where("kind = 'S'").select("site", "volume_seq")
    whole = made.join(begun, ["site", "volume_seq"], "left_semi")
    out = []
    for odd in (0, 1):
        folder = shared_path(spark, "volumes")
        encode.write_volumes(whole.where(F.col("volume_seq") % 2 == odd), folder, plain=bool(odd))
        radials = chunks.radials(archive.decode_archives(archive.read_archives(spark, folder, split_bytes=6000)))
        out.append(radials.select("site_id", "scan_time_ms", "elevation_number", "radial_status", F.col("site_parameters")["vcp_number"].alias("vcp_number"), F.lit(bool(odd)).alias("plain")))
    return out[0].unionByName(out[1]).select(F.rtrim("site_id").alias("site"), "scan_time_ms", "elevation_number", "radial_status", "vcp_number", "plain")
