"""Radar-shaped tables made from the driver's tables, as SQL that Spark and DuckDB both run.

Each text names its inputs in braces. view() runs it in Spark; cte() gives it for an oracle text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import scan

VCP_OF = "case vol_no % 3 when 0 then 35 when 1 then 212 else 121 end"
TEXTS = {
    "radials": f"""
with e as (select event_id, ts, user_id % 10 as site_no, event_type, value, {{k}} as k, {{seq}} - 1 as seq from {{events}}),
c as (select *, cast(floor(seq / 12) as bigint) as chunk_no, cast(seq % 12 as int) as radial_idx from e),
v as (select *, cast(floor(chunk_no / 8) as bigint) as vol_no, cast(chunk_no % 8 as int) as pos8 from c)
select concat('S', cast(site_no as string)) as site, chunk_no, radial_idx, event_id, ts, value, k, vol_no,
  case when pos8 = 0 and vol_no % 5 <> 3 then 'S' when pos8 = 7 and vol_no % 5 <> 4 then 'E' else 'I' end as kind,
  case when event_type = 'signup' and value > 100 then 1 else 1 + cast(floor((pos8 * 12 + radial_idx) / 20) as int) end as elevation_number,
  case when pos8 = 7 and radial_idx = 11 then 4 when (pos8 * 12 + radial_idx) % 20 = 19 and value <= 60 then 2 else 1 end as radial_status,
  k * 3.6e0 as azimuth_deg, 0.5e0 * (pos8 + 1) + 0.01e0 * (k % 3) as elevation_deg,
  case when k % 7 = 0 then null else 8e0 + k % 5 end as nyquist, 300e0 + k % 2 as unamb_range,
  cast(20000 + vol_no as int) as julian_date, cast(k * 1000 + radial_idx as bigint) as scan_time_ms,
  case when k % 4 = 0 then null else {VCP_OF} end as rvol_vcp,
  case when k % 4 = 0 then null else 30e0 + site_no end as latitude, case when k % 4 = 0 then null else -90e0 - site_no end as longitude,
  case when k % 4 = 0 then null else cast(k as int) end as site_amsl_m,
  case when pos8 = 0 and vol_no % 2 = 0 then {VCP_OF} end as msg5_vcp
from v""",
    "chunks": "select site, chunk_no, min(kind) as kind, max(ts) as arrival, max(msg5_vcp) as vcp from {radials} group by site, chunk_no",
    "gates": """
with l as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, case l_partkey % 3 when 0 then 'DREF' when 1 then 'DVEL' else 'DZDR' end as product,
  case when l_quantity = 1 then cast(l_partkey % 2 as int) else cast(l_quantity * 5 as int) end as raw from {lineitem})
select concat('S', cast(l_orderkey % 5 as string)) as site, l_orderkey as radial_idx, product,
  cast(row_number() over (partition by l_orderkey, product order by l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) - 1 as int) as gate_idx, raw,
  cast(l_orderkey % 14 + 1 as int) as elevation_number, 0.5e0 + 0.9e0 * (l_orderkey % 14) as elevation_deg, l_orderkey % 720 * 0.5e0 as azimuth_deg,
  case product when 'DZDR' then 32e0 else 2e0 end as scale, case product when 'DREF' then 66e0 when 'DVEL' then 129e0 else 418e0 end as offset,
  2125 as first_gate_m, 250 as gate_width_m
from l""",
    "moments": """
select site, radial_idx, product, min(elevation_number) as elevation_number, min(elevation_deg) as elevation_deg, min(azimuth_deg) as azimuth_deg, cast(count(*) as int) as gate_count,
  min(scale) as scale, min(g.offset) as offset, min(first_gate_m) as first_gate_m, min(gate_width_m) as gate_width_m, {raws} as raw from {gates} g group by site, radial_idx, product""",
    "polls": """
select concat('S', cast(user_id % 10 as string)) as site, {seq} as seq, ts as polled_at, event_type = 'error' as is_error,
  event_type = 'signup' and value > 200 as reanchored, case when event_type in ('click', 'purchase') and value > 40 then 1 else 0 end as n_keys,
  case when event_id % 4 = 0 then cast(user_id % 10 * 100 + event_id % 50 as bigint) end as newest, cast(user_id % 10 * 100 as bigint) as start, event_id, value, event_type
from {events}""",
    "folders": "select distinct concat('S', cast(user_id % 10 as string)) as site, cast({k} * 3 + user_id % 2 as bigint) as volume_seq from {events}",
    "object_keys": """
select event_id, case when event_id % 11 = 0 then concat('KDOX/', event_type, '/20260728-095259-001-S') when event_id % 13 = 0 then concat('KDOX/', cast({k} as string), '/20260728-095259-001-X')
  else concat('K', upper(substring(event_type, 1, 3)), '/', cast({k} as string), '/20260728-0', cast(event_id % 10 as string), '5259-', lpad(cast(event_id % 100 as string), 3, '0'), '-', case event_id % 3 when 0 then 'S' when 1 then 'I' else 'E' end) end as key
from {events}""",
    "sites": """
select concat('S', cast(s_suppkey % 10 as string), case when s_suppkey % 17 = 0 then '-' else '' end, case when s_suppkey < 10 then '' else lpad(cast(s_suppkey % 100 as string), 2, '0') end) as id,
  s_name as name, (s_suppkey * 7 % 190) - 95e0 as lat, (s_suppkey * 13 % 370) - 185e0 as lon, cast(s_suppkey * 31 % 3700 - 120 as int) as elevation_m from {supplier}""",
    "cuts": """
select distinct cast(case l_suppkey % 3 when 0 then 35 when 1 then 212 else 121 end as int) as vcp_number, cast(l_linenumber as int) as cut,
  case when l_linenumber in (1, 2, 5) then 0.5e0 else 0.5e0 * l_linenumber end as elevation_deg, cast(l_linenumber % 5 + 1 as int) as waveform from {lineitem}""",
    "paths": """
select cast(c_nationkey as int) as part_id, 'layer' as layer, cast(row_number() over (partition by c_nationkey order by c_custkey) as int) as point_idx,
  -100e0 + c_custkey % 40 * 0.5e0 as lon, 30e0 + c_custkey % 23 * 0.5e0 as lat from {customer}""",
}
#: seq numbers the events of a site; numbered_events() adds it for Spark, without a window over a whole site.
SPARK = {"seq": "seq", "k": "cast(get_json_object(props, '$.k') as int)", "raws": "transform(array_sort(collect_list(struct(gate_idx, raw))), x -> x.raw)"}
DUCK = {"seq": "row_number() over (partition by user_id % 10 order by event_id)", "k": "cast(json_extract_string(props, '$.k') as int)", "raws": "list(raw order by gate_idx)"}
NEEDS = {"chunks": ("radials",), "moments": ("gates",)}
TABLES = ("events", "lineitem", "supplier", "customer", "pages")


def numbered_events(events: DataFrame) -> DataFrame:
    return scan.numbered(events.withColumn("site_no", F.col("user_id") % 10), "seq", "event_id", by=("site_no",)).drop("site_no")


def view(spark: SparkSession, sf_dir: str, name: str, **made: DataFrame) -> DataFrame:
    """The named table; made: tables that it needs and that are at hand."""
    text = TEXTS[name]
    given = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if f"{{{t}}}" in text}
    if "{seq}" in text:
        given["events"] = numbered_events(given["events"])
    given |= {t: made[t] if t in made else view(spark, sf_dir, t) for t in NEEDS.get(name, ())}
    for key, part in SPARK.items():
        text = text.replace(f"{{{key}}}", part)
    return spark.sql(text, **given)


def cte(*names: str) -> str:
    """'with recursive a as (...), b as (...)' for DuckDB, with what the names need before them."""
    order: list[str] = []
    for n in names:
        order += [x for x in (*NEEDS.get(n, ()), n) if x not in order]
    out = []
    for n in order:
        text = TEXTS[n]
        for key in (*TABLES, *NEEDS.get(n, ())):
            text = text.replace(f"{{{key}}}", key)
        for key, part in DUCK.items():
            text = text.replace(f"{{{key}}}", part)
        out.append(f"{n} as ({text})")
    return "with " + ",\n".join(out)
