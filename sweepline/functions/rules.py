"""Splitting rows by rules: addresses, hosts, object keys, errors, sites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: the public buckets of the chunk feed and the archive.
ALLOWED_HOSTS = ("unidata-nexrad-level2-chunks.s3.amazonaws.com", "unidata-nexrad-level2.s3.amazonaws.com")


def split_object_url(df: DataFrame, url_col: str = "url") -> DataFrame:
    """Add host, key and reason. reason is null for a good https address, else one of http_scheme,
    missing_scheme, no_path, empty_host, empty_key (null addresses: missing_scheme)."""
    url = F.col(url_col)
    rest = F.substr(url, F.lit(9))
    slash = F.locate("/", rest)
    host, key = F.substr(rest, F.lit(1), slash - 1), F.substr(rest, slash + 1)
    reason = F.when(url.startswith("http://"), "http_scheme").when(url.isNull() | ~url.startswith("https://"), "missing_scheme").when(slash == 0, "no_path").when(slash == 1, "empty_host").when(key == "", "empty_key")
    out = df.withColumn("reason", reason)
    good = F.col("reason").isNull()
    return out.withColumns({"host": F.when(good, host), "key": F.when(good, key)})


def host_shape_reason(host: Column) -> Column:
    return F.when(host.isNull(), "missing").when(host.rlike("[@:/]"), "not_a_bare_host").when(host.endswith("."), "trailing_dot")


def host_reason(host: Column, allow) -> Column:
    return F.coalesce(host_shape_reason(host), F.when(~host.isin(*allow), "not_listed"))


def split_by_allowlist(df: DataFrame, host_col: str = "host", allow=ALLOWED_HOSTS) -> tuple[DataFrame, DataFrame]:
    """(rows whose host is listed exactly, all others with their reason)."""
    out = df.withColumn("host_reason", host_reason(F.col(host_col), allow))
    return out.where("host_reason is null").drop("host_reason"), out.where("host_reason is not null")


def split_by_allow_table(df: DataFrame, allow: DataFrame, host_col: str = "host") -> tuple[DataFrame, DataFrame]:
    """The same as split_by_allowlist, with the list as a table (its column host) of any length."""
    out = df.withColumn("host_reason", host_shape_reason(F.col(host_col)))
    bare = out.where("host_reason is null").drop("host_reason")
    listed = allow.select(F.col("host").alias("allowed_host")).distinct()
    same = F.col(host_col) == F.col("allowed_host")
    bad = out.where("host_reason is not null").unionByName(bare.join(listed, same, "left_anti").withColumn("host_reason", F.lit("not_listed")))
    return bare.join(listed, same, "left_semi"), bad


def parse_object_keys(df: DataFrame, key_col: str = "key") -> DataFrame:
    """SITE/<volume>/<yyyymmdd-hhmmss>-<n>-<kind> as columns.

    Adds site, volume_seq, chunk_ts, chunk_no, kind and reason: null, or bad_suffix (the last
    letter is none of S, I, E), bad_volume (the folder is no number), bad_name. Volumes are numbers,
    so 78 comes before 709.
    """
    key = F.col(key_col)
    shape = r"^([^/]+)/([^/]+)/(\d{8}-\d{6})-(\d+)-([SIE])$"
    part = lambda i: F.regexp_extract(key, shape, i)
    volume = F.split_part(key, F.lit("/"), F.lit(2)).try_cast("bigint")
    reason = F.when(key.isNull() | ~key.rlike("[SIE]$"), "bad_suffix").when(volume.isNull() | (volume < 0), "bad_volume").when(~key.rlike(shape), "bad_name")
    out = df.withColumn("reason", reason)
    good = F.col("reason").isNull()
    return out.withColumns({
        "site": F.when(good, part(1)), "volume_seq": F.when(good, volume), "chunk_ts": F.when(good, F.try_to_timestamp(part(3), F.lit("yyyyMMdd-HHmmss"))),
        "chunk_no": F.when(good, part(4).try_cast("int")), "kind": F.when(good, part(5)),
    })


def parse_volume_folder(prefix: Column, folder: Column) -> Column:
    """The number in 'SITE/166/' under the prefix 'SITE/'; null for anything else."""
    inner = F.when(folder.startswith(prefix) & folder.endswith("/"), F.substr(folder, F.length(prefix) + 1, F.length(folder) - F.length(prefix) - 1))
    return F.when(inner.rlike(r"^\d+$"), inner.try_cast("bigint"))


def classify_poll_errors(df: DataFrame, error_col: str = "error", status_col: str = "status") -> DataFrame:
    """Add error_class: Network, Http(status), MalformedListing or Protocol; null without an error."""
    e = F.lower(F.col(error_col))
    kind = F.when(e == "http", F.concat(F.lit("Http("), F.col(status_col).cast("string"), F.lit(")"))).when(e.isin("connect", "tls", "timeout", "closed"), "Network").when(e == "xml", "MalformedListing")
    return df.withColumn("error_class", F.when(e.isNotNull(), F.coalesce(kind, F.lit("Protocol"))))


def check_sites(sites: DataFrame) -> DataFrame:
    """Add bad_id, bad_lat, bad_lon, bad_elevation and ok for columns id, lat, lon, elevation_m."""
    bad = {"bad_id": ~F.col("id").rlike("^[A-Za-z0-9]{4}$"), "bad_lat": ~F.col("lat").between(-90, 90), "bad_lon": ~F.col("lon").between(-180, 180), "bad_elevation": ~((F.col("elevation_m") >= -100) & (F.col("elevation_m") < 3500))}
    out = sites.withColumns({k: F.coalesce(v, F.lit(True)) for k, v in bad.items()})
    return out.withColumn("ok", ~(F.col("bad_id") | F.col("bad_lat") | F.col("bad_lon") | F.col("bad_elevation")))


def split_good_bad(df: DataFrame, error_col: str = "error") -> tuple[DataFrame, DataFrame]:
    """(rows without an error, rows with one)."""
    return df.where(F.col(error_col).isNull()).drop(error_col), df.where(F.col(error_col).isNotNull())
