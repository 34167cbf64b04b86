"""Bucket listings in XML, page by page."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import written

SCHEMA = "IsTruncated string, NextContinuationToken string, Prefix string, Contents array<struct<Key string>>, CommonPrefixes array<struct<Prefix string>>, _bad string"


def parse_bucket_listing(df: DataFrame, xml_col: str = "xml") -> DataFrame:
    """Add keys, folders, is_truncated, next_token and malformed.

    The request's own Prefix at the top is no folder. A document that is no well-formed XML, as with
    an unknown entity, is malformed and has empty lists.
    """
    body = F.regexp_replace(F.col(xml_col), r"<\?xml[^>]*\?>|\sxmlns=\"[^\"]*\"", "")
    unknown = body.rlike(r"&(?!(amp|lt|gt|apos|quot|#[0-9]+|#x[0-9A-Fa-f]+);)")
    parsed = F.from_xml(body, SCHEMA, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    out = df.withColumn("listing", parsed)
    bad = unknown | F.col("listing").isNull() | F.col("listing._bad").isNotNull()
    none = F.array().cast("array<string>")
    part = lambda path: F.when(F.col("malformed"), none).otherwise(F.coalesce(F.col(path), none))
    out = out.withColumn("malformed", F.coalesce(bad, F.lit(True)))
    return out.withColumns({
        "keys": part("listing.Contents.Key"), "folders": part("listing.CommonPrefixes.Prefix"),
        "is_truncated": ~F.col("malformed") & F.coalesce(F.col("listing.IsTruncated") == "true", F.lit(False)), "next_token": F.when(~F.col("malformed"), F.col("listing.NextContinuationToken")),
    }).drop("listing")


def follow_pages(pages: DataFrame, by: tuple[str, ...] = ("listing",)) -> DataFrame:
    """Put the pages of listings in order by their tokens: adds page_no and problem.

    pages: `by` (the listing), token (that the page was asked for with; null for the first page),
    and what parse_bucket_listing() adds. A truncated page goes on with the page asked for with its
    next_token; another one ends its listing, whatever token it has. page_no counts from 1; it is
    null for pages that no chain reaches. problem: malformed, no_token (truncated without a token),
    next_missing (no page has its token), unreached; null where all is well. Pages of one listing
    with equal tokens share a number.

    Pages point to the one before them; each round doubles how far they point, so a listing of n
    pages takes about log2 n joins on (listing, token), and a ring of tokens ends as unreached.
    """
    here = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(f"_b{i}") for i, c in enumerate(by)]
    names = [f"_b{i}" for i in range(len(by))]
    key = F.coalesce(F.concat(F.lit("t"), F.col("token")), F.lit("first"))
    rows = pages.withColumns({"_key": key, "_next": F.when(~F.col("malformed") & F.col("is_truncated"), F.concat(F.lit("t"), F.col("next_token")))})
    links = written(rows.select(*here, "_key", "_next").distinct())
    before = links.where("_next is not null").groupBy(*names, F.col("_next").alias("_key")).agg(F.min("_key").alias("_to"))
    first = F.col("_key") == "first"
    steps = links.select(*names, "_key").distinct().join(before, [*names, "_key"], "left")
    steps = written(steps.select(*names, "_key", F.when(first, F.col("_key")).otherwise(F.col("_to")).alias("_to"), F.when(first, 0).otherwise(1).cast("long").alias("_steps")))
    left, rounds = steps.count(), 0
    while left >> rounds:  # no chain is longer than there are pages
        back = steps.select(*names, F.col("_key").alias("_to"), F.col("_to").alias("_to2"), F.col("_steps").alias("_more"))
        steps = written(steps.join(back, [*names, "_to"], "left").select(*names, "_key", F.col("_to2").alias("_to"), (F.col("_steps") + F.col("_more")).alias("_steps")))
        rounds += 1
        if steps.where("_to is not null and _to <> 'first'").isEmpty():
            break
    number = steps.select(*names, "_key", F.when(F.col("_to") == "first", F.col("_steps") + 1).alias("page_no"))
    known = links.select(*names, F.col("_key").alias("_next"), F.lit(True).alias("_known")).distinct()
    out = rows.withColumns({f"_b{i}": F.coalesce(F.col(c).cast("string"), F.lit("")) for i, c in enumerate(by)}).join(number, [*names, "_key"]).join(known, [*names, "_next"], "left")
    problem = F.when(F.col("page_no").isNull(), "unreached").when(F.col("malformed"), "malformed").when(F.col("is_truncated") & F.col("_next").isNull(), "no_token").when(F.col("is_truncated") & F.col("_known").isNull(), "next_missing")
    return out.select(*pages.columns, "page_no", problem.alias("problem"))
