"""Mixes sources to target weights by a low-discrepancy schedule of equal-token blocks.

The points of the golden-ratio sequence, mapped through the cumulative shares of the sources, say
which source fills each slot of the mix; slots are numbered within their source. The documents of
a source, in a shuffled order, form a stream cut into blocks of equal token counts; the n-th slot
of a source takes its n-th block, starting over at the end. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import prepare
from .common import WORD_SQL

GOLDEN = 0.6180339887498949
CHUNK_BITS = 12  # of the shuffle key: prefix sums run within a source's 4096 chunks, then over them


def size_of(text: Column) -> Column:
    """Words of a text; 0 for a null one."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_SQL)), F.lit(0)).cast("long")


def targets(sources: DataFrame, most_passes: int = 3, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """(source, source_size) -> also weight and target. One row a source, none of them null.

    Sources by code point weigh as `weights` say, over and over. They share the sum of all sizes;
    no target exceeds most_passes times its source, and what is left over is shared again by
    weight: all sources below their cap end at one common level of target by weight, so those
    whose cap lies below that level, in ascending order of cap by weight, are full.
    """
    named = Window.orderBy("source")
    cyc = F.array(*[F.lit(w) for w in weights])
    s = sources.withColumn("weight", F.element_at(cyc, ((F.row_number().over(named) - 1) % len(weights) + 1).cast("int")))
    s = s.withColumn("cap", F.lit(most_passes) * F.col("source_size")).withColumn("ratio", F.col("cap") / F.col("weight"))
    up = Window.orderBy("ratio", "source")
    before = up.rowsBetween(Window.unboundedPreceding, -1)
    rest = up.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = s.withColumn("level", (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("weight").over(rest))
    # full ones come first; the level of the first that is not full is that of all after it
    whole = up.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = s.withColumn("common", F.first(F.when(F.col("ratio") > F.col("level"), F.col("level")), ignorenulls=True).over(whole))
    full = F.col("common").isNull() | (F.col("ratio") <= F.col("common"))
    return s.select("source", "source_size", "weight", F.when(full, F.col("cap").cast("double")).otherwise(F.col("weight") * F.col("common")).alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block_tokens: int = 1024, seed: int = 11, most_passes: int = 3) -> DataFrame:
    """One row per input row: doc_id, size, source, source_size, target, taken.

    taken is the number of the row's words in the mix, repeats counted, never more than
    most_passes times its size; a source's taken words add up to its target rounded. Null and empty
    texts have size 0 and are never taken. A null source is one source, weighed last. Ties in the
    shuffled order are rows with equal ids, which are ordered by size; equal rows are
    interchangeable. Reruns agree. Other columns are not read; an empty table gives no rows.

    Prefix sums run within small chunks of the shuffled order and over the chunks' sums, so no task
    holds a source. The table of sources is small: one row each.
    """
    prepare(docs.sparkSession)
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))))
    # a key that is never null and sorts as sources do, with the null source last
    source = F.coalesce(F.concat(F.lit("0"), F.col(source_col).cast("string")), F.lit("1"))
    rows = docs.select(F.col(id_col).alias("doc_id"), source.alias("source"), size_of(F.col(text_col)).alias("size"), order.alias("key"))
    rows = rows.withColumn("chunk", F.substring("key", 1, CHUNK_BITS // 4)).checkpoint()

    chunks = rows.groupBy("source", "chunk").agg(F.sum("size").alias("chunk_size"))
    by_source = Window.partitionBy("source").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = chunks.withColumn("chunk_start", F.coalesce(F.sum("chunk_size").over(by_source), F.lit(0)))
    plan = targets(chunks.groupBy("source").agg(F.sum("chunk_size").alias("source_size")), most_passes)
    # words beyond whole passes come from the stream's first blocks; the last slot takes a part of its block
    plan = plan.withColumn("goal", F.round("target").cast("long")).withColumn("blocks", F.ceil(F.col("source_size") / block_tokens))
    size1 = F.greatest("source_size", F.lit(1))
    plan = plan.withColumn("passes", F.floor(F.col("goal") / size1)).withColumn("part", F.col("goal") - F.col("passes") * F.col("source_size"))
    plan = plan.withColumn("quota", F.col("passes") * F.col("blocks") + F.ceil(F.col("part") / block_tokens)).checkpoint()

    block = F.col("rank") % F.col("blocks")
    last = (F.col("rank") >= F.col("passes") * F.col("blocks")) & ((block + 1) * block_tokens > F.col("part"))
    words = F.when(last, F.col("part") - block * block_tokens).otherwise(F.lit(block_tokens))
    # of each block: how many of its first words are taken each time (most_passes times at most)
    blocks = schedule(plan).join(plan.select("source", "blocks", "passes", "part"), "source").select("source", block.alias("block"), words.alias("words"))
    blocks = blocks.groupBy("source", "block").agg(F.collect_list("words").alias("prefixes"))

    within = Window.partitionBy("source", "chunk").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("offset", F.coalesce(F.sum("size").over(within), F.lit(0))).join(chunks.select("source", "chunk", "chunk_start"), ["source", "chunk"])
    placed = placed.select("doc_id", "source", "size", (F.col("chunk_start") + F.col("offset")).alias("start"))
    first, final = F.floor(F.col("start") / block_tokens), F.floor((F.col("start") + F.greatest("size", F.lit(1)) - 1) / block_tokens)
    pieces = placed.withColumn("block", F.explode(F.sequence(first, final))).join(blocks, ["source", "block"], "left")
    low = F.greatest(F.col("start") - F.col("block") * block_tokens, F.lit(0))
    high = F.least(F.col("start") + F.col("size") - F.col("block") * block_tokens, F.lit(block_tokens))
    none = F.array().cast("array<long>")
    got = F.aggregate(F.coalesce("prefixes", none), F.lit(0).cast("long"), lambda s, p: s + F.greatest(F.least(p, high) - low, F.lit(0)).cast("long"))
    summed = pieces.select("doc_id", "source", "size", "start", got.alias("got")).groupBy("doc_id", "source", "size", "start").agg(F.sum("got").alias("taken"), F.count("*").alias("parts"))
    # rows of size 0 share their start with rows equal to them: they were summed into one, with a part each
    summed = summed.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.when(F.col("size") == 0, F.col("parts")).otherwise(F.lit(1)))))
    named = F.when(F.col("source") != "1", F.substr("source", F.lit(2)))
    return summed.join(plan.select("source", "source_size", "target"), "source").select("doc_id", "size", named.alias("source"), "source_size", "target", "taken")


def schedule(plan: DataFrame) -> DataFrame:
    """(source, rank, slot): which source fills each slot of the mix, slots numbered per source.

    plan: source (not null) and quota, the number of slots that it is to get. As many points are
    laid out as there are slots; a source that the points give more than its quota loses its last
    ones, and one that they give fewer (by the sequence's small discrepancy) gets closing slots.
    """
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by_name = Window.orderBy("source")
    shares = plan.where("quota > 0").select("source", "quota", (F.sum("quota").over(by_name.rowsBetween(Window.unboundedPreceding, 0)) / F.sum("quota").over(everything)).alias("to"))
    shares = shares.withColumn("from", F.coalesce(F.lag("to").over(by_name), F.lit(0.0)))
    n = int(shares.agg(F.coalesce(F.sum("quota"), F.lit(0))).first()[0])
    # points meet the shares cell by cell: an equi-join, then the exact bounds
    grid = 1024
    spread = shares.withColumn("cell", F.explode(F.sequence(F.floor(F.col("from") * grid), F.floor(F.least(F.col("to"), F.lit(1 - 1e-12)) * grid))))
    points = plan.sparkSession.range(n).select(F.col("id").alias("slot"), ((F.col("id") + 0.5) * GOLDEN % 1.0).alias("x")).withColumn("cell", F.floor(F.col("x") * grid))
    filled = points.join(spread, "cell").where("x >= `from` and x < `to`").select("slot", "source", "quota", F.shiftright("slot", 12).alias("chunk"))
    counts = filled.groupBy("source", "chunk").agg(F.count("*").alias("n"))
    before = Window.partitionBy("source").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    place = F.row_number().over(Window.partitionBy("source", "chunk").orderBy("slot")) - 1
    ranked = filled.withColumn("place", place).join(counts.select("source", "chunk", "before"), ["source", "chunk"])
    ranked = ranked.select("source", (F.col("before") + F.col("place")).alias("rank"), "slot", "quota").where("rank < quota").drop("quota")
    have = counts.groupBy("source").agg(F.sum("n").alias("have"))
    short = shares.select("source", "quota").join(have, "source", "left").withColumn("have", F.coalesce("have", F.lit(0))).where("have < quota")
    closing = short.select("source", F.explode(F.sequence(F.col("have"), F.col("quota") - 1)).alias("rank"), F.lit(n).cast("long").alias("slot"))
    return ranked.unionByName(closing)
