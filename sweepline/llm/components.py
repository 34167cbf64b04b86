"""Connected components by alternating large-star and small-star steps on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import prepare
from .common import join_keyed


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.min("b").alias("low"), F.count("*").alias("n")).select("a", F.least("a", "low").alias("low"), "n")
    return join_keyed(both, low, "a", "n", 2 * total).where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()


def _small_star(edges: DataFrame, total: int) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = down.groupBy("a").agg(F.min("b").alias("low"), F.count("*").alias("n"))
    moved = join_keyed(down, low, "a", "n", total).where("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
    return moved.union(low.select("a", F.col("low").alias("b"))).distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node with an edge; component is the smallest node it reaches.

    edges: columns a, b (long). Loops and repeated edges do no harm, rows with a null end are
    ignored, an empty table gives an empty one. Each round cuts its lineage with checkpoint(), so
    a lost executor costs no more than a round. Links stay on the executors; the driver sees one
    count and one checksum per round. A node with very many links is no hot key: see join_keyed().
    """
    prepare(edges.sparkSession)
    now = edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b").distinct().checkpoint()
    seen, total = None, now.count()
    for _ in range(max_rounds):
        # both steps yield no more edges than they get
        now = _small_star(_large_star(now, total), total).checkpoint()
        mark = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if mark == seen:
            break
        seen, total = mark, mark[0]
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
