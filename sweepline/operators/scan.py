"""Running values over a site's whole history, without one task that holds or streams that history.

The history is cut into blocks of consecutive order numbers. A block's rows meet in one task, which
computes what the block alone can tell, and a summary row. Summaries, a few thousandths of the rows,
are scanned in order per site; what came before a block (and what follows it) then comes back to
its rows by a join on site and block. Rows are shuffled once, by site and block.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

#: Order numbers to a block. Order columns count rows of a site, if with gaps.
BLOCK = 4096


def cut(df: DataFrame, order: str, block_rows: int | None = None) -> DataFrame:
    """Add block, the number of the row's block within its site."""
    return df.withColumn("block", F.floor(F.col(order) / (block_rows or BLOCK)))


def inside(*order: str | Column, by: tuple[str, ...] = ("site",)) -> WindowSpec:
    return Window.partitionBy(*by, "block").orderBy(*order)


def upto(w: WindowSpec) -> WindowSpec:
    """The rows so far, this one included."""
    return w.rowsBetween(Window.unboundedPreceding, 0)


def earlier(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding, -1)


def carry(df: DataFrame, summary: list[Column], carried: Callable[[DataFrame, WindowSpec], DataFrame], by: tuple[str, ...] = ("site",)) -> DataFrame:
    """Rows of df (with block) and, for each, what `carried` tells about its block.

    summary: aggregates over a block. carried takes the summaries and a window over a site's blocks in order, and returns
    them with the columns to bring back; columns of the summary itself stay behind.
    """
    blocks = df.groupBy(*by, "block").agg(*summary)
    told = carried(blocks, Window.partitionBy(*by).orderBy("block"))
    mine = [c for c in told.columns if c not in blocks.columns]
    on = None
    told = told.select(*[F.col(c).alias(f"_{c}") for c in (*by, "block")], *mine)
    for c in (*by, "block"):
        same = F.col(c).eqNullSafe(F.col(f"_{c}"))
        on = same if on is None else on & same
    return df.join(told, on).drop(*[f"_{c}" for c in (*by, "block")])


def numbered(df: DataFrame, name: str, order: str, *then: str | Column, by: tuple[str, ...] = ("site",), block_rows: int | None = None) -> DataFrame:
    """Add `name`, the row's place among those of its site by order, then by the other columns; from 1."""
    rows = cut(df, order, block_rows).withColumn("place_in_block", F.row_number().over(inside(order, *then, by=by)))
    rows = carry(rows, [F.count("*").alias("n_rows")], lambda b, w: b.withColumn("rows_before", F.coalesce(F.sum("n_rows").over(earlier(w)), F.lit(0))), by)
    return rows.withColumn(name, (F.col("rows_before") + F.col("place_in_block")).cast("int")).drop("rows_before", "place_in_block", "block")


def neighbours(df: DataFrame, value: Column, order: str, by: tuple[str, ...] = ("site",), block_rows: int | None = None) -> DataFrame:
    """Add before and after: value (never null) of the row before and of the row after, null at the ends."""
    w = inside(order, by=by)
    rows = cut(df, order, block_rows).withColumns({"before": F.lag(value).over(w), "after": F.lead(value).over(w)})
    summary = [F.min_by(value, order).alias("first_one"), F.max_by(value, order).alias("last_one")]
    rows = carry(rows, summary, lambda b, w: b.withColumns({"block_before": F.lag("last_one").over(w), "block_after": F.lead("first_one").over(w)}), by)
    return rows.withColumns({"before": F.coalesce("before", "block_before"), "after": F.coalesce("after", "block_after")}).drop("block_before", "block_after", "block")


def streak(df: DataFrame, hit: Column, order: str, by: tuple[str, ...] = ("site",), block_rows: int | None = None) -> DataFrame:
    """Add streak, how many rows in a row up to here are hits (0 on a miss), and missed, whether a miss came so far.

    It is the number of hits so far less that at the last miss, and both come in blocks.
    """
    so_far = upto(inside(order, by=by))
    rows = cut(df, order, block_rows).withColumn("_hits", F.sum(hit.cast("int")).over(so_far))
    rows = rows.withColumn("_at_miss", F.max(F.when(~hit, F.col("_hits"))).over(so_far))

    def carried(blocks: DataFrame, w: WindowSpec) -> DataFrame:
        out = blocks.withColumn("_hits_before", F.coalesce(F.sum("hits").over(earlier(w)), F.lit(0)))
        return out.withColumn("_at_miss_before", F.max(F.col("_hits_before") + F.col("at_miss")).over(earlier(w)))

    rows = carry(rows, [F.max("_hits").alias("hits"), F.max("_at_miss").alias("at_miss")], carried, by)
    last = F.coalesce(F.col("_hits_before") + F.col("_at_miss"), F.col("_at_miss_before"))
    return rows.select(*df.columns, (F.col("_hits_before") + F.col("_hits") - F.coalesce(last, F.lit(0))).alias("streak"), last.isNotNull().alias("missed"))
