"""What several operators share: word rule, streaming over sorted groups, joins on hot keys."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import map_arrow

#: A word is a run of anything but the space and the five ASCII controls tab to carriage return.
WORD = re.compile(r"[^\x20\x09-\x0D]+")
WORD_SQL = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id's decimal text, modulo n. A null id has no remainder and gives null."""
    return F.crc32(doc_id.cast("string")) % n


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Consecutive rows with equal keys, one table per run, from batches sorted by the keys."""
    import numpy as np

    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        cols = [batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in keys]
        new = np.zeros(n, dtype=bool)
        for c in cols:
            new[1:] |= c[1:] != c[:-1]
        starts = np.concatenate([[0], np.flatnonzero(new), [n]])
        if held and tuple(c[0] for c in cols) != last:
            yield pa.Table.from_batches(held)
            held = []
        for a, b in zip(starts[:-1], starts[1:], strict=True):
            if a and held:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
        last = tuple(c[-1] for c in cols)
    if held:
        yield pa.Table.from_batches(held)


def by_blocks(df: DataFrame, keys: list[str], fn: Callable[[pa.Table], dict | None], schema: str, least: int = 2) -> DataFrame:
    """Run fn once per group of at least `least` rows, streaming over partitions sorted by the keys.

    Meant for very many small groups of bounded size: one shuffle, one Python pass, and results
    of many groups leave in one Arrow batch. fn returns columns by name, or None.
    """
    names = [x.split()[0] for x in schema.split(",")]

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: dict[str, list] = {k: [] for k in names}
        held = 0
        for group in runs(batches, keys):
            if group.num_rows < least:
                continue
            got = fn(group)
            if got is None:
                continue
            held += len(got[names[0]])
            for k in names:
                out[k].extend(got[k])
            if held >= 20_000:
                yield pa.RecordBatch.from_pydict(out)
                out, held = {k: [] for k in names}, 0
        if held:
            yield pa.RecordBatch.from_pydict(out)

    return map_arrow(df.repartition(*keys).sortWithinPartitions(*keys), stream, schema)


def join_keyed(big: DataFrame, small: DataFrame, key: str, n: str, total: int, hot_share: int = 10_000) -> DataFrame:
    """big joined with small on key, where small holds every key of big at most once, and in column n how often.

    Keys with more than a hot_share-th of all `total` rows number less than hot_share, whatever the
    input: they are broadcast, so that no task gets all rows of one. The others meet by a shuffle,
    which is asked for: Spark takes what explode() or a Python pass makes for hardly larger than
    what it was made of, and would send it whole through the driver.
    """
    hot = F.col(n) > total / hot_share
    if total <= hot_share:
        return big.join(small.drop(n), key)
    few = F.broadcast(small.where(hot).drop(n))
    rest = big.join(few.select(key), key, "left_anti").join(small.where(~hot).drop(n).hint("merge"), key)
    return big.join(few, key).unionByName(rest)


def salted_blocks(df: DataFrame, keys: list[str], item: Column, pieces: Column) -> DataFrame:
    """Deal a group out to blocks of bounded size that together meet every pair once.

    A group cut into k pieces gives k(k+1)/2 blocks, one for each pair of pieces. Rows go to k
    blocks; columns piece, block_a and block_b tell where each pair is to be counted: in a block
    with a <> b only pairs across the two pieces, in a block with a = b all of its pairs.
    """
    k = F.greatest(pieces.cast("int"), F.lit(1))
    out = df.withColumn("piece_count", k).withColumn("piece", F.pmod(F.xxhash64(item), F.col("piece_count")).cast("int"))
    out = out.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("piece_count") - 1)))
    return out.withColumns({"block_a": F.least("piece", "other"), "block_b": F.greatest("piece", "other")}).drop("other", "piece_count")
