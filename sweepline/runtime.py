"""What every part needs of the session: workers that can import the package, and the shared folder."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that a task's Parquet writer gathers before it writes them out: a small part of an executor's heap.
ROW_GROUP = 16 << 20
#: Most rows that are broadcast where their number was counted before: some 100 MB at most.
FEW_ROWS = 1_000_000


def prepare(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package, and see that checkpoint() has a folder.

    The folder is the one named by spark.checkpoint.dir. Only where that is unset (tests, a
    notebook) and no other was set does the session get a temporary one of its own.
    """
    sc = spark.sparkContext
    root = str(Path(__file__).resolve().parents[1])
    paths = [p for p in sc.environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        sc.environment["PYTHONPATH"] = os.pathsep.join([root, *paths])
    if not sc.getConf().get("spark.checkpoint.dir") and sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="sweepline-"))
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors see, as a full address.

    A folder without a scheme lies where Spark itself would look for it: in the default file system.
    """
    prepare(spark)
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc._jsc.sc().getCheckpointDir().get()
    path = sc._jvm.org.apache.hadoop.fs.Path(named)
    full = path.getFileSystem(sc._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return re.sub(r"^file:/(?!/)", "file:///", full)


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh address in the shared folder; what is written there is deleted when the session's driver ends."""
    full = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(full)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    return full


def delete(spark: SparkSession, address: str) -> None:
    """Delete a table of the shared folder that nothing reads any more."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(address)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame) -> DataFrame:
    """The rows, written to the shared folder as a table and read back: lineage ends here, as with checkpoint()."""
    path = shared_path(df.sparkSession, "table")
    df.write.option("parquet.block.size", ROW_GROUP).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def map_arrow(df: DataFrame, fn, schema) -> DataFrame:
    """mapInArrow with the package importable in the workers."""
    prepare(df.sparkSession)
    return df.mapInArrow(fn, schema)


def few(df: DataFrame, rows: int, most: int = FEW_ROWS) -> DataFrame:
    """The table, broadcast where its counted rows are few; else Spark chooses the join."""
    return F.broadcast(df) if rows <= most else df


def sample_grains(share: Column | float, grains: int) -> Column:
    share = F.lit(float(share)) if isinstance(share, int | float) else share
    return F.greatest(F.lit(1), F.round(share * grains).cast("long"))


def sampled(share: Column | float, *keys: str, grain_bits: int = 40) -> Column:
    """Whether a row is in a sample of about this share, by a hash of its keys.

    The grain of 2^-40 leaves a sample of thousands its size even among 10^15 rows. A share below
    one grain counts as one, so that a sample never gets empty because the table is large.
    """
    grains = 1 << grain_bits
    return F.pmod(F.xxhash64(*keys), F.lit(grains)) < sample_grains(share, grains)
