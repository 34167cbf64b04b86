"""Durable tables: appended to, or kept up to date by key; a replayed micro-batch changes neither."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value of the file commit protocol: the mark of a complete write.
DONE = "_SUCCESS"


def write_table(df: DataFrame, path: str, by: tuple[str, ...] = ("site", "volume_date"), mode: str = "append") -> None:
    """Parquet below path; readers see a write whole or not at all (Spark's commit protocol).

    Rows are brought together by partition first, so that a partition gets few files.
    """
    df.repartition(*by).sortWithinPartitions(*by).write.mode(mode).partitionBy(*by).parquet(path)


def stream_table(df: DataFrame, path: str, checkpoint: str, by: tuple[str, ...] = ("site",)):
    """Start a query that appends every micro-batch to the table, each in a folder batch=<id> of its own.

    A micro-batch that is replayed after a failure overwrites what it wrote before.
    """

    def put(batch: DataFrame, number: int) -> None:
        write_table(batch, f"{path}/batch={number}", by, mode="overwrite")

    return df.writeStream.option("checkpointLocation", checkpoint).foreachBatch(put).start()


@dataclass
class KeyedTable:
    """The latest row of every key, by an order column, as Parquet files that a ledger names.

    Rows lie in buckets by a hash of the key. A micro-batch rewrites the buckets that it touches, in
    a folder of its own, and then enters in the ledger which folder holds each bucket. A batch that
    the ledger has is not applied again; one that failed before its entry writes its folder anew. So
    each batch counts once, however often it runs. Readers take the newest complete entry and see
    no batch in part. There is one writer at a time.
    """

    path: str
    keys: tuple[str, ...]
    order: str
    buckets: int = 16

    def _entries(self, spark: SparkSession) -> list[int]:
        """Numbers of the batches that were entered, ascending."""
        jvm = spark._jvm.org.apache.hadoop.fs
        ledger = jvm.Path(f"{self.path}/ledger")
        fs = ledger.getFileSystem(spark._jsc.hadoopConfiguration())
        if not fs.exists(ledger):
            return []
        found = [x.getPath() for x in fs.listStatus(ledger)]
        return sorted(int(p.getName().partition("=")[2]) for p in found if fs.exists(jvm.Path(p, DONE)))

    def _held(self, spark: SparkSession) -> dict[int, str]:
        """Of each bucket the folder that holds it; as many entries as there are buckets."""
        if not (entries := self._entries(spark)):
            return {}
        return {r["bucket"]: r["folder"] for r in spark.read.schema("bucket int, folder string").parquet(f"{self.path}/ledger/batch={entries[-1]}").collect()}

    def _rows(self, spark: SparkSession, schema, held: dict[int, str]) -> DataFrame:
        if not held:
            return spark.createDataFrame([], schema)
        return spark.read.schema(schema).parquet(*[f"{self.path}/data/{f}/bucket={b}" for b, f in sorted(held.items())])

    def upsert(self, batch: DataFrame, number: int) -> bool:
        """Apply a micro-batch; False where it was applied before.

        Of rows of one key the one with the greatest order stays, and of equal ones any. A null key is a
        key. An empty batch changes nothing.
        """
        spark = batch.sparkSession
        if number in self._entries(spark):
            return False
        rest = [c for c in batch.columns if c not in (*self.keys, self.order)]
        kept = batch.groupBy(*self.keys).agg(F.max_by(F.struct(self.order, *rest), self.order).alias("row"))
        kept = kept.select(*self.keys, "row.*").select(*batch.columns).withColumn("bucket", F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")).persist()
        try:
            touched = [r[0] for r in kept.select("bucket").distinct().collect()]  # bounded by the buckets
            held = self._held(spark)
            folder = f"{number}-{uuid.uuid4().hex}"
            before = self._rows(spark, batch.schema, {b: held[b] for b in touched if b in held})
            both = kept.drop("bucket").unionByName(before)
            newest = both.groupBy(*self.keys).agg(F.max_by(F.struct(self.order, *rest), self.order).alias("row")).select(*self.keys, "row.*").select(*batch.columns)
            newest = newest.withColumn("bucket", F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int"))
            if touched:
                newest.repartition("bucket").write.partitionBy("bucket").parquet(f"{self.path}/data/{folder}")
        finally:
            kept.unpersist()
        entry = held | dict.fromkeys(touched, folder)
        spark.createDataFrame(sorted(entry.items()), "bucket int, folder string").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/ledger/batch={number}")
        return True

    def read(self, spark: SparkSession, schema) -> DataFrame:
        return self._rows(spark, schema, self._held(spark))


def keep_current(changes: DataFrame, path: str, checkpoint: str, trigger: dict | None = None):
    """Start a query that keeps two keyed tables up to date from a stream of changes of sites.

    path/sweeps has the latest sweep of each (site, elevation), path/sites the latest revision of
    each site; current_tables() reads them. A batch reaches both or, replayed, the one that it missed.
    """
    sweeps, sites = state_tables(path)

    def put(batch: DataFrame, number: int) -> None:
        # two tables read it; and the stream's state is only committed if all of it is computed, even where both tables have it
        batch = batch.persist()
        batch.count()
        sweeps.upsert(batch.where("change = 'sweep'").select("site", "elevation_number", "volume", "vcp_number", "revision"), number)
        sites.upsert(batch.where("revision is not null").select("site", "vcp_number", "last_complete", "revision", "since"), number)
        batch.unpersist()

    return changes.writeStream.option("checkpointLocation", checkpoint).foreachBatch(put).trigger(**trigger or {"processingTime": "5 seconds"}).start()


def take_back(spark: SparkSession, checkpoint: str) -> None:
    """Take the mark of a stopped query's last micro-batch back, as if it had died just before: started again, it runs that batch once more."""
    jvm = spark._jvm.org.apache.hadoop.fs
    commits = jvm.Path(f"{checkpoint}/commits")
    fs = commits.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(commits) and (done := [n for x in fs.listStatus(commits) if (n := x.getPath().getName()).isdigit()]):
        fs.delete(jvm.Path(commits, max(done, key=int)), False)


def keep_current_twice(changes: DataFrame, path: str, checkpoint: str, trigger: dict):
    """keep_current() until its trigger has taken what there is, then started again with its last micro-batch to be applied a second time.

    The batch is computed anew from the state before it and reaches both tables, whose ledgers have it.
    """
    keep_current(changes, path, checkpoint, trigger).awaitTermination()
    take_back(changes.sparkSession, checkpoint)
    return keep_current(changes, path, checkpoint, trigger)


SWEEPS = "site string, elevation_number int, volume long, vcp_number int, revision long"
SITES = "site string, vcp_number int, last_complete long, revision long, since long"


def state_tables(path: str) -> tuple[KeyedTable, KeyedTable]:
    return KeyedTable(f"{path}/sweeps", ("site", "elevation_number"), "revision"), KeyedTable(f"{path}/sites", ("site",), "revision")


def current_tables(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(current sweeps, sites) of a table that keep_current() fills."""
    sweeps, sites = state_tables(path)
    s = sites.read(spark, SITES)
    live = sweeps.read(spark, SWEEPS).join(s.select("site", "since"), "site").where("revision >= since").drop("since")
    return live, s
