"""Helpers shared by the operators: scratch tables, numbering, components."""

from __future__ import annotations

import atexit
import contextlib
import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table; the path may be in any store that Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that ``df`` does not have (compared without case), one for each given name."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Only a local master, where one machine runs everything, may do without it.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = os.path.join(tempfile.gettempdir(), "shelfline-scratch")
    return found.rstrip("/")


BROADCAST_ROWS = 1_000_000
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """From now on whole texts go to Python in batches of at most BATCH_BYTES.

    Spark's own 64 MB are held by the JVM and by the Python worker of each task, there as objects too.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch()
    if not 0 < now <= BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def bounded(df: DataFrame) -> DataFrame:
    """Marks a narrow table for broadcast if its counted rows are within BROADCAST_ROWS; else joins shuffle it."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


class Scratch:
    """Intermediate tables of one call, written as Parquet under the shared folder.

    A written table cuts the lineage and survives lost executors.  ``drop`` deletes a table that no
    later step reads; what the lazily evaluated result still reads goes when the process ends.
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.paths: dict[int, str] = {}
        self.count = 0
        atexit.register(self.close)

    def keep(self, df: DataFrame) -> DataFrame:
        self.count += 1
        path = f"{self.root}/{self.count}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        return out

    def _delete(self, path: str) -> None:
        with contextlib.suppress(Exception):  # the session may have ended
            at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)

    def drop(self, *dfs: DataFrame) -> None:
        for df in dfs:
            if path := self.paths.pop(id(df), None):
                self._delete(path)

    def close(self) -> None:
        if self.spark.sparkContext._jsc is not None:
            self._delete(self.root)


def numbered(df: DataFrame, group: list[str], order: list[str], name: str) -> DataFrame:
    """Adds ``name``: a number without gaps from 0 within each group, with no task per group.

    Rows are dealt to hash buckets of their order columns; each (group, bucket) is sorted on its own and
    starts where the counts of the buckets before it end.  The offsets are one row per (group, bucket): the
    number of buckets is the session's number of shuffle partitions, which grows with the cluster, not with a
    group, and a caller has a bounded number of groups.
    """
    spark = df.sparkSession
    buckets = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    b, n, start = fresh(df, "bucket", "n_rows", "start_at")
    dealt = df.withColumn(b, F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    before = Window.partitionBy(*group).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    starts = (dealt.groupBy(*group, b).agg(F.count(F.lit(1)).alias(n))
              .withColumn(start, F.coalesce(F.sum(n).over(before), F.lit(0)))
              .drop(n))
    own = Window.partitionBy(*group, b).orderBy(*order)
    return (dealt.withColumn(name, F.row_number().over(own).cast("long") - 1)
            .join(starts, [*group, b])
            .withColumn(name, F.col(name) + F.col(start))
            .select(*df.columns, name))


def components(spark: SparkSession, scratch: Scratch, links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node reachable over the links, for each node that has a link.

    Alternating large-star and small-star steps: every step is a grouped minimum (combined before the
    shuffle, so a hub costs a row per task) and an equi-join, and rows never exceed the links.  Each round is
    a written table; a logarithmic number of rounds suffices.
    """
    edges = scratch.keep(links.select(F.col(a).alias("u"), F.col(b).alias("v"))
                         .where(F.col("u") != F.col("v"))
                         .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (both.where(F.col("v") > F.col("u")).join(least, "u")
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .where(F.col("u") != F.col("v"))
                 .unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        after = scratch.keep(small)
        # done when each node hangs on exactly one root and no root hangs on another node
        roots = after.select(F.col("v").alias("u")).distinct()
        open_ = (after.join(roots, "u", "left_semi").limit(1).count()
                 or after.groupBy("u").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count())
        scratch.drop(edges)
        edges = after
        if not open_:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def utf8_crc32(text: Column) -> Column:
    """CRC-32 of the UTF-8 bytes, unsigned; null stays null."""
    return F.crc32(F.encode(text, "UTF-8"))
