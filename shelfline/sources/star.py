"""Materialised tables: written once to the shared checkpoint folder and read by every mart.

The dashboard runs dozens of marts over the same fact; rebuilding
rental ⋈ inventory ⟕ payment for each is the dominant cost.  The fact is kept by
month (:mod:`.monthly`); this module writes the conformed dimensions once per input version.

* Location: ``<spark.checkpoint.dir>/shelfline-star/<signature>/<table>`` — the
  cluster's shared folder, so the tables survive executor loss and are shared by
  every job of the session.
* Signature: a digest of names, sizes and modification times of the input files,
  summed up by Spark from its own file listing (one job for all tables, one row per table to
  the driver); new input -> new folder.
* Publication: a table is written to a folder of its own and then named by a small
  pointer file, created only if none is there; nothing is renamed or deleted, so a
  reader sees a whole table or none, and of two writers the first one's is read.
"""

from __future__ import annotations

import hashlib
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p, jvm


def listing(spark: SparkSession, paths: list[str]) -> DataFrame:
    """path, length, modificationTime of all files under the paths; contents are not read."""
    return (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths)
            .select("path", "length", "modificationTime"))


def input_signatures(spark: SparkSession, paths: list[str]) -> dict[str, str]:
    """For each path a digest of its files, independent of their order."""
    plain = [p.rstrip("/") for p in paths]
    # the listing names a path with its scheme; the longest given path that a file lies under is its own
    owner = F.coalesce(*(F.when(F.col("path").endswith(p) | F.col("path").contains(p + "/"), F.lit(p)) for p in sorted(plain, key=len, reverse=True)))
    mark = F.xxhash64("path", "length", "modificationTime")
    rows = (listing(spark, plain).groupBy(owner.alias("owner"))
            .agg(F.count(F.lit(1)).alias("n"), F.sum(mark.cast("decimal(38,0)")).alias("total"), F.bit_xor(mark).alias("mixed")).collect())
    found = {r["owner"]: f"{r['n']}:{r['total']}:{r['mixed']}" for r in rows}
    return {p: hashlib.sha256(f"{q}:{found.get(q, '')}".encode()).hexdigest()[:16] for p, q in zip(paths, plain, strict=True)}


def input_signature(spark: SparkSession, paths: list[str]) -> str:
    """One digest of all files under the paths."""
    found = input_signatures(spark, sorted(paths))
    return hashlib.sha256("\n".join(f"{p}:{s}" for p, s in found.items()).encode()).hexdigest()[:16]


def published(spark: SparkSession, pointer: str) -> str | None:
    """The folder that a pointer file names, or None."""
    fs, p, _ = _fs(spark, pointer)
    return spark.read.text(pointer).first()[0] if fs.exists(p) and fs.getFileStatus(p).getLen() else None


def publish(spark: SparkSession, pointer: str, folder: str) -> str:
    """Names the folder in the pointer file unless one is named already; the folder that readers get."""
    fs, p, jvm = _fs(spark, pointer)
    try:
        out = fs.create(p, False)  # fails if it exists
        out.write(bytearray(folder.encode()))
        out.close()
    except Py4JJavaError:
        pass  # another job published it first
    return published(spark, pointer) or folder


def materialize(spark: SparkSession, name: str, df: DataFrame, signature: str,
                sort_col: str | None = None) -> DataFrame:
    """Write ``df`` once under the star folder for ``signature`` and return a scan of it."""
    pointer = f"{ensure_checkpoint_dir(spark).rstrip('/')}/shelfline-star/{signature}/{name}.current"
    folder = published(spark, pointer)
    if folder is None:
        folder = f"{pointer.removesuffix('.current')}-{uuid.uuid4().hex}"
        (df.sortWithinPartitions(sort_col) if sort_col else df).write.parquet(folder)
        folder = publish(spark, pointer, folder)
    return spark.read.parquet(folder)
