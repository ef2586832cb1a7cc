"""Month-partitioned tables kept up to date month by month.

A table is a set of immutable month partitions, ``<root>/version=<id>/rental_month=<yyyymm>/``, and a snapshot: which
version each month is read from.  A refresh writes only the months whose rows may have changed, under a version of its
own, and publishes a new snapshot that names the old versions for all other months.  Nothing is overwritten, so a running
query keeps the files it planned with, a failed refresh leaves nothing that is read, and of two concurrent refreshes the
one published first is read.

``rental_month`` is a partition column: a month filter lists that month's files only.  Rows without a date are month 0.
A large month is split over several files and small ones are joined up (the ``rebalance`` hint), so the number of files
follows the bytes and not tasks x months.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import star

MONTH = "rental_month"


def month_number(date: str = "rental_date") -> Column:
    """yyyymm as a number, 0 without a date."""
    return F.coalesce(F.year(date) * 100 + F.month(date), F.lit(0)).cast("int")


@dataclass
class Snapshot:
    """For each table its months' versions, and the folder that lists the input files it was made of."""
    months: dict[str, dict[int, str]] = field(default_factory=dict)
    files: str = ""

    def text(self) -> str:
        return json.dumps({"months": self.months, "files": self.files}, sort_keys=True)

    @classmethod
    def of(cls, text: str) -> Snapshot:
        found = json.loads(text)
        return cls({t: {int(m): v for m, v in months.items()} for t, months in found["months"].items()}, found["files"])


class MonthStore:
    """Month tables of one family under ``root``."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root

    def _pointer(self, signature: str) -> str:
        return f"{self.root}/{signature}.current"

    def published(self, signature: str) -> Snapshot | None:
        text = star.published(self.spark, self._pointer(signature))
        return Snapshot.of(text) if text else None

    def newest(self) -> Snapshot | None:
        """The snapshot published last, whatever its signature: one pointer file per refresh."""
        fs, p, _ = star._fs(self.spark, f"{self.root}/*.current")
        found = [(s.getModificationTime(), s.getPath().toString()) for s in fs.globStatus(p) or []]
        text = star.published(self.spark, max(found)[1]) if found else None
        return Snapshot.of(text) if text else None

    def publish(self, signature: str, snapshot: Snapshot) -> Snapshot:
        return Snapshot.of(star.publish(self.spark, self._pointer(signature), snapshot.text()))

    def write(self, table: str, df: DataFrame) -> dict[int, str]:
        """Writes the rows under a version of their own, a folder per month; month -> version."""
        version = "v" + uuid.uuid4().hex
        path = f"{self.root}/{table}/version={version}"
        (df.hint("rebalance", MONTH).sortWithinPartitions(MONTH, *(c for c in ("rental_date",) if c in df.columns))
         .write.partitionBy(MONTH).parquet(path))
        fs, p, _ = star._fs(self.spark, f"{path}/{MONTH}=*")
        return {int(s.getPath().getName().partition("=")[2]): version for s in fs.globStatus(p) or []}

    def read(self, table: str, months: dict[int, str], schema: T.StructType) -> DataFrame:
        """The rows of a snapshot's months; the schema is that of the written rows."""
        if not months:
            return self.spark.createDataFrame([], schema)
        base = f"{self.root}/{table}"
        columns = [f for f in schema.fields if f.name != MONTH]
        full = T.StructType([*columns, T.StructField("version", T.StringType()), T.StructField(MONTH, T.IntegerType())])
        paths = [f"{base}/version={v}/{MONTH}={m}" for m, v in sorted(months.items())]
        return self.spark.read.schema(full).option("basePath", base).parquet(*paths).drop("version")
