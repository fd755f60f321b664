"""Helpers shared by the operators of this package."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tamizal.session import Scratch, size_of, spread

#: Bytes of compressed parquet up to which a kept table may be broadcast; beyond it joins shuffle. In memory such a
#: table takes up to some twenty times as much, and a query may hold a dozen of them.
BROADCAST_BYTES = 1 << 19


def maybe_broadcast(kept: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """The kept table with a broadcast hint if its measured size is within ``limit``, else as it is."""
    return F.broadcast(kept) if size_of(kept) <= limit else kept


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once, however often ``then`` names it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def names_something(folded: Column) -> Column:
    """Whether a folded name is neither null, blank nor the placeholder."""
    return F.coalesce((folded != "") & (folded != "unknown"), F.lit(False))


class Buckets:
    """Append-only tables (name: schema) of persisted state under one folder, each in ``count`` buckets by a hash of a column.

    Each append belongs to a numbered batch. Readers see committed batches only, so that a batch that broke is
    simply run again; a look-up reads the buckets its keys fall into.
    """

    def __init__(self, spark: SparkSession, home: str, tables: dict[str, str], count: int = 16):
        self.spark, self.home, self.tables, self.count = spark, home.rstrip("/"), tables, count
        self.jvm = spark._jvm
        self.fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())
        marks = self._path("commits")
        self.batches = max((int(f.getPath().getName()) for f in self.fs.listStatus(marks)), default=0) if self.fs.exists(marks) else 0

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.home}/{name}" if name else self.home)

    def bucket(self, c: Column) -> Column:
        return F.pmod(F.xxhash64(c), F.lit(self.count)).cast("int")

    def append(self, name: str, rows: DataFrame, key: str) -> None:
        """Adds rows to a table as part of the batch under way; what a broken run of this batch left is replaced."""
        where = f"{self.home}/{name}/batch={self.batches + 1}"
        rows.withColumn("bucket", self.bucket(F.col(key))).repartition(self.count, "bucket").write.mode("overwrite").option("compression", "zstd").partitionBy("bucket").parquet(where)

    def commit(self) -> None:
        """Makes the appends of the batch under way visible."""
        self.fs.mkdirs(self._path(f"commits/{self.batches + 1}"))
        self.batches += 1

    def look_up(self, name: str, keys: DataFrame, key: str) -> DataFrame | None:
        """Rows of a table with a key of ``keys`` (column ``key``); None if nothing was appended yet."""
        if not self.batches:
            return None
        touched = [r["bucket"] for r in keys.select(self.bucket(F.col(key)).alias("bucket")).distinct().collect()]  # ``count`` numbers at most
        return self.whole(name, touched).join(keys.select(key).distinct(), key, "left_semi")

    def whole(self, name: str, buckets: list[int] | None = None) -> DataFrame | None:
        """A table's committed rows, of all buckets or of some; None before the first commit."""
        if not self.batches:
            return None
        where = [f"{self.home}/{name}/batch={k}" for k in range(1, self.batches + 1)]
        rows = self.spark.read.schema(f"{self.tables[name]}, batch int, bucket int").option("basePath", f"{self.home}/{name}").parquet(*where)
        return (rows if buckets is None else rows.where(F.col("bucket").isin(buckets))).drop("bucket")


__all__ = ["BROADCAST_BYTES", "Buckets", "Scratch", "let", "maybe_broadcast", "names_something", "spread"]
