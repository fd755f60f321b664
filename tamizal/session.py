"""Session, table and scratch helpers shared by all operators."""

from __future__ import annotations

import io
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cores: int | str = 8, shuffle: int = 8, name: str = "tamizal") -> SparkSession:
    """A session for tests and benchmarks on one machine; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.driver.memory", "16g")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; a temporary one only where none is set (tests on one machine)."""
    set_to = spark.conf.get("spark.checkpoint.dir", None)
    if not set_to and (own := spark.sparkContext._jsc.sc().getCheckpointDir()).isDefined():
        set_to = own.get()
    if not set_to:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        set_to = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(set_to)
    return set_to.rstrip("/")


def ship_package(spark: SparkSession) -> None:
    """Sends this package to the Python workers once per application, by way of the shared folder."""
    sc = spark.sparkContext
    if getattr(sc, "_tamizal_shipped", False):
        return
    home, packed = Path(__file__).resolve().parent, io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as archive:
        for path in sorted(home.rglob("*.py")):
            archive.write(path, str(path.relative_to(home.parent)))
    where = f"{shared_dir(spark)}/tamizal-code-{uuid.uuid4().hex[:12]}.zip"
    target = spark._jvm.org.apache.hadoop.fs.Path(where)
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True)
    out.write(bytearray(packed.getvalue()))
    out.close()
    sc.addPyFile(where)
    sc._tamizal_shipped = True


class Scratch:
    """Parquet tables in the shared checkpoint folder.

    ``keep`` writes a DataFrame and reads it back, which cuts its lineage and survives the loss of
    executors; ``drop`` removes tables that nothing reads any more.
    """

    def __init__(self, spark: SparkSession, name: str = "t"):
        ship_package(spark)
        self.spark = spark
        self.root = f"{shared_dir(spark)}/tamizal-{name}-{uuid.uuid4().hex[:12]}"
        self.count = 0

    def path(self, name: str) -> str:
        self.count += 1
        return f"{self.root}/{self.count:03d}-{name}"

    def keep(self, df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
        path = self.path(name)
        writer = df.write.option("compression", "zstd")
        (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
        return self.spark.read.parquet(path) if partition_by else self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *frames: DataFrame) -> None:
        for df in frames:
            for parent in {f.rpartition("/")[0] for f in df.inputFiles()}:
                path = self.spark._jvm.org.apache.hadoop.fs.Path(parent)
                path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def size_of(df: DataFrame) -> int:
    """Bytes of a kept table as Spark's own statistics have them: the size of its files, or of the columns read."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def small(df: DataFrame, limit: int = 8 << 20, growth: int = 4) -> DataFrame:
    """The table with a broadcast hint if Spark's statistics (file sizes, carried through the plan), ``growth`` times, are within ``limit`` bytes; else as it is, so that the join shuffles.

    ``growth`` covers what the statistics don't know: rows in memory against compressed files, and exploded arrays.
    """
    return F.broadcast(df) if size_of(df) * growth <= limit else df


def spread(df: DataFrame) -> DataFrame:
    """A scan of fewer tasks than cores dealt out over all of them, for costly work on a row; a larger scan as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
