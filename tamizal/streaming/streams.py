"""Streaming forms: windowed metrics, idempotent ingest by content hash, bounded last-event state.

Sources are files; runs use ``availableNow``, so that a run ends when all files are read and continues from its
checkpoint the next time. State and output live in the folder the caller names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def stream_of(spark: SparkSession, path: str, files: int = 4) -> DataFrame:
    """The parquet file or folder at ``path`` as a stream of files."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rpartition("/")
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files)
    inner = spark._jvm.org.apache.hadoop.fs.Path(path)
    if inner.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(inner).isDirectory():
        return reader.parquet(path)
    return reader.option("pathGlobFilter", name).parquet(folder)


def windowed_counts(events: DataFrame, width: str = "1 day", late: str = "2 hours") -> DataFrame:
    """Events per tumbling window and type; rows later than ``late`` behind the newest are dropped."""
    timed = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    return timed.groupBy(F.window("at", width).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n")


def run_windows(spark: SparkSession, path: str, home: str) -> DataFrame:
    """Runs the windowed counts to the end of the input; the newest state of each window is the result."""

    def store(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{home}/windows/batch={number}")

    stream = windowed_counts(stream_of(spark, path)).writeStream.outputMode("update").foreachBatch(store)
    stream.option("checkpointLocation", f"{home}/state").trigger(availableNow=True).start().awaitTermination()
    states = spark.read.parquet(f"{home}/windows")
    return states.groupBy("start", "event_type").agg(F.max_by("n", "batch").alias("n"))


def run_ingest(spark: SparkSession, path: str, home: str) -> DataFrame:
    """Registry rows taken in once per content hash: each batch is held against what is stored, new hashes are appended."""

    def store(batch: DataFrame, number: int) -> None:
        rows = batch.withColumn("h", F.lower(F.regexp_replace(F.trim("content_hash"), "^.*:", ""))).where("h is not null")
        first = rows.groupBy("h").agg(F.min("entry_id").alias("entry_id"))
        known = spark._jvm.org.apache.hadoop.fs.Path(f"{home}/taken")
        if known.getFileSystem(spark._jsc.hadoopConfiguration()).exists(known):
            # a batch that is run again leaves out its own earlier output
            first = first.join(spark.read.parquet(f"{home}/taken").where(F.col("batch") < number).select("h"), "h", "left_anti")
        first.write.mode("overwrite").parquet(f"{home}/taken/batch={number}")

    stream_of(spark, path).writeStream.foreachBatch(store).option("checkpointLocation", f"{home}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{home}/taken").select("h", "entry_id")


def run_tail(spark: SparkSession, path: str, home: str, n: int = 50) -> DataFrame:
    """(event_type, event_id): the last ``n`` events of each type, kept as bounded state from batch to batch."""

    def store(batch: DataFrame, number: int) -> None:
        rows = batch.select("event_type", "event_id", "ts")
        before = spark._jvm.org.apache.hadoop.fs.Path(f"{home}/tail/batch={number - 1}")
        if number and before.getFileSystem(spark._jsc.hadoopConfiguration()).exists(before):
            rows = rows.unionByName(spark.read.parquet(f"{home}/tail/batch={number - 1}"))
        w = Window.partitionBy("event_type").orderBy(F.desc("ts"), F.desc("event_id"))
        rows.withColumn("age", F.row_number().over(w)).where(F.col("age") <= n).drop("age").write.mode("overwrite").parquet(f"{home}/tail/batch={number}")
        spark.createDataFrame([(number,)], "last long").coalesce(1).write.mode("overwrite").parquet(f"{home}/last")

    stream_of(spark, path).writeStream.foreachBatch(store).option("checkpointLocation", f"{home}/state").trigger(availableNow=True).start().awaitTermination()
    last = spark.read.parquet(f"{home}/last").first()[0]
    return spark.read.parquet(f"{home}/tail/batch={last}").select("event_type", "event_id")
