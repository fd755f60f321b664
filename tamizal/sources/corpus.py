"""Sources and sinks: page texts, whole-text corpora with exclusions, event logs, notes with front matter, JSON artifacts."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamizal.functions.text import strip_accents
from tamizal.session import Scratch


def list_files(spark: SparkSession, folder: str, extension: str = "pdf") -> DataFrame:
    """(path, name, size): files of an extension in any case, each path once."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "length")
    name = F.element_at(F.split("path", "/"), -1)
    return files.where(F.lower("path").endswith(f".{extension}")).select("path", name.alias("name"), F.col("length").alias("size")).dropDuplicates(["path"])


def read_binary_pages(spark: SparkSession, folder: str, extract, extension: str = "pdf") -> DataFrame:
    """(path, page, text, error): pages of binary files by a pluggable extractor (bytes -> list of page texts).

    A file that the extractor refuses becomes one row with its error; empty pages are dropped.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).where(F.lower("path").endswith(f".{extension}")).select("path", "content")

    def run(batches):
        for pdf in batches:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"]):
                try:
                    rows += [(path, i, t.strip(), None) for i, t in enumerate(extract(bytes(content)), 1) if t and t.strip()]
                except Exception as e:  # noqa: BLE001 - any failure of a file is data
                    rows.append((path, None, None, str(e)[:500]))
            yield pd.DataFrame(rows, columns=["path", "page", "text", "error"]).astype({"page": "Int32"})

    return files.mapInPandas(run, "path string, page int, text string, error string")


def pages_of(texts: DataFrame, text: str = "text", key: str = "filename") -> DataFrame:
    """(key, page, text): pages of extracted texts between their page marks, trimmed, without accents; empty pages dropped."""
    parts = F.split(F.concat(F.lit("\n"), text), r"\n--- P[^\n]*? (?=\d+ ---)")
    rows = texts.where(F.col(text).isNotNull()).select(key, F.explode(F.slice(parts, 2, 1_000_000)).alias("part"))
    page, body = F.regexp_extract("part", r"^(\d+) ---", 1).cast("int"), F.regexp_replace("part", r"^\d+ ---\s*|\s+$", "")
    return rows.select(key, page.alias("page"), strip_accents(body).alias("text")).where("text <> ''")


def write_extracted(pages: DataFrame, folder: str, key: str = "filename") -> None:
    """Pages written as one text per file with its marks, partitioned by nothing: one row is one file's text."""
    listed = pages.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("page", "text"))).alias("p"))
    body = F.array_join(F.transform("p", lambda x: F.concat(F.lit("--- Página "), x["page"].cast("string"), F.lit(" ---\n"), x["text"])), "\n\n")
    listed.select(key, F.concat(F.lit("=== "), key, F.lit(" ===\n\n"), body).alias("text")).write.mode("overwrite").parquet(folder)


def read_corpus(spark: SparkSession, folder: str, exclusions: DataFrame | None = None) -> DataFrame:
    """(path, name, text): whole texts of a folder; ``exclusions`` (name) are left out."""
    texts = spark.read.text(folder, wholetext=True, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("name"), F.col("value").alias("text"))
    return texts if exclusions is None else texts.join(exclusions.select("name"), "name", "left_anti")


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """(event, ts, latency_s): an append-only log of JSON lines; malformed lines are skipped."""
    lines = spark.read.text(path).select(F.from_json("value", "event string, ts string, latency_s double", {"mode": "PERMISSIVE"}).alias("e"))
    return lines.select("e.event", F.try_to_timestamp("e.ts").alias("ts"), "e.latency_s").where("event is not null and ts is not null")


def append_event(spark: SparkSession, path: str, events: DataFrame) -> None:
    """Events added to the log as JSON lines."""
    events.write.mode("append").json(path)


def read_front_matter(spark: SparkSession, folder: str) -> DataFrame:
    """(path, field, value): the front matter of Markdown notes; inline and block lists give one row per element."""
    notes = read_corpus(spark, folder).withColumn("head", F.regexp_extract("text", r"(?s)^---\n(.*?)\n---", 1)).where("head <> ''")
    joined = F.regexp_replace("head", r"\n\s*-\s+", "\u0001")  # block lists onto their field's line
    lines = notes.select("path", F.explode(F.split(joined, "\n")).alias("line")).where(F.col("line").contains(":"))
    field, raw = F.trim(F.regexp_extract("line", r"^([^:]+):", 1)), F.trim(F.regexp_extract("line", r"(?s)^[^:]+:(.*)$", 1))
    values = F.filter(F.transform(F.split(F.regexp_replace(raw, r"^\[|\]$", ""), r",(?![^\[]*\])|\x01"), lambda x: F.trim(F.regexp_replace(x, "^[\"']|[\"']$", ""))), lambda x: (x != "") & (x != "null"))
    return lines.select("path", field.alias("field"), F.explode_outer(values).alias("value"))


def upsert(target: str, rows: DataFrame, key: str, buckets: int = 64) -> None:
    """Rows merged into the parquet table at ``target``: equal keys are replaced, bad rows (null key) go to ``target``_quarantine.

    The table lies in ``buckets`` by a hash of the key; only the buckets that the rows touch are read and written
    again, and Spark's dynamic overwrite puts each into place after it is written whole.
    """
    spark, bucket = rows.sparkSession, F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
    good, bad = rows.where(F.col(key).isNotNull()).withColumn("bucket", bucket), rows.where(F.col(key).isNull())
    bad.write.mode("append").parquet(f"{target}_quarantine")
    scratch = Scratch(spark, "upsert")
    path = spark._jvm.org.apache.hadoop.fs.Path(target)
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        touched = [r["bucket"] for r in good.select("bucket").distinct().collect()]  # ``buckets`` numbers at most
        old = spark.read.parquet(target).where(F.col("bucket").isin(touched))
        good = good.unionByName(old.join(good.select(key).distinct(), key, "left_anti"))
    merged = scratch.keep(good, "merged")
    merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(target)
    scratch.drop(merged)


def build_index(spark: SparkSession, files: list[str], target: str, read, rebuild: bool = False, batch: int = 50) -> int:
    """Chunks of files written to the table at ``target`` in batches of ``batch`` files; returns how many files were added.

    ``read`` (list of files -> DataFrame with a column ``path``) makes the chunks. Files the table holds already are
    left out, unless it is built anew. Each batch is one append, so that a broken run goes on where it stopped.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(target)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if rebuild and fs.exists(path):
        fs.delete(path, True)
    known = {r["path"] for r in spark.read.parquet(target).select("path").where(F.col("path").isin(files)).distinct().collect()} if fs.exists(path) else set()
    todo = [f for f in dict.fromkeys(files) if f not in known]
    for k in range(0, len(todo), batch):
        read(todo[k : k + batch]).write.mode("append").parquet(target)
    return len(todo)


def cross_references(notes: DataFrame, fields: tuple[str, ...] = ("related", "supersedes")) -> DataFrame:
    """(value, field, notes): which notes name a value in the given fields of their front matter (path, field, value), in order."""
    return notes.where(F.col("field").isin(*fields) & F.col("value").isNotNull()).groupBy("value", "field").agg(F.array_sort(F.collect_set("path")).alias("notes"))
