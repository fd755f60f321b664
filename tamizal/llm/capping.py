"""Problem 6: capping the records of dominant contributors.

A state table holds each contributor's kept records and, once it is full, its cutoff: the place of the last
kept record. A new batch is first held against the cutoffs; only rows that could still enter meet the kept
lists, top lists are merged, and whatever leaves or never enters is logged as displaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tamizal.functions.text import fold

from .common import Scratch, maybe_broadcast


def file_key(c: Column) -> Column:
    """A file's name without folder, extension, case, accents, outer blanks; underscores are blanks. Null if nothing is left."""
    name = F.regexp_replace(fold(F.regexp_replace(c, "_", " ")), r"^.*[/\\]", "")
    name = F.trim(F.regexp_replace(name, r"\.[a-z][a-z0-9]{0,4}$", ""))
    return F.when(name != "", name)


class CapState:
    """The kept rows of each contributor, persisted in the folder ``home``: (key, score, id, place) in buckets of keys.

    The row at place ``limit`` is a contributor's cutoff. A state opened on the same folder goes on where the last
    batch ended. A batch reads the buckets its keys fall into and writes those anew, as the next version of them;
    a version counts once its number is committed.
    """

    def __init__(self, scratch: Scratch, limit: int, home: str | None = None, buckets: int = 16):
        self.scratch, self.limit, self.buckets = scratch, limit, buckets
        self.home = (home or f"{scratch.root}/state").rstrip("/")
        self.jvm = scratch.spark._jvm
        self.fs = self._path("").getFileSystem(scratch.spark._jsc.hadoopConfiguration())
        marks = self._path("commits")
        #: the version of each bucket that counts
        self.versions: dict[int, int] = {}
        self.batches = 0
        for f in self.fs.listStatus(marks) if self.fs.exists(marks) else []:
            number, _, touched = f.getPath().getName().partition("_")
            self.batches = max(self.batches, int(number))
            for bucket in filter(None, touched.split("-")):
                self.versions[int(bucket)] = max(self.versions.get(int(bucket), 0), int(number))

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.home}/{name}" if name else self.home)

    def kept(self, touched: list[int] | None = None) -> DataFrame | None:
        """The kept rows (key, score, id, place, bucket), of all buckets or of some."""
        where = [f"{self.home}/kept/batch={v}/bucket={k}" for k, v in sorted(self.versions.items()) if (touched is None or k in touched) and self.fs.exists(self._path(f"kept/batch={v}/bucket={k}"))]
        return self.scratch.spark.read.option("basePath", f"{self.home}/kept").parquet(*where).drop("batch") if where else None

    def add(self, batch: DataFrame) -> DataFrame:
        """Takes in one batch (key, score, id) and returns the displaced rows (id).

        Order within a key: higher score first, null and NaN last, then the smaller id. Rows behind their
        contributor's cutoff are displaced at once; the others meet the kept lists.
        """
        sc = self.scratch
        rows = sc.keep(batch.where("key is not null").withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(self.buckets)).cast("int")), "arrived")
        touched = [r["bucket"] for r in rows.select("bucket").distinct().collect()]  # ``buckets`` numbers at most
        before, late = self.kept(touched), None
        behind = (F.col("score") < F.col("low")) | ((F.col("score") == F.col("low")) & (F.col("id") > F.col("last")))
        if before is not None:
            cut = sc.keep(before.where(F.col("place") == self.limit).select("key", F.col("score").alias("low"), F.col("id").alias("last")), "cutoffs")
            met = rows.join(maybe_broadcast(cut), "key", "left")
            late = met.where(F.coalesce(behind, F.lit(False))).select("id")
            rows = met.where(~F.coalesce(behind, F.lit(False))).select("key", "score", "id", "bucket").unionByName(before.select("key", "score", "id", "bucket"))
        order = Window.partitionBy("bucket", "key").orderBy(F.col("score").desc(), F.col("id").asc())
        # rank <= limit lets Spark cut each partition's rows to the limit before the shuffle
        top = rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= self.limit)
        top.write.mode("overwrite").option("compression", "zstd").partitionBy("bucket").parquet(f"{self.home}/kept/batch={self.batches + 1}")
        self.batches += 1
        self.fs.mkdirs(self._path(f"commits/{self.batches}_{'-'.join(map(str, sorted(touched)))}"))
        self.versions |= {k: self.batches for k in touched}
        now = self.kept(touched)
        if now is None:
            return rows.select("id").limit(0)
        cut = sc.keep(now.where(F.col("place") == self.limit).select("key", F.col("score").alias("low"), F.col("id").alias("last")), "cutoffs")
        gone = rows.join(maybe_broadcast(cut), "key").where(behind).select("id")
        return gone if late is None else gone.unionByName(late)


def cap(records: DataFrame, keys: list[Column], score: str, row_id: str, limit: int, batches: list[Column] | None = None, home: str | None = None) -> DataFrame:
    """(id): the rows that must go so that no contributor keeps more than ``limit``.

    ``keys``: what names the contributor; rows with a null key always stay. ``batches``: disjoint conditions
    that cut the table into arrivals, taken in turn; none means one arrival. ``home``: a folder with the state of
    earlier batches, to go on with. Null and NaN scores come last,
    equal scores keep the smaller id; repeated rows count each. Empty table: empty result. Other columns of any
    name are ignored.
    """
    scratch = Scratch(records.sparkSession, "cap")
    s = F.col(score).cast("double")
    s = F.when(s.isNull() | F.isnan(s), F.lit(float("-inf"))).otherwise(s)
    named, nth = F.lit(True), F.lit(None).cast("int")
    for k in keys:
        named = named & k.isNotNull()
    for i, arrival in reversed(list(enumerate(batches or [F.lit(True)]))):
        nth = F.when(arrival, i).otherwise(nth)
    key = F.when(named, F.struct(*[k.alias(f"k{i}") for i, k in enumerate(keys)]))
    # names are made once; what follows reads this narrow table
    rows = scratch.keep(records.select(key.alias("key"), s.alias("score"), F.col(row_id).alias("id"), nth.alias("arrival")).where("key is not null"), "rows")
    state, gone = CapState(scratch, limit, home), None
    for i in range(len(batches or [1])):
        out = state.add(rows.where(F.col("arrival") == i).drop("arrival"))
        gone = out if gone is None else gone.unionByName(out)
    return gone


def capped_hits(hits: DataFrame, limit: int = 20, history: float = 0.8) -> DataFrame:
    """(hit_id): hits beyond the best ``limit`` of each file in each run.

    The table arrives in two parts, by ``hit_id``: ``history`` of it first, the rest as a new batch.
    """
    ends = hits.agg(F.min("hit_id"), F.max("hit_id")).first()
    if ends[0] is None:
        return hits.select("hit_id").limit(0)
    border = ends[0] + int((ends[1] - ends[0]) * history)
    parts = [F.col("hit_id") <= border, F.col("hit_id") > border]
    return cap(hits, [F.col("run_id"), file_key(F.col("source"))], "final_score", "hit_id", limit, parts).select(F.col("id").alias("hit_id"))
