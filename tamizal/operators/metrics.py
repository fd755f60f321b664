"""Operational metrics over event logs: windows, percentiles, error rates, availability; batch and streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def trailing_window(events: DataFrame, as_of: Column, hours: int = 24) -> DataFrame:
    """Events of the ``hours`` before ``as_of`` (a time without zone)."""
    return events.where((F.col("ts") > as_of - F.make_dt_interval(hours=F.lit(hours))) & (F.col("ts") <= as_of))


def order_statistics(rows: DataFrame, keys: list[str], value: str, places: dict[str, Callable[[Column], Column]], ranges: int = 512) -> DataFrame:
    """Per group the elements at given places of its order: ``places`` maps a name to a function of the group's size.

    Equal values are counted first. The counted values of a group fall into ranges by estimated quantiles, sized by
    their totals; only the ranges in which a place lies are put in order, so that no task sorts a whole group.
    """
    counted = rows.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("v")).agg(F.count("*").alias("c"))
    cuts = counted.groupBy(*keys).agg(F.percentile_approx("v", [i / ranges for i in range(1, ranges)], 10 * ranges).alias("cuts"), F.sum("c").alias("n"))
    placed = counted.join(cuts, keys).withColumn("range", F.size(F.filter("cuts", lambda x: x < F.col("v")))).drop("cuts")
    of_range = placed.groupBy(*keys, "n", "range").agg(F.sum("c").alias("of_range"))
    before = F.sum("of_range").over(Window.partitionBy(*keys).orderBy("range")) - F.col("of_range")
    wanted = F.array(*[F.struct(F.lit(name).alias("name"), at(F.col("n")).cast("long").alias("at")) for name, at in places.items()])
    hit = of_range.withColumn("before", before).select(*keys, "range", "before", "of_range", F.inline(wanted)).where((F.col("at") > F.col("before")) & (F.col("at") <= F.col("before") + F.col("of_range")))
    few = placed.join(hit.select(*keys, "range", "before").distinct(), [*keys, "range"])
    last = F.col("before") + F.sum("c").over(Window.partitionBy(*keys, "range").orderBy("v"))
    few = few.withColumn("last", last).select(*keys, "range", "v", (F.col("last") - F.col("c")).alias("first"), "last")
    found = few.join(hit.select(*keys, "range", "name", "at"), [*keys, "range"]).where((F.col("at") > F.col("first")) & (F.col("at") <= F.col("last")))
    return found.groupBy(*keys).agg(*[F.max(F.when(F.col("name") == name, F.col("v"))).alias(name) for name in places])


def latency(events: DataFrame, key: Column, value: str = "value") -> DataFrame:
    """Per key: count, mean, interpolated median and element-wise p90, p95, p99 (the largest while a group is small)."""
    rows = events.where(F.col(value).isNotNull()).select(key.alias("key"), F.col(value).alias("v"))
    high = lambda p, least: lambda n: F.least(F.when(n > least, F.floor(n * p) + 1).otherwise(n), n)
    places = {"low": lambda n: F.floor((n + 1) / 2), "up": lambda n: F.floor(n / 2) + 1, "p90": high(0.90, 10), "p95": high(0.95, 20), "p99": high(0.99, 100)}
    marks = order_statistics(rows, ["key"], "v", places)
    means = rows.groupBy("key").agg(F.count("*").alias("n"), F.round(F.avg("v"), 6).alias("mean"))
    return means.join(marks, "key").select("key", "n", "mean", F.round((F.col("low") + F.col("up")) / 2, 6).alias("p50"), *[F.round(p, 6).alias(p) for p in ("p90", "p95", "p99")])


def error_rate(events: DataFrame, key: Column, error: Column, request: Column) -> DataFrame:
    """Errors per hundred requests, two decimals; 0 without requests."""
    out = events.groupBy(key.alias("key")).agg(F.count_if(error).alias("errors"), F.count_if(request).alias("requests"))
    return out.withColumn("rate", F.when(F.col("requests") > 0, F.round(F.col("errors") / F.col("requests") * 100, 2)).otherwise(0.0))


def gaps(events: DataFrame, key: Column, seconds: int = 300, width: str = "1 hour") -> DataFrame:
    """Silences longer than ``seconds`` between consecutive events of a key: their number and total length.

    Events are compared within windows of ``width`` of a key; between windows only their first and last times are,
    so that no task orders all events of a key.
    """
    timed = events.where("ts is not null").select(key.alias("key"), "ts", F.window(F.col("ts").cast("timestamp"), width)["start"].alias("w"))
    inner = timed.withColumn("gap", F.timestamp_diff("SECOND", F.lag("ts").over(Window.partitionBy("key", "w").orderBy("ts")), F.col("ts")))
    long = lambda g: [F.count_if(g > seconds).alias("gaps"), F.sum(F.when(g > seconds, g).otherwise(0)).alias("down_s")]
    within = inner.groupBy("key", "w").agg(*long(F.col("gap")), F.min("ts").alias("first"), F.max("ts").alias("last"))
    # one row a window is left of each key
    across = within.withColumn("gap", F.timestamp_diff("SECOND", F.lag("last").over(Window.partitionBy("key").orderBy("w")), F.col("first")))
    jump = F.coalesce((F.col("gap") > seconds).cast("int"), F.lit(0))
    out = across.groupBy("key").agg(F.sum(F.col("gaps") + jump).alias("gaps"), F.sum(F.col("down_s") + jump * F.coalesce("gap", F.lit(0))).alias("down_s"), F.timestamp_diff("SECOND", F.min("first"), F.max("last")).alias("span_s"))
    return out.withColumn("availability", F.when(F.col("span_s") > 0, F.round(100 - 100 * F.col("down_s") / F.col("span_s"), 4)).otherwise(100.0))


def sessions(events: DataFrame, seconds: int = 300) -> DataFrame:
    """Runs of events of a user without a silence of ``seconds``."""
    return events.groupBy("user_id", F.session_window(F.col("ts").cast("timestamp"), f"{seconds} seconds").alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), "n")


def windowed_counts(events: DataFrame, width: str = "1 day") -> DataFrame:
    """Events and mean value per tumbling window and type; the same expression serves batches and streams."""
    return events.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "mean")


def last_events(events: DataFrame, n: int = 50) -> DataFrame:
    """The last ``n`` events of each type."""
    w = Window.partitionBy("event_type").orderBy(F.desc("ts"), F.desc("event_id"))
    return events.withColumn("age", F.row_number().over(w)).where(F.col("age") <= n)


def generation_speed(runs: DataFrame) -> DataFrame:
    """Time to first token and tokens per second, null where a duration is missing or zero.

    runs: id, load_ns, prompt_tokens, prompt_ns, tokens, ns.
    """
    rate = lambda n, ns: F.when(F.col(ns) > 0, F.round(F.col(n) / (F.col(ns) / 1e9), 3))
    return runs.select("id", F.round((F.col("load_ns") + F.col("prompt_ns")) / 1e9, 6).alias("ttft_s"), rate("prompt_tokens", "prompt_ns").alias("prefill_tps"), rate("tokens", "ns").alias("decode_tps"))
