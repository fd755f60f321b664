"""Queries of operational metrics over the events, and of the relational helpers over the star schema."""

from __future__ import annotations


import uuid

from pyspark.sql import functions as F

from tamizal.operators import metrics as M
from tamizal.session import shared_dir, small, table
from tamizal.streaming import streams as ST


def _ev(s, d):
    return table(s, d, "events")


def m_window(s, d):
    e = _ev(s, d)
    last = e.agg(F.max("ts").alias("as_of"))
    return M.trailing_window(e.crossJoin(small(last)), F.col("as_of")).groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


def m_query_event(s, d):
    h = table(s, d, "hits")
    return h.groupBy("run_id", "query_id").agg(F.count("*").alias("hits"), F.floor(F.sum(F.length(F.coalesce("text", F.lit("")))) / 4).alias("tokens"), F.max(F.timestamp_diff("SECOND", "searched_at", "logged_at")).alias("latency_s"))


def m_llm(s, d):
    """Orders stand for runs: line items are what a run produced."""
    li = table(s, d, "lineitem")
    runs = li.groupBy(F.col("l_orderkey").alias("id")).agg(
        F.sum(F.col("l_quantity").cast("long")).alias("tokens"), (F.sum("l_linenumber") * 1000000000).alias("ns"), F.count("*").alias("prompt_tokens"), (F.max("l_linenumber").cast("long") * 500000000).alias("prompt_ns"), (F.min("l_linenumber").cast("long") * 1000000).alias("load_ns")
    )
    return M.generation_speed(runs)


def h_count(s, d):
    n, c, o = (table(s, d, t) for t in ("nation", "customer", "orders"))
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(small(n), F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.count("*").alias("n"))


def h_pivot_search(s, d):
    """Key-value metadata brought back to one row per chunk, searched by words of the text."""
    h = table(s, d, "hits")
    kv = h.select(F.col("hit_id").alias("id"), F.inline(F.array(*[F.struct(F.lit(k).alias("key"), F.col(c).cast("string").alias("value")) for k, c in (("source", "source"), ("page", "page"), ("document", "text"))])))
    wide = kv.groupBy("id").agg(*[F.max(F.when(F.col("key") == k, F.col("value"))).alias(k) for k in ("source", "page", "document")])
    return wide.where(F.lower("document").contains("alarm")).select("id", "source", F.col("page").cast("int").alias("page"), F.substring("document", 1, 80).alias("start"))


def h_doc_names(s, d):
    names = table(s, d, "hits").select("source").where("source is not null").distinct()
    return names.withColumn("initial", F.upper(F.substring(F.trim("source"), 1, 1))).groupBy("initial").agg(F.count("*").alias("n"), F.min("source").alias("first"))


def s_incremental(s, d):
    """Entries of the last batch that earlier ones don't hold by hash, and those to retry for missing chunks."""
    r = table(s, d, "ingest_registry").withColumn("h", F.lower(F.regexp_replace(F.trim("content_hash"), "^.*:", "")))
    r = r.crossJoin(F.broadcast(r.agg(F.max("batch_no").alias("last"))))  # one row
    old = r.where("batch_no < last and h is not null").groupBy("h").agg(F.max(F.coalesce("chunks_indexed", F.lit(0)) - F.coalesce("attempted_chunks", F.lit(0))).alias("short"))
    new = r.where("batch_no = last").join(old, "h", "left")
    return new.where("short is null or short < 0").select("entry_id", F.when(F.col("short").isNull(), "new").otherwise("retry").alias("action"))


def s_cache_plan(s, d):
    docs = table(s, d, "documents").select("doc_id", F.substring(F.sha2(F.coalesce("text", F.lit("")), 256), 1, 16).alias("key"))
    return docs.groupBy("key").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n"))


def s_corpus_excl(s, d):
    """Documents of sources that are not excluded; the exclusions are the sources with the fewest documents."""
    docs = table(s, d, "documents").withColumn("src", F.lower(F.trim("source")))
    few = docs.where("src is not null").groupBy("src").count().where("count < 20").select("src")
    return docs.join(small(few), "src", "left_anti").select("doc_id", "src")


QUERIES = {
    "m_window": m_window,
    "m_latency": lambda s, d: M.latency(_ev(s, d), F.col("event_type")),
    "m_error_rate": lambda s, d: M.error_rate(_ev(s, d), F.to_date("ts"), F.col("event_type") == "error", F.col("event_type") == "view"),
    "m_availability": lambda s, d: M.gaps(_ev(s, d), F.col("event_type")),
    "m_sessions": lambda s, d: M.sessions(_ev(s, d)),
    "m_tumbling": lambda s, d: M.windowed_counts(_ev(s, d)),
    "m_last_events": lambda s, d: M.last_events(_ev(s, d)).select("event_type", "event_id", "age"),
    "m_query_event": m_query_event,
    "m_llm": m_llm,
    "st_windows": lambda s, d: ST.run_windows(s, f"{d}/events.parquet", f"{shared_dir(s)}/tamizal-stream-{uuid.uuid4().hex[:12]}"),
    "st_ingest": lambda s, d: ST.run_ingest(s, f"{d}/ingest_registry.parquet", f"{shared_dir(s)}/tamizal-stream-{uuid.uuid4().hex[:12]}"),
    "h_sources": lambda s, d: table(s, d, "hits").where("source is not null").groupBy("source").agg(F.count("*").alias("n"), F.countDistinct("page").alias("pages")),
    "h_count": h_count,
    "h_pivot_search": h_pivot_search,
    "h_doc_names": h_doc_names,
    "s_top_sources": lambda s, d: table(s, d, "hits").where("source is not null").groupBy("source").count().withColumnRenamed("count", "n").orderBy(F.desc("n"), "source").limit(10),
    "s_stats": lambda s, d: table(s, d, "hits").agg(F.count("*").alias("chunks"), F.countDistinct("source").alias("sources"), F.countDistinct("chunk_id").alias("distinct_chunks")),
    "s_incremental": s_incremental,
    "s_cache_plan": s_cache_plan,
    "s_cache_counts": lambda s, d: s_cache_plan(s, d).groupBy("n").agg(F.count("*").alias("keys")),
    "s_corpus_excl": s_corpus_excl,
    "s_excl_summary": lambda s, d: table(s, d, "documents").groupBy(F.coalesce(F.lower(F.trim("source")), F.lit("none")).alias("src")).agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars")),
}

_P = "CASE WHEN n > %d THEN CAST(floor(n * %s::DOUBLE) AS BIGINT) + 1 ELSE n END"
_AT = lambda p, k: f"round(max(CASE WHEN i = least({_P % (k, p)}, n) THEN v END), 6)"
_RUNS = "WITH r AS (SELECT l_orderkey AS id, sum(CAST(trunc(l_quantity) AS BIGINT)) AS tokens, sum(l_linenumber) * 1000000000::BIGINT AS ns, count(*) AS prompt_tokens, max(l_linenumber) * 500000000::BIGINT AS prompt_ns, min(l_linenumber) * 1000000::BIGINT AS load_ns FROM lineitem GROUP BY 1)"
SQL = {
    "st_ingest": "SELECT lower(regexp_replace(trim(content_hash), '^.*:', '')) AS h, min(entry_id) AS entry_id FROM ingest_registry WHERE content_hash IS NOT NULL GROUP BY 1",
    "m_window": "WITH w AS (SELECT max(ts) AS a FROM events) SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM events, w WHERE ts > a - INTERVAL 24 HOUR AND ts <= a GROUP BY 1",
    "m_latency": f"WITH x AS (SELECT event_type AS key, value AS v, count(*) OVER (PARTITION BY event_type) AS n, row_number() OVER (PARTITION BY event_type ORDER BY value) AS i FROM events WHERE value IS NOT NULL) SELECT key, count(*) AS n, round(avg(v), 6) AS mean, round(quantile_cont(v, 0.5), 6) AS p50, {_AT('0.90', 10)} AS p90, {_AT('0.95', 20)} AS p95, {_AT('0.99', 100)} AS p99 FROM x GROUP BY key",
    "m_error_rate": "WITH x AS (SELECT CAST(ts AS DATE) AS key, count(*) FILTER (event_type = 'error') AS errors, count(*) FILTER (event_type = 'view') AS requests FROM events GROUP BY 1) SELECT *, CASE WHEN requests > 0 THEN round(errors::DOUBLE / requests * 100, 2) ELSE 0.0::DOUBLE END AS rate FROM x",
    "m_availability": "WITH x AS (SELECT event_type AS key, ts, CAST(trunc(epoch_us(ts - lag(ts) OVER (PARTITION BY event_type ORDER BY ts, event_id)) / 1000000) AS BIGINT) AS gap FROM events), y AS (SELECT key, count(*) FILTER (gap > 300) AS gaps, CAST(coalesce(sum(gap) FILTER (gap > 300), 0) AS BIGINT) AS down_s, CAST(trunc(epoch_us(max(ts) - min(ts)) / 1000000) AS BIGINT) AS span_s FROM x GROUP BY key) SELECT *, CASE WHEN span_s > 0 THEN round(100 - 100 * down_s::DOUBLE / span_s, 4) ELSE 100.0::DOUBLE END AS availability FROM y",
    "m_sessions": "WITH x AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts >= lag(ts) OVER w + INTERVAL 300 SECOND THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), y AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM x) SELECT user_id, min(ts) AS start, count(*) AS n FROM y GROUP BY user_id, g",
    "m_tumbling": "SELECT date_trunc('day', ts)::TIMESTAMP AS start, event_type, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY ALL",
    "m_last_events": "SELECT event_type, event_id, age FROM (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS age FROM events) WHERE age <= 50",
    "m_query_event": "SELECT run_id, query_id, count(*) AS hits, CAST(floor(sum(length(coalesce(text, ''))) / 4) AS BIGINT) AS tokens, max(CAST(trunc(epoch_us(logged_at - searched_at) / 1000000) AS BIGINT)) AS latency_s FROM hits GROUP BY ALL",
    "m_llm": _RUNS + " SELECT id, round((load_ns + prompt_ns) / 1e9::DOUBLE, 6) AS ttft_s, CASE WHEN prompt_ns > 0 THEN round(prompt_tokens / (prompt_ns / 1e9::DOUBLE), 3) END AS prefill_tps, CASE WHEN ns > 0 THEN round(tokens / (ns / 1e9::DOUBLE), 3) END AS decode_tps FROM r",
    "st_windows": "SELECT date_trunc('day', ts)::TIMESTAMP AS start, event_type, count(*) AS n FROM events GROUP BY ALL",
    "h_sources": "SELECT source, count(*) AS n, count(DISTINCT page) AS pages FROM hits WHERE source IS NOT NULL GROUP BY 1",
    "h_count": "SELECT n_name, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1",
    "h_pivot_search": "SELECT hit_id AS id, source, page, substr(text, 1, 80) AS start FROM hits WHERE contains(lower(text), 'alarm')",
    "h_doc_names": "SELECT upper(substr(trim(source), 1, 1)) AS initial, count(*) AS n, min(source) AS first FROM (SELECT DISTINCT source FROM hits WHERE source IS NOT NULL) GROUP BY 1",
    "s_top_sources": "SELECT source, count(*) AS n FROM hits WHERE source IS NOT NULL GROUP BY 1 ORDER BY n DESC, source LIMIT 10",
    "s_stats": "SELECT count(*) AS chunks, count(DISTINCT source) AS sources, count(DISTINCT chunk_id) AS distinct_chunks FROM hits",
    "s_incremental": "WITH r AS (SELECT *, lower(regexp_replace(trim(content_hash), '^.*:', '')) AS h, max(batch_no) OVER () AS last FROM ingest_registry), o AS (SELECT h, max(coalesce(chunks_indexed, 0) - coalesce(attempted_chunks, 0)) AS short FROM r WHERE batch_no < last AND h IS NOT NULL GROUP BY h) SELECT entry_id, CASE WHEN short IS NULL THEN 'new' ELSE 'retry' END AS action FROM r LEFT JOIN o ON r.h = o.h WHERE batch_no = last AND (short IS NULL OR short < 0)",
    "s_cache_plan": "SELECT substr(sha256(coalesce(text, '')), 1, 16) AS key, min(doc_id) AS first_id, count(*) AS n FROM documents GROUP BY 1",
    "s_cache_counts": "SELECT n, count(*) AS keys FROM (SELECT count(*) AS n FROM documents GROUP BY sha256(coalesce(text, ''))) GROUP BY n",
    "s_corpus_excl": "WITH d AS (SELECT doc_id, lower(trim(source)) AS src FROM documents), f AS (SELECT src FROM d WHERE src IS NOT NULL GROUP BY 1 HAVING count(*) < 20) SELECT doc_id, src FROM d WHERE src IS NULL OR src NOT IN (SELECT src FROM f)",
    "s_excl_summary": "SELECT coalesce(lower(trim(source)), 'none') AS src, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY 1",
}
