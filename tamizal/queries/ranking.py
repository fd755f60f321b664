"""Queries of the ranking operators over the search hits, each over the whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamizal.operators import ranking as R
from tamizal.session import small, table

IDS = ["run_id", "query_id", "hit_id"]


def _hits(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "hits")


def _r6(name: str):
    return F.round(name, 6).alias(name)


def _wanted(spark: SparkSession, d: str) -> DataFrame:
    """The documents most often found; what the injection query asks for."""
    by = _hits(spark, d).where("canonical_doc_id is not null").groupBy("canonical_doc_id").count()
    return by.orderBy(F.desc("count"), "canonical_doc_id").limit(3).select("canonical_doc_id")


def _in_scope():
    return F.col("canonical_doc_id").startswith("doc:anexo")


def _preferred():
    return F.lower("source").contains("manual") | F.lower("source").contains("handbook")


def _asked(spark: SparkSession, d: str) -> DataFrame:
    """Questions that ask for a number, and how many names of two or more words they hold."""
    q = table(spark, d, "eval_questions")
    names = F.size(F.regexp_extract_all("question", F.lit("[A-Z][a-z]{5,}"), F.lit(0)))
    return q.select(F.col("item_id").alias("query_id"), F.lower("question").rlike("how many|what pressure|cuant|presi").alias("numeric"), names.alias("entities"))


def _keywords(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "eval_questions").select(F.col("item_id").alias("query_id"), F.col("answer_keywords").alias("entities"))


QUERIES = {
    "r_per_source": lambda s, d: R.limit_per_source(_hits(s, d)).select(*IDS, "rank", "source_rank"),
    "r_diversify": lambda s, d: R.diversify(_hits(s, d)).select(*IDS, "within", "place"),
    "r_rrf": lambda s, d: R.reciprocal_rank_fusion(_hits(s, d)).select(*IDS, "first_rank", "second_rank", _r6("rrf")),
    "r_quality": lambda s, d: R.adaptive_quality(_hits(s, d)).select(*IDS, "threshold", "rank"),
    "r_rerank": lambda s, d: R.normalize_rerank(R.rerank_pool(_hits(s, d))).select(*IDS, "rank", _r6("norm"), _r6("blend")),
    "r_norm_filter": lambda s, d: R.normalized_filter(_hits(s, d), _asked(s, d)).select(*IDS, "weak", "free", "rank"),
    "r_preserve": lambda s, d: R.preserve_top(_hits(s, d)).select(*IDS, "filled", "place"),
    "r_preserve_final": lambda s, d: R.preserve_top(R.limit_per_source(_hits(s, d), 4).drop("rank", "source_rank"), 8).select(*IDS, "filled", "place"),
    "r_merge": lambda s, d: R.first_per_page(_hits(s, d)).select(*IDS, "rank"),
    "r_scope_soft": lambda s, d: R.soft_scope(_hits(s, d), _in_scope()).select(*IDS, "inside", "any_inside"),
    "r_scope_guard": lambda s, d: R.guarded_scope(_hits(s, d), _in_scope()).select(*IDS, "applies", "inside"),
    "r_scoped": lambda s, d: _hits(s, d).join(small(_wanted(s, d)), "canonical_doc_id", "left_semi").select(*IDS, "canonical_doc_id"),
    "r_neighbors": lambda s, d: R.neighbour_pages(_hits(s, d)).select("run_id", "query_id", "source", "page", "of_rank", "nth"),
    "r_ensure": lambda s, d: R.ensure_source(_hits(s, d), _wanted(s, d)).select(*IDS, "nth", "forced_score"),
    "r_pair_sim": lambda s, d: R.similar_hits(_hits(s, d)),
    "r_ensure_entity": lambda s, d: R.ensure_entity(_hits(s, d), _keywords(s, d)).select(*IDS, "nth", "forced_semantic", "forced_keyword", "forced_score"),
    "r_dedup": lambda s, d: R.greedy_dedup(_hits(s, d)),
    "x_best_per_source": lambda s, d: R.best_per_source(_hits(s, d)).select(*IDS, "rank", F.length("cut").alias("chars")),
    "x_source_stats": lambda s, d: R.source_stats(_hits(s, d)),
    "x_caps": lambda s, d: R.nested_caps(_hits(s, d)).select(*IDS, "in_source", "place"),
    "x_multi_doc": lambda s, d: R.spread_of_sources(_hits(s, d)).select("run_id", "query_id", "sources", _r6("spread"), "several"),
    "x_pick_sources": lambda s, d: R.pick_sources(_hits(s, d), _preferred()).select("run_id", "query_id", "source", "preferred", "place"),
    "x_expand_docs": lambda s, d: R.expand_sources(_hits(s, d)).select("run_id", "hit_id", "source"),
    "x_context": lambda s, d: R.context_budget(_hits(s, d)).select(*IDS, "rank", "used"),
    "x_reorder": lambda s, d: R.reorder(_hits(s, d), F.lower("text").contains("alarm")).select(*IDS, "first", "place"),
    "x_listing": lambda s, d: R.listing(_hits(s, d)).select(*IDS, "page", "place", F.length("cut").alias("chars")),
    "x_dyn_budget": lambda s, d: R.dynamic_budget(_hits(s, d)),
}

_NUM = "CASE WHEN isnan({0}) THEN NULL ELSE {0} END AS {0}"
_H = f"""WITH h0 AS (SELECT hit_id, run_id, query_id, text, source, page, canonical_doc_id, {", ".join(_NUM.format(c) for c in ("hybrid_score", "rerank_score", "rerank_norm", "final_score"))} FROM hits),
h AS (SELECT *, row_number() OVER (PARTITION BY run_id, query_id ORDER BY final_score DESC NULLS LAST, hit_id) AS rank,
  row_number() OVER (PARTITION BY run_id, query_id ORDER BY hybrid_score DESC NULLS LAST, hit_id) AS hrank,
  row_number() OVER (PARTITION BY run_id, query_id ORDER BY rerank_score DESC NULLS LAST, hit_id) AS rrank FROM h0)"""
_WANTED = "w AS (SELECT canonical_doc_id FROM hits WHERE canonical_doc_id IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, canonical_doc_id LIMIT 3)"
_WORDS = "list_distinct(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^a-z0-9áéíóúüñ]+'), lambda x: x <> ''))"

def _keep(rows: str, k: int) -> str:
    """First k by final score without pages outside the first k by hybrid score, then the first hit of each lost page."""
    return f"""{_H}, b AS (SELECT *, lower(coalesce(source, '')) AS s_, coalesce(page, 0) AS p_, row_number() OVER (PARTITION BY run_id, query_id ORDER BY hybrid_score DESC NULLS LAST, hit_id) AS b FROM {rows}), a AS (SELECT *, row_number() OVER (PARTITION BY run_id, query_id ORDER BY final_score DESC NULLS LAST, b) AS a FROM b),
keys AS (SELECT DISTINCT run_id, query_id, s_, p_ FROM a WHERE b <= {k}), kept AS (SELECT a.* FROM a SEMI JOIN keys USING (run_id, query_id, s_, p_) WHERE a <= {k}),
lost AS (SELECT run_id, query_id, s_, p_, min(b) AS b FROM a ANTI JOIN kept USING (run_id, query_id, s_, p_) WHERE b <= {k} GROUP BY ALL), al AS (SELECT run_id, query_id, hit_id, 0 AS filled, a AS o FROM kept UNION ALL SELECT a.run_id, a.query_id, a.hit_id, 1, a.b FROM a JOIN lost USING (run_id, query_id, b)),
z AS (SELECT *, row_number() OVER (PARTITION BY run_id, query_id ORDER BY filled, o) AS place FROM al) SELECT run_id, query_id, hit_id, filled, place FROM z WHERE place <= {k}"""


SQL = {
    "r_per_source": f"{_H}, x AS (SELECT *, row_number() OVER (PARTITION BY run_id, query_id, source ORDER BY rank) AS source_rank FROM h) SELECT run_id, query_id, hit_id, rank, source_rank FROM x WHERE source_rank <= 2",
    "r_diversify": f"{_H}, x AS (SELECT *, CAST(row_number() OVER (PARTITION BY run_id, query_id, source ORDER BY rank) <= 2 AS INT) AS within FROM h), y AS (SELECT *, row_number() OVER (PARTITION BY run_id, query_id ORDER BY within DESC, rank) AS place FROM x) SELECT run_id, query_id, hit_id, within, place FROM y WHERE place <= 10",
    "r_rrf": f"{_H} SELECT run_id, query_id, hit_id, hrank AS first_rank, rrank AS second_rank, round(1.0::DOUBLE / (60 + hrank) + 1.0::DOUBLE / (60 + rrank), 6) AS rrf FROM h",
    "r_quality": f"""{_H}, x AS (SELECT *, coalesce(hybrid_score, 0) AS s, sum(CASE WHEN coalesce(hybrid_score, 0) > 0.5 THEN 1 ELSE 0 END) OVER q AS high, max(coalesce(hybrid_score, 0)) OVER q AS top, count(*) OVER q AS n FROM h WINDOW q AS (PARTITION BY run_id, query_id)),
y AS (SELECT *, CASE WHEN high >= 5 THEN 0.40::DOUBLE WHEN n < 3 AND top < 0.30 THEN 0.15::DOUBLE ELSE 0.25::DOUBLE END AS threshold FROM x) SELECT run_id, query_id, hit_id, threshold, hrank AS rank FROM y WHERE s >= threshold OR hrank <= 3""",
    "r_rerank": f"""{_H}, p AS (SELECT *, coalesce(rerank_score, 0) AS s FROM h WHERE hrank <= 15), x AS (SELECT *, max(s) OVER (PARTITION BY run_id, query_id) AS top FROM p),
y AS (SELECT *, CASE WHEN top < 0.1 THEN greatest(0.0::DOUBLE, least(1.0::DOUBLE, s / 0.1::DOUBLE)) ELSE 1 / (1 + exp(-5 * s)) END AS nn FROM x) SELECT run_id, query_id, hit_id, hrank AS rank, round(nn, 6) AS norm, round(0.7::DOUBLE * nn + (1 - 0.7::DOUBLE) * coalesce(hybrid_score, 0), 6) AS blend FROM y""",
    "r_norm_filter": f"""{_H}, q AS (SELECT item_id AS query_id, regexp_matches(lower(question), 'how many|what pressure|cuant|presi') AS numeric, len(regexp_extract_all(question, '[A-Z][a-z]{{5,}}')) AS ents FROM eval_questions),
x AS (SELECT h.*, coalesce(max(rerank_score) OVER (PARTITION BY run_id, h.query_id), 0) < 0.10::DOUBLE AS weak, coalesce(numeric, false) AS num, coalesce(ents, 0) AS ents FROM h LEFT JOIN q ON h.query_id = q.query_id),
y AS (SELECT * EXCLUDE (rank), row_number() OVER (PARTITION BY run_id, query_id ORDER BY final_score DESC NULLS LAST, hit_id) AS rank FROM x WHERE weak OR ents >= 3 OR coalesce(rerank_norm, 0) >= CASE WHEN num THEN 0.10::DOUBLE ELSE 0.15::DOUBLE END OR (num AND rank <= 2))
SELECT run_id, query_id, hit_id, weak, weak OR ents >= 3 AS free, rank FROM y WHERE rank <= 10""",
    "r_preserve": _keep("h", 5),
    "r_preserve_final": _keep("(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run_id, query_id, source ORDER BY rank) AS sr FROM h) WHERE sr <= 4)", 8),
    "r_ensure_entity": f"""{_H}, m AS (SELECT h.*, coalesce(len(list_filter(answer_keywords, lambda k: contains(lower(coalesce(text, '')), lower(k)))) > 0, false) AS named FROM h JOIN eval_questions e ON h.query_id = e.item_id WHERE len(answer_keywords) > 0),
x AS (SELECT *, max(CAST(named AND rank <= 10 AS INT)) OVER (PARTITION BY run_id, query_id) AS seen FROM m), y AS (SELECT *, row_number() OVER (PARTITION BY run_id, query_id ORDER BY rank) AS nth FROM x WHERE named AND seen = 0)
SELECT run_id, query_id, hit_id, nth, 0.75::DOUBLE AS forced_semantic, 0.0::DOUBLE AS forced_keyword, 0.72::DOUBLE AS forced_score FROM y WHERE nth <= 2""",
    "r_merge": f"{_H}, x AS (SELECT *, row_number() OVER (PARTITION BY run_id, query_id, source, page ORDER BY rank) AS nth FROM h) SELECT run_id, query_id, hit_id, rank FROM x WHERE nth = 1",
    "r_scope_soft": f"{_H}, x AS (SELECT *, CAST(coalesce(starts_with(canonical_doc_id, 'doc:anexo'), false) AS INT) AS inside FROM h), y AS (SELECT *, max(inside) OVER (PARTITION BY run_id, query_id) AS any_inside FROM x) SELECT run_id, query_id, hit_id, inside, any_inside FROM y WHERE inside = 1 OR any_inside = 0",
    "r_scope_guard": f"{_H}, x AS (SELECT *, CAST(coalesce(starts_with(canonical_doc_id, 'doc:anexo'), false) AS INT) AS inside FROM h), y AS (SELECT *, sum(inside) OVER q AS kept, count(*) OVER q AS n FROM x WINDOW q AS (PARTITION BY run_id, query_id)), z AS (SELECT *, CAST(kept >= greatest(5, n // 2) AS INT) AS applies FROM y) SELECT run_id, query_id, hit_id, applies, inside FROM z WHERE applies = 0 OR inside = 1",
    "r_scoped": f"{_H}, {_WANTED} SELECT run_id, query_id, hit_id, canonical_doc_id FROM h WHERE canonical_doc_id IN (SELECT canonical_doc_id FROM w)",
    "r_neighbors": f"""{_H}, b AS (SELECT run_id, query_id, source, page, min(rank) AS rank FROM h WHERE source IS NOT NULL AND page IS NOT NULL GROUP BY ALL),
n AS (SELECT run_id, query_id, source, p AS page, min(rank) AS of_rank FROM (SELECT run_id, query_id, source, unnest([page - 1, page + 1]) AS p, rank FROM b WHERE rank <= 10) WHERE p > 0 GROUP BY ALL),
f AS (SELECT n.* FROM n ANTI JOIN b USING (run_id, query_id, source, page)), x AS (SELECT *, row_number() OVER (PARTITION BY run_id, query_id, source ORDER BY of_rank, page) AS nth FROM f) SELECT run_id, query_id, source, page, of_rank, nth FROM x WHERE nth <= 4""",
    "r_ensure": f"""{_H}, {_WANTED}, m AS (SELECT * FROM h WHERE canonical_doc_id IN (SELECT canonical_doc_id FROM w)), p AS (SELECT DISTINCT run_id, query_id FROM m WHERE rank <= 10),
x AS (SELECT m.*, row_number() OVER (PARTITION BY m.run_id, m.query_id ORDER BY m.rank) AS nth FROM m ANTI JOIN p USING (run_id, query_id)) SELECT run_id, query_id, hit_id, nth, 0.85::DOUBLE AS forced_score FROM x WHERE nth <= 2""",
    "r_pair_sim": f"""{_H}, t AS (SELECT run_id, query_id, rank, hit_id, list_sort({_WORDS}) AS w FROM h), c AS (SELECT *, first_value(hit_id) OVER (PARTITION BY run_id, query_id, w ORDER BY rank) AS class_id FROM t), o AS (SELECT * FROM c WHERE hit_id = class_id),
l AS (SELECT a.run_id, a.query_id, a.class_id, count(*) AS links FROM o a JOIN o b ON a.run_id = b.run_id AND a.query_id = b.query_id AND a.class_id <> b.class_id
WHERE len(a.w) > 0 AND len(b.w) > 0 AND len(list_intersect(a.w, b.w))::DOUBLE / len(list_distinct(list_concat(a.w, b.w))) >= 0.85::DOUBLE GROUP BY ALL)
SELECT c.run_id, c.query_id, c.hit_id, c.class_id, coalesce(links, 0) AS links FROM c LEFT JOIN l USING (run_id, query_id, class_id)""",
    "x_best_per_source": f"{_H}, x AS (SELECT *, row_number() OVER (PARTITION BY run_id, query_id, source ORDER BY rank) AS nth FROM h) SELECT run_id, query_id, hit_id, rank, CAST(length(substr(text, 1, 800)) AS INT) AS chars FROM x WHERE nth = 1",
    "x_source_stats": f"{_H} SELECT run_id, query_id, source, max(rerank_score) AS best, count(*) AS n FROM h WHERE rank <= 20 GROUP BY ALL",
    "x_caps": f"""{_H}, x AS (SELECT *, row_number() OVER (PARTITION BY run_id, query_id, source ORDER BY final_score DESC NULLS LAST, page ASC NULLS LAST, hit_id) AS in_source FROM h), y AS (SELECT *, row_number() OVER (PARTITION BY run_id, query_id ORDER BY final_score DESC NULLS LAST, page ASC NULLS LAST, hit_id) AS place FROM x WHERE in_source <= 8) SELECT run_id, query_id, hit_id, in_source, place FROM y WHERE place <= 25""",
    "x_multi_doc": f"""{_H}, x AS (SELECT run_id, query_id, count(DISTINCT source) AS sources, max(coalesce(final_score, 0)) - min(coalesce(final_score, 0)) AS s FROM h WHERE rank <= 5 GROUP BY ALL) SELECT run_id, query_id, sources, round(s, 6) AS spread, sources >= 3 AND s < 0.3::DOUBLE AS several FROM x""",
    "x_pick_sources": f"""{_H}, b AS (SELECT run_id, query_id, source, min(rank) AS first_rank, max(CAST(contains(lower(source), 'manual') OR contains(lower(source), 'handbook') AS INT)) AS preferred FROM h WHERE rank <= 15 AND source IS NOT NULL GROUP BY ALL),
x AS (SELECT *, row_number() OVER (PARTITION BY run_id, query_id ORDER BY preferred DESC, first_rank) AS place FROM b) SELECT run_id, query_id, source, preferred, place FROM x WHERE place <= 4""",
    "x_expand_docs": f"{_H}, c AS (SELECT DISTINCT run_id, source FROM h WHERE rank <= 1 AND source IS NOT NULL) SELECT h.run_id, h.hit_id, h.source FROM h SEMI JOIN c ON h.run_id = c.run_id AND h.source = c.source",
    "x_context": f"{_H}, x AS (SELECT *, CAST(sum(length(substr(coalesce(text, ''), 1, 700))) OVER (PARTITION BY run_id, query_id ORDER BY rank ROWS UNBOUNDED PRECEDING) AS BIGINT) AS used FROM h) SELECT run_id, query_id, hit_id, rank, used FROM x WHERE used <= 6000",
    "x_reorder": f"{_H}, x AS (SELECT *, CAST(coalesce(contains(lower(text), 'alarm'), false) AS INT) AS first FROM h) SELECT run_id, query_id, hit_id, first, row_number() OVER (PARTITION BY run_id, query_id ORDER BY first DESC, rank) AS place FROM x",
    "x_listing": f"{_H}, x AS (SELECT *, row_number() OVER (PARTITION BY run_id, query_id ORDER BY page ASC NULLS LAST, hit_id) AS place FROM h) SELECT run_id, query_id, hit_id, page, place, CAST(length(substr(text, 1, 1200)) AS INT) AS chars FROM x WHERE place <= 20",
}
