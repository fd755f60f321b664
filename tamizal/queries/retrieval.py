"""Queries of lexical, vector and hybrid retrieval: the evaluation questions against all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamizal.operators import retrieval as R
from tamizal.session import small, table


def _questions(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "eval_questions").select(F.col("item_id").alias("query_id"), F.col("question").alias("text"))


def _lexical(s: SparkSession, d: str) -> DataFrame:
    return R.bm25(table(s, d, "documents").select("doc_id", "text"), _questions(s, d))


def _vectors(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "embeddings").select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").alias("v"))


def _semantic(s: SparkSession, d: str) -> DataFrame:
    """Question vectors are the vectors of the questions' ids, document vectors those of the documents' ids."""
    v = _vectors(s, d)
    asked = v.join(small(_questions(s, d).select(F.col("query_id").alias("id"))), "id", "left_semi")
    docs = v.join(table(s, d, "documents").select(F.col("doc_id").alias("id")), "id", "left_semi")
    return R.cosine_top(docs, asked)


def r_semantic(s: SparkSession, d: str) -> DataFrame:
    """Every twentieth vector as a query against all vectors."""
    v = _vectors(s, d)
    return R.cosine_top(v, v.where("id % 20 = 0")).withColumn("cosine", F.round("cosine", 6))


def r_compare(s: SparkSession, d: str) -> DataFrame:
    q = table(s, d, "eval_questions").select(F.col("item_id").alias("query_id"), F.regexp_extract_all("passage", F.lit("[A-Z][a-z]{5,}"), F.lit(0)).alias("entities"))
    scores = R.bm25(table(s, d, "documents").select("doc_id", "text"), _questions(s, d)).select("query_id", "doc_id", F.col("bm25").alias("score"))
    return R.compare_entities(table(s, d, "documents"), q, scores)


def r_ann(s: SparkSession, d: str) -> DataFrame:
    """Every twentieth vector as a query against the index of all vectors."""
    v = _vectors(s, d)
    return R.CellIndex(v).top(v.where("id % 20 = 0")).withColumn("cosine", F.round("cosine", 6))


QUERIES = {
    "t_tokens": lambda s, d: table(s, d, "documents").select("doc_id", F.size(R.content_tokens(F.col("text"))).cast("long").alias("n_tokens"), F.size(F.array_distinct(R.content_tokens(F.col("text")))).cast("long").alias("n_distinct")),
    "r_bm25_stats": lambda s, d: R.document_frequency(table(s, d, "documents")),
    "s_corpus_length": lambda s, d: R.corpus_stats(table(s, d, "documents")).select("n", F.round("avg_len", 6).alias("avg_len")),
    "r_bm25": lambda s, d: _lexical(s, d),
    "r_semantic": r_semantic,
    "r_hybrid": lambda s, d: R.hybrid(_lexical(s, d), _semantic(s, d)).select("query_id", "doc_id", F.round("bm25_norm", 6).alias("bm25_norm"), F.round("cosine", 6).alias("cosine"), "hybrid", "rank"),
    "r_retry": lambda s, d: R.hybrid(_lexical(s, d), _semantic(s, d), weight=max(0.3, round(0.6 - 0.15, 2)), top=15).select("query_id", "doc_id", "hybrid", "rank"),
    "r_compare": r_compare,
    "r_ann": r_ann,
}

_STOP = "('de', 'la', 'el', 'los', 'las', 'y', 'o', 'a', 'en', 'del', 'al', 'un', 'una', 'con', 'por', 'para', 'que', 'se', 'es', 'su', 'sus', 'lo', 'como', 'sobre', 'sin', 'entre', 'desde', 'hasta')"
_PAT = r"[a-zñáéíóúü]+(?:[./-]?[a-z0-9]+)*|\d+(?:[.,]\d+)?"
_TOK = f"list_filter(regexp_extract_all(lower(coalesce(%s, '')), '{_PAT}'), lambda t: t NOT IN {_STOP})"
_BM = f"""q AS (SELECT item_id AS query_id, unnest(list_distinct({_TOK % "question"})) AS token FROM eval_questions),
s AS (SELECT doc_id, {_TOK % "text"} AS tokens FROM documents), c AS (SELECT count(*) AS n, avg(len(tokens)) AS avg_len FROM s),
p AS (SELECT doc_id, l, token, count(*) AS tf FROM (SELECT doc_id, len(tokens) AS l, unnest(tokens) AS token FROM s) WHERE token IN (SELECT token FROM q) GROUP BY ALL),
f AS (SELECT token, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) AS i, avg_len FROM (SELECT doc_id, unnest(list_distinct(tokens)) AS token FROM s), c GROUP BY token, n, avg_len), w AS (SELECT token, CASE WHEN i < 0 THEN 0.25::DOUBLE * (SELECT avg(i) FROM f) ELSE i END AS idf, avg_len FROM f),
x AS (SELECT query_id, doc_id, round(sum(idf * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * l / avg_len))), 6) AS bm25 FROM p JOIN w USING (token) JOIN q USING (token) GROUP BY ALL),
lex AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY bm25 DESC, doc_id) AS bm25_rank FROM x) WHERE bm25_rank <= 80)"""
_COS = "round(list_inner_product(a.v, b.v) / (sqrt(list_inner_product(a.v, a.v)) * sqrt(list_inner_product(b.v, b.v))), 9)"
_VEC = "v AS (SELECT vec_id AS id, list_transform(embedding, lambda z: CAST(z AS DOUBLE)) AS v FROM embeddings)"
_SEM = f"""{_VEC}, sm AS (SELECT * FROM (SELECT a.id AS query_id, b.id AS doc_id, {_COS} AS cosine, row_number() OVER (PARTITION BY a.id ORDER BY {_COS} DESC, b.id) AS r FROM v a, v b WHERE a.id IN (SELECT item_id FROM eval_questions) AND b.id IN (SELECT doc_id FROM documents)) WHERE r <= 20)"""


def _hyb(w: str, top: int) -> str:
    return f"""WITH {_BM}, {_SEM}, b AS (SELECT query_id, doc_id, coalesce(bm25, 0) AS bm25, coalesce(cosine, 0) AS cosine FROM lex FULL OUTER JOIN sm USING (query_id, doc_id)),
n AS (SELECT *, bm25 / CASE WHEN max(bm25) OVER (PARTITION BY query_id) > 0 THEN max(bm25) OVER (PARTITION BY query_id) ELSE 1.0 END AS bn FROM b),
h AS (SELECT query_id, doc_id, bn, cosine, round({w}::DOUBLE * cosine + (1 - {w}::DOUBLE) * bn, 5) AS hybrid FROM n), o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY hybrid DESC, doc_id) AS rank FROM h WHERE true QUALIFY rank <= {top})"""


SQL = {
    "t_tokens": f"SELECT doc_id, len(t) AS n_tokens, len(list_distinct(t)) AS n_distinct FROM (SELECT doc_id, {_TOK % 'text'} AS t FROM documents)",
    "r_bm25_stats": f"SELECT token, count(*) AS df FROM (SELECT doc_id, unnest(list_distinct({_TOK % 'text'})) AS token FROM documents) GROUP BY 1",
    "s_corpus_length": f"SELECT count(*) AS n, round(avg(len({_TOK % 'text'})), 6) AS avg_len FROM documents",
    "r_bm25": f"WITH {_BM} SELECT query_id, doc_id, bm25, bm25_rank FROM lex",
    "r_semantic": f"WITH {_VEC} SELECT query_id, doc_id, round(cosine, 6) AS cosine, cosine_rank FROM (SELECT a.id AS query_id, b.id AS doc_id, {_COS} AS cosine, row_number() OVER (PARTITION BY a.id ORDER BY {_COS} DESC, b.id) AS cosine_rank FROM v a, v b WHERE a.id % 20 = 0) WHERE cosine_rank <= 20",
    "r_hybrid": _hyb("0.6", 10) + " SELECT query_id, doc_id, round(bn, 6) AS bm25_norm, round(cosine, 6) AS cosine, hybrid, rank FROM o",
    "r_retry": _hyb("0.45", 15) + " SELECT query_id, doc_id, hybrid, rank FROM o",
    "r_compare": f"""WITH {_BM}, e0 AS (SELECT item_id AS query_id, list_distinct(regexp_extract_all(passage, '[A-Z][a-z]{{5,}}')) AS e FROM eval_questions), e1 AS (SELECT query_id, greatest(1, 9 // len(e)) AS part, unnest(e) AS entity FROM e0 WHERE len(e) >= 2),
t AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '{_PAT}'))) AS token FROM documents), z AS (SELECT e1.query_id, entity, part, t.doc_id, bm25 AS score, row_number() OVER (PARTITION BY e1.query_id, entity ORDER BY bm25 DESC, t.doc_id) AS place FROM e1 JOIN t ON t.token = lower(entity) JOIN lex ON lex.query_id = e1.query_id AND lex.doc_id = t.doc_id) SELECT query_id, entity, doc_id, score, place FROM z WHERE place <= part""",
}
