"""Queries of evaluation over the search hits and the evaluation questions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tamizal.functions.text import fold
from tamizal.operators import evaluation as V
from tamizal.operators.ranking import SEARCH, number, ranked
from tamizal.session import small, table


def _hits(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "hits")


def _questions(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "eval_questions").withColumnRenamed("item_id", "query_id")


def _metrics(s: SparkSession, d: str) -> DataFrame:
    return V.retrieval_metrics(_hits(s, d), _questions(s, d))


def _answers(s: SparkSession, d: str) -> DataFrame:
    """The best hit's text stands for the answer, the next four for its context; id is the best hit's."""
    few = ranked(_hits(s, d)).where("rank <= 5 and text is not null")
    return few.groupBy(*SEARCH).agg(
        F.max(F.when(F.col("rank") == 1, F.col("hit_id"))).alias("id"), F.max(F.when(F.col("rank") == 1, F.col("text"))).alias("answer"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("rank") > 1, F.struct("rank", "text")))), lambda x: x["text"]), "\n").alias("context"),
    ).where("id is not null")


_RATES = ("doc_hit", "page_hit", "recall_1", "recall_3", "recall_5", "recall", "mrr", "precision", "precision_distinct")


def _rates():
    return [F.count("*").alias("n"), *[F.round(F.avg(c), 6).alias(c) for c in _RATES]]


def v_summary(s, d):
    m = _metrics(s, d).join(small(_questions(s, d).select("query_id", "category")), "query_id")
    return m.groupingSets([["category"], []], "category").agg(*_rates())


def v_by_run(s, d):
    m = _metrics(s, d)
    median = V.order_statistics(m, ["run_id"], "first_rank", {"low": lambda n: F.floor((n + 1) / 2), "up": lambda n: F.floor(n / 2) + 1})
    return m.groupBy("run_id").agg(*_rates()).join(median, "run_id", "left").select("run_id", "n", *_RATES, ((F.col("low") + F.col("up")) / 2).alias("median_rank"))


def v_ranks(s, d):
    """How often the first relevant hit has each place, per category."""
    m = _metrics(s, d).join(small(_questions(s, d).select("query_id", "category")), "query_id")
    return m.where("first_rank is not null").groupBy("category", "first_rank").agg(F.count("*").alias("n"))


def _verified(s, d):
    return V.verify(_checked(s, d)).select("id", F.col("passed").alias("verified"))


def v_layers(s, d):
    """Pass rates of the layers of answers, per category and over all."""
    m = V.answer_layers(_answers(s, d).join(_verified(s, d), "id"), _questions(s, d))
    rate = lambda c, when=F.lit(True): F.round(F.avg(F.when(when, F.col(c).cast("int"))), 6)
    none = ~F.col("is_answerable")
    return m.groupingSets([["category"], []], "category").agg(
        F.count("*").alias("n"), rate("passed").alias("passed"), rate("passed", F.col("is_answerable")).alias("passed_answerable"), rate("passed", none).alias("passed_no_answer"), rate("pass_groundedness").alias("groundedness"),
        rate("pass_generation").alias("generation"), rate("pass_hallucination", none).alias("hallucination"), F.round(F.avg("keyword_score"), 6).alias("keyword_score"),
    )


def v_prepost_summary(s, d):
    """How reranking moves the first relevant hit, per category; searches found both before and after are the core."""
    m = V.before_and_after(_hits(s, d), _questions(s, d)).join(small(_questions(s, d).select("query_id", "category")), "query_id")
    core = F.col("before").isNotNull() & F.col("after").isNotNull()
    n = lambda c: F.count_if(F.col("change") == c)
    return m.groupBy("category").agg(F.count("*").alias("n"), F.count_if(core).alias("core"), n("better").alias("better"), n("worse").alias("worse"), F.round(F.avg(F.when(core, F.col("after") - F.col("before"))), 6).alias("mean_change"))


def v_latency(s, d):
    rows = _hits(s, d).select("run_id", F.timestamp_diff("SECOND", "searched_at", "logged_at").alias("lag_s"))
    return V.nearest_percentile(rows, ["run_id"], "lag_s", 0.95, "p95")


def v_keywords(s, d):
    """Share of expected words in the answers, and forbidden ones."""
    a = _answers(s, d).join(small(_questions(s, d).select("query_id", "answer_keywords", "must_not_contain")), "query_id")
    text = fold(F.col("answer"))
    has = lambda c: F.size(F.filter(c, lambda k: F.contains(text, fold(k))))
    n = F.size(F.coalesce("answer_keywords", F.array().cast("array<string>")))
    return a.select("id", F.when(n > 0, F.round(has("answer_keywords") / n, 6)).alias("keyword_score"), F.coalesce(has("must_not_contain"), F.lit(0)).alias("forbidden"))


def v_readiness(s, d):
    q = _questions(s, d).withColumn("status", F.when(~F.col("is_answerable"), "negative").when(F.size("expected_sources") == 0, "no sources").when(F.exists("expected_pages", lambda p: p.isNull()), "pages missing").otherwise("ready"))
    asked = _hits(s, d).select("query_id").groupBy("query_id").agg(F.count("*").alias("hits"))
    return q.join(asked, "query_id", "left").groupBy("status").agg(F.count("*").alias("items"), F.coalesce(F.sum("hits"), F.lit(0)).alias("hits"))


def v_canonical(s, d):
    """Coverage of the expected documents by those found, per search."""
    q = _questions(s, d).select("query_id", F.array_distinct(F.transform("expected_sources", lambda x: V.stem(x))).alias("expected")).where("size(expected) > 0")
    seen = _hits(s, d).where("source is not null").groupBy(*SEARCH).agg(F.collect_set(V.stem(F.col("source"))).alias("found"))
    return seen.join(small(q), "query_id").select(*SEARCH, F.round(V.coverage(seen, "expected", "found"), 6).alias("coverage"))


def e_signals(s, d):
    return V.evidence_signals(_hits(s, d)).select(*SEARCH, "n", "sources", "chars", "good", F.round("density", 6).alias("density"))


def _covered(s, d):
    return V.entity_coverage(_hits(s, d), _questions(s, d).select("query_id", F.col("answer_keywords").alias("entities")))


def _assessed(s, d):
    """No evaluation question is of a factual type, so that this gate lets all pass."""
    signals = V.evidence_signals(_hits(s, d)).join(_covered(s, d), list(SEARCH), "left")
    return V.assess(signals.withColumn("factual", F.lit(True)))


def e_evidence_gate(s, d):
    kind = F.lower("question").rlike("que es|qué es|certificacion|certificación|framework|explica por qué|diferencias entre|what is|which")
    signals = V.evidence_signals(_hits(s, d)).join(_covered(s, d), list(SEARCH), "left").join(small(_questions(s, d).select("query_id", kind.alias("reasoning"))), "query_id")
    return V.evidence_gate(signals).select(*SEARCH, "reason", "decision")


def _checked(s, d):
    """Answers with what their claims are checked against: the context, ten results; every second search counts as assessed."""
    return _answers(s, d).withColumns({"n_results": F.lit(10), "assess_passed": (F.col("id") % 2 == 0)})


def e_claims(s, d):
    return V.claim_support(_checked(s, d))


def e_hedge(s, d):
    text = fold(F.col("answer"))
    declined = F.exists(F.array(*[F.lit(h) for h in V.DECLINES]), lambda h: F.contains(text, h))
    phrase = V.hedge_of(F.col("answer"))
    return _answers(s, d).select("id", phrase.alias("phrase"), phrase.isNotNull().cast("int").alias("hedge"), declined.cast("int").alias("declined"))


def e_risk(s, d):
    """Versions and numbers of the answers that their context must hold, and those it lacks."""
    risk = V.risk_tokens(F.col("answer"))
    return _answers(s, d).select("id", F.size(risk).alias("tokens"), F.size(F.filter(risk, lambda t: ~F.contains(F.lower("context"), F.lower(t)))).alias("missing"))


def e_policy(s, d):
    a = _assessed(s, d)
    return V.decisions(a.withColumns({"llm_calls": F.col("run_id") % 4, "retry_count": F.col("query_id") % 2, "repair_count": (F.col("query_id") % 3).cast("int")})).select(*SEARCH, "gate", "score", "decision")


def e_entity_hits(s, d):
    """Hits whose text has a word of the question's expected answer; all hits of a search where none has."""
    q = _questions(s, d).select("query_id", "answer_keywords")
    m = ranked(_hits(s, d)).join(small(q), "query_id")
    flag = F.coalesce(F.exists("answer_keywords", lambda k: F.contains(F.lower(F.coalesce("text", F.lit(""))), F.lower(k))), F.lit(False)).cast("int")
    m = m.withColumn("mentions", flag).withColumn("any_mention", F.max("mentions").over(Window.partitionBy(*SEARCH)))
    return m.where("mentions = 1 or any_mention = 0").select(*SEARCH, "hit_id", "mentions")


QUERIES = {
    "v_page_hit": lambda s, d: V.relevance(_hits(s, d), _questions(s, d)).select(*SEARCH, "hit_id", "rank", "nth", "page_hit"),
    "v_retrieval": _metrics,
    "v_summary": v_summary,
    "v_by_run": v_by_run,
    "v_ranks": v_ranks,
    "v_layers": v_layers,
    "v_prepost_summary": v_prepost_summary,
    "v_prepost": lambda s, d: V.before_and_after(_hits(s, d), _questions(s, d)),
    "v_pool_class": lambda s, d: V.relevance(_hits(s, d), _questions(s, d)).select(*SEARCH, "hit_id", V.pool_class(F.col("rank")).alias("pool")),
    "v_latency": v_latency,
    "v_keywords": v_keywords,
    "v_readiness": v_readiness,
    "v_canonical": v_canonical,
    "e_signals": e_signals,
    "e_assess": lambda s, d: _assessed(s, d).select(*SEARCH, "gate", "score"),
    "e_evidence_gate": e_evidence_gate,
    "e_claims": lambda s, d: e_claims(s, d).withColumn("share", F.round("share", 6)),
    "e_claim_status": lambda s, d: e_claims(s, d).groupBy("status").agg(F.count("*").alias("n")),
    "e_ground": lambda s, d: V.groundedness(e_claims(s, d)),
    "e_hedge": e_hedge,
    "e_verify": lambda s, d: V.verify(_checked(s, d)),
    "e_risk": e_risk,
    "e_policy": e_policy,
    "x_entity_hits": e_entity_hits,
    "e_best_scores": lambda s, d: _hits(s, d).groupBy(*SEARCH).agg(F.max(number("final_score")).alias("best"), F.max_by("hit_id", F.struct(F.coalesce(number("final_score"), F.lit(-1.0)), -F.col("hit_id"))).alias("hit_id")),
}

_FOLD = r"trim(regexp_replace(lower(strip_accents(%s)), '[\s\x{1c}-\x{1f}\x{85}\pZ]+', ' ', 'g'))"
_STEM = r"regexp_replace(" + _FOLD + r", '\.[a-z][a-z0-9]{0,4}$', '')"
_H = """h0 AS (SELECT hit_id, run_id, query_id, text, source, page, """ + ", ".join(f"CASE WHEN isnan({c}) THEN NULL ELSE {c} END AS {c}" for c in ("hybrid_score", "rerank_score", "final_score")) + """ FROM hits),
h AS (SELECT *, row_number() OVER (PARTITION BY run_id, query_id ORDER BY final_score DESC NULLS LAST, hit_id) AS rank, row_number() OVER (PARTITION BY run_id, query_id ORDER BY hybrid_score DESC NULLS LAST, hit_id) AS hrank, row_number() OVER (PARTITION BY run_id, query_id ORDER BY rerank_score DESC NULLS LAST, hit_id) AS rrank FROM h0)"""
_REL = f"""WITH {_H}, w0 AS (SELECT item_id AS query_id, unnest(range(len(expected_sources))) AS nth, expected_sources, expected_pages FROM eval_questions), w AS (SELECT query_id, CAST(nth AS INT) AS nth, lower(expected_sources[nth + 1]) AS name, expected_pages[nth + 1] AS pages FROM w0),
r AS (SELECT h.run_id, h.query_id, h.hit_id, h.rank, h.hrank, h.rrank, w.nth, CASE WHEN pages IS NULL THEN NULL WHEN len(pages) = 0 THEN true ELSE coalesce(len(list_filter(pages, lambda p: abs(p - coalesce(h.page, 0)) <= 2)) > 0, false) END AS page_hit
FROM h JOIN w ON h.query_id = w.query_id AND trim(h.source) <> '' AND trim(w.name) <> '' AND (contains(lower(h.source), w.name) OR contains(w.name, lower(h.source))))"""
_MET = _REL + """, p AS (SELECT run_id, query_id, min(rank) AS first_rank, count(DISTINCT nth) AS found, count(*) AS relevant, count(DISTINCT rank) AS places, max(CAST(coalesce(page_hit, false) AS INT)) AS page_hit FROM r WHERE rank <= 10 GROUP BY ALL),
s AS (SELECT run_id, h.query_id, any_value(len(expected_sources)) AS expected, any_value(category) AS category, least(count(*), 10) AS k FROM h JOIN eval_questions e ON h.query_id = e.item_id WHERE is_answerable AND len(expected_sources) > 0 GROUP BY ALL),
m AS (SELECT s.run_id, s.query_id, category, CAST(first_rank IS NOT NULL AS INT) AS doc_hit, coalesce(page_hit, 0) AS page_hit, first_rank, round(coalesce(1.0::DOUBLE / first_rank, 0.0::DOUBLE), 3) AS mrr, round(coalesce(found, 0)::DOUBLE / expected, 3) AS recall, round(coalesce(relevant, 0)::DOUBLE / k, 3) AS precision,
round(coalesce(places, 0)::DOUBLE / k, 3) AS precision_distinct, coalesce(CAST(first_rank <= 1 AS INT), 0) AS recall_1, coalesce(CAST(first_rank <= 3 AS INT), 0) AS recall_3, coalesce(CAST(first_rank <= 5 AS INT), 0) AS recall_5 FROM s LEFT JOIN p USING (run_id, query_id))"""
_AVG = "count(*) AS n, " + ", ".join(f"round(avg({c}), 6) AS {c}" for c in ("doc_hit", "page_hit", "recall_1", "recall_3", "recall_5", "recall", "mrr", "precision", "precision_distinct"))
_ANS = f"""WITH {_H}, ans AS (SELECT run_id, query_id, max(CASE WHEN rank = 1 THEN hit_id END) AS id, max(CASE WHEN rank = 1 THEN text END) AS answer, coalesce(string_agg(text, chr(10) ORDER BY rank) FILTER (rank > 1), '') AS context FROM h WHERE rank <= 5 AND text IS NOT NULL GROUP BY ALL HAVING id IS NOT NULL)"""
_WDS = "list_distinct(regexp_extract_all(lower(%s), '[a-z0-9áéíóúüñ]{3,}'))"
_STOP_ = "('de', 'la', 'el', 'en', 'y', 'a', 'que', 'es', 'se', 'del', 'las', 'los', 'un', 'una', 'con', 'por', 'para', 'su', 'al', 'lo', 'como', 'mas', 'pero', 'sus', 'le', 'ya', 'o', 'este', 'si', 'porque', 'esta', 'entre', 'cuando', 'the', 'an', 'of', 'in', 'on', 'for', 'to', 'and', 'is', 'are', 'was', 'were', 'be', 'been', 'with', 'by', 'at', 'from', 'it', 'this', 'that')"
_CT = r"list_filter(regexp_extract_all(lower(coalesce(%s, '')), '[\p{L}\p{N}_]{3,}'), lambda x: x NOT IN " + _STOP_ + ")"
_HEDGES = "['no se menciona', 'no se encuentra', 'no hay informacion', 'no hay evidencia', 'no se proporciona', 'no se contiene', 'no existe', 'no se documenta', 'no esta disponible', 'no tengo informacion', 'no encontre', 'no hay datos', 'no hay documentos', 'no hay suficiente', 'insuficiente', 'fuera de mi alcance', 'fuera del alcance', 'no puedo responder', 'no dispongo']"
_HG = "list_filter(" + _HEDGES + ", lambda p: contains(lower(%s), p))"
_CITE = r"list_transform(regexp_extract_all(%s, '(?i)\[(?:Doc\s+)?(\d+)[^\]]*\]', 1), lambda z: TRY_CAST(z AS INT))"
# RE2 has no look-behind: numbers are cut out as whole words first
_BARE = r"regexp_replace(%s, '(?i)\[(?:Doc\s+)?(\d+)[^\]]*\]', ' ', 'g')"
_RISK = "list_distinct(list_concat(regexp_extract_all(" + _BARE + r", 'v?\d+\.\d+(?:\.\d+)*'), list_filter(regexp_extract_all(" + _BARE + r", '[\p{L}\p{N}_]+'), lambda z: regexp_full_match(z, '\d+'))))"
_RISK2 = _RISK.replace("%s", "{0}").replace("{3,}", "{{3,}}").replace(r"\p{L}\p{N}", r"\p{{L}}\p{{N}}").format
_CL = _ANS + rf""", c0 AS (SELECT id, id % 2 = 0 AS ap, lower(context) AS context, list_filter(list_transform(string_split(regexp_replace(regexp_replace(answer, '([.!?])\s+', '\1' || chr(1), 'g'), '\n+', chr(1), 'g'), chr(1)), lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(13))), lambda x: x <> '') AS cl, answer FROM ans),
c1 AS (SELECT *, unnest(range(greatest(len(cl), 1))) AS k FROM c0), c2 AS (SELECT id, ap, context, CAST(k AS INT) AS claim_no, coalesce(cl[k + 1], trim(answer)) AS claim FROM c1),
c3 AS (SELECT *, {_CITE % 'claim'} AS cited, {_RISK2('claim')} AS risk, {_CT % 'claim'} AS tok, list_distinct({_CT % 'context'}) AS known, len({_HG % 'claim'}) > 0 AS hg FROM c2),
c4 AS (SELECT *, CASE WHEN len(tok) > 0 THEN len(list_filter(tok, lambda t: list_contains(known, t)))::DOUBLE / len(tok) ELSE 0.0::DOUBLE END AS share FROM c3),
cs AS (SELECT id, claim_no, share, CASE WHEN hg AND ap THEN 'contradicted' WHEN len(cited) > 0 AND len(list_filter(cited, lambda z: z >= 1 AND z <= 10)) = 0 THEN 'contradicted' WHEN len(list_filter(risk, lambda t: NOT contains(context, lower(t)))) > 0 THEN 'unsupported'
WHEN share >= CASE WHEN len(risk) > 0 THEN 0.5::DOUBLE ELSE 0.15::DOUBLE END THEN 'supported' ELSE 'weakly_supported' END AS status FROM c4),
gr AS (SELECT id, count(*) AS claims, ['supported', 'weakly_supported', 'unsupported', 'contradicted'][max(CASE status WHEN 'contradicted' THEN 3 WHEN 'unsupported' THEN 2 WHEN 'weakly_supported' THEN 1 ELSE 0 END) + 1] AS verdict FROM cs GROUP BY id),
v0 AS (SELECT ans.id, run_id, query_id, answer, trim(answer) AS a, ans.id % 2 = 0 AS ap, {_CT % 'answer'} AS tok, list_distinct({_CT % 'context'}) AS known, {_CITE % 'answer'} AS cited, len({_HG % 'trim(answer)'}) > 0 AS hg, claims, verdict FROM ans LEFT JOIN gr ON ans.id = gr.id),
v1 AS (SELECT *, CASE WHEN len(tok) > 0 THEN len(list_filter(tok, lambda t: list_contains(known, t)))::DOUBLE / len(tok) ELSE 0.0::DOUBLE END AS ratio, len(list_filter(cited, lambda z: z >= 1 AND z <= 10)) AS valid FROM v0),
v2 AS (SELECT *, CASE WHEN length(a) = 0 THEN 'empty' WHEN length(a) < 10 THEN 'short' WHEN hg AND ap THEN 'unjustified hedge' WHEN hg THEN 'hedge' WHEN verdict IN ('contradicted', 'unsupported') THEN verdict WHEN len(cited) > 0 AND valid = 0 THEN 'no valid citation' ELSE 'supported' END AS reason FROM v1),
vf AS (SELECT *, CASE WHEN reason IN ('empty', 'short', 'unjustified hedge') THEN 0.0::DOUBLE WHEN reason = 'hedge' THEN 0.5::DOUBLE WHEN reason IN ('contradicted', 'unsupported') THEN ratio WHEN reason = 'no valid citation' THEN ratio * 0.5::DOUBLE ELSE least(1.0::DOUBLE, ratio + CASE WHEN len(cited) > 0 AND valid = len(cited) THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END) END AS signal, reason IN ('hedge', 'supported') AS passed FROM v2)"""
_DECLINED = f"len(list_filter(['no encontre', 'no hay informacion', 'not found', 'no information', 'cannot answer', 'no puedo responder'], lambda p: contains({_FOLD % 'answer'}, p))) > 0"
_LAYERS = _CL + f""", kq AS (SELECT vf.*, category, is_answerable, coalesce(len(answer_keywords), 0) AS n, coalesce(len(list_filter(answer_keywords, lambda k: contains({_FOLD % 'answer'}, {_FOLD % 'k'}))), 0) AS hit, coalesce(len(list_filter(must_not_contain, lambda k: contains({_FOLD % 'answer'}, {_FOLD % 'k'}))), 0) AS bad, {_DECLINED} AS dec FROM vf JOIN eval_questions e ON vf.query_id = e.item_id),
ks AS (SELECT *, CASE WHEN n > 0 THEN round(hit::DOUBLE / n, 3) ELSE 1.0::DOUBLE END AS score FROM kq), kl AS (SELECT *, bad = 0 AND passed AS g, NOT is_answerable OR score >= 0.3::DOUBLE AS gen, is_answerable OR (dec AND bad = 0) AS hal FROM ks), ka AS (SELECT *, g AND gen AND hal AS ok FROM kl)"""
_SIG = f"""WITH {_H}, f AS (SELECT *, {_CT % 'text'} AS ws, coalesce(final_score, rerank_score, 0.5::DOUBLE * hybrid_score, 0) AS q FROM h),
t AS (SELECT run_id, query_id, count(DISTINCT word)::DOUBLE / count(*) AS density FROM (SELECT run_id, query_id, unnest(ws) AS word FROM f) GROUP BY ALL),
sg AS (SELECT f.run_id, f.query_id, count(*) AS n, count(DISTINCT CASE WHEN source <> '' THEN lower(source) END) AS sources, CAST(sum(length(trim(coalesce(text, '')))) AS BIGINT) AS chars, max(rerank_score) AS br, coalesce(max(hybrid_score), 0) AS bh, coalesce(max(final_score), 0) AS bf, count(*) FILTER (q > 0.15::DOUBLE) AS good, coalesce(max(density), 0) AS density FROM f LEFT JOIN t ON f.run_id = t.run_id AND f.query_id = t.query_id GROUP BY ALL),
en AS (SELECT item_id AS query_id, nth, list_filter(regexp_split_to_array(lower(trim(answer_keywords[nth + 1])), '\\s+'), lambda w: length(w) > 2) AS ws FROM (SELECT item_id, answer_keywords, unnest(range(len(answer_keywords))) AS nth FROM eval_questions)),
ew AS (SELECT run_id, h.query_id, nth, len(ws) AS n, unnest(range(len(ws))) AS pos, ws, lower(coalesce(text, '')) AS tx FROM h JOIN en ON h.query_id = en.query_id WHERE len(ws) > 0),
es AS (SELECT run_id, query_id, nth, n, pos, max(CAST(contains(tx, ws[pos + 1]) AS INT)) AS seen FROM ew GROUP BY ALL), ee AS (SELECT run_id, query_id, nth, n, sum(seen) AS seen FROM es GROUP BY ALL), cv AS (SELECT run_id, query_id, count(*) FILTER (seen >= greatest(1, n // 2)) AS covered, count(*) AS total FROM ee GROUP BY ALL),
g AS (SELECT sg.*, coalesce(covered, 0) AS covered, coalesce(total, 0) AS total, CASE WHEN n = 0 THEN 'no hits' WHEN chars < 30 THEN 'too short' WHEN coalesce(br < 0.1::DOUBLE AND bh <= 0.5::DOUBLE AND bf <= 0.5::DOUBLE, false) THEN 'weak' WHEN coalesce(total, 0) > 0 AND coalesce(covered, 0) = 0 THEN 'no entity' ELSE 'pass' END AS gate FROM sg LEFT JOIN cv ON sg.run_id = cv.run_id AND sg.query_id = cv.query_id),
a AS (SELECT *, round(CASE gate WHEN 'pass' THEN least(1.0::DOUBLE, 0.2::DOUBLE + 0.1::DOUBLE * good + least(0.4::DOUBLE, chars / 8000) + CASE WHEN total > 0 THEN least(0.15::DOUBLE, covered / total * 0.15::DOUBLE) ELSE 0 END + least(0.1::DOUBLE, sources * 0.03::DOUBLE) + least(0.05::DOUBLE, density * 0.05::DOUBLE)) WHEN 'weak' THEN br ELSE 0.0::DOUBLE END, 6) AS score FROM g)"""

SQL = {
    "v_page_hit": _REL + " SELECT run_id, query_id, hit_id, rank, nth, page_hit FROM r",
    "v_retrieval": _MET + " SELECT run_id, query_id, doc_hit, page_hit, first_rank, mrr, recall, precision, precision_distinct, recall_1, recall_3, recall_5 FROM m",
    "v_summary": _MET + f" SELECT category, {_AVG} FROM m GROUP BY GROUPING SETS ((category), ())",
    "v_by_run": _MET + f" SELECT run_id, {_AVG}, quantile_cont(first_rank, 0.5)::DOUBLE AS median_rank FROM m GROUP BY run_id",
    "v_ranks": _MET + " SELECT category, first_rank, count(*) AS n FROM m WHERE first_rank IS NOT NULL GROUP BY ALL",
    "v_layers": _LAYERS + """ SELECT category, count(*) AS n, round(avg(ok::INT), 6) AS passed, round(avg(ok::INT) FILTER (is_answerable), 6) AS passed_answerable, round(avg(ok::INT) FILTER (NOT is_answerable), 6) AS passed_no_answer, round(avg(g::INT), 6) AS groundedness, round(avg(gen::INT), 6) AS generation,
round(avg(hal::INT) FILTER (NOT is_answerable), 6) AS hallucination, round(avg(score), 6) AS keyword_score FROM ka GROUP BY GROUPING SETS ((category), ())""",
    "v_prepost_summary": _REL + ", b AS (SELECT run_id, query_id, min(hrank) AS x, min(rrank) AS y FROM r GROUP BY ALL) SELECT category, count(*) AS n, count(*) AS core, count(*) FILTER (y < x) AS better, count(*) FILTER (y > x) AS worse, round(avg(y - x), 6) AS mean_change FROM b JOIN eval_questions e ON b.query_id = e.item_id GROUP BY category",
    "v_prepost": _REL + " SELECT run_id, query_id, min(hrank) AS before, min(rrank) AS after, CASE WHEN min(rrank) < min(hrank) THEN 'better' WHEN min(rrank) > min(hrank) THEN 'worse' ELSE 'same' END AS change FROM r GROUP BY ALL",
    "v_pool_class": _REL + " SELECT run_id, query_id, hit_id, CASE WHEN rank <= 10 THEN 'top10' WHEN rank <= 35 THEN 'pool35' WHEN rank <= 75 THEN 'pool75' ELSE 'out' END AS pool FROM r",
    "v_latency": "WITH x AS (SELECT run_id, CAST(trunc(epoch_us(logged_at - searched_at) / 1000000) AS BIGINT) AS v FROM hits), y AS (SELECT *, count(*) OVER (PARTITION BY run_id) AS n, row_number() OVER (PARTITION BY run_id ORDER BY v) AS i FROM x WHERE v IS NOT NULL) SELECT run_id, v AS p95 FROM y WHERE i = least(CAST(floor(n * 0.95::DOUBLE) AS BIGINT), n - 1) + 1",
    "v_keywords": _ANS + f" SELECT id, CASE WHEN len(answer_keywords) > 0 THEN round(len(list_filter(answer_keywords, lambda k: contains({_FOLD % 'answer'}, {_FOLD % 'k'})))::DOUBLE / len(answer_keywords), 6) END AS keyword_score, coalesce(len(list_filter(must_not_contain, lambda k: contains({_FOLD % 'answer'}, {_FOLD % 'k'}))), 0) AS forbidden FROM ans JOIN eval_questions e ON ans.query_id = e.item_id",
    "v_readiness": "WITH q AS (SELECT item_id, CASE WHEN NOT is_answerable THEN 'negative' WHEN len(expected_sources) = 0 THEN 'no sources' WHEN len(list_filter(expected_pages, lambda p: p IS NULL)) > 0 THEN 'pages missing' ELSE 'ready' END AS status FROM eval_questions), a AS (SELECT query_id, count(*) AS hits FROM hits GROUP BY 1) SELECT status, count(*) AS items, CAST(coalesce(sum(hits), 0) AS BIGINT) AS hits FROM q LEFT JOIN a ON q.item_id = a.query_id GROUP BY status",
    "v_canonical": f"WITH {_H}, q AS (SELECT item_id AS query_id, list_distinct(list_transform(expected_sources, lambda z: {_STEM % 'z'})) AS expected FROM eval_questions), s AS (SELECT run_id, query_id, list_distinct(list({_STEM % 'source'})) AS found FROM h WHERE source IS NOT NULL GROUP BY ALL) SELECT run_id, query_id, round(len(list_intersect(expected, found))::DOUBLE / len(expected), 6) AS coverage FROM s JOIN q USING (query_id) WHERE len(expected) > 0",
    "e_signals": _SIG + " SELECT run_id, query_id, n, sources, chars, good, round(density, 6) AS density FROM sg",
    "e_assess": _SIG + " SELECT run_id, query_id, gate, score FROM a",
    "e_evidence_gate": _SIG + " , k AS (SELECT a.*, regexp_matches(lower(question), 'que es|qué es|certificacion|certificación|framework|explica por qué|diferencias entre|what is|which') AS rq FROM a JOIN eval_questions e ON a.query_id = e.item_id), z AS (SELECT *, CASE WHEN total = 0 OR covered > 0 THEN 'entity' WHEN good >= 5 THEN 'enough' WHEN good >= 3 THEN 'borderline' WHEN chars > 2000 THEN 'context' WHEN rq AND good >= 1 THEN 'reasoning' ELSE 'none' END AS reason FROM k) SELECT run_id, query_id, reason, CASE WHEN reason = 'none' THEN 'decline' ELSE 'pass' END AS decision FROM z",
    "e_claims": _CL + " SELECT id, claim_no, round(share, 6) AS share, status FROM cs",
    "e_claim_status": _CL + " SELECT status, count(*) AS n FROM cs GROUP BY 1",
    "e_ground": _CL + " SELECT id, claims, verdict FROM gr",
    "e_hedge": _ANS + f" SELECT id, ({_HG % 'answer'})[1] AS phrase, CAST(len({_HG % 'answer'}) > 0 AS INT) AS hedge, CAST({_DECLINED} AS INT) AS declined FROM ans",
    "e_verify": _CL + " SELECT id, claims, verdict, round(ratio, 6) AS ratio, round(signal, 6) AS signal, passed, reason FROM vf",
    "e_risk": _ANS + f", x AS (SELECT id, lower(context) AS context, {_RISK2('answer')} AS r FROM ans) SELECT id, CAST(len(r) AS INT) AS tokens, CAST(len(list_filter(r, lambda t: NOT contains(context, lower(t)))) AS INT) AS missing FROM x",
    "e_policy": _SIG + " SELECT run_id, query_id, gate, score, CASE WHEN gate IN ('no hits', 'factual', 'no entity') THEN 'decline' WHEN gate = 'weak' AND query_id % 2 < 1 AND run_id % 4 < 3 THEN 'retry' WHEN gate <> 'pass' THEN 'decline' WHEN score < 0.5::DOUBLE AND query_id % 3 < 1 AND run_id % 4 < 3 THEN 'repair' ELSE 'answer' END AS decision FROM a",
    "x_entity_hits": f"WITH {_H}, m AS (SELECT h.run_id, h.query_id, hit_id, CAST(coalesce(len(list_filter(answer_keywords, lambda k: contains(lower(coalesce(text, '')), lower(k)))) > 0, false) AS INT) AS mentions FROM h JOIN eval_questions e ON h.query_id = e.item_id), x AS (SELECT *, max(mentions) OVER (PARTITION BY run_id, query_id) AS am FROM m) SELECT run_id, query_id, hit_id, mentions FROM x WHERE mentions = 1 OR am = 0",
    "e_best_scores": f"WITH {_H} SELECT run_id, query_id, max(final_score) AS best, arg_max(hit_id, {{'s': coalesce(final_score, -1.0::DOUBLE), 'h': -hit_id}}) AS hit_id FROM h GROUP BY ALL",
}
