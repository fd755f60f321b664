"""Queries of evidence gates, cleaning, glossaries, relations and simulation verdicts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tamizal.operators import language as L
from tamizal.operators.ranking import SEARCH, ranked
from tamizal.session import small, table


def _t(name):
    return lambda s, d: table(s, d, name)


DOCS, HITS, ALIASES, CLAIMS, ITEMS = _t("documents"), _t("hits"), _t("alias_claims"), _t("entity_claims"), _t("eval_questions")


def _questions(s, d):
    return ITEMS(s, d).withColumnRenamed("item_id", "query_id")


def t_glossary(s, d):
    terms = CLAIMS(s, d).select(F.explode("entity_types").alias("t")).where("t is not null").select(F.lower("t").alias("term"))
    return L.glossary(DOCS(s, d), terms)


def k_pred_audit(s, d):
    r = L.relations(ALIASES(s, d))
    return r.groupBy("origin", "predicate").agg(F.count("*").alias("n"), F.count_if(F.col("subject") == F.col("object")).alias("self")).withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6))


def c_infer_entity(s, d):
    """Documents that name the person or place of a question's keywords."""
    words = ITEMS(s, d).select("item_id", F.explode("answer_keywords").alias("k")).select("item_id", F.lower("k").alias("term")).where(F.col("term").rlike("^[a-z]+$"))
    found = DOCS(s, d).select("doc_id", F.explode(F.array_distinct(L.tokens(F.col("text")))).alias("term"))
    return found.join(small(words), "term").groupBy("item_id").agg(F.countDistinct("doc_id").alias("documents"), F.min("doc_id").alias("first_doc"))


def v_simulation(s, d):
    """Verdict of each search's best hit as an answer: too long, banned words, wrong source, or pass."""
    best = ranked(HITS(s, d)).where("rank = 1").join(small(_questions(s, d).select("query_id", "must_not_contain", "category")), "query_id")
    text = F.lower(F.coalesce("text", F.lit("")))
    banned = F.coalesce(F.exists("must_not_contain", lambda k: F.contains(text, F.lower(k))), F.lit(False))
    verdict = F.when(F.length(text) > 600, "too long").when(banned, "banned").when(F.col("source").isNull(), "no source").otherwise("pass")
    return best.groupBy("category", verdict.alias("verdict")).agg(F.count("*").alias("n"))


def cv_enrich(s, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    turns = table(s, d, "events").select(F.col("user_id").alias("conv_id"), F.row_number().over(w).alias("turn"), "event_id", "value")
    return L.follow_up(turns).select("event_id", "before", "change")


def _backed(s, d):
    """The first five passages of every search, cited as a context."""
    five = ranked(HITS(s, d).where("text is not null and source is not null")).where(F.col("rank") <= 5)
    line = F.concat(F.lit("[Doc "), F.col("rank"), F.lit(" - "), F.col("source"), F.lit(" p."), F.coalesce(F.col("page"), F.lit(0)), F.lit("] "), F.col("text"))
    context = five.groupBy(*SEARCH).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))), lambda x: x["line"]), "\n").alias("context"))
    return context.select(*SEARCH, L.procedure_backed(F.col("context")).alias("backed"))


QUERIES = {
    "e_factual_gate": lambda s, d: L.factual_gate(HITS(s, d), _questions(s, d)).select(*SEARCH, "type", "evidence", "passes"),
    "r_pool": lambda s, d: HITS(s, d).select("run_id", "query_id").distinct().join(small(_questions(s, d).select("query_id", L.pool_size(F.col("question")).alias("pool"))), "query_id").select("run_id", "query_id", "pool"),
    "c_filters": lambda s, d: DOCS(s, d).select("doc_id", L.technology(F.concat_ws(" ", "title", "text")).alias("technology")),
    "p_cuts": lambda s, d: DOCS(s, d).select("doc_id", F.md5(L.condense(F.col("text"))).alias("condensed"), F.md5(L.cut_safely(F.col("text"))).alias("cut"), L.lists_steps(F.col("text")).alias("steps")),
    "p_backed": _backed,
    "p_clean": lambda s, d: HITS(s, d).where("text is not null").select("hit_id", F.md5(L.clean_answer(F.col("text"))).alias("md5")),
    "t_glossary": t_glossary,
    "t_entity_expand": lambda s, d: L.entity_expansion(CLAIMS(s, d), ALIASES(s, d)),
    "t_acronym": lambda s, d: ALIASES(s, d).select("claim_id", L.acronym_of(F.col("canonical_name")).alias("acronym")),
    "k_pred_map": lambda s, d: L.relations(ALIASES(s, d)).select("claim_id", "origin", "predicate"),
    "k_pred_audit": k_pred_audit,
    "k_dedup_rel": lambda s, d: L.merge_relations(L.relations(ALIASES(s, d))),
    "c_infer_entity": c_infer_entity,
    "v_timing": lambda s, d: HITS(s, d).groupBy("run_id").agg(*[F.round(F.avg(F.when(~F.isnan(c), F.col(c))), 6).alias(c) for c in ("semantic_score", "keyword_score", "hybrid_score", "rerank_score")]),
    "v_simulation": v_simulation,
    "cv_enrich": cv_enrich,
}

TOKEN = r"[a-zñáéíóúü]+(?:[./-]?[a-z0-9]+)*|\d+(?:[.,]\d+)?"
_FOLD = r"trim(regexp_replace(lower(strip_accents(%s)), '[\s\x{1c}-\x{1f}\x{85}\pZ]+', ' ', 'g'))"


def _name(c: str) -> str:
    f = _FOLD % c
    return f"CASE WHEN {f} <> '' AND {f} <> 'unknown' THEN {f} END"


_Q = _FOLD % "regexp_replace(question, '[¿?]', '', 'g')"
_TYPE = "CASE " + " ".join(f"WHEN regexp_matches({_Q}, '{p}') THEN '{n}'" for n, p in L.QUESTION_TYPES.items()) + " ELSE 'other' END"
_HAS = "CASE type " + " ".join(f"WHEN '{n}' THEN regexp_matches({_FOLD % 'coalesce(text, chr(32))'}, '{p}')" for n, p in L.EVIDENCE.items()) + " ELSE true END"
_RANK = "h AS (SELECT *, row_number() OVER (PARTITION BY run_id, query_id ORDER BY CASE WHEN isnan(final_score) THEN NULL ELSE final_score END DESC NULLS LAST, hit_id) AS rank FROM hits)"
_TECH = "CASE " + " ".join(f"WHEN contains(f, '{t}') THEN '{t}'" for t in L.TECHNOLOGIES) + " END"
_PRED = "CASE origin " + " ".join(f"WHEN '{k}' THEN '{v if v in L.CATALOG else 'references'}'" for k, v in L.PREDICATES.items()) + " ELSE 'references' END"
_REL = f"WITH r0 AS (SELECT claim_id, ord, {_name('alias')} AS subject, coalesce(raw['origin'], 'none') AS origin, {_name('canonical_name')} AS object, CASE WHEN NOT isnan(confidence) AND confidence > 0 AND confidence <= 1 THEN confidence END AS p FROM alias_claims), r AS (SELECT *, {_PRED} AS predicate FROM r0)"
SQL = {
    "e_factual_gate": f"WITH {_RANK}, q AS (SELECT item_id AS query_id, {_TYPE} AS type FROM eval_questions), x AS (SELECT run_id, h.query_id, type, {_HAS} AS has FROM h JOIN q ON h.query_id = q.query_id WHERE rank <= 5) SELECT run_id, query_id, type, count(*) FILTER (has) AS evidence, count(*) FILTER (has) > 0 AS passes FROM x GROUP BY ALL",
    "r_pool": f"WITH q AS (SELECT item_id AS query_id, {_FOLD % 'question'} AS f FROM eval_questions) SELECT DISTINCT run_id, h.query_id, CASE WHEN regexp_matches(f, 'list|cuales|which') THEN 20 WHEN regexp_matches(f, 'compar|versus|diferencia') THEN 15 WHEN len(string_split(f, ' ')) <= 8 THEN 10 ELSE 15 END AS pool FROM hits h JOIN q ON h.query_id = q.query_id",
    "c_filters": f"SELECT doc_id, {_TECH} AS technology FROM (SELECT doc_id, {_FOLD % 'c'} AS f FROM (SELECT doc_id, concat_ws(' ', title, text) AS c FROM documents))",
    "p_cuts": r"""WITH d AS (SELECT doc_id, text, list_filter(list_transform(string_split(text, chr(10) || chr(10)), lambda p: trim(p, chr(32) || chr(9) || chr(13) || chr(10))), lambda p: p <> '') AS p, regexp_split_to_array(coalesce(text, ''), '\r\n|\n|\r') AS l, substring(coalesce(text, ''), 1, 1000) AS c FROM documents),
n AS (SELECT *, coalesce(len(list_filter(range(1, len(p) + 1), lambda i: list_sum(list_transform(p[1:i], lambda x: length(x) + 2)) <= 600)), 0) AS np, len(list_filter(range(1, len(l) + 1), lambda i: list_sum(list_transform(l[1:i], lambda x: length(x) + 1)) <= 1000)) AS nl,
len(list_filter(l, lambda x: regexp_matches(x, '^\s*(?:[0-9]+\s*[.)-]|[-*•])\s+\S'))) >= 2 AS s, regexp_extract(c, '(?s)^(.*[.!?])', 1) AS e FROM d)
SELECT doc_id, md5(CASE WHEN length(text) <= 600 THEN text WHEN np > 0 THEN array_to_string(p[1:np], chr(10) || chr(10)) ELSE substring(text, 1, 600) END) AS condensed,
md5(CASE WHEN length(coalesce(text, '')) <= 1000 THEN coalesce(text, '') WHEN s AND nl > 0 AND rtrim(array_to_string(l[1:nl], chr(10))) <> '' THEN rtrim(array_to_string(l[1:nl], chr(10)))
WHEN length(e) > 500 THEN trim(e, chr(32) || chr(9) || chr(13) || chr(10)) ELSE trim(c, chr(32) || chr(9) || chr(13) || chr(10)) || '…' END) AS cut,
coalesce(len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(trim(x), '^(?:[0-9]+[.)]|[-*•])\s+.{5,}'))) >= 2, false) AS steps FROM n""",
    "p_backed": r"""WITH h AS (SELECT *, row_number() OVER (PARTITION BY run_id, query_id ORDER BY CASE WHEN isnan(final_score) THEN NULL ELSE final_score END DESC NULLS LAST, hit_id) AS rank FROM hits WHERE text IS NOT NULL AND source IS NOT NULL),
c AS (SELECT run_id, query_id, string_agg('[Doc ' || rank || ' - ' || source || ' p.' || coalesce(page, 0) || '] ' || text, chr(10) ORDER BY rank) AS context FROM h WHERE rank <= 5 GROUP BY ALL)
SELECT run_id, query_id, len(list_distinct(regexp_extract_all(context, '\[Doc [0-9]+ - (.+?) p\.[0-9]+\]', 1))) >= 2 AND regexp_matches(lower(context), 'paso|step|procedimiento|procedure|instruccion|instrucción|protocolo|configurar|instalar|ejecutar') AS backed FROM c""",
    "p_clean": rf"WITH c AS (SELECT hit_id, list_transform(string_split(regexp_replace(regexp_replace(text, '{L.META}', '', 'g'), '\[Doc [0-9]+[^\]]*\]', '', 'g'), chr(10)), lambda x: trim(regexp_replace(x, '[\s\x{{1c}}-\x{{1f}}\x{{85}}\pZ]+', ' ', 'g'))) AS l FROM hits WHERE text IS NOT NULL) SELECT hit_id, md5(array_to_string(list_filter(list_filter(l, lambda x, i: i = 1 OR x <> l[i - 1]), lambda x: x <> ''), chr(10))) AS md5 FROM c",
    "t_glossary": f"WITH t AS (SELECT DISTINCT lower(t) AS term FROM (SELECT unnest(entity_types) AS t FROM entity_claims) WHERE t IS NOT NULL), w AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '{TOKEN}'))) AS term FROM documents), x AS (SELECT doc_id, term, row_number() OVER (PARTITION BY doc_id ORDER BY term) AS place FROM w JOIN t USING (term)) SELECT * FROM x WHERE place <= 10",
    "t_entity_expand": f"WITH p AS (SELECT {_name('canonical_name')} AS key, {_name('alias')} AS alias FROM alias_claims), n AS (SELECT DISTINCT {_name('canonical_name')} AS key FROM entity_claims), c AS (SELECT key, alias, count(*) AS claims FROM p WHERE key IS NOT NULL AND alias IS NOT NULL AND key <> alias AND key IN (SELECT key FROM n WHERE key IS NOT NULL) GROUP BY ALL), x AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY claims DESC, alias) AS place FROM c) SELECT * FROM x WHERE place <= 3",
    "t_acronym": f"SELECT claim_id, upper(array_to_string(list_transform(list_filter(regexp_split_to_array({_FOLD % 'canonical_name'}, '[^a-z0-9]+'), lambda w: w <> '' AND w NOT IN ('de', 'del', 'la', 'y', 'of', 'the', 'and')), lambda w: substr(w, 1, 1)), '')) AS acronym FROM alias_claims",
    "k_pred_map": _REL + " SELECT claim_id, origin, predicate FROM r",
    "k_pred_audit": _REL + " SELECT origin, predicate, count(*) AS n, count(*) FILTER (subject = object) AS self, round(count(*)::DOUBLE / sum(count(*)) OVER (), 6) AS share FROM r GROUP BY origin, predicate",
    "k_dedup_rel": _REL + " SELECT subject, predicate, object, min(ord) AS first_ord, max(p) AS confidence, count(*) AS claims FROM r WHERE subject IS NOT NULL AND object IS NOT NULL AND subject <> object GROUP BY ALL",
    "c_infer_entity": f"WITH k AS (SELECT item_id, lower(k) AS term FROM (SELECT item_id, unnest(answer_keywords) AS k FROM eval_questions) WHERE regexp_matches(lower(k), '^[a-z]+$')), w AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '{TOKEN}'))) AS term FROM documents) SELECT item_id, count(DISTINCT doc_id) AS documents, min(doc_id) AS first_doc FROM w JOIN k USING (term) GROUP BY item_id",
    "v_timing": "SELECT run_id, " + ", ".join(f"round(avg(CASE WHEN NOT isnan({c}) THEN {c} END), 6) AS {c}" for c in ("semantic_score", "keyword_score", "hybrid_score", "rerank_score")) + " FROM hits GROUP BY 1",
    "v_simulation": f"WITH {_RANK}, b AS (SELECT category, CASE WHEN length(lower(coalesce(text, ''))) > 600 THEN 'too long' WHEN coalesce(len(list_filter(must_not_contain, lambda k: contains(lower(coalesce(text, '')), lower(k)))) > 0, false) THEN 'banned' WHEN source IS NULL THEN 'no source' ELSE 'pass' END AS verdict FROM h JOIN eval_questions e ON h.query_id = e.item_id WHERE rank = 1) SELECT category, verdict, count(*) AS n FROM b GROUP BY ALL",
    "cv_enrich": "WITH t AS (SELECT event_id, value, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) SELECT event_id, before, round(value - before, 6) AS change FROM t",
}
