"""Queries of the remaining operators: citations, coverage, evidence, forced pages, pages, log tails, coercion."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from tamizal.functions.text import fold
from tamizal.operators import documents as T
from tamizal.operators import evaluation as V
from tamizal.operators import language as L
from tamizal.operators.knowledge import document_role
from tamizal.operators.ranking import SEARCH, ranked
from tamizal.session import shared_dir, small, table
from tamizal.sources.corpus import pages_of
from tamizal.streaming import streams as ST

from . import documents as _D  # the SQL builds on parts of these
from . import evaluation as _V
from . import language as _L

# How the roles of titles map to the roles of the contract.
TAXONOMY = {"procedure": "operational", "policy": "normative", "manual": "reference", "guide": "reference", "annex": "annex", "plan": "operational", "record": "record", "inventory": "record"}


def _hits(s, d):
    return table(s, d, "hits")


def _keywords(s, d):
    return table(s, d, "eval_questions").select(F.col("item_id").alias("query_id"), "answer_keywords", "category")


def e_citations(s, d):
    """Citations of a text with as many documents as the search has hits; valid from 1 to that number."""
    n = F.count("*").over(Window.partitionBy(*SEARCH))
    cited = _hits(s, d).withColumn("n", n).withColumn("answer", F.concat(F.coalesce("text", F.lit("")), F.lit(" [Doc "), (F.col("page") % 15).cast("string"), F.lit(" p.3]")))
    found = F.transform(F.regexp_extract_all("answer", F.lit(r"\[Doc ([0-9]+)[^\]]*\]"), F.lit(1)), lambda x: x.cast("int"))
    return cited.select("hit_id", F.size(found).alias("citations"), F.size(F.filter(found, lambda x: (x >= 1) & (x <= F.col("n")))).alias("valid"))


def e_coverage(s, d):
    """Whether the first hits of a search mention at least half of the question's keywords, one at least."""
    few = _hits(s, d).join(small(_keywords(s, d)), "query_id")
    words = few.select(*SEARCH, F.lower(F.coalesce("text", F.lit(""))).alias("t"), F.size("answer_keywords").alias("n"), F.explode("answer_keywords").alias("k"))
    per = words.groupBy(*SEARCH, "n").agg(F.countDistinct(F.when(F.contains("t", F.lower("k")), F.col("k"))).alias("found"))
    return per.withColumn("covered", F.col("found") >= F.greatest(F.lit(1), F.floor(F.col("n") / 2)))


def e_entity_evidence(s, d):
    """Hits that name an entity claimed in the documents their search found: the whole name, or its first and last word at most fifty characters apart."""
    c = table(s, d, "entity_claims").select(fold(F.col("canonical_name")).alias("k"), F.explode("evidence").alias("e")).select("k", F.col("e.source_doc_id").alias("canonical_doc_id"))
    c = c.where(F.rlike("k", F.lit("^[a-z]+( [a-z]+)+$")) & (F.col("k") != "unknown")).distinct()
    m = _hits(s, d).where("text is not null").select("hit_id", "canonical_doc_id", fold(F.col("text")).alias("t")).join(c, "canonical_doc_id")
    first, last = F.substring_index("k", " ", 1), F.substring_index("k", " ", -1)
    near = F.contains("t", first) & F.contains("t", last) & F.rlike("t", F.concat(F.lit(r"\b"), first, F.lit(r"\b.{0,50}\b"), last, F.lit(r"\b")))
    return m.where(near).select("hit_id", "k", F.contains("t", F.col("k")).cast("int").alias("whole"))


def e_latest(s, d):
    e = table(s, d, "events")
    return e.groupBy("user_id", "event_type").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"))


def j_coerce(s, d):
    """Types that a model gave as one word or as a list, read as a list."""
    c = table(s, d, "entity_claims").where("size(entity_types) > 0 and entity_types[0] is not null")
    raw = F.when(F.col("claim_id") % 2 == 0, F.to_json(F.struct(F.col("entity_types")[0].alias("types")))).otherwise(F.to_json(F.struct(F.filter("entity_types", lambda x: x.isNotNull()).alias("types"))))
    given = F.get_json_object(raw, "$.types")
    listed = F.when(F.startswith(given, F.lit("[")), F.from_json(given, "array<string>")).otherwise(F.array(given))
    return c.select("claim_id", F.array_join(listed, "|").alias("types"))


def r_forced_pages(s, d):
    """The hits of a wanted page put before the others, each text of a page once."""
    m = ranked(_hits(s, d)).withColumn("forced", (F.col("page") == 20).cast("int"))
    w = Window.partitionBy(*SEARCH, "source", "page", F.substring("text", 1, 120)).orderBy(F.desc_nulls_last("forced"), "rank")
    once = m.withColumn("nth", F.row_number().over(w)).where("nth = 1")
    return once.withColumn("place", F.row_number().over(Window.partitionBy(*SEARCH).orderBy(F.desc_nulls_last("forced"), "rank"))).select(*SEARCH, "hit_id", "place")


def s_pages(s, d):
    p = pages_of(table(s, d, "extracted_texts"), key="text_id")
    return p.groupBy("text_id").agg(F.count("*").alias("pages"), F.sum(F.length("text")).alias("chars"), F.max("page").alias("last"))


def t_expand(s, d):
    """Spellings with up to three names of the same entity that they don't hold themselves."""
    names = L.entity_expansion(table(s, d, "entity_claims"), table(s, d, "alias_claims"))
    c = table(s, d, "entity_claims").select("claim_id", fold(F.col("surface_form")).alias("surface"), fold(F.col("canonical_name")).alias("key"))
    m = c.join(names, "key").where(~F.contains("surface", F.col("alias")))
    return m.groupBy("claim_id", "surface").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "alias"))), lambda x: x["alias"]), " OR ").alias("extra"))


def v_by_category(s, d):
    m = V.retrieval_metrics(_hits(s, d), table(s, d, "eval_questions").withColumnRenamed("item_id", "query_id"))
    return m.join(small(_keywords(s, d).select("query_id", "category")), "query_id").groupBy("category").agg(F.count("*").alias("n"), F.sum("doc_hit").alias("hits"), F.count_if(F.col("first_rank") == 1).alias("at_one"))


QUERIES = {
    "d_centrality": lambda s, d: table(s, d, "documents").select("doc_id", F.round(T.centrality(F.coalesce("title", F.lit("")), F.coalesce("text", F.lit(""))), 6).alias("centrality")),
    "d_entities": lambda s, d: table(s, d, "documents").select("doc_id", F.array_join(F.slice(F.array_sort(T.entities(F.col("text"))), 1, 20), "|").alias("entities")),
    "e_citations": e_citations,
    "e_coverage": e_coverage,
    "e_entity_evidence": e_entity_evidence,
    "e_latest": e_latest,
    "e_tokens": lambda s, d: _hits(s, d).where("text is not null").select("hit_id", F.size(V.content_tokens(F.col("text"))).alias("n")),
    "j_coerce": j_coerce,
    "k_role_map": lambda s, d: table(s, d, "documents").select(F.coalesce(F.create_map(*[F.lit(x) for kv in TAXONOMY.items() for x in kv])[document_role(F.coalesce("title", F.lit("")))], F.lit("other")).alias("role")).groupBy("role").agg(F.count("*").alias("n")),
    "r_forced_pages": r_forced_pages,
    "s_pages": s_pages,
    "st_tail": lambda s, d: ST.run_tail(s, f"{d}/events.parquet", f"{shared_dir(s)}/tamizal-stream-{uuid.uuid4().hex[:12]}"),
    "t_expand": t_expand,
    "v_by_category": v_by_category,
}

_K = "k AS (SELECT item_id AS query_id, answer_keywords, category FROM eval_questions)"
SQL = {
    "d_centrality": f"""SELECT doc_id, round(least(1.0::DOUBLE, 0.1::DOUBLE + CASE WHEN {_D._HITS_IN(_D._FOLD % "coalesce(title, '')")} > 0 THEN 0.6::DOUBLE ELSE 0.0::DOUBLE END + least(0.3::DOUBLE, 0.05::DOUBLE * {_D._HITS_IN("lower(coalesce(text, ''))")})), 6) AS centrality FROM documents""",
    "d_entities": f"SELECT doc_id, array_to_string(list_sort({_D._ENTS})[1:20], '|') AS entities FROM documents",
    "e_citations": r"WITH x AS (SELECT hit_id, count(*) OVER (PARTITION BY run_id, query_id) AS n, list_transform(regexp_extract_all(coalesce(text, '') || ' [Doc ' || (page % 15) || ' p.3]', '\[Doc ([0-9]+)[^\]]*\]', 1), lambda z: CAST(z AS INT)) AS c FROM hits) SELECT hit_id, CAST(len(c) AS INT) AS citations, CAST(len(list_filter(c, lambda z: z >= 1 AND z <= n)) AS INT) AS valid FROM x",
    "e_coverage": f"WITH {_V._H}, {_K}, x AS (SELECT h.run_id, h.query_id, lower(coalesce(text, '')) AS t, len(answer_keywords) AS n, unnest(answer_keywords) AS k FROM h JOIN k ON h.query_id = k.query_id), y AS (SELECT run_id, query_id, CAST(n AS INT) AS n, count(DISTINCT CASE WHEN contains(t, lower(k)) THEN k END) AS found FROM x GROUP BY ALL) SELECT *, found >= greatest(1, n // 2) AS covered FROM y",
    "e_entity_evidence": rf"""WITH c AS (SELECT DISTINCT k, e.source_doc_id AS doc FROM (SELECT {_D._FOLD % 'canonical_name'} AS k, unnest(evidence) AS e FROM entity_claims) WHERE regexp_matches(k, '^[a-z]+( [a-z]+)+$')), h AS (SELECT hit_id, canonical_doc_id AS doc, {_D._FOLD % 'text'} AS t FROM hits WHERE text IS NOT NULL)
SELECT hit_id, k, CAST(contains(t, k) AS INT) AS whole FROM h JOIN c USING (doc) WHERE regexp_matches(t, '\b' || string_split(k, ' ')[1] || '\b.{{0,50}}\b' || string_split(k, ' ')[-1] || '\b')""",
    "e_latest": "SELECT user_id, event_type, arg_max(event_id, {'t': ts, 'e': event_id}) AS event_id FROM events GROUP BY ALL",
    "e_tokens": f"SELECT hit_id, CAST(len({_V._CT % 'text'}) AS INT) AS n FROM hits WHERE text IS NOT NULL",
    "j_coerce": "SELECT claim_id, CASE WHEN claim_id % 2 = 0 THEN entity_types[1] ELSE array_to_string(list_filter(entity_types, lambda x: x IS NOT NULL), '|') END AS types FROM entity_claims WHERE len(entity_types) > 0 AND entity_types[1] IS NOT NULL",
    "k_role_map": f"WITH r AS (SELECT {_D._ROLE} AS r FROM documents) SELECT CASE r " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in TAXONOMY.items()) + " ELSE 'other' END AS role, count(*) AS n FROM r GROUP BY 1",
    "r_forced_pages": f"WITH {_V._H}, m AS (SELECT *, CAST(page = 20 AS INT) AS forced FROM h), o AS (SELECT *, row_number() OVER (PARTITION BY run_id, query_id, source, page, substr(text, 1, 120) ORDER BY forced DESC NULLS LAST, rank) AS nth FROM m) SELECT run_id, query_id, hit_id, row_number() OVER (PARTITION BY run_id, query_id ORDER BY forced DESC NULLS LAST, rank) AS place FROM o WHERE nth = 1",
    "s_pages": r"WITH p AS (SELECT text_id, unnest(regexp_split_to_array(chr(10) || text, '\n--- P[^\n]*? ')[2:]) AS part FROM extracted_texts WHERE text IS NOT NULL), q AS (SELECT text_id, CAST(regexp_extract(part, '^(\d+) ---', 1) AS INT) AS page, strip_accents(regexp_replace(part, '^\d+ ---\s*|\s+$', '', 'g')) AS t FROM p) SELECT text_id, count(*) AS pages, CAST(sum(length(t)) AS BIGINT) AS chars, max(page) AS last FROM q WHERE t <> '' GROUP BY 1",
    "st_tail": "SELECT event_type, event_id FROM (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS age FROM events) WHERE age <= 50",
    "t_expand": f"WITH nm AS ({_L.SQL['t_entity_expand']}), c AS (SELECT claim_id, {_D._FOLD % 'surface_form'} AS surface, {_D._FOLD % 'canonical_name'} AS key FROM entity_claims) SELECT claim_id, surface, string_agg(alias, ' OR ' ORDER BY place) AS extra FROM c JOIN nm USING (key) WHERE NOT contains(surface, alias) GROUP BY ALL",
    "v_by_category": _V._MET + " SELECT category, count(*) AS n, CAST(sum(doc_hit) AS BIGINT) AS hits, count(*) FILTER (first_rank = 1) AS at_one FROM m GROUP BY category",
}
