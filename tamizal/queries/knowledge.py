"""Queries of the knowledge operators over the claim tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tamizal.functions.text import fold
from tamizal.operators import knowledge as K
from tamizal.session import table


def _t(name):
    return lambda s, d: table(s, d, name)


E, A, C, D = _t("entity_claims"), _t("alias_claims"), _t("canonical_entities"), _t("documents")


def _confidence(policy):
    def run(s, d):
        named = E(s, d).withColumn("key", K.name_of(F.col("canonical_name"))).where("key is not null")
        return named.groupBy("key").agg(F.round(K.combined_confidence(policy, F.col("confidence"), F.col("extractor_id")), 6).alias("confidence"))

    return run


def _names(df, c):
    return df.select(K.name_of(F.col(c)).alias("name")).where("name is not null")


def k_merge(s, d):
    a = A(s, d).select("claim_id", F.lit("alias").alias("kind"), "extractor_id", "confidence")
    e = E(s, d).select("claim_id", F.lit("entity").alias("kind"), "extractor_id", "confidence")
    return a.unionByName(e).groupBy("kind", "extractor_id").agg(F.count("*").alias("n"), F.max(K.usable(F.col("confidence"))).alias("best"))


def k_stats(s, d):
    e = E(s, d).agg(F.count("*").alias("entity_claims"), F.countDistinct(K.name_of(F.col("canonical_name"))).alias("entities"))
    a = A(s, d).agg(F.count("*").alias("alias_claims"), F.countDistinct(K.name_of(F.col("alias"))).alias("aliases"))
    return e.crossJoin(a)  # one row each


def k_types(s, d):
    return E(s, d).select(F.explode("entity_types").alias("type")).where("type is not null").groupBy(F.lower("type").alias("type")).agg(F.count("*").alias("n")).withColumn("share", F.round(F.col("n") / F.sum("n").over(K.Window.partitionBy()), 6))


def a_checksums(s, d):
    return K.checksums(K.canonical_map(E(s, d)).select("entity_id", "key"), "entity_id")


def a_retention(s, d):
    return K.retention(C(s, d).select("entity_id", "record_id"), "entity_id", "record_id", 2)


def a_artifacts(s, d):
    r = C(s, d).where(K.usable(F.col("confidence")).isNotNull())
    return r.select("record_id", "entity_id", fold(F.col("canonical_name")).alias("canonical_name"), F.array_join(F.array_sort(F.array_distinct(F.filter("types", lambda x: x.isNotNull()))), "|").alias("types"), "confidence", F.col("generated_by.extractor_id").alias("extractor_id"))


def k_infer_types(s, d):
    """Types told by the names of records, next to how many records are given types."""
    r = C(s, d).select("record_id", K.infer_types(F.col("canonical_name")).alias("t"), F.coalesce(F.size("types"), F.lit(0)).alias("given"))
    return r.groupBy(F.array_join("t", "|").alias("types")).agg(F.count("*").alias("n"), F.count_if(F.col("given") > 0).alias("given"))


def k_pred_words(s, d):
    """Words of the documents that name a predicate, with the catalog's predicate they map to."""
    words = D(s, d).select(F.explode(F.split(F.lower("text"), r"[^a-z_]+")).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    known = F.array(*[F.lit(x) for listed in K.FALLBACK.values() for x in listed.split(",")], *[F.lit(x) for x in K.CATALOG])
    return words.where(F.array_contains(known, F.col("word"))).select("word", K.map_predicate(F.col("word")).alias("predicate"), "n")


def a_cross_errors(s, d):
    """Artifacts of the tables held against each other: records, alias claims, evidence, documents."""
    ent = lambda c: F.concat(F.lit("ent:"), K.slug(K.name_of(F.col(c))))
    e = E(s, d).where(K.name_of(F.col("canonical_name")).isNotNull())
    a = A(s, d).where(K.name_of(F.col("alias")).isNotNull() & K.name_of(F.col("canonical_name")).isNotNull())
    roles = e.select(ent("canonical_name").alias("entity_id"), F.explode("evidence").alias("x")).groupBy(F.col("x.source_doc_id").alias("doc_id")).agg(F.collect_set("entity_id").alias("entity_ids")).where("doc_id is not null")
    relations = a.select(F.col("claim_id").alias("relation_id"), ent("alias").alias("subject"), F.try_element_at("raw", F.lit("origin")).alias("predicate"), ent("canonical_name").alias("object"))
    return K.cross_errors(C(s, d), a.select("alias", ent("canonical_name").alias("entity_id")), e.select(ent("canonical_name").alias("entity_id")).distinct(), roles, relations, D(s, d).select(F.col("canonical_doc_id").alias("doc_id")).where("doc_id is not null").distinct()).groupBy("rule").agg(F.count("*").alias("n"), F.countDistinct("value").alias("values"))


QUERIES = {
    "k_infer_types": k_infer_types,
    "k_pred_words": k_pred_words,
    "k_entity_docs": lambda s, d: K.entity_documents(E(s, d)).select("key", F.array_join("documents", "|").alias("documents"), F.array_join("extractors", "|").alias("extractors"), "confidence"),
    "a_cross_errors": a_cross_errors,
    "k_merge": k_merge,
    "k_stats": k_stats,
    "k_types": k_types,
    "k_canon": lambda s, d: K.canonical_map(E(s, d)),
    "k_dedup_entity": lambda s, d: K.merge_entities(E(s, d)),
    "k_dedup_alias": lambda s, d: K.merge_aliases(A(s, d)),
    "k_dedup_doc": lambda s, d: K.merge_documents(table(s, d, "hits")),
    "k_evidence": lambda s, d: K.evidence_set(E(s, d)),
    "k_conf_max": _confidence("max"),
    "k_conf_mean": _confidence("mean"),
    "k_conf_weighted": _confidence("weighted"),
    "k_conf_bayes": _confidence("bayesian"),
    "k_entity_index": lambda s, d: K.entity_index(E(s, d)),
    "k_stubs": lambda s, d: K.alias_stubs(A(s, d), E(s, d)),
    "k_validate": lambda s, d: K.structural_findings(E(s, d)),
    "k_semantic": lambda s, d: K.contradictions(A(s, d)),
    "k_self": lambda s, d: K.self_claims(A(s, d)),
    "k_collisions": lambda s, d: K.slug_collisions(E(s, d)),
    "k_select_docs": lambda s, d: K.select_documents(D(s, d), "procedure", F.col("n_chars")).select("doc_id", "centrality"),
    "a_resolve": lambda s, d: K.resolve_aliases(A(s, d), E(s, d)),
    "a_conf": lambda s, d: C(s, d).where(K.usable(F.col("confidence")) >= 0.8).select("record_id", "entity_id", "confidence"),
    "a_diff": lambda s, d: K.difference(_names(A(s, d), "canonical_name"), _names(E(s, d), "canonical_name")),
    "a_refint": lambda s, d: K.reference_errors(E(s, d), D(s, d), A(s, d)),
    "a_schema": lambda s, d: K.schema_errors(C(s, d)),
    "a_retrieval_meta": lambda s, d: K.retrieval_metadata(D(s, d)),
    "a_artifacts": a_artifacts,
    "a_checksums": a_checksums,
    "a_retention": a_retention,
}

_F = r"trim(regexp_replace(lower(strip_accents(%s)), '[\s\x{1c}-\x{1f}\x{85}\pZ]+', ' ', 'g'))"


def _name(c: str) -> str:
    f = _F % c
    return f"CASE WHEN {f} <> '' AND {f} <> 'unknown' THEN {f} END"


_U = "CASE WHEN NOT isnan(confidence) AND confidence > 0 AND confidence <= 1 THEN confidence END"
_W = "CASE extractor_id WHEN 'deterministic:equivalences-text' THEN 0.95::DOUBLE WHEN 'deterministic:entity-aliases-dict' THEN 0.9::DOUBLE WHEN 'deterministic:doc-cards' THEN 0.7::DOUBLE WHEN 'llm:granite-4.1-3b' THEN 0.85::DOUBLE ELSE 0.5::DOUBLE END"
_E = f"WITH e AS (SELECT *, {_name('canonical_name')} AS key, {_U} AS p, {_W} AS w FROM entity_claims)"
_AL = f"WITH a AS (SELECT *, {_name('alias')} AS a, {_name('canonical_name')} AS c, {_U} AS p, {_W} AS w FROM alias_claims)"
_WT = "least(sum(p * w) / sum(CASE WHEN p IS NOT NULL THEN w END), 1.0::DOUBLE)"
_SLUG = "CASE WHEN s = '' THEN 'unknown' ELSE s END"
_ROLE = "CASE " + " ".join(f"WHEN regexp_matches(t, '(?:^|[^a-z])(?:{w})(?:[^a-z]|$)') THEN '{r}'" for r, w in K.ROLES) + " ELSE 'other' END"
_DOCS = f"WITH d0 AS (SELECT *, {_F % 'coalesce(title, chr(32))'} AS t FROM documents), d AS (SELECT *, {_ROLE} AS role FROM d0)"

_CANON = _E + f", f AS (SELECT key, arg_min(canonical_name, ord) AS canonical, regexp_replace(regexp_replace(key, '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS s FROM e WHERE key IS NOT NULL GROUP BY key), m AS (SELECT key, canonical, 'ent:' || {_SLUG} AS entity_id FROM f)"
_TYPES = "list_filter([CASE WHEN regexp_matches(lower(canonical_name), 'iso|nist|cobit|itil|owasp') THEN 'framework' END, CASE WHEN regexp_matches(lower(canonical_name), 'iso|nist|pci') THEN 'standard' END, CASE WHEN regexp_matches(lower(canonical_name), 'cissp|ceh|oscp|cism|cisa|ccsp|crisc|gsec|gcih') THEN 'certification' END, CASE WHEN regexp_matches(lower(canonical_name), 'cia|risk|governance|compliance') THEN 'concept' END, CASE WHEN regexp_matches(lower(canonical_name), 'siem|soc|edr|xdr|waf|ids|ips|dlp|pam|sso') THEN 'technology' END, CASE WHEN regexp_matches(lower(canonical_name), 'tls|ssl|dns|tcp|ospf|bgp|mpls') THEN 'protocol' END, CASE WHEN regexp_matches(lower(canonical_name), 'gdpr|dora|nis2|hipaa|sox') THEN 'regulation' END, CASE WHEN regexp_matches(lower(canonical_name), 'devsecops|sdlc|sast|dast') THEN 'methodology' END], lambda x: x IS NOT NULL)"
_PW = "CASE WHEN word IN ('implements', 'extends', 'references', 'governs', 'contains', 'uses', 'creates') THEN word WHEN word IN ('requires') THEN 'depends_on' WHEN word IN ('provides', 'defines', 'produces', 'specifies', 'establishes', 'determines', 'identifies') THEN 'creates' WHEN word IN ('includes', 'incorporates', 'embeds', 'groups', 'aggregates') THEN 'contains' WHEN word IN ('supports') THEN 'implements' WHEN word IN ('certifies', 'enforces', 'mandates') THEN 'governs' WHEN word IN ('supersedes', 'replaces', 'specializes', 'generalizes') THEN 'extends' WHEN word IN ('utilizes', 'consumes', 'invokes', 'calls') THEN 'uses' WHEN word IN ('contradicts', 'describes', 'covers', 'precedes', 'follows', 'documents', 'categorizes', 'classifies', 'enables', 'facilitates') THEN 'references' END"
_ENT = lambda c: f"'ent:' || regexp_replace(regexp_replace({_F % c}, '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')"
SQL = {
    "k_infer_types": f"SELECT types, count(*) AS n, count(*) FILTER (given > 0) AS given FROM (SELECT coalesce(nullif(array_to_string({_TYPES}, '|'), ''), 'concept') AS types, coalesce(len(types), 0) AS given FROM canonical_entities) GROUP BY 1",
    "k_pred_words": f"SELECT * FROM (SELECT word, {_PW} AS predicate, count(*) AS n FROM (SELECT unnest(regexp_split_to_array(lower(text), '[^a-z_]+')) AS word FROM documents) GROUP BY word) WHERE predicate IS NOT NULL",
    "k_entity_docs": _E + ", x AS (SELECT key, p, extractor_id, unnest(list_transform(evidence, lambda z: z.source_doc_id)) AS doc FROM e WHERE key IS NOT NULL) SELECT key, array_to_string(list_sort(list_distinct(list(doc))), '|') AS documents, array_to_string(list_sort(list_distinct(list(extractor_id))), '|') AS extractors, max(p) AS confidence FROM x WHERE doc IS NOT NULL GROUP BY key",
    "a_cross_errors": f"""WITH c AS (SELECT DISTINCT entity_id FROM canonical_entities WHERE entity_id IS NOT NULL), e AS (SELECT {_ENT('canonical_name')} AS id, evidence FROM entity_claims WHERE {_name('canonical_name')} IS NOT NULL), a AS (SELECT alias, {_ENT('alias')} AS s, {_ENT('canonical_name')} AS id, raw['origin'] AS p FROM alias_claims WHERE {_name('alias')} IS NOT NULL AND {_name('canonical_name')} IS NOT NULL),
r AS (SELECT DISTINCT id, x.source_doc_id AS doc FROM (SELECT id, unnest(evidence) AS x FROM e) WHERE x.source_doc_id IS NOT NULL),
z AS (SELECT 'predicate' AS rule, p AS v FROM a WHERE p IS NOT NULL AND p NOT IN ('equivalent_to', 'depends_on', 'implements', 'extends', 'references', 'governs', 'contains', 'uses', 'creates') UNION ALL SELECT 'alias', id FROM a WHERE id NOT IN (SELECT entity_id FROM c) UNION ALL SELECT 'index', id FROM (SELECT DISTINCT id FROM e) WHERE id NOT IN (SELECT entity_id FROM c)
UNION ALL SELECT 'role', id FROM r WHERE id NOT IN (SELECT entity_id FROM c) UNION ALL SELECT 'relation', id FROM (SELECT s AS id FROM a UNION ALL SELECT id FROM a) WHERE id NOT IN (SELECT entity_id FROM c) UNION ALL SELECT 'retrieval', doc FROM (SELECT DISTINCT canonical_doc_id AS doc FROM documents WHERE canonical_doc_id IS NOT NULL) WHERE doc NOT IN (SELECT doc FROM r))
SELECT rule, count(*) AS n, count(DISTINCT v) AS values FROM z GROUP BY rule""",
    "k_merge": f"SELECT kind, extractor_id, count(*) AS n, max(p) AS best FROM (SELECT 'alias' AS kind, extractor_id, {_U} AS p FROM alias_claims UNION ALL SELECT 'entity', extractor_id, {_U} FROM entity_claims) GROUP BY ALL",
    "k_stats": f"SELECT * FROM (SELECT count(*) AS entity_claims, count(DISTINCT {_name('canonical_name')}) AS entities FROM entity_claims), (SELECT count(*) AS alias_claims, count(DISTINCT {_name('alias')}) AS aliases FROM alias_claims)",
    "k_types": "SELECT type, n, round(n / sum(n) OVER (), 6) AS share FROM (SELECT lower(t) AS type, count(*) AS n FROM (SELECT unnest(entity_types) AS t FROM entity_claims) WHERE t IS NOT NULL GROUP BY 1)",
    "k_canon": _CANON + " SELECT * FROM m",
    "k_dedup_entity": _E + rf""", m AS (SELECT key, arg_min(trim(regexp_replace(surface_form, '[\s\x{{1c}}-\x{{1f}}\x{{85}}\pZ]+', ' ', 'g')), ord) FILTER (true) AS s0, array_to_string(list_sort(list_distinct(list(extractor_id))), '|') AS extractors, round({_WT}, 6) AS confidence, count(*) AS claims, min(ord) AS o FROM e WHERE key IS NOT NULL GROUP BY key),
s AS (SELECT e.key, trim(regexp_replace(surface_form, '[\s\x{{1c}}-\x{{1f}}\x{{85}}\pZ]+', ' ', 'g')) AS surface FROM e JOIN m ON e.key = m.key AND e.ord = m.o),
t AS (SELECT key, lower(ty) AS type, min(ord) AS o FROM (SELECT key, ord, unnest(entity_types) AS ty FROM e WHERE key IS NOT NULL) WHERE ty IS NOT NULL GROUP BY ALL), l AS (SELECT key, string_agg(type, '|' ORDER BY o, type) AS types FROM t GROUP BY key)
SELECT m.key, s.surface, coalesce(types, '') AS types, extractors, confidence, claims FROM m JOIN s USING (key) LEFT JOIN l USING (key)""",
    "k_dedup_alias": _AL + f" SELECT a, c, min(ord) AS first_ord, array_to_string(list_sort(list_distinct(list(extractor_id))), '|') AS extractors, round({_WT}, 6) AS confidence FROM a WHERE a IS NOT NULL AND c IS NOT NULL GROUP BY a, c",
    "k_dedup_doc": "SELECT canonical_doc_id, arg_max(hit_id, {'s': coalesce(CASE WHEN NOT isnan(rerank_score) THEN rerank_score END, -1.0::DOUBLE), 'h': -hit_id}) AS best_hit, max(page) AS last_page, count(*) AS n FROM hits WHERE canonical_doc_id IS NOT NULL GROUP BY 1",
    "k_evidence": _E + " SELECT key, ev.source_doc_id AS source_doc_id, ev.quote AS quote, count(*) AS times FROM (SELECT key, unnest(evidence) AS ev FROM e WHERE key IS NOT NULL) GROUP BY ALL",
    "k_conf_max": _E + " SELECT key, round(max(p), 6) AS confidence FROM e WHERE key IS NOT NULL GROUP BY key",
    "k_conf_mean": _E + " SELECT key, round(avg(p), 6) AS confidence FROM e WHERE key IS NOT NULL GROUP BY key",
    "k_conf_weighted": _E + f" SELECT key, round({_WT}, 6) AS confidence FROM e WHERE key IS NOT NULL GROUP BY key",
    "k_conf_bayes": _E + " SELECT key, round(CASE WHEN max(p) >= 1 THEN 1.0::DOUBLE WHEN count(p) > 0 THEN 1 - exp(sum(ln(1 - CASE WHEN p < 1 THEN p END))) END, 6) AS confidence FROM e WHERE key IS NOT NULL GROUP BY key",
    "k_entity_index": _E + ", x AS (SELECT key, p, unnest(CASE WHEN len(evidence) > 0 THEN list_transform(evidence, lambda z: z.source_doc_id) ELSE [NULL::VARCHAR] END) AS doc FROM e WHERE key IS NOT NULL) SELECT key, count(DISTINCT doc) AS documents, min(doc) AS first_doc, max(doc) AS last_doc, max(p) AS confidence FROM x GROUP BY key",
    "k_stubs": _AL + f", k AS (SELECT DISTINCT {_name('canonical_name')} AS key FROM entity_claims) SELECT c AS key, round(0.5::DOUBLE * max(p), 6) AS confidence, count(*) AS claims FROM a WHERE c IS NOT NULL AND c NOT IN (SELECT key FROM k WHERE key IS NOT NULL) GROUP BY c",
    "k_validate": _E + """, x AS (SELECT claim_id, 'error' AS level, 'no canonical name' AS finding FROM e WHERE key IS NULL UNION ALL SELECT claim_id, 'error', 'confidence out of range' FROM e WHERE confidence IS NOT NULL AND (isnan(confidence) OR confidence < 0 OR confidence > 1)
UNION ALL SELECT claim_id, 'warning', 'confidence zero or missing' FROM e WHERE confidence IS NULL OR confidence = 0 UNION ALL SELECT claim_id, 'quarantine', 'no evidence' FROM e WHERE coalesce(len(evidence), 0) <= 0) SELECT * FROM x""",
    "k_semantic": _AL + " SELECT a AS alias, count(DISTINCT c) AS names, count(*) AS claims FROM a WHERE a IS NOT NULL AND c IS NOT NULL GROUP BY a HAVING count(DISTINCT c) > 1",
    "k_self": _AL + " SELECT claim_id, c AS key FROM a WHERE a = c",
    "k_collisions": _CANON + " SELECT entity_id, count(*) AS names FROM m GROUP BY 1 HAVING count(*) > 1",
    "k_select_docs": _DOCS + " SELECT doc_id, n_chars AS centrality FROM d WHERE role = 'procedure' ORDER BY n_chars DESC NULLS LAST, doc_id LIMIT 60",
    "a_resolve": _AL + f", e AS (SELECT {_name('canonical_name')} AS key, unnest(CASE WHEN len(evidence) > 0 THEN list_transform(evidence, lambda z: z.source_doc_id) ELSE [NULL::VARCHAR] END) AS doc FROM entity_claims), i AS (SELECT key, count(DISTINCT doc) AS documents FROM e WHERE key IS NOT NULL GROUP BY key), p AS (SELECT DISTINCT a AS alias, c AS key FROM a WHERE a IS NOT NULL AND c IS NOT NULL) SELECT alias, key, documents FROM p JOIN i USING (key)",
    "a_conf": f"SELECT record_id, entity_id, confidence FROM canonical_entities WHERE ({_U}) >= 0.8::DOUBLE",
    "a_diff": f"WITH l AS (SELECT DISTINCT {_name('canonical_name')} AS name FROM alias_claims), r AS (SELECT DISTINCT {_name('canonical_name')} AS name FROM entity_claims) SELECT name, 'left' AS side FROM l WHERE name IS NOT NULL AND name NOT IN (SELECT name FROM r WHERE name IS NOT NULL) UNION ALL SELECT name, 'right' FROM r WHERE name IS NOT NULL AND name NOT IN (SELECT name FROM l WHERE name IS NOT NULL)",
    "a_refint": f"""WITH c AS (SELECT DISTINCT ev.source_doc_id AS value FROM (SELECT unnest(evidence) AS ev FROM entity_claims)), n AS (SELECT DISTINCT {_name('canonical_name')} AS value FROM entity_claims), m AS (SELECT DISTINCT {_name('canonical_name')} AS value FROM alias_claims)
SELECT 'evidence' AS rule, value FROM c WHERE value IS NOT NULL AND value NOT IN (SELECT canonical_doc_id FROM documents WHERE canonical_doc_id IS NOT NULL) UNION ALL SELECT 'alias', value FROM m WHERE value IS NOT NULL AND value NOT IN (SELECT value FROM n WHERE value IS NOT NULL)""",
    "a_schema": r"""SELECT record_id, unnest(list_filter([CASE WHEN NOT coalesce(regexp_matches(entity_id, '^ent:[a-z0-9]+(-[a-z0-9]+)*$'), false) THEN 'entity_id' END, CASE WHEN confidence IS NULL OR isnan(confidence) OR confidence < 0 OR confidence > 1 THEN 'confidence' END,
CASE WHEN coalesce(len(types), 0) <= 0 THEN 'types' END, CASE WHEN NOT coalesce(regexp_matches(builder_version, '^\d+\.\d+\.\d+$'), false) THEN 'version' END, CASE WHEN NOT coalesce(validated, false) THEN 'validated' END], lambda x: x IS NOT NULL)) AS rule FROM canonical_entities""",
    "a_retrieval_meta": _DOCS + " SELECT doc_id, role, CASE WHEN role IN ('policy', 'procedure') THEN 0.05::DOUBLE WHEN role IN ('manual', 'guide') THEN 0.03::DOUBLE ELSE 0.0::DOUBLE END AS boost_weight, role IN ('policy', 'procedure', 'manual') AS two_stage_eligible, CASE role WHEN 'annex' THEN 'strict' WHEN 'other' THEN 'none' ELSE 'soft' END AS scoping_preference FROM d",
    "a_artifacts": f"SELECT record_id, entity_id, {_F % 'canonical_name'} AS canonical_name, array_to_string(list_sort(list_distinct(list_filter(types, lambda x: x IS NOT NULL))), '|') AS types, confidence, generated_by.extractor_id AS extractor_id FROM canonical_entities WHERE ({_U}) IS NOT NULL",
    "a_checksums": _CANON + """, j AS (SELECT entity_id, '{"entity_id":' || to_json(entity_id)::VARCHAR || ',"key":' || to_json(key)::VARCHAR || '}' AS body FROM m) SELECT entity_id, sha256(body) AS sha256, length(body) AS size FROM j""",
    "a_retention": "SELECT entity_id, record_id, age_rank FROM (SELECT entity_id, record_id, row_number() OVER (PARTITION BY entity_id ORDER BY record_id DESC) AS age_rank FROM canonical_entities) WHERE age_rank > 2",
}
