"""Claims into knowledge: canonical names, merges, confidence policies, indexes, validation, artifacts.

Claims carry ``ord``, the order of extraction: wherever the first claim wins, the smallest ``ord`` does. All
merges are grouped aggregates that combine before the shuffle; names are compared folded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tamizal.functions.text import fold, slug, squeeze

# How far each kind of extractor is trusted, and the trust in others.
EXTRACTOR_WEIGHTS = {"deterministic:equivalences-text": 0.95, "deterministic:entity-aliases-dict": 0.90, "deterministic:doc-cards": 0.70, "llm:granite-4.1-3b": 0.85}
OTHER_WEIGHT = 0.5


def usable(confidence: Column) -> Column:
    """A confidence above 0 and at most 1; anything else counts as missing."""
    return F.when(~F.isnan(confidence) & (confidence > 0) & (confidence <= 1), confidence)


def extractor_weight(extractor: Column) -> Column:
    w = F.lit(OTHER_WEIGHT)
    for name, value in EXTRACTOR_WEIGHTS.items():
        w = F.when(extractor == name, value).otherwise(w)
    return w


def combined_confidence(policy: str, confidence: Column, extractor: Column) -> Column:
    """An aggregate over the usable confidences of a group; filtered together with their extractors. Null if none is usable.

    max; mean; weighted (by extractor, at most 1); bayesian (1 - product of 1 - p).
    """
    p = usable(confidence)
    if policy == "max":
        return F.max(p)
    if policy == "mean":
        return F.avg(p)
    if policy == "weighted":
        w = F.when(p.isNotNull(), extractor_weight(extractor))
        return F.least(F.sum(p * w) / F.sum(w), F.lit(1.0))
    if policy == "bayesian":
        sure = F.max((p >= 1).cast("int"))
        return F.when(sure == 1, 1.0).when(F.count(p) > 0, 1 - F.exp(F.sum(F.log1p(-F.when(p < 1, p)))))
    raise ValueError(f"unknown policy {policy}")


def name_of(c: Column) -> Column:
    """The folded name, null where it names nothing."""
    f = fold(c)
    return F.when((f != "") & (f != "unknown"), f)


def canonical_map(claims: DataFrame) -> DataFrame:
    """(key, canonical, entity_id): the first spelling of each folded canonical name and its id."""
    named = claims.withColumn("key", name_of(F.col("canonical_name"))).where("key is not null")
    first = named.groupBy("key").agg(F.min_by("canonical_name", "ord").alias("canonical"))
    return first.withColumn("entity_id", F.concat(F.lit("ent:"), slug(F.col("key"))))


def merge_entities(claims: DataFrame, policy: str = "weighted") -> DataFrame:
    """One row per folded canonical name: first surface form, types in order of first claim, extractors sorted, confidence, number of claims."""
    named = claims.withColumn("key", name_of(F.col("canonical_name"))).where("key is not null")
    merged = named.groupBy("key").agg(
        F.min_by(squeeze(F.col("surface_form")), "ord").alias("surface"),
        F.array_join(F.array_sort(F.collect_set("extractor_id")), "|").alias("extractors"),
        F.round(combined_confidence(policy, F.col("confidence"), F.col("extractor_id")), 6).alias("confidence"),
        F.count("*").alias("claims"),
    )
    types = named.select("key", "ord", F.explode("entity_types").alias("type")).where("type is not null").groupBy("key", F.lower("type").alias("type")).agg(F.min("ord").alias("ord"))
    listed = types.groupBy("key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "type"))), lambda x: x["type"]), "|").alias("types"))
    return merged.join(listed, "key", "left").select("key", "surface", F.coalesce("types", F.lit("")).alias("types"), "extractors", "confidence", "claims")


def merge_aliases(claims: DataFrame) -> DataFrame:
    """One row per folded (alias, canonical) pair with its confidence, extractors and first claim."""
    named = claims.select("*", name_of(F.col("alias")).alias("a"), name_of(F.col("canonical_name")).alias("c")).where("a is not null and c is not null")
    return named.groupBy("a", "c").agg(
        F.min("ord").alias("first_ord"),
        F.array_join(F.array_sort(F.collect_set("extractor_id")), "|").alias("extractors"),
        F.round(combined_confidence("weighted", F.col("confidence"), F.col("extractor_id")), 6).alias("confidence"),
    )


def merge_documents(hits: DataFrame) -> DataFrame:
    """One row per document of the hits: the best hit by reranker score, first on ties, and the most pages."""
    score = F.coalesce(F.when(~F.isnan("rerank_score"), F.col("rerank_score")), F.lit(-1.0))
    return hits.where("canonical_doc_id is not null").groupBy("canonical_doc_id").agg(
        F.max_by("hit_id", F.struct(score, -F.col("hit_id"))).alias("best_hit"), F.max("page").alias("last_page"), F.count("*").alias("n")
    )


def evidence_set(claims: DataFrame) -> DataFrame:
    """(key, source_doc_id, quote): evidence of each entity without repeats."""
    named = claims.withColumn("key", name_of(F.col("canonical_name"))).where("key is not null")
    return named.select("key", F.inline("evidence")).groupBy("key", "source_doc_id", "quote").agg(F.count("*").alias("times"))


def entity_documents(claims: DataFrame) -> DataFrame:
    """Per entity the sorted set of documents in its evidence, its sorted extractors and its best confidence."""
    named = claims.withColumn("key", name_of(F.col("canonical_name"))).where("key is not null")
    seen = named.select("key", "confidence", "extractor_id", F.explode("evidence").alias("e")).where("e.source_doc_id is not null")
    return seen.groupBy("key").agg(F.array_sort(F.collect_set("e.source_doc_id")).alias("documents"), F.array_sort(F.collect_set("extractor_id")).alias("extractors"), F.max(usable(F.col("confidence"))).alias("confidence"))


def entity_index(claims: DataFrame) -> DataFrame:
    """Per entity: number of documents in its evidence, the first and last of them, best confidence."""
    named = claims.withColumn("key", name_of(F.col("canonical_name"))).where("key is not null")
    seen = named.select("key", "confidence", F.explode_outer("evidence").alias("e"))
    return seen.groupBy("key").agg(
        F.countDistinct("e.source_doc_id").alias("documents"), F.min("e.source_doc_id").alias("first_doc"), F.max("e.source_doc_id").alias("last_doc"), F.max(usable(F.col("confidence"))).alias("confidence")
    )


def alias_stubs(aliases: DataFrame, entities: DataFrame) -> DataFrame:
    """Canonical names that only aliases know, as entities at half the confidence."""
    known = entities.select(name_of(F.col("canonical_name")).alias("key")).distinct()
    named = aliases.withColumn("key", name_of(F.col("canonical_name"))).where("key is not null")
    only = named.join(known, "key", "left_anti")
    return only.groupBy("key").agg(F.round(0.5 * F.max(usable(F.col("confidence"))), 6).alias("confidence"), F.count("*").alias("claims"))


def resolve_aliases(aliases: DataFrame, entities: DataFrame) -> DataFrame:
    """(alias, key, documents): each alias with the canonical names it stands for and how many documents these have."""
    pairs = aliases.select(name_of(F.col("alias")).alias("alias"), name_of(F.col("canonical_name")).alias("key")).where("alias is not null and key is not null").distinct()
    return pairs.join(entity_index(entities).select("key", "documents"), "key")


def structural_findings(claims: DataFrame) -> DataFrame:
    """(claim_id, level, finding): errors, warnings and quarantine of single claims."""
    conf = F.col("confidence")
    tests = [
        ("error", "no canonical name", name_of(F.col("canonical_name")).isNull()),
        ("error", "confidence out of range", conf.isNotNull() & (F.isnan(conf) | (conf < 0) | (conf > 1))),
        ("warning", "confidence zero or missing", conf.isNull() | (conf == 0)),
        ("quarantine", "no evidence", F.coalesce(F.size("evidence"), F.lit(0)) <= 0),
    ]
    found = F.filter(F.array(*[F.when(t, F.struct(F.lit(level).alias("level"), F.lit(what).alias("finding"))) for level, what, t in tests]), lambda x: x.isNotNull())
    return claims.select("claim_id", F.inline(found))


def contradictions(aliases: DataFrame) -> DataFrame:
    """Aliases that stand for several canonical names."""
    pairs = aliases.select(name_of(F.col("alias")).alias("alias"), name_of(F.col("canonical_name")).alias("key")).where("alias is not null and key is not null")
    return pairs.groupBy("alias").agg(F.countDistinct("key").alias("names"), F.count("*").alias("claims")).where("names > 1")


def self_claims(aliases: DataFrame) -> DataFrame:
    """Claims of a name to itself."""
    return aliases.select("claim_id", name_of(F.col("alias")).alias("alias"), name_of(F.col("canonical_name")).alias("key")).where("alias = key").select("claim_id", "key")


def slug_collisions(claims: DataFrame) -> DataFrame:
    """Ids that several different folded names share."""
    return canonical_map(claims).groupBy("entity_id").agg(F.count("*").alias("names")).where("names > 1")


def difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """(name, side): names that only one of two sets has."""
    a, b = left.select("name").distinct(), right.select("name").distinct()
    return a.join(b, "name", "left_anti").withColumn("side", F.lit("left")).unionByName(b.join(a, "name", "left_anti").withColumn("side", F.lit("right")))


def reference_errors(entities: DataFrame, documents: DataFrame, aliases: DataFrame) -> DataFrame:
    """(rule, value): references that lead nowhere: evidence to unknown documents, aliases to unknown names."""
    docs = documents.select(F.col("canonical_doc_id").alias("value")).distinct()
    cited = entities.select(F.explode("evidence").alias("e")).select(F.col("e.source_doc_id").alias("value")).where("value is not null").distinct()
    names = entities.select(name_of(F.col("canonical_name")).alias("value")).distinct()
    meant = aliases.select(name_of(F.col("canonical_name")).alias("value")).where("value is not null").distinct()
    return cited.join(docs, "value", "left_anti").select(F.lit("evidence").alias("rule"), "value").unionByName(meant.join(names, "value", "left_anti").select(F.lit("alias").alias("rule"), "value"))


def schema_errors(records: DataFrame) -> DataFrame:
    """(record_id, rule): records that break the artifact schema."""
    conf = F.col("confidence")
    tests = {
        "entity_id": ~F.coalesce(F.col("entity_id").rlike("^ent:[a-z0-9]+(-[a-z0-9]+)*$"), F.lit(False)),
        "confidence": conf.isNull() | F.isnan(conf) | (conf < 0) | (conf > 1),
        "types": F.coalesce(F.size("types"), F.lit(0)) <= 0,
        "version": ~F.coalesce(F.col("builder_version").rlike(r"^\d+\.\d+\.\d+$"), F.lit(False)),
        "validated": ~F.coalesce(F.col("validated"), F.lit(False)),
    }
    rules = F.filter(F.array(*[F.when(t, F.lit(r)) for r, t in tests.items()]), lambda x: x.isNotNull())
    return records.select("record_id", F.explode(rules).alias("rule"))


def retrieval_metadata(documents: DataFrame) -> DataFrame:
    """Per document: boost, two-stage eligibility and scope preference by its role."""
    role = document_role(F.coalesce("title", F.lit("")))
    return documents.select("doc_id", role.alias("role")).select(
        "doc_id", "role",
        F.when(F.col("role").isin("policy", "procedure"), 0.05).when(F.col("role").isin("manual", "guide"), 0.03).otherwise(0.0).alias("boost_weight"),
        F.col("role").isin("policy", "procedure", "manual").alias("two_stage_eligible"),
        F.when(F.col("role") == "annex", "strict").when(F.col("role") == "other", "none").otherwise("soft").alias("scoping_preference"),
    )


# Words of a title that tell the role of a document, first match wins.
ROLES = [("annex", "anexo|annex"), ("procedure", "procedimiento|procedure|runbook|playbook"), ("policy", "politica|policy"), ("manual", "manual|handbook"), ("guide", "guia|guide|instructivo"), ("record", "minuta|reporte|informe|review"), ("inventory", "inventario|inventory|checklist"), ("plan", "plan")]


def document_role(title: Column) -> Column:
    role = F.lit("other")
    for name, words in reversed(ROLES):
        role = F.when(fold(title).rlike(rf"(?:^|[^a-z])(?:{words})(?:[^a-z]|$)"), name).otherwise(role)
    return role


def checksums(artifacts: DataFrame, key: str) -> DataFrame:
    """SHA-256 and size of each row's canonical JSON: fields in order of name."""
    body = F.to_json(F.struct(*[F.col(c) for c in sorted(artifacts.columns)]))
    return artifacts.select(key, F.sha2(body, 256).alias("sha256"), F.length(body).cast("long").alias("size"))


def retention(builds: DataFrame, group: str, order: str, keep: int = 5) -> DataFrame:
    """Builds of each group beyond the newest ``keep``."""
    w = Window.partitionBy(group).orderBy(F.desc(order))
    return builds.withColumn("age_rank", F.row_number().over(w)).where(F.col("age_rank") > keep)


def select_documents(documents: DataFrame, role: str, centrality: Column, n: int = 60) -> DataFrame:
    """The ``n`` most central documents of a role."""
    fit = documents.where(document_role(F.coalesce("title", F.lit(""))) == role)
    return fit.withColumn("centrality", centrality).orderBy(F.desc("centrality"), "doc_id").limit(n)


# Predicates of the catalog; what other predicates fall back to (target: predicates, separated by commas);
# roles of documents and the wider role each belongs to; words in names that tell a type.
CATALOG = ("equivalent_to", "depends_on", "implements", "extends", "references", "governs", "contains", "uses", "creates")
FALLBACK = {
    "references": "related_to,contradicts,describes,covers,applies_to,located_in,compares_with,is_located_in,interacts_with,is located in,is referenced by,maps_to,corresponds_to,is_similar_to,is_related_to,is_associated_with,is_compatible_with,"
    "is_incompatible_with,precedes,follows,is_defined_in,is_described_in,is_specified_in,documents,categorizes,classifies",
    "depends_on": "requires,is_based_on,is_derived_from,derived_from,is based on,is derived from,depends on,is_required_by,based_on,is_enabled_by,is_facilitated_by",
    "creates": "provides,defines,produces,created_by,is created by,specifies,establishes,determines,identifies",
    "contains": "includes,contains,belongs_to,part_of,is_part_of,is_composed_of,is part of,is composed of,is contained in,composed_of,consists_of,incorporates,embeds,groups,aggregates,is_grouped_in,is_aggregated_in",
    "implements": "supports,is_instance_of,is instance of,is implemented by,implements_for",
    "equivalent_to": "aligned_with,is_alternative_to,alternative_to,is alternative to,is equivalent to,is_equivalent_to",
    "governs": "complies_with,certifies,is_certification_for,is certification for,is governed by,enforces,mandates,requires_compliance_with",
    "extends": "supersedes,is_type_of,is type of,is extended by,replaces,superseded_by,specializes,generalizes,inherits_from,is_inherited_by",
    "uses": "is_used_by,is used by,utilizes,consumes,invokes,calls,is_called_by,is_utilized_by",
    "supports": "enables,facilitates",
}
ROLE_TAXONOMY = {
    "framework_list": "list", "cert_list": "list", "standard_profile": "entity_profile", "entity_profile": "entity_profile", "procedure": "guide", "manual_reference": "reference", "security_ops": "guide", "analysis_report": "analysis",
    "threat_intel": "analysis", "policy_compliance": "reference", "list": "list", "guide": "guide", "reference": "reference", "analysis": "analysis", "other": "other",
}
TYPE_WORDS = {
    "framework": "iso nist cobit itil owasp", "standard": "iso nist pci", "certification": "cissp ceh oscp cism cisa ccsp crisc gsec gcih", "concept": "cia risk governance compliance", "technology": "siem soc edr xdr waf ids ips dlp pam sso",
    "protocol": "tls ssl dns tcp ospf bgp mpls", "regulation": "gdpr dora nis2 hipaa sox", "methodology": "devsecops sdlc sast dast",
}


def map_predicate(predicate: Column) -> Column:
    """The catalog's predicate: its own name, else what it falls back to, and 'references' where that is outside the catalog too. Compared folded."""
    name = fold(predicate)
    pairs = [(p, target) for target, listed in FALLBACK.items() for p in listed.split(",")]
    table = F.create_map(*[F.lit(x) for kv in pairs for x in kv])
    return F.when(name.isin(*CATALOG), name).otherwise(F.when(table[name].isin(*CATALOG), table[name]).otherwise("references"))


def wider_role(role: Column) -> Column:
    """The wider role of a role; 'other' for unknown ones."""
    return F.coalesce(F.create_map(*[F.lit(x) for kv in ROLE_TAXONOMY.items() for x in kv])[role], F.lit("other"))


def infer_types(name: Column) -> Column:
    """Types whose words a name contains, in order of the list; 'concept' if none does."""
    low = F.lower(name)
    found = F.filter(F.array(*[F.when(low.rlike(words.replace(" ", "|")), F.lit(t)) for t, words in TYPE_WORDS.items()]), lambda x: x.isNotNull())
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("concept")))


def best_name(names: Column) -> Column:
    """The canonical name of a cluster: the longest that has a blank or a small letter, else the longest; the first in order on ties."""
    rich = F.filter(names, lambda x: F.contains(x, F.lit(" ")) | x.rlike(r"\p{Ll}"))
    pool = F.when(F.size(rich) > 0, rich).otherwise(names)
    return F.get(F.transform(F.array_sort(F.transform(pool, lambda x: F.struct((-F.length(x)).alias("l"), x.alias("x")))), lambda s: s["x"]), F.lit(0))


def cross_errors(canonical: DataFrame, aliases: DataFrame, index: DataFrame, roles: DataFrame, relations: DataFrame, retrieval: DataFrame) -> DataFrame:
    """(rule, value, at): references between artifacts that lead nowhere, by the six rules of the contract.

    canonical: entity_id; aliases: alias, entity_id; index: entity_id; roles: doc_id, entity_ids; relations:
    relation_id, subject, predicate, object; retrieval: doc_id. All are anti-joins, of distinct ids.
    """
    known, docs = canonical.select("entity_id").distinct(), roles.select("doc_id").distinct()
    off = lambda rows, rule: rows.where("entity_id is not null").join(known, "entity_id", "left_anti").select(F.lit(rule).alias("rule"), F.col("entity_id").alias("value"), F.col("at").cast("string").alias("at"))
    found = relations.where(F.col("predicate").isNotNull() & ~F.col("predicate").isin(*CATALOG)).select(F.lit("predicate").alias("rule"), F.col("predicate").alias("value"), F.col("relation_id").cast("string").alias("at"))
    found = found.unionByName(off(aliases.select("entity_id", F.col("alias").alias("at")), "alias")).unionByName(off(index.select("entity_id", F.lit("").alias("at")), "index"))
    found = found.unionByName(off(roles.select(F.explode("entity_ids").alias("entity_id"), F.col("doc_id").alias("at")), "role"))
    ends = relations.select(F.explode(F.array("subject", "object")).alias("entity_id"), F.col("relation_id").alias("at"))
    found = found.unionByName(off(ends, "relation"))
    lost = retrieval.select("doc_id").join(docs, "doc_id", "left_anti")
    return found.unionByName(lost.select(F.lit("retrieval").alias("rule"), F.col("doc_id").cast("string").alias("value"), F.lit("").alias("at")))
