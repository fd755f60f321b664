"""Queries of text functions, document cards, query classification, conversation windows and score adjustments."""

from __future__ import annotations

from pyspark.sql import functions as F

from tamizal.functions.text import doc_slug, fold, slug
from tamizal.operators import boosting as B
from tamizal.operators import documents as T
from tamizal.operators.knowledge import ROLES, document_role
from tamizal.operators.questions import question_flags
from tamizal.operators.ranking import SEARCH
from tamizal.session import small, table


def _t(name):
    return lambda s, d: table(s, d, name)


DOCS, HITS, ALIASES, FILES, ITEMS = _t("documents"), _t("hits"), _t("alias_claims"), _t("ingest_registry"), _t("eval_questions")


def _entities(s, d):
    return ITEMS(s, d).select(F.col("item_id").alias("query_id"), F.coalesce("answer_keywords", F.array().cast("array<string>")).alias("entities"))


def _cards(s, d):
    c = DOCS(s, d).where("canonical_doc_id is not null").select("canonical_doc_id", document_role(F.coalesce("title", F.lit(""))).alias("role"), (F.col("n_chars") / 10000.0).alias("centrality"), T.attributes(F.coalesce("text", F.lit(""))).alias("attributes"))
    return c.groupBy("canonical_doc_id").agg(F.min("role").alias("role"), F.max("centrality").alias("centrality"), F.array_distinct(F.flatten(F.collect_set("attributes"))).alias("attributes"))


def _specific(s, d):
    """Questions that name an entity and ask for no procedure."""
    procedural = question_flags(F.col("question"), F.array().cast("array<string>"))["procedural"]
    return ITEMS(s, d).where((F.size("answer_keywords") > 0) & ~procedural).select(F.col("item_id").alias("query_id"))


def _entity_docs(s, d):
    h = HITS(s, d).where("canonical_doc_id like 'doc:anexo%'")
    return h.select("query_id", "canonical_doc_id").distinct()


def _turns(s, d):
    """A user's events in order stand for a conversation; purchases and sign-ups name a topic."""
    e = table(s, d, "events")
    w = T.Window.partitionBy("user_id").orderBy("ts", "event_id")
    return e.select(F.col("user_id").alias("conv_id"), F.row_number().over(w).alias("turn"), "event_id", "event_type", F.when(F.col("event_type").isin("purchase", "signup"), F.col("event_type")).alias("topic"))


def j_parse(s, d):
    """Objects wrapped as a model would answer, repaired and read again."""
    e = table(s, d, "events")
    raw = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("Here it is:\n```json\n"), "props", F.lit("\n```"))).when(F.col("event_id") % 3 == 1, F.regexp_replace("props", r"\}$", ",}")).otherwise(F.regexp_replace("props", r"\}$", ""))
    parsed = F.from_json(T.repair_json(raw), "k int")
    return e.select("event_id", parsed["k"].alias("k"))


def t_chunks(s, d):
    c = T.token_chunks(DOCS(s, d), 60, 10).join(DOCS(s, d).select("doc_id", F.coalesce(F.lower(F.trim("source")), F.lit("none")).alias("src")), "doc_id")
    return T.chunk_ids(c, F.col("src")).select("doc_id", "chunk_index", "tokens", "chunk_id")


def t_equiv(s, d):
    line = F.concat_ws(" = ", "alias", F.concat("canonical_name", F.lit(" (note)")), "alias")
    return ALIASES(s, d).select("claim_id", T.equivalences(line).alias("names")).where("names is not null").select("claim_id", F.size("names").alias("n"), F.array_join("names", "|").alias("names"))


def t_gazetteer(s, d):
    a = table(s, d, "canonical_entities").select(fold(F.col("canonical_name")).alias("name"), F.lit("entity").alias("kind"))
    b = HITS(s, d).select(fold(F.regexp_replace("source", r"\.[A-Za-z]+$", "")).alias("name"), F.lit("document").alias("kind"))
    return a.unionByName(b).where("name <> ''").groupBy("name").agg(F.min("kind").alias("kind"), F.count("*").alias("n"))


def d_vendor(s, d):
    return DOCS(s, d).select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("[A-Z][a-z]{4,}"), F.lit(0)))).alias("name")).groupBy("name").agg(F.count("*").alias("docs")).where("docs >= 2")


def x_compare_cover(s, d):
    """Per entity of a question the first hit that mentions it."""
    m = B.ranked(HITS(s, d)).join(small(_entities(s, d)), "query_id").select(*SEARCH, "hit_id", "rank", "text", F.explode("entities").alias("entity"))
    m = m.where(F.contains(F.lower("text"), F.lower("entity")))
    return m.groupBy(*SEARCH, "entity").agg(F.min("rank").alias("rank"), F.count("*").alias("mentions"))


QUERIES = {
    "t_normalize": lambda s, d: ALIASES(s, d).select("claim_id", fold(F.col("alias")).alias("alias"), fold(F.col("canonical_name")).alias("canonical")),
    "t_slug": lambda s, d: ALIASES(s, d).select("claim_id", slug(F.col("canonical_name")).alias("slug")),
    "t_doc_id": lambda s, d: FILES(s, d).select("entry_id", doc_slug(F.col("filename")).alias("doc")),
    "t_hash": lambda s, d: DOCS(s, d).select("doc_id", F.sha2("text", 256).alias("sha"), F.md5(F.trim(F.regexp_replace(F.lower("text"), r"[ \t\r\n]+", " "))).alias("md5")),
    "t_chunk_tok": lambda s, d: T.token_chunks(DOCS(s, d)).select("doc_id", "chunk_index", "tokens", F.md5("text").alias("md5")),
    "t_chunk_sem": lambda s, d: T.semantic_chunks(DOCS(s, d)),
    "t_chunk_par": lambda s, d: T.semantic_chunks(DOCS(s, d), 4000),
    "t_chunks": t_chunks,
    "t_equiv": t_equiv,
    "t_equiv_map": lambda s, d: T.longest_names(ALIASES(s, d)),
    "t_lex_expand": lambda s, d: ITEMS(s, d).select("item_id", T.expand_terms(F.col("question"), T.LEXICON).alias("expanded")),
    "t_trigger_expand": lambda s, d: DOCS(s, d).select("doc_id", T.trigger_terms(F.col("text")).alias("terms")),
    "t_norm_query": lambda s, d: ALIASES(s, d).select("claim_id", T.normalize_query(F.col("alias")).alias("alias")),
    "t_entities": lambda s, d: DOCS(s, d).select("doc_id", F.array_join(F.array_sort(T.entities(F.col("text"))), "|").alias("entities")),
    "t_gazetteer": t_gazetteer,
    "c_entity_clean": lambda s, d: DOCS(s, d).select("doc_id", F.array_join(T.clean_entities(T.entities(F.col("text"))), "|").alias("entities")),
    "c_intent": lambda s, d: DOCS(s, d).select("doc_id", *T.intent_flags(F.col("text"))),
    "c_ood": lambda s, d: DOCS(s, d).select("doc_id", F.coalesce(T.out_of_domain(F.col("text")), F.lit(False)).alias("ood")),
    "c_plan": lambda s, d: DOCS(s, d).select("doc_id", T.semantic_weight(F.col("text")).alias("weight")),
    "c_docref": lambda s, d: HITS(s, d).select("hit_id", *T.doc_reference(F.coalesce("source", F.lit("")))),
    "d_cards": lambda s, d: T.cards(DOCS(s, d), document_role),
    "d_role": lambda s, d: DOCS(s, d).groupBy(document_role(F.coalesce("title", F.lit(""))).alias("role")).agg(F.count("*").alias("n")),
    "d_attrs": lambda s, d: DOCS(s, d).select(F.explode(T.attributes(F.col("text"))).alias("attribute")).groupBy("attribute").agg(F.count("*").alias("n")),
    "d_vendor": d_vendor,
    "j_parse": j_parse,
    "cv_recent": lambda s, d: T.recent(_turns(s, d)).select("conv_id", "turn", "event_id", "age"),
    "cv_sticky": lambda s, d: T.sticky(_turns(s, d), "topic").select("event_id", "carried"),
    "r_entity_filter": lambda s, d: B.entity_filter(HITS(s, d), _entities(s, d)).select(*SEARCH, "hit_id", "matches", F.round("boosted", 6).alias("boosted")),
    "r_type": lambda s, d: B.type_filter(HITS(s, d), F.lower("source").contains("scada"), F.lower("source").contains("phishing")).select(*SEARCH, "hit_id", "fit", "place"),
    "r_role_boost": lambda s, d: B.role_boost(HITS(s, d), _cards(s, d), ["manual", "guide"], "risk", _specific(s, d)).select(*SEARCH, "hit_id", F.round("boosted", 6).alias("boosted")),
    "r_mention": lambda s, d: B.mention_boost(HITS(s, d), _entities(s, d)).select(*SEARCH, "hit_id", F.round("boosted", 6).alias("boosted")),
    "r_exact": lambda s, d: B.exact_boost(HITS(s, d), _entities(s, d)).select(*SEARCH, "hit_id", F.round("boosted", 6).alias("boosted")),
    "r_two_stage": lambda s, d: B.two_stage(HITS(s, d), _entity_docs(s, d)).select(*SEARCH, "hit_id", "of_entity", "gate", F.round("boosted", 6).alias("boosted")),
    "r_in_doc": lambda s, d: B.in_document(HITS(s, d), "manual", 20).select(*SEARCH, "hit_id", "far", "exact", F.round("boosted", 6).alias("boosted")),
    "r_source_score": lambda s, d: B.source_score(HITS(s, d)),
    "q_count_answer": lambda s, d: B.majority_number(HITS(s, d)),
    "x_categorize": lambda s, d: B.content_category(HITS(s, d)).select(*SEARCH, "hit_id", "kind", "place"),
    "x_snippets": lambda s, d: HITS(s, d).where("text is not null").select("hit_id", F.md5(F.concat(F.substring("text", 1, 600), F.when(F.length("text") > 600, "...").otherwise(""))).alias("snippet"), F.concat_ws(" ", F.lit("[Doc -"), F.coalesce("source", F.lit("?")), F.concat(F.lit("p."), F.col("page").cast("string"), F.lit("]"))).alias("label")),
    "x_compare_cover": x_compare_cover,
}

_FOLD = r"trim(regexp_replace(lower(strip_accents(%s)), '[\s\x{1c}-\x{1f}\x{85}\pZ]+', ' ', 'g'))"
_SLUG = r"regexp_replace(regexp_replace(" + _FOLD + r", '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')"
_N = lambda c: f"CASE WHEN isnan({c}) THEN NULL ELSE {c} END"
_H = f"""WITH h0 AS (SELECT hit_id, run_id, query_id, text, source, page, canonical_doc_id, coalesce({_N('hybrid_score')}, 0) AS hs, coalesce({_N('final_score')}, 0) AS fs, {_N('final_score')} AS final_score FROM hits),
h AS (SELECT *, row_number() OVER (PARTITION BY run_id, query_id ORDER BY final_score DESC NULLS LAST, hit_id) AS rank FROM h0)"""
_EN = "e AS (SELECT item_id AS query_id, coalesce(answer_keywords, []::VARCHAR[]) AS entities FROM eval_questions)"
_FILL = lambda n: rf"""WITH RECURSIVE p AS (SELECT doc_id, list_filter(flatten(list_transform(list_transform(regexp_split_to_array(coalesce(text, ''), '\n+'), lambda x: regexp_replace(x, '^[\s\pZ\x{{1c}}-\x{{1f}}\x{{85}}]+|[\s\pZ\x{{1c}}-\x{{1f}}\x{{85}}]+$', '', 'g')),
lambda x: CASE WHEN length(x) <= {n} THEN [x] ELSE string_split(regexp_replace(x, '([.!?])[\s\pZ\x{{1c}}-\x{{1f}}\x{{85}}]+', '\1' || chr(1), 'g'), chr(1)) END)), lambda x: x <> '') AS p FROM documents),
f AS (SELECT doc_id, p, 1 AS i, 0 AS k, p[1] AS held FROM p WHERE len(p) > 0 UNION ALL SELECT doc_id, p, i + 1, CASE WHEN length(held) + 1 + length(p[i + 1]) > {n} THEN k + 1 ELSE k END, CASE WHEN length(held) + 1 + length(p[i + 1]) > {n} THEN p[i + 1] ELSE held || ' ' || p[i + 1] END FROM f WHERE i < len(p))
SELECT doc_id, k AS chunk_index, arg_max(held, i) AS text FROM f GROUP BY doc_id, k"""  # noqa: E731
_ROLE = "CASE " + " ".join(f"WHEN regexp_matches({_FOLD % 'coalesce(title, chr(32))'}, '(?:^|[^a-z])(?:{w})(?:[^a-z]|$)') THEN '{r}'" for r, w in ROLES) + " ELSE 'other' END"
_CH = lambda size, step: rf"w AS (SELECT doc_id, source, list_filter(regexp_split_to_array(coalesce(text, ''), '\s+'), lambda x: x <> '') AS w FROM documents), k AS (SELECT doc_id, source, w, unnest(range(1 + CAST(greatest(ceil((len(w) - {size}) / {step}), 0) AS INT))) AS i FROM w WHERE len(w) > 0), c AS (SELECT doc_id, source, CAST(i AS INT) AS chunk_index, w[i * {step} + 1 : i * {step} + {size}] AS p FROM k)"
_ENTS = f"list_distinct(regexp_extract_all(text, '{T.ENTITY}'))"
_L = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"
_WL = rf"regexp_split_to_array({_FOLD % 'text'}, '[^a-z0-9]+')"
_HITS_IN = lambda c: f"len(list_filter({_L(T.DOMAIN)}, lambda w: contains({c}, w)))"
_TURNS = "WITH t AS (SELECT user_id AS conv_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS turn, CASE WHEN event_type IN ('purchase', 'signup') THEN event_type END AS topic FROM events)"
_NORM = rf"regexp_replace({_FOLD % 'alias'}, '\b([a-z])([0-9]{{1,3}})\b', '\1_\2', 'g')"
for _r, _d in (("viii", "8"), ("vii", "7"), ("iii", "3"), ("ii", "2"), ("iv", "4"), ("vi", "6"), ("ix", "9")):
    _NORM = rf"regexp_replace({_NORM}, '\b{_r}\b', '{_d}', 'g')"
_ATTR = "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(coalesce(text, ''), '{p}') THEN '{n}' END" for n, p in T.ATTRIBUTES.items()) + "], lambda x: x IS NOT NULL)"
_ROM = lambda c: f"regexp_extract(upper({c}), '(?:^|[^A-Z])((?:IX|IV|V?I{{1,3}}|V|X))(?:[^A-Z]|$)', 1)"

_STEM = r"regexp_replace(coalesce(title, ''), '\.[^.]*$', '')"

SQL = {
    "t_normalize": f"SELECT claim_id, {_FOLD % 'alias'} AS alias, {_FOLD % 'canonical_name'} AS canonical FROM alias_claims",
    "t_slug": f"SELECT claim_id, CASE WHEN coalesce({_SLUG % 'canonical_name'}, '') = '' THEN 'unknown' ELSE {_SLUG % 'canonical_name'} END AS slug FROM alias_claims",
    "t_doc_id": rf"SELECT entry_id, 'doc:' || {_SLUG % 'stem'} AS doc FROM (SELECT entry_id, regexp_replace(filename, '\.[^.]*$', '') AS stem FROM ingest_registry)",
    "t_hash": r"SELECT doc_id, sha256(text) AS sha, md5(trim(regexp_replace(lower(text), '[ \t\r\n]+', ' ', 'g'))) AS md5 FROM documents",
    "t_chunk_tok": f"WITH {_CH(350, 300)} SELECT doc_id, chunk_index, CAST(len(p) AS INT) AS tokens, md5(array_to_string(p, ' ')) AS md5 FROM c",
    "t_chunks": f"WITH {_CH(60, 50)} SELECT doc_id, chunk_index, CAST(len(p) AS INT) AS tokens, coalesce(lower(trim(source)), 'none') || '_' || substr(sha256(array_to_string(p, ' ')), 1, 8) || '_' || chunk_index AS chunk_id FROM c",
    "t_equiv": r"""WITH l AS (SELECT claim_id, concat_ws(' = ', alias, canonical_name || ' (note)', alias) AS line FROM alias_claims), n AS (SELECT claim_id, list_filter(list_transform(string_split(regexp_replace(line, '\([^)]*\)|\{[^}]*\}', '', 'g'), '='), lambda x: trim(regexp_replace(x, '[\s\x{1c}-\x{1f}\x{85}\pZ]+', ' ', 'g'))), lambda x: x <> '') AS a FROM l),
u AS (SELECT claim_id, list_filter(a, lambda x, i: list_position(a, x) = i) AS names FROM n) SELECT claim_id, CAST(len(names) AS INT) AS n, array_to_string(names, '|') AS names FROM u WHERE len(names) >= 2""",
    "t_equiv_map": rf"WITH p AS (SELECT {_FOLD % 'canonical_name'} AS key, trim(regexp_replace(alias, '[\s\x{{1c}}-\x{{1f}}\x{{85}}\pZ]+', ' ', 'g')) AS alias FROM alias_claims) SELECT key, arg_max(alias, {{'l': length(alias), 'a': alias}}) AS longest, min(CASE WHEN regexp_matches(alias, '^[A-Z]{{2,8}}$') THEN alias END) AS acronym FROM p WHERE key <> '' AND alias <> '' GROUP BY key",
    "t_lex_expand": f"WITH lx AS (SELECT * FROM (VALUES {', '.join(chr(40) + repr(k) + ', ' + repr(v) + chr(41) for k, v in T.LEXICON.items())}) AS x(k, v)), q AS (SELECT item_id, question, list_distinct(list_filter(regexp_split_to_array({_FOLD % 'question'}, '[^a-z0-9]+'), lambda w: w <> '')) AS ws FROM eval_questions), m AS (SELECT item_id, string_agg(DISTINCT v, ' ' ORDER BY v) AS extra FROM (SELECT item_id, unnest(ws) AS w FROM q) JOIN lx ON w = k GROUP BY 1) SELECT q.item_id, question || ' ' || coalesce(extra, '') AS expanded FROM q LEFT JOIN m USING (item_id)",
    "t_trigger_expand": "SELECT doc_id, array_to_string(list_sort(list_distinct(list_concat(" + ", ".join(f"CASE WHEN regexp_matches({_FOLD % 'text'}, '{p}') THEN {_L(t.split())} ELSE []::VARCHAR[] END" for p, t in T.TRIGGERS.items()) + "))), ' ') AS terms FROM documents",
    "t_norm_query": f"SELECT claim_id, {_NORM} AS alias FROM alias_claims",
    "t_entities": f"SELECT doc_id, array_to_string(list_sort({_ENTS}), '|') AS entities FROM documents",
    "t_gazetteer": rf"WITH u AS (SELECT {_FOLD % 'canonical_name'} AS name, 'entity' AS kind FROM canonical_entities UNION ALL SELECT {_FOLD % 's'}, 'document' FROM (SELECT regexp_replace(source, '\.[A-Za-z]+$', '') AS s FROM hits)) SELECT name, min(kind) AS kind, count(*) AS n FROM u WHERE name <> '' GROUP BY 1",
    "c_entity_clean": f"WITH d AS (SELECT doc_id, {_ENTS} AS f FROM documents), o AS (SELECT doc_id, list_filter(f, lambda x: len(list_filter(f, lambda y: x <> y AND contains(y, x))) = 0) AS o FROM d) SELECT doc_id, array_to_string(list_transform(list_sort(list_transform(o, lambda x: {{'l': -length(x), 'x': x}}))[1:3], lambda s: s.x), '|') AS entities FROM o",
    "t_chunk_sem": _FILL(1000),
    "t_chunk_par": _FILL(4000),
    "c_intent": "SELECT doc_id, " + ", ".join(f"coalesce(regexp_matches({_FOLD % 'text'}, '{p}'), false) AS \"{n}\"" for n, p in T.INTENTS.items()) + " FROM documents",
    "c_ood": f"SELECT doc_id, coalesce(list_has_any({_WL}, {_L(T.FOREIGN)}) AND NOT list_has_any({_WL}, {_L(T.DOMAIN)}), false) AS ood FROM documents",
    "c_plan": f"SELECT doc_id, CASE WHEN regexp_matches({_FOLD % 'text'}, '{T.INTENTS['count']}') THEN 0.4::DOUBLE WHEN regexp_matches({_FOLD % 'text'}, '{T.INTENTS['procedure']}') THEN 0.5::DOUBLE WHEN regexp_matches({_FOLD % 'text'}, '{T.INTENTS['definition']}') THEN 0.7::DOUBLE ELSE 0.6::DOUBLE END AS weight FROM documents",
    "c_docref": rf"SELECT hit_id, regexp_extract({_FOLD % 'coalesce(source, chr(32))'}, '(?:pagina|page|pag|p)\.? ([0-9]{{1,4}})', 1) AS page, regexp_extract({_FOLD % 'coalesce(source, chr(32))'}, '(?:anexo|annex) ([a-z])(?:[^a-z]|$)', 1) AS annex FROM hits",
    "d_cards": rf"""WITH d AS (SELECT *, substr(regexp_split_to_array(coalesce(text, ''), '\n\n+')[1], 1, 800) AS f, {_SLUG % _STEM} AS sl FROM documents) SELECT doc_id, 'doc:' || CASE WHEN sl = '' THEN 'unknown' ELSE sl END AS card_id, {_ROLE} AS role,
round(least(1.0::DOUBLE, 0.1::DOUBLE + CASE WHEN {_HITS_IN(_FOLD % "coalesce(title, '')")} > 0 THEN 0.6::DOUBLE ELSE 0.0::DOUBLE END + least(0.3::DOUBLE, 0.05::DOUBLE * {_HITS_IN("lower(coalesce(text, ''))")})), 6) AS centrality, array_to_string({_ATTR}, '|') AS attributes, CAST(length(f) AS INT) AS first_chars, substr(f, 1, 400) AS summary FROM d""",
    "d_role": f"SELECT {_ROLE} AS role, count(*) AS n FROM documents GROUP BY 1",
    "d_attrs": f"SELECT attribute, count(*) AS n FROM (SELECT unnest({_ATTR}) AS attribute FROM documents WHERE text IS NOT NULL) GROUP BY 1",
    "d_vendor": "SELECT name, count(*) AS docs FROM (SELECT unnest(list_distinct(regexp_extract_all(text, '[A-Z][a-z]{4,}'))) AS name FROM documents) GROUP BY 1 HAVING count(*) >= 2",
    "j_parse": "SELECT event_id, CAST(props->>'k' AS INT) AS k FROM events",
    "cv_recent": _TURNS + " SELECT conv_id, turn, event_id, age FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS age FROM t) WHERE age <= 4",
    "cv_sticky": _TURNS + " SELECT event_id, coalesce(topic, last_value(topic IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)) AS carried FROM t",
    "r_entity_filter": _H + f""", {_EN}, x AS (SELECT h.*, entities, list_filter(entities, lambda k: len(list_filter([lower(k), replace(lower(k), ' del ', ' de '), replace(lower(k), ' de ', ' del ')], lambda f: contains(lower(coalesce(text, '')), f) OR contains(lower(coalesce(source, '')), f))) > 0) AS f FROM h JOIN e ON h.query_id = e.query_id),
y AS (SELECT *, coalesce(list_sum(list_transform(f, lambda k: CASE WHEN len(regexp_split_to_array(trim(k), '\\s+')) >= 3 THEN 3 ELSE 1 END)), 0) AS matches, hs * (1.0::DOUBLE + coalesce(list_sum(list_transform(f, lambda k: CASE WHEN len(regexp_split_to_array(trim(k), '\\s+')) >= 3 THEN 1.0::DOUBLE ELSE 0.3::DOUBLE END)), 0)) AS b FROM x),
z AS (SELECT *, max(matches) OVER (PARTITION BY run_id, query_id) AS best FROM y) SELECT run_id, query_id, hit_id, CAST(matches AS INT) AS matches, round(b, 6) AS boosted FROM z WHERE len(entities) = 0 OR matches >= 1 OR (best < 1 AND len(list_filter(entities, lambda k: len(regexp_split_to_array(trim(k), '\\s+')) >= 3)) > 0)""",
    "r_type": _H + """, x AS (SELECT *, coalesce(CAST(contains(lower(source), 'scada') AS INT) - CAST(contains(lower(source), 'phishing') AS INT), 0) AS fit FROM h), y AS (SELECT *, sum(CASE WHEN rank <= 10 AND fit > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY run_id, query_id) AS good FROM x), z AS (SELECT * FROM y WHERE good < 3 OR fit >= 0) SELECT run_id, query_id, hit_id, fit, row_number() OVER (PARTITION BY run_id, query_id ORDER BY fit DESC, rank) AS place FROM z""",
    "r_role_boost": _H + f""", c AS (SELECT canonical_doc_id, min({_ROLE}) AS role, max(n_chars / 10000.0::DOUBLE) AS centrality, bool_or(regexp_matches(coalesce(text, ''), 'risk|riesgo')) AS risk FROM documents WHERE canonical_doc_id IS NOT NULL GROUP BY 1),
i AS (SELECT item_id AS query_id FROM eval_questions WHERE len(answer_keywords) > 0 AND NOT regexp_matches(lower(coalesce(question, '')), 'como|cómo|procedimiento|proceso|pasos para|forma de|manera de|modo de|instrucciones para|protocolo|reset|reiniciar|configurar|instalar|operar'))
SELECT run_id, h.query_id, hit_id, round(fs + CASE WHEN role IN ('manual', 'guide') THEN 0.2::DOUBLE ELSE 0.0::DOUBLE END + 0.1::DOUBLE * coalesce(centrality, 0) + CASE WHEN risk THEN 0.15::DOUBLE ELSE 0.0::DOUBLE END - CASE WHEN role = 'procedure' AND i.query_id IS NOT NULL THEN 0.2::DOUBLE ELSE 0.0::DOUBLE END, 6) AS boosted
FROM h LEFT JOIN c USING (canonical_doc_id) LEFT JOIN i ON h.query_id = i.query_id""",
    "r_mention": _H + f""", {_EN}, m AS (SELECT run_id, h.query_id, hit_id, fs, lower(coalesce(source, '')) AS src, len(list_filter(entities, lambda k: contains(lower(coalesce(text, '')) || ' ' || lower(coalesce(source, '')), lower(k)))) > 0 AS men FROM h JOIN e ON h.query_id = e.query_id WHERE len(entities) > 0)
SELECT run_id, query_id, hit_id, round(fs + (CASE WHEN men THEN 0.2::DOUBLE ELSE -0.35::DOUBLE END - CASE WHEN regexp_matches(src, 'pt_| pt|pt |manual|procedim|instructivo') THEN 0.4::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN NOT contains(src, 'anexo d') THEN 0.0::DOUBLE WHEN men THEN 0.5::DOUBLE ELSE -0.4::DOUBLE END), 6) AS boosted FROM m""",
    "r_exact": _H + f", {_EN} SELECT run_id, h.query_id, hit_id, round(fs + CASE WHEN len(list_filter(entities, lambda k: contains(lower(coalesce(source, '')), lower(k)))) > 0 THEN 0.6::DOUBLE ELSE 0.0::DOUBLE END - CASE WHEN len(list_filter(entities, lambda k: {_ROM('k')} <> '' AND {_ROM('source')} <> '' AND {_ROM('k')} <> {_ROM('source')})) > 0 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END, 6) AS boosted FROM h JOIN e ON h.query_id = e.query_id WHERE len(entities) > 0",
    "r_two_stage": _H + """, x AS (SELECT *, CAST(coalesce(starts_with(canonical_doc_id, 'doc:anexo'), false) AS INT) AS of_entity FROM h), y AS (SELECT *, coalesce(max(CASE WHEN of_entity = 1 THEN hs END) OVER q >= 0.5::DOUBLE * max(hs) OVER q, false) AS gate FROM x WINDOW q AS (PARTITION BY run_id, query_id)) SELECT run_id, query_id, hit_id, of_entity, gate, round(hs * CASE WHEN gate AND of_entity = 1 THEN 1.25::DOUBLE ELSE 1.0::DOUBLE END, 6) AS boosted FROM y""",
    "r_in_doc": _H + """, x AS (SELECT *, abs(page - 20) AS far FROM h WHERE contains(lower(source), 'manual')), y AS (SELECT *, coalesce(max(CAST(far = 0 AS INT)) OVER (PARTITION BY run_id, query_id), 0) AS exact FROM x) SELECT run_id, query_id, hit_id, far, exact, round(fs * CASE WHEN page > 1 THEN 1.3::DOUBLE ELSE 1.0::DOUBLE END, 6) AS boosted FROM y WHERE (exact = 1 AND far = 0) OR (exact = 0 AND far <= 3)""",
    "r_source_score": _H + r""" SELECT run_id, query_id, source, round(sum(CASE WHEN fs >= 0.5::DOUBLE THEN 1 ELSE 0 END) / 10 + max(CASE WHEN regexp_matches(text, '\d+ (?:percent|por ciento|minutes|minutos|days|dias|días|hours|horas)') THEN 2 ELSE 0 END) - max(CASE WHEN regexp_matches(text, '(?m)^- ') THEN 3 ELSE 0 END), 6) AS score FROM h WHERE source IS NOT NULL GROUP BY ALL""",
    "q_count_answer": _H + r""", n AS (SELECT run_id, query_id, hit_id, unnest(list_distinct(regexp_extract_all(coalesce(text, ''), '\d+'))) AS number FROM h WHERE rank <= 5), v AS (SELECT run_id, query_id, number, count(*) AS votes FROM n GROUP BY ALL),
b AS (SELECT run_id, query_id, count(*) AS candidates, max(votes) AS most, arg_min(number, {'v': -votes, 'l': length(number), 'n': number}) AS number FROM v GROUP BY ALL) SELECT run_id, query_id, candidates, CASE WHEN candidates = 1 OR most >= 2 THEN number END AS answer FROM b""",
    "x_categorize": _H + r""", x AS (SELECT *, CASE WHEN regexp_matches(lower(coalesce(text, '')), '\b(?:es el nombre|is the code name|se define|means)\b') THEN 0 WHEN regexp_matches(lower(coalesce(text, '')), '\b(?:paso|step|abre|opens)\b') THEN 1 WHEN regexp_matches(lower(coalesce(text, '')), '\b(?:ejemplo|example|por caso)\b') THEN 2 ELSE 3 END AS o FROM h) SELECT run_id, query_id, hit_id, ['definition', 'procedure', 'example', 'mention'][o + 1] AS kind, row_number() OVER (PARTITION BY run_id, query_id ORDER BY o, rank) AS place FROM x""",
    "x_snippets": "SELECT hit_id, md5(substr(text, 1, 600) || CASE WHEN length(text) > 600 THEN '...' ELSE '' END) AS snippet, concat_ws(' ', '[Doc -', coalesce(source, '?'), 'p.' || page || ']') AS label FROM hits WHERE text IS NOT NULL",
    "x_compare_cover": _H + f", {_EN}, x AS (SELECT h.run_id, h.query_id, h.rank, h.text, unnest(entities) AS entity FROM h JOIN e ON h.query_id = e.query_id) SELECT run_id, query_id, entity, min(rank) AS rank, count(*) AS mentions FROM x WHERE contains(lower(text), lower(entity)) GROUP BY ALL",
}
