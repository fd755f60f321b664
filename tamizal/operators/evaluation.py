"""Evaluation of answers and retrieval: relevance marks, rates, ranks, percentiles, evidence and claim checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamizal.functions.text import fold
from tamizal.session import small

from .metrics import order_statistics
from .ranking import SEARCH, number, ranked

# Phrases that hedge, in order; phrases that decline; words that carry no meaning.
HEDGES = (
    "no se menciona", "no se encuentra", "no hay informacion", "no hay evidencia", "no se proporciona", "no se contiene", "no existe", "no se documenta", "no esta disponible", "no tengo informacion",
    "no encontre", "no hay datos", "no hay documentos", "no hay suficiente", "insuficiente", "fuera de mi alcance", "fuera del alcance", "no puedo responder", "no dispongo",
)
STOPWORDS = (
    "de la el en y a que es se del las los un una con por para su al lo como mas pero sus le ya o este si porque esta entre cuando "
    "the an of in on for to and is are was were be been with by at from it this that"
).split()
DECLINES = ("no encontre", "no hay informacion", "not found", "no information", "cannot answer", "no puedo responder")


WORD = r"[\p{L}\p{N}_]{3,}"
CITATION = r"(?i)\[(?:Doc\s+)?(\d+)[^\]]*\]"


def stem(source: Column) -> Column:
    """A file name folded, without extension."""
    return F.regexp_replace(fold(source), r"\.[a-z][a-z0-9]{0,4}$", "")


def relevance(hits: DataFrame, questions: DataFrame, tolerance: int = 2, score: str = "final_score") -> DataFrame:
    """One row per hit and matching expected source: rank, page_hit.

    questions: query_id, expected_sources, expected_pages (aligned; null: page not checked, empty: any page). A
    source matches when either name, in lower case, contains the other; blank names match nothing. A page hits
    within ``tolerance``; a missing page counts as 0. Hits meet the few expected names of their question only.
    """
    wanted = questions.select("query_id", F.posexplode("expected_sources").alias("nth", "name"), "expected_pages").select(
        "query_id", "nth", F.lower("name").alias("name"), F.try_element_at("expected_pages", F.col("nth") + 1).alias("pages")
    )
    placed = ranked(hits, score).select(*SEARCH, "hit_id", "rank", F.coalesce("page", F.lit(0)).alias("page"), F.lower("source").alias("source"))
    met = placed.where("trim(source) <> ''").join(small(wanted.where("trim(name) <> ''"), growth=8), "query_id").where(F.contains("source", F.col("name")) | F.contains("name", F.col("source")))
    close = F.exists("pages", lambda p: F.abs(p - F.col("page")) <= tolerance)
    return met.withColumn("page_hit", F.when(F.col("pages").isNull(), None).when(F.size("pages") == 0, True).otherwise(F.coalesce(close, F.lit(False))))


def retrieval_metrics(hits: DataFrame, questions: DataFrame, k: int = 10, score: str = "final_score") -> DataFrame:
    """Per search of an answerable question, over its first ``k`` hits: document and page hit, first relevant rank, reciprocal rank, recall, precision.

    ``precision`` counts a place once for each expected source it matches, ``precision_distinct`` once; both are
    shares of the hits there are. ``recall_1``, ``recall_3``, ``recall_5`` say whether the first relevant rank is that good.
    """
    found = relevance(hits, questions, score=score).where(F.col("rank") <= k)
    per = found.groupBy(*SEARCH).agg(
        F.min("rank").alias("first_rank"), F.countDistinct("nth").alias("found"), F.count("*").alias("relevant"), F.countDistinct("rank").alias("places"), F.max(F.coalesce(F.col("page_hit"), F.lit(False)).cast("int")).alias("page_hit")
    )
    searches = hits.groupBy(*SEARCH).agg(F.least(F.count("*"), F.lit(k)).alias("k"))
    searches = searches.join(small(questions.where("is_answerable and size(expected_sources) > 0").select("query_id", F.size("expected_sources").alias("expected"))), "query_id")
    out = searches.join(per, list(SEARCH), "left").na.fill(0, ["found", "relevant", "places", "page_hit"])
    by = lambda c: F.coalesce((F.col("first_rank") <= c).cast("int"), F.lit(0)).alias(f"recall_{c}")
    return out.select(
        *SEARCH, F.col("first_rank").isNotNull().cast("int").alias("doc_hit"), "page_hit", "first_rank", F.round(F.coalesce(1 / F.col("first_rank"), F.lit(0.0)), 3).alias("mrr"), F.round(F.col("found") / F.col("expected"), 3).alias("recall"),
        F.round(F.col("relevant") / F.col("k"), 3).alias("precision"), F.round(F.col("places") / F.col("k"), 3).alias("precision_distinct"), by(1), by(3), by(5),
    )


def answer_layers(answers: DataFrame, questions: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Per answer: keyword score and the verdicts of its layers, and whether it passes.

    answers: id, query_id, answer, verified (whether the context supports it). questions: query_id, is_answerable,
    answer_keywords, must_not_contain. Keywords and answer are compared folded. Groundedness fails on a forbidden
    word or an unsupported answer, generation under ``threshold`` of the keywords, the check of unanswerable
    questions without a declining phrase or with a forbidden word.
    """
    m = answers.join(small(questions.select("query_id", "category", "is_answerable", "answer_keywords", "must_not_contain")), "query_id")
    text = fold(F.coalesce("answer", F.lit("")))
    held = lambda c: F.size(F.filter(F.coalesce(c, F.array().cast("array<string>")), lambda k: F.contains(text, fold(k))))
    n = F.size(F.coalesce("answer_keywords", F.array().cast("array<string>")))
    declined = F.exists(F.array(*[F.lit(x) for x in DECLINES]), lambda x: F.contains(text, x))
    m = m.withColumn("keyword_score", F.when(n > 0, F.round(held("answer_keywords") / n, 3)).otherwise(1.0)).withColumn("forbidden", held("must_not_contain"))
    m = m.withColumn("pass_groundedness", (F.col("forbidden") == 0) & F.col("verified")).withColumn("pass_generation", ~F.col("is_answerable") | (F.col("keyword_score") >= threshold))
    m = m.withColumn("pass_hallucination", F.col("is_answerable") | (declined & (F.col("forbidden") == 0)))
    return m.withColumn("passed", F.col("pass_groundedness") & F.col("pass_generation") & F.col("pass_hallucination"))


def before_and_after(hits: DataFrame, questions: DataFrame) -> DataFrame:
    """First relevant ranks before and after reranking, per search."""
    before = relevance(hits, questions, score="hybrid_score").groupBy(*SEARCH).agg(F.min("rank").alias("before"))
    after = relevance(hits, questions, score="rerank_score").groupBy(*SEARCH).agg(F.min("rank").alias("after"))
    both = before.join(after, list(SEARCH), "full_outer")
    return both.withColumn("change", F.when(F.col("after") < F.col("before"), "better").when(F.col("after") > F.col("before"), "worse").otherwise("same"))


def pool_class(rank: Column) -> Column:
    return F.when(rank <= 10, "top10").when(rank <= 35, "pool35").when(rank <= 75, "pool75").otherwise("out")


def nearest_percentile(rows: DataFrame, keys: list[str], value: str, p: float, name: str) -> DataFrame:
    """The element at position int(n * p) of each group in order, the last at most; found on counted values."""
    at = lambda n: F.least(F.floor(n * p), n - 1) + 1
    return order_statistics(rows, keys, value, {name: at})


def evidence_signals(hits: DataFrame) -> DataFrame:
    """Per search: hits, distinct sources, characters, quality hits, share of distinct words, best scores.

    The quality of a hit is its final score, else the reranker's, else half of the hybrid one; above .15 counts.
    """
    words = F.filter(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(WORD), F.lit(0)), lambda x: ~x.isin(*STOPWORDS))
    quality = F.coalesce(number("final_score"), number("rerank_score"), 0.5 * number("hybrid_score"), F.lit(0.0))
    per = hits.groupBy(*SEARCH).agg(
        F.count("*").alias("n"), F.countDistinct(F.when(F.col("source") != "", F.lower("source"))).alias("sources"), F.sum(F.length(F.trim(F.coalesce("text", F.lit(""))))).alias("chars"), F.max(number("rerank_score")).alias("best_rerank"),
        F.coalesce(F.max(number("hybrid_score")), F.lit(0.0)).alias("best_hybrid"), F.coalesce(F.max(number("final_score")), F.lit(0.0)).alias("best_final"), F.count_if(quality > 0.15).alias("good"),
    )
    tokens = hits.select(*SEARCH, F.explode(words).alias("word")).groupBy(*SEARCH, "word").agg(F.count("*").alias("c"))
    density = tokens.groupBy(*SEARCH).agg((F.count("*") / F.sum("c")).alias("density"))
    return per.join(density, list(SEARCH), "left").na.fill(0.0, ["density"])


def entity_coverage(hits: DataFrame, entities: DataFrame) -> DataFrame:
    """(run_id, query_id, covered, total): entities of the question of which half of the longer words, one at least, stand in the search's texts.

    entities: query_id, entities. Words of two letters or fewer don't count, nor entities without others.
    """
    asked = entities.select("query_id", F.posexplode(F.transform("entities", lambda e: F.filter(F.split(F.lower(F.trim(e)), r"\s+"), lambda w: F.length(w) > 2))).alias("nth", "words")).where(F.size("words") > 0)
    m = hits.select(*SEARCH, F.lower(F.coalesce("text", F.lit(""))).alias("t")).join(small(asked, growth=8), "query_id").select(*SEARCH, "nth", F.size("words").alias("n"), "t", F.posexplode("words").alias("at", "word"))
    seen = m.groupBy(*SEARCH, "nth", "n", "at").agg(F.max(F.contains("t", F.col("word")).cast("int")).alias("seen"))
    per = seen.groupBy(*SEARCH, "nth", "n").agg(F.sum("seen").alias("seen"))
    return per.groupBy(*SEARCH).agg(F.count_if(F.col("seen") >= F.greatest(F.lit(1), F.floor(F.col("n") / 2))).alias("covered"), F.count("*").alias("total"))


def assess(signals: DataFrame, least_chars: int = 30, floor: float = 0.1, rescue: float = 0.5, need_entities: bool = True) -> DataFrame:
    """Gates and score (0..1) of the evidence of each search.

    signals: those of ``evidence_signals``, with ``factual`` (whether the factual gate lets it pass) and the
    ``covered`` and ``total`` entities; the three may be null. Gates in order: no hits, too little text, a weak
    best reranker score that neither hybrid nor final score rescues (then it is the score), the factual gate, no
    entity found.
    """
    weak = (F.col("best_rerank") < floor) & (F.col("best_hybrid") <= rescue) & (F.col("best_final") <= rescue)
    total, covered = F.coalesce("total", F.lit(0)), F.coalesce("covered", F.lit(0))
    lost = F.lit(need_entities) & (total > 0) & (covered == 0)
    gate = F.when(F.col("n") == 0, "no hits").when(F.col("chars") < least_chars, "too short").when(F.coalesce(weak, F.lit(False)), "weak").when(~F.coalesce("factual", F.lit(True)), "factual").when(lost, "no entity").otherwise("pass")
    share = F.when(total > 0, covered / total * 0.15).otherwise(0.0)
    score = 0.2 + 0.1 * F.col("good") + F.least(F.lit(0.4), F.col("chars") / 8000) + F.least(F.lit(0.15), share) + F.least(F.lit(0.1), F.col("sources") * 0.03) + F.least(F.lit(0.05), F.col("density") * 0.05)
    return signals.withColumn("gate", gate).withColumn("score", F.round(F.when(gate == "pass", F.least(F.lit(1.0), score)).when(gate == "weak", F.col("best_rerank")).otherwise(0.0), 6))


def evidence_gate(signals: DataFrame) -> DataFrame:
    """Whether to answer: signals with ``reasoning`` (kind of question) and the ``covered`` entities.

    Searches that found an entity, or whose question has none, pass; else five or three quality hits, or much
    text, or one quality hit for a reasoning question.
    """
    found = (F.coalesce("total", F.lit(0)) == 0) | (F.coalesce("covered", F.lit(0)) > 0)
    ok = F.when(found, "entity").when(F.col("good") >= 5, "enough").when(F.col("good") >= 3, "borderline").when(F.col("chars") > 2000, "context").when(F.col("reasoning") & (F.col("good") >= 1), "reasoning")
    return signals.withColumn("reason", F.coalesce(ok, F.lit("none"))).withColumn("decision", F.when(ok.isNotNull(), "pass").otherwise("decline"))


def claims_of(text: Column) -> Column:
    """Sentences and lines of a text as single claims; the text itself if it has none."""
    parts = F.filter(F.transform(F.split(text, r"(?<=[.!?])\s+|\n+"), lambda x: F.btrim(x, F.lit(" \t\r\n"))), lambda x: x != "")
    return F.when(F.size(parts) > 0, parts).otherwise(F.array(F.trim(text)))


def content_tokens(text: Column) -> Column:
    """Words of three characters or more without those that carry no meaning; repeats stay."""
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0)), lambda x: ~x.isin(*STOPWORDS))


def content_words(text: Column) -> Column:
    return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9áéíóúüñ]{3,}"), F.lit(0)), lambda x: x != ""))


def hedge_of(text: Column) -> Column:
    """The first phrase of the list that a text holds, else null."""
    return F.get(F.filter(F.array(*[F.lit(h) for h in HEDGES]), lambda h: F.contains(F.lower(text), h)), F.lit(0))


def citations(text: Column) -> Column:
    """Numbers that a text cites as [Doc 3 ...] or [3]."""
    return F.transform(F.regexp_extract_all(text, F.lit(CITATION), F.lit(1)), lambda x: x.try_cast("int"))


def risk_tokens(claim: Column) -> Column:
    """Versions and whole numbers of a claim, citations set aside."""
    bare = F.regexp_replace(claim, CITATION, " ")
    return F.array_distinct(F.concat(F.regexp_extract_all(bare, F.lit(r"v?\d+\.\d+(?:\.\d+)*"), F.lit(0)), F.regexp_extract_all(bare, F.lit(r"(?<![\p{L}\p{N}_])\d+(?![\p{L}\p{N}_])"), F.lit(0))))


def share_known(tokens: Column, known: Column) -> Column:
    """Share of the tokens, repeats counted, that are known; 0 without tokens."""
    return F.when(F.size(tokens) > 0, F.size(F.filter(tokens, lambda t: F.array_contains(known, t))) / F.size(tokens)).otherwise(0.0)


def claim_support(answers: DataFrame) -> DataFrame:
    """(id, claim_no, share, status): each claim of an answer against its context.

    answers: id, answer, context, n_results (citations are valid from 1 to that) and assess_passed. A hedge after a
    passed assessment and citations that are all invalid contradict; versions and numbers that the context lacks
    are unsupported; with known ones half of the words must be known, without any 15 %, else support is weak.
    """
    rows = answers.select("id", "n_results", "assess_passed", F.posexplode(claims_of(F.col("answer"))).alias("claim_no", "claim"), F.lower(F.coalesce("context", F.lit(""))).alias("context"))
    rows = rows.withColumns({"cited": citations(F.col("claim")), "risk": risk_tokens(F.col("claim")), "share": share_known(content_tokens(F.col("claim")), F.array_distinct(content_tokens(F.col("context"))))})
    invalid = (F.size("cited") > 0) & (F.size(F.filter("cited", lambda x: (x >= 1) & (x <= F.col("n_results")))) == 0)
    missing = F.exists("risk", lambda t: ~F.contains("context", F.lower(t)))
    status = F.when(hedge_of(F.col("claim")).isNotNull() & F.col("assess_passed"), "contradicted").when(invalid, "contradicted").when(missing, "unsupported").when(F.col("share") >= F.when(F.size("risk") > 0, 0.5).otherwise(0.15), "supported").otherwise("weakly_supported")
    return rows.select("id", "claim_no", "share", status.alias("status"))


def groundedness(claims: DataFrame) -> DataFrame:
    """Per answer: claims and verdict: contradicted before unsupported before weakly before supported."""
    worst = F.max(F.when(F.col("status") == "contradicted", 3).when(F.col("status") == "unsupported", 2).when(F.col("status") == "weakly_supported", 1).otherwise(0))
    out = claims.groupBy("id").agg(F.count("*").alias("claims"), worst.alias("worst"))
    return out.withColumn("verdict", F.element_at(F.array(*[F.lit(x) for x in ("supported", "weakly_supported", "unsupported", "contradicted")]), F.col("worst") + 1)).drop("worst")


def verify(answers: DataFrame, least: int = 10) -> DataFrame:
    """(id, claims, verdict, ratio, signal, passed, reason): the signal of each answer.

    answers as for ``claim_support``. Empty and short answers fail; a hedge is worth a half if the assessment did
    not pass, else nothing; contradicted and unsupported answers fail with their share of known words; with
    citations that are all invalid half of it; a tenth is added where all citations are valid.
    """
    grounded = groundedness(claim_support(answers))
    tokens = content_tokens(F.coalesce("answer", F.lit("")))
    m = answers.select(
        "id", F.trim(F.coalesce("answer", F.lit(""))).alias("a"), "n_results", "assess_passed", share_known(tokens, F.array_distinct(content_tokens(F.coalesce("context", F.lit(""))))).alias("ratio"), citations(F.coalesce("answer", F.lit(""))).alias("cited")
    ).join(grounded, "id", "left")
    valid = F.size(F.filter("cited", lambda x: (x >= 1) & (x <= F.col("n_results"))))
    hedged = hedge_of(F.col("a")).isNotNull()
    reason = F.when(F.length("a") == 0, "empty").when(F.length("a") < least, "short").when(hedged & F.col("assess_passed"), "unjustified hedge").when(hedged, "hedge")
    reason = reason.when(F.col("verdict").isin("contradicted", "unsupported"), F.col("verdict")).when((F.size("cited") > 0) & (valid == 0), "no valid citation").otherwise("supported")
    bonus = F.when((F.size("cited") > 0) & (valid == F.size("cited")), 0.1).otherwise(0.0)
    m = m.withColumn("reason", reason).withColumn("bonus", bonus)
    score = F.when(F.col("reason").isin("empty", "short", "unjustified hedge"), 0.0).when(F.col("reason") == "hedge", 0.5).when(F.col("reason").isin("contradicted", "unsupported"), F.col("ratio")).when(F.col("reason") == "no valid citation", F.col("ratio") * 0.5).otherwise(F.least(F.lit(1.0), F.col("ratio") + F.col("bonus")))
    return m.select("id", "claims", "verdict", F.round("ratio", 6).alias("ratio"), F.round(score, 6).alias("signal"), F.col("reason").isin("hedge", "supported").alias("passed"), "reason")


def decisions(signals: DataFrame, max_llm_calls: int = 3) -> DataFrame:
    """The first policy that decides: evidence gate, retry, repair, answer.

    signals: gate, score and counters llm_calls, retry_count, repair_count.
    """
    spent = F.col("llm_calls") >= max_llm_calls
    chain = F.coalesce(
        F.when(F.col("gate").isin("no hits", "factual", "no entity"), "decline"),
        F.when((F.col("gate") == "weak") & (F.col("retry_count") < 1) & ~spent, "retry"),
        F.when(F.col("gate") != "pass", "decline"),
        F.when((F.col("score") < 0.5) & (F.col("repair_count") < 1) & ~spent, "repair"),
        F.lit("answer"),
    )
    return signals.withColumn("decision", chain)


def coverage(answers: DataFrame, wanted: str, supported: str) -> Column:
    return F.when(F.size(wanted) > 0, F.size(F.array_intersect(wanted, supported)) / F.size(F.array_distinct(wanted))).otherwise(1.0)
