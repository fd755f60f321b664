"""Score adjustments on search hits: entities, types, roles, mentions; each a column expression or one join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamizal.session import small

from .ranking import SEARCH, number, ranked, search


def _text() -> Column:
    return F.lower(F.coalesce("text", F.lit("")))


def entity_filter(hits: DataFrame, entities: DataFrame, least: int = 1) -> DataFrame:
    """Hits that name enough of the question's entities in text or source, their hybrid score boosted; where none does, all hits if the question has a compound name, else none.

    entities: query_id, entities. A compound of three words or more counts three and boosts by one, a simple
    name counts one and boosts by 0.3; 'de' and 'del' stand for each other. Names are matched literally.
    """
    m = hits.join(small(entities), "query_id")
    compound = lambda e: F.size(F.split(F.trim(e), r"\s+")) >= 3
    source = F.lower(F.coalesce("source", F.lit("")))

    def named(e):
        forms = [F.lower(e), F.replace(F.lower(e), F.lit(" del "), F.lit(" de ")), F.replace(F.lower(e), F.lit(" de "), F.lit(" del "))]
        test = F.lit(False)
        for f in forms:
            test = test | F.contains(_text(), f) | F.contains(source, f)
        return test

    found = F.filter("entities", named)
    matches = F.aggregate(found, F.lit(0), lambda s, e: s + F.when(compound(e), 3).otherwise(1))
    boost = F.aggregate(found, F.lit(1.0), lambda s, e: s + F.when(compound(e), 1.0).otherwise(0.3))
    m = m.withColumn("matches", matches).withColumn("boosted", F.coalesce(number("hybrid_score"), F.lit(0.0)) * boost)
    best = F.max("matches").over(search())
    return m.withColumn("best", best).where((F.size("entities") == 0) | (F.col("matches") >= least) | ((F.col("best") < least) & F.exists("entities", compound)))


def type_filter(hits: DataFrame, wanted: Column, other: Column, top: int = 10) -> DataFrame:
    """Hits in order of how well they fit a type; misfits go where at least three of the first ``top`` fit."""
    score = wanted.cast("int") - other.cast("int")
    m = ranked(hits).withColumn("fit", F.coalesce(score, F.lit(0)))
    good = F.sum(F.when((F.col("rank") <= top) & (F.col("fit") > 0), 1).otherwise(0)).over(search())
    m = m.withColumn("good", good).where((F.col("good") < 3) | (F.col("fit") >= 0))
    return m.withColumn("place", F.row_number().over(search(F.desc("fit"), F.asc("rank"))))


# Parts of file names of procedures.
PROCEDURAL_SOURCES = ("pt_", " pt", "pt ", "manual", "procedim", "instructivo")


def role_boost(hits: DataFrame, cards: DataFrame, preferred: list[str], attribute: str | None = None, specific: DataFrame | None = None, bonus: float = 0.2, central: float = 0.1, holds: float = 0.15, penalty: float = 0.2) -> DataFrame:
    """Hits with a score for the role, centrality and attributes of their document.

    cards: canonical_doc_id, role, centrality, attributes (read only with ``attribute``). Documents without a card
    keep their score. specific: query_id of the questions that name an entity and ask for no procedure, where
    procedures lose ``penalty``; without it all do.
    """
    m = hits.join(cards, "canonical_doc_id", "left")
    if specific is None:
        m = m.withColumn("specific", F.lit(True))
    else:
        m = m.join(small(specific.select("query_id").distinct().withColumn("specific", F.lit(True))), "query_id", "left")
    score = F.coalesce(number("final_score"), F.lit(0.0)) + F.when(F.col("role").isin(*preferred), bonus).otherwise(0.0) + central * F.greatest(F.coalesce("centrality", F.lit(0.0)), F.lit(0.0))
    if attribute is not None:
        score += F.when(F.array_contains("attributes", attribute), holds).otherwise(0.0)
    return m.withColumn("boosted", score - F.when((F.col("role") == "procedure") & F.col("specific"), penalty).otherwise(0.0)).drop("specific")


def mention_boost(hits: DataFrame, entities: DataFrame, up: float = 0.2, down: float = 0.35, annex: str = "anexo d", annex_up: float = 0.5, procedural: float = 0.4) -> DataFrame:
    """Hits of questions with entities, up if text or source mentions one, down if not.

    Hits of the annex gain ``annex_up`` with a mention and lose ``procedural`` without; hits of procedures lose
    ``procedural`` in any case.
    """
    m = hits.join(small(entities.where("size(entities) > 0")), "query_id")
    source = F.lower(F.coalesce("source", F.lit("")))
    whole = F.concat_ws(" ", _text(), source)
    mentions = F.exists("entities", lambda e: F.contains(whole, F.lower(e)))
    steps = F.lit(False)
    for part in PROCEDURAL_SOURCES:
        steps = steps | F.contains(source, F.lit(part))
    m = m.withColumn("mentions", F.coalesce(mentions, F.lit(False)))
    change = F.when(F.col("mentions"), up).otherwise(-down) - F.when(steps, procedural).otherwise(0.0)
    change += F.when(F.contains(source, F.lit(annex)), F.when(F.col("mentions"), annex_up).otherwise(-procedural)).otherwise(0.0)
    return m.withColumn("boosted", F.coalesce(number("final_score"), F.lit(0.0)) + change).drop("mentions")


def exact_boost(hits: DataFrame, entities: DataFrame, up: float = 0.6, conflict: float = 0.5) -> DataFrame:
    """Hits whose source holds an entity exactly go up; a source with another roman numeral than the entity goes down."""
    m = hits.join(small(entities.where("size(entities) > 0")), "query_id")
    src = F.lower(F.coalesce("source", F.lit("")))
    exact = F.exists("entities", lambda e: F.contains(src, F.lower(e)))
    roman = lambda c: F.regexp_extract(F.upper(c), r"(?:^|[^A-Z])((?:IX|IV|V?I{1,3}|V|X))(?:[^A-Z]|$)", 1)
    other = F.exists("entities", lambda e: (roman(e) != "") & (roman(F.col("source")) != "") & (roman(e) != roman(F.col("source"))))
    return m.withColumn("boosted", F.coalesce(number("final_score"), F.lit(0.0)) + F.when(exact, up).otherwise(0.0) - F.when(F.coalesce(other, F.lit(False)), conflict).otherwise(0.0))


def two_stage(hits: DataFrame, entity_docs: DataFrame, factor: float = 1.25) -> DataFrame:
    """Hits of an entity's documents weigh ``factor`` times, if the best of them reaches half of the search's best.

    entity_docs: query_id, canonical_doc_id.
    """
    m = hits.join(entity_docs.distinct().withColumn("of_entity", F.lit(1)), ["query_id", "canonical_doc_id"], "left").na.fill(0, ["of_entity"])
    s = F.coalesce(number("hybrid_score"), F.lit(0.0))
    mine, best = F.max(F.when(F.col("of_entity") == 1, s)).over(search()), F.max(s).over(search())
    return m.withColumn("gate", F.coalesce(mine >= 0.5 * best, F.lit(False))).withColumn("boosted", s * F.when(F.col("gate") & (F.col("of_entity") == 1), factor).otherwise(1.0))


def in_document(hits: DataFrame, name: str, page: int, near: int = 3) -> DataFrame:
    """Hits of a named document, of the exact page where a search has any, else of pages within ``near``, in page order."""
    mine = hits.where(F.contains(F.lower("source"), F.lit(name.lower()))).withColumn("far", F.abs(F.col("page") - page))
    exact = F.max((F.col("far") == 0).cast("int")).over(search())
    mine = mine.withColumn("exact", F.coalesce(exact, F.lit(0))).where(((F.col("exact") == 1) & (F.col("far") == 0)) | ((F.col("exact") == 0) & (F.col("far") <= near)))
    return mine.withColumn("boosted", F.coalesce(number("final_score"), F.lit(0.0)) * F.when(F.col("page") > 1, 1.3).otherwise(1.0))


def source_score(hits: DataFrame) -> DataFrame:
    """Per source of a search: two for numeric evidence, minus three for lists, a tenth per good hit."""
    numeric, listing = F.rlike("text", F.lit(r"\d+ (?:percent|por ciento|minutes|minutos|days|dias|días|hours|horas)")), F.rlike("text", F.lit(r"(?m)^- "))
    s = F.sum(F.when(F.coalesce(number("final_score"), F.lit(0.0)) >= 0.5, 1).otherwise(0)) / 10 + F.max(F.when(numeric, 2).otherwise(0)) - F.max(F.when(listing, 3).otherwise(0))
    return hits.where("source is not null").groupBy(*SEARCH, "source").agg(F.round(s, 6).alias("score"))


def majority_number(hits: DataFrame, top: int = 5) -> DataFrame:
    """The number that most of a search's first hits hold: the only one, or one of at least two hits; else none."""
    few = ranked(hits).where(F.col("rank") <= top)
    numbers = few.select(*SEARCH, "hit_id", F.explode(F.array_distinct(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"\d+"), F.lit(0)))).alias("number"))
    votes = numbers.groupBy(*SEARCH, "number").agg(F.count("*").alias("votes"))
    best = votes.groupBy(*SEARCH).agg(F.count("*").alias("candidates"), F.max("votes").alias("most"), F.min_by("number", F.struct(-F.col("votes"), F.length("number"), "number")).alias("number"))
    return best.select(*SEARCH, "candidates", F.when((F.col("candidates") == 1) | (F.col("most") >= 2), F.col("number")).alias("answer"))


def content_category(hits: DataFrame) -> DataFrame:
    """Hits with the kind of their text, definitions first."""
    kinds = [("definition", r"\b(?:es el nombre|is the code name|se define|means)\b"), ("procedure", r"\b(?:paso|step|abre|opens)\b"), ("example", r"\b(?:ejemplo|example|por caso)\b")]
    kind, order = F.lit("mention"), F.lit(3)
    for i, (name, pattern) in reversed(list(enumerate(kinds))):
        test = F.coalesce(F.rlike(_text(), F.lit(pattern)), F.lit(False))
        kind, order = F.when(test, name).otherwise(kind), F.when(test, i).otherwise(order)
    m = ranked(hits).withColumn("kind", kind).withColumn("kind_order", order)
    return m.withColumn("place", F.row_number().over(search(F.asc("kind_order"), F.asc("rank"))))
