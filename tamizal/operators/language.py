"""Evidence gates by question type, answer cleaning, glossaries, acronyms, relation predicates, follow-up questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tamizal.functions.text import fold, squeeze, tokens
from tamizal.session import small

from .knowledge import name_of, usable
from .ranking import SEARCH, ranked

# Default parameters: the literal evidence that a type of question needs, technologies, predicates of the catalog.
EVIDENCE = {"count": r"\d+", "time": r"\d+ (?:hours|horas|days|dias|minutes|minutos|weeks|semanas)", "who": r"team|equipo|owner|officer|oficina|jefatura|supervisor|analyst|analista", "where": r"site|sitio|yard|patio|room|sala|station|estacion", "which": r".{20,}"}
QUESTION_TYPES = {"count": "^(?:how many|cuant)", "time": "when|cuando|pressure|presion", "who": "who|quien", "where": "where|donde", "which": "which|what|que|cual"}
TECHNOLOGIES = ("scada", "phishing", "backup", "respaldo", "motor", "network", "cloud")
PREDICATES = {"footnote": "references", "chunk": "part_of", "title": "defines", "table": "contains", "supports": "supports"}
CATALOG = ("references", "part_of", "defines", "contains", "depends_on", "related_to", "implements", "applies_to", "uses")
META = r"(?i)\b(?:as an ai|segun el contexto|based on the (?:context|documents)|de acuerdo con los documentos)[^.]*\.\s*"


def question_type(question: Column) -> Column:
    f, kind = fold(F.regexp_replace(question, "[¿?]", "")), F.lit("other")
    for name, pattern in reversed(list(QUESTION_TYPES.items())):
        kind = F.when(F.rlike(f, F.lit(pattern)), name).otherwise(kind)
    return kind


def factual_gate(hits: DataFrame, questions: DataFrame, top: int = 5) -> DataFrame:
    """Per search: the question's type, how many of the first hits hold its literal evidence, and whether any does."""
    few = ranked(hits).where(F.col("rank") <= top).join(small(questions.select("query_id", question_type(F.col("question")).alias("type"))), "query_id")
    text, has = fold(F.coalesce("text", F.lit(""))), F.lit(True)
    for name, pattern in EVIDENCE.items():
        has = F.when(F.col("type") == name, F.rlike(text, F.lit(pattern))).otherwise(has)
    return few.groupBy(*SEARCH, "type").agg(F.count_if(has).alias("evidence")).withColumn("passes", F.col("evidence") > 0)


def pool_size(question: Column) -> Column:
    """How many hits a reranker gets: 20 for lists, 15 for comparisons, 10 for short questions, else 15."""
    f = fold(question)
    return F.when(F.rlike(f, F.lit("list|cuales|which")), 20).when(F.rlike(f, F.lit("compar|versus|diferencia")), 15).when(F.size(F.split(f, " ")) <= 8, 10).otherwise(15)


def technology(text: Column) -> Column:
    """The first technology of the list that a text names."""
    f, found = fold(text), F.lit(None).cast("string")
    for name in reversed(TECHNOLOGIES):
        found = F.when(F.contains(f, F.lit(name)), name).otherwise(found)
    return found


def clean_answer(text: Column) -> Column:
    """Comments on the task dropped, citations and repeated blanks tidied, repeated neighbouring lines once."""
    s = F.regexp_replace(F.regexp_replace(text, META, ""), r"\[Doc [0-9]+[^\]]*\]", "")
    lines = F.transform(F.split(s, "\n"), squeeze)
    kept = F.filter(lines, lambda x, i: (i == 0) | (x != F.get(lines, i - 1)))
    return F.array_join(F.filter(kept, lambda x: x != ""), "\n")


def first_that_fit(parts: Column, limit: int, gap: int) -> Column:
    """How many parts from the first on fit into ``limit`` characters, each with ``gap`` more; none after the first that doesn't."""

    def add(state, part):
        n = state["used"] + F.length(part) + gap
        fits = state["open"] & (n <= limit)
        return F.struct(F.when(fits, n).otherwise(state["used"]).alias("used"), (state["n"] + fits.cast("int")).alias("n"), fits.alias("open"))

    return F.aggregate(parts, F.struct(F.lit(0).alias("used"), F.lit(0).alias("n"), F.lit(True).alias("open")), add, lambda st: st["n"])


def condense(text: Column, limit: int = 600) -> Column:
    """A text of more than ``limit`` characters cut to its first whole paragraphs; to its first characters where none fits."""
    parts = F.filter(F.transform(F.split(text, "\n\n"), lambda p: F.btrim(p, F.lit(" \t\r\n"))), lambda p: p != "")
    n = first_that_fit(parts, limit, 2)
    return F.when(F.length(text) <= limit, text).when(n > 0, F.array_join(F.slice(parts, 1, n), "\n\n")).otherwise(F.substring(text, 1, limit))


def cut_safely(text: Column, limit: int = 1000, least: int = 300) -> Column:
    """A text of more than ``limit`` characters cut after whole lines if it lists steps, else after a sentence in its second half, else with an ellipsis. Null becomes empty."""
    text = F.coalesce(text, F.lit(""))
    lines = F.split(text, "\r\n|\n|\r")
    steps = F.size(F.filter(lines, lambda x: x.rlike(r"^\s*(?:[0-9]+\s*[.)-]|[-*•])\s+\S"))) >= 2
    kept = F.rtrim(F.array_join(F.slice(lines, 1, F.greatest(first_that_fit(lines, limit, 1), F.lit(1))), "\n"))
    whole = F.when(steps & (F.length(lines[0]) < limit) & (kept != ""), kept)
    cut = F.substring(text, 1, limit)
    sentence = F.regexp_extract(cut, r"(?s)^(.*[.!?])", 1)
    tidy = lambda c: F.btrim(c, F.lit(" \t\r\n"))
    short = F.when(F.length(sentence) > max(least, limit // 2), tidy(sentence)).otherwise(F.concat(tidy(cut), F.lit("…")))
    return F.when(F.length(text) <= limit, text).otherwise(F.coalesce(whole, short))


def lists_steps(text: Column) -> Column:
    """Whether two lines at least are numbered or marked steps of five characters or more."""
    return F.coalesce(F.size(F.filter(F.split(text, "\n"), lambda x: F.trim(x).rlike(r"^(?:[0-9]+[.)]|[-*•])\s+.{5,}"))) >= 2, F.lit(False))


# Words of procedures.
STEP_WORDS = ("paso", "step", "procedimiento", "procedure", "instruccion", "instrucción", "protocolo", "configurar", "instalar", "ejecutar")


def procedure_backed(context: Column, least: int = 2) -> Column:
    """Whether a context of cited passages '[Doc 1 - file p.2]' holds a word of procedures and names ``least`` files."""
    files = F.array_distinct(F.regexp_extract_all(context, F.lit(r"\[Doc [0-9]+ - (.+?) p\.[0-9]+\]"), F.lit(1)))
    return F.coalesce((F.size(files) >= least) & F.lower(context).rlike("|".join(STEP_WORDS)), F.lit(False))


def glossary(documents: DataFrame, terms: DataFrame, n: int = 10) -> DataFrame:
    """(doc_id, term, place): the first ``n`` terms (term, lower case words) that a document uses, in order."""
    words = documents.select("doc_id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("term"))
    met = words.join(terms.select("term").distinct(), "term")
    return met.withColumn("place", F.row_number().over(Window.partitionBy("doc_id").orderBy("term"))).where(F.col("place") <= n)


def entity_expansion(names: DataFrame, aliases: DataFrame, n: int = 3) -> DataFrame:
    """(key, alias, place): up to ``n`` aliases of each canonical name, those claimed most first."""
    pairs = aliases.select(name_of(F.col("canonical_name")).alias("key"), name_of(F.col("alias")).alias("alias")).where("key is not null and alias is not null and key <> alias")
    counted = pairs.join(names.select(name_of(F.col("canonical_name")).alias("key")).distinct(), "key", "left_semi").groupBy("key", "alias").agg(F.count("*").alias("claims"))
    return counted.withColumn("place", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("claims"), "alias"))).where(F.col("place") <= n)


def acronym_of(name: Column) -> Column:
    """Initials of the words of a name, without joining words."""
    words = F.filter(F.split(fold(name), "[^a-z0-9]+"), lambda w: (w != "") & ~w.isin("de", "del", "la", "y", "of", "the", "and"))
    return F.upper(F.array_join(F.transform(words, lambda w: F.substring(w, 1, 1)), ""))


def relations(claims: DataFrame) -> DataFrame:
    """Alias claims read as relations: subject, predicate (mapped; outside the catalog it falls back to 'references'), object."""
    raw = F.coalesce(F.try_element_at("raw", F.lit("origin")), F.lit("none"))
    table = F.create_map(*[F.lit(x) for kv in PREDICATES.items() for x in kv])
    mapped = F.coalesce(table[raw], F.lit("supports"))
    return claims.select("claim_id", "ord", name_of(F.col("alias")).alias("subject"), raw.alias("origin"), F.when(mapped.isin(*CATALOG), mapped).otherwise("references").alias("predicate"), name_of(F.col("canonical_name")).alias("object"), "confidence", "extractor_id")


def merge_relations(rows: DataFrame) -> DataFrame:
    """One row per subject, predicate and object; relations of a name to itself are left out."""
    return rows.where("subject is not null and object is not null and subject <> object").groupBy("subject", "predicate", "object").agg(F.min("ord").alias("first_ord"), F.max(usable(F.col("confidence"))).alias("confidence"), F.count("*").alias("claims"))


def follow_up(turns: DataFrame) -> DataFrame:
    """Turns (conv_id, turn, value) with the value of the turn before and the change to it."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    return turns.withColumn("before", F.lag("value").over(w)).withColumn("change", F.round(F.col("value") - F.col("before"), 6))
