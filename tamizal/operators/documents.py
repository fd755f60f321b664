"""Chunking, document cards, query normalization and classification: column functions over texts.

Word lists are parameters; the defaults suit the project's own domain.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tamizal.functions.text import BLANKS, doc_slug, fold, squeeze

# Default parameters: words that mark intents, domains, attributes; and words of one language for the other's.
INTENTS = {
    "definition": "que es|what is|define|significa|means", "procedure": "como|how to|paso|step|procedimiento|procedure", "listing": "lista|list|enumera|cuales|which",
    "count": "cuantos|cuantas|how many|numero de", "comparison": "diferencia|difference|compar|versus", "page": "pagina|page", "who": "quien|who", "location": "donde|where",
}
DOMAIN = ("control", "relay", "rele", "scada", "alarm", "alarma", "network", "red", "audit", "auditoria", "backup", "respaldo")
FOREIGN = ("receta", "recipe", "futbol", "football", "horoscopo", "weather", "clima")
ATTRIBUTES = {"schedule": r"\d+ (?:days|dias|horas|hours|minutos|minutes)", "numbers": r"\d", "steps": "paso|step", "roles": "owner|responsable", "quotes": "«|\"|“", "lists": r"(?m)^- ", "risk": "risk|riesgo", "access": "access|acceso"}
LEXICON = {"alarma": "alarm", "respaldo": "backup", "acceso": "access", "registro": "record", "sitio": "site", "puerta": "gate", "llave": "key", "permiso": "permit", "horas": "hours", "anexo": "annex", "armario": "locker", "presion": "pressure"}
TRIGGERS = {"how many|cuantos": "total count numero", "version|release": "release version", "incident|incidente": "response respuesta", "control|controles": "measure medida", "fail|falla": "fault diagnosis"}


def token_chunks(documents: DataFrame, size: int = 350, overlap: int = 50) -> DataFrame:
    """(doc_id, chunk_index, tokens, text): windows of ``size`` blank-separated tokens that overlap; the last ends with the text."""
    words = F.filter(F.split(F.coalesce("text", F.lit("")), r"\s+"), lambda w: w != "")
    step = size - overlap
    split = documents.select("doc_id", words.alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.ceil((F.size("w") - size) / step), F.lit(0)).cast("int"))
    cut = split.select("doc_id", "w", F.explode(starts).alias("chunk_index"))
    piece = F.slice("w", F.col("chunk_index") * step + 1, size)
    return cut.select("doc_id", "chunk_index", F.size(piece).alias("tokens"), F.array_join(piece, " ").alias("text"))


def semantic_chunks(documents: DataFrame, budget: int = 1000) -> DataFrame:
    """(doc_id, chunk_index, text): paragraphs filled into chunks of at most ``budget`` characters; longer paragraphs go sentence by sentence, longer sentences stay whole.

    Null and blank texts have no chunks.
    """
    outer = rf"^{BLANKS}|{BLANKS}$"
    paragraphs = F.transform(F.split(F.coalesce("text", F.lit("")), "\n+"), lambda p: F.regexp_replace(p, outer, ""))
    parts = F.flatten(F.transform(paragraphs, lambda p: F.when(F.length(p) <= budget, F.array(p)).otherwise(F.split(p, f"(?<=[.!?]){BLANKS}"))))
    split = documents.select("doc_id", F.filter(parts, lambda p: p != "").alias("parts")).where("size(parts) > 0")

    def fill(state, part):
        full = F.length(state["held"]) + 1 + F.length(part) > budget
        done = F.when(full, F.concat(state["done"], F.array(state["held"]))).otherwise(state["done"])
        return F.struct(done.alias("done"), F.when(full, part).otherwise(F.concat_ws(" ", state["held"], part)).alias("held"))

    start = F.struct(F.array().cast("array<string>").alias("done"), F.col("parts")[0].alias("held"))
    chunks = F.aggregate(F.slice("parts", 2, F.size("parts")), start, fill, lambda st: F.concat(st["done"], F.array(st["held"])))
    return split.select("doc_id", F.posexplode(chunks).alias("chunk_index", "text"))


def chunk_ids(chunks: DataFrame, name: Column) -> DataFrame:
    """Chunk ids of name, eight digits of the text's hash and the index."""
    return chunks.withColumn("chunk_id", F.concat_ws("_", name, F.substring(F.sha2("text", 256), 1, 8), F.col("chunk_index").cast("string")))


def equivalences(line: Column) -> Column:
    """Names of a line 'A = B (note) = C': notes dropped, trimmed, without repeats; null under two names."""
    names = F.filter(F.transform(F.split(F.regexp_replace(line, r"\([^)]*\)|\{[^}]*\}", ""), "="), squeeze), lambda x: x != "")
    distinct = F.array_distinct(names)
    return F.when(F.size(distinct) >= 2, distinct)


def longest_names(claims: DataFrame) -> DataFrame:
    """Per canonical name: the longest alias and, where there is one, an acronym."""
    pairs = claims.select(fold(F.col("canonical_name")).alias("key"), squeeze(F.col("alias")).alias("alias")).where("key <> '' and alias <> ''")
    short = F.when(F.rlike("alias", F.lit("^[A-Z]{2,8}$")), F.col("alias"))
    return pairs.groupBy("key").agg(F.max_by("alias", F.struct(F.length("alias"), "alias")).alias("longest"), F.min(short).alias("acronym"))


def expand_terms(text: Column, table: dict[str, str]) -> Column:
    """The text with the counterparts of its words added at the end, each once."""
    pairs = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    words = F.array_distinct(F.filter(F.split(fold(text), "[^a-z0-9]+"), lambda w: w != ""))
    extra = F.filter(F.transform(words, lambda w: pairs[w]), lambda x: x.isNotNull())
    return F.concat_ws(" ", text, F.array_join(F.array_sort(F.array_distinct(extra)), " "))


def trigger_terms(text: Column) -> Column:
    """Terms that certain words of a question bring along, sorted."""
    f = fold(text)
    terms = F.flatten(F.array(*[F.when(F.rlike(f, F.lit(p)), F.array(*[F.lit(t) for t in ts.split()])).otherwise(F.array().cast("array<string>")) for p, ts in TRIGGERS.items()]))
    return F.array_join(F.array_sort(F.array_distinct(terms)), " ")


def normalize_query(text: Column) -> Column:
    """Folded, codes like A12 also as a_12, roman numerals up to ten as digits."""
    f = F.regexp_replace(fold(text), r"\b([a-z])([0-9]{1,3})\b", "$1_$2")
    for roman, digit in (("viii", "8"), ("vii", "7"), ("iii", "3"), ("ii", "2"), ("iv", "4"), ("vi", "6"), ("ix", "9")):
        f = F.regexp_replace(f, rf"\b{roman}\b", digit)
    return f


def intent_flags(text: Column) -> list[Column]:
    f = fold(text)
    return [F.coalesce(F.rlike(f, F.lit(p)), F.lit(False)).alias(name) for name, p in INTENTS.items()]


def out_of_domain(text: Column) -> Column:
    """A foreign word and none of the domain."""
    words = F.array_distinct(F.split(fold(text), "[^a-z0-9]+"))
    return F.arrays_overlap(words, F.array(*[F.lit(w) for w in FOREIGN])) & ~F.arrays_overlap(words, F.array(*[F.lit(w) for w in DOMAIN]))


def semantic_weight(text: Column) -> Column:
    """How much the vector search weighs for a question."""
    f = fold(text)
    return F.when(F.rlike(f, F.lit(INTENTS["count"])), 0.4).when(F.rlike(f, F.lit(INTENTS["procedure"])), 0.5).when(F.rlike(f, F.lit(INTENTS["definition"])), 0.7).otherwise(0.6)


def attributes(text: Column) -> Column:
    """Names of the attributes a text shows, in order of the list."""
    return F.filter(F.array(*[F.when(F.rlike(text, F.lit(p)), F.lit(n)) for n, p in ATTRIBUTES.items()]), lambda x: x.isNotNull())


def centrality(title: Column, text: Column) -> Column:
    """0.1, 0.6 for a title of the domain, up to 0.3 for domain words in the text; one at most."""
    hits = lambda c: F.size(F.filter(F.array(*[F.lit(w) for w in DOMAIN]), lambda w: F.contains(c, w)))
    return F.least(F.lit(1.0), 0.1 + F.when(hits(fold(title)) > 0, 0.6).otherwise(0.0) + F.least(F.lit(0.3), 0.05 * hits(F.lower(text))))


def cards(documents: DataFrame, role) -> DataFrame:
    """Document cards: id, role, centrality, attributes, first paragraph and summary."""
    first = F.substring(F.split(F.coalesce("text", F.lit("")), r"\n\n+")[0], 1, 800)
    return documents.select(
        "doc_id", doc_slug(F.coalesce("title", F.lit(""))).alias("card_id"), role(F.coalesce("title", F.lit(""))).alias("role"), F.round(centrality(F.coalesce("title", F.lit("")), F.coalesce("text", F.lit(""))), 6).alias("centrality"),
        F.array_join(attributes(F.coalesce("text", F.lit(""))), "|").alias("attributes"), F.length(first).alias("first_chars"), F.substring(first, 1, 400).alias("summary"),
    )


ENTITY = "[A-Z][a-z]+(?: [A-Z][a-z]+){0,2}|[A-Z]{2,6}[0-9]*"


def entities(text: Column) -> Column:
    """Runs of up to three capitalized words and acronyms, each once."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(ENTITY), F.lit(0)))


def clean_entities(found: Column, n: int = 3) -> Column:
    """Entities without those inside another, longest first, the first ``n``."""
    outer = F.filter(found, lambda x: ~F.exists(found, lambda y: (x != y) & F.contains(y, x)))
    ordered = F.array_sort(F.transform(outer, lambda x: F.struct((-F.length(x)).alias("l"), x.alias("x"))))
    return F.slice(F.transform(ordered, lambda s: s["x"]), 1, n)


def doc_reference(text: Column) -> list[Column]:
    """The page and the annex that a question names."""
    f = fold(text)
    return [F.regexp_extract(f, r"(?:pagina|page|pag|p)\.? ([0-9]{1,4})", 1).alias("page"), F.regexp_extract(f, r"(?:anexo|annex) ([a-z])(?:[^a-z]|$)", 1).alias("annex")]


def repair_json(raw: Column) -> Column:
    """The object inside a fenced or chatty answer, trailing commas dropped."""
    body = F.regexp_extract(raw, r"(?s)(\{.*\})", 1)
    return F.regexp_replace(F.when(body == "", F.concat(F.regexp_extract(raw, r"(?s)(\{.*)", 1), F.lit("}"))).otherwise(body), r",\s*([}\]])", "$1")


def sticky(turns: DataFrame, value: str, ttl: int = 3) -> DataFrame:
    """Turns (conv_id, turn) with the last known value of the ``ttl`` turns before where they have none."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(-ttl, -1)
    return turns.withColumn("carried", F.coalesce(value, F.last(value, ignorenulls=True).over(w)))


def recent(turns: DataFrame, n: int = 4) -> DataFrame:
    """The last ``n`` turns of each conversation."""
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return turns.withColumn("age", F.row_number().over(w)).where(F.col("age") <= n)
