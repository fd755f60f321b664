"""What a question asks for and what evidence it needs: flags as column expressions, a gate of literal evidence, the choice of several documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamizal.session import small

from .ranking import SEARCH, number, ranked

# Words that mark each kind of question.
CUES = {
    "detailed": (
        "toda la información", "toda la informacion", "toda la infomacion", "toda informacion", "toda información", "toda info", "toda la info", "todo sobre", "todos los datos", "todos los detalles",
        "completa", "completo", "completas", "completos", "detallada", "detallado", "detalladas", "detallados", "exhaustiva", "exhaustivo", "extensa", "extenso", "amplia", "amplio", "profundidad", "profunda", "profundo",
        "explica", "explicame", "explícame", "describe", "descripción", "descripcion", "dame todo", "dame toda", "informacion disponible", "información disponible", "infomacion disponible",
    ),
    "multi_document": (
        "todos", "todas", "todo", "compara", "comparar", "comparación", "diferencia", "resumen", "lista completa", "listado", "cuáles", "cuales", "qué", "que", "varios", "múltiples", "diferentes",
        "total", "suma", "sumar", "cada", "cada uno", "más de", "menos de", "mayor", "menor", "entre",
    ),
    "comparison": ("compara", "comparar", "comparación", "diferencia", "vs", "versus"),
    "about_one": ("información sobre", "informacion sobre", "datos de", "detalles de", "háblame de", "hablame de", "dame información de", "dame informacion de"),
    "area": ("network", "cloud", "endpoint", "application", "identity", "iam", "firewall", "ids", "ips"),
    "aggregation": (
        "total", "en total", "suma total", "cuántos controles", "cuantos controles", "cuántos requisitos", "cuantos requisitos", "todos los controles", "todas las políticas", "todas juntas", "sumar todas",
        "total de requisitos", "todos los frameworks", "de todos", "de todas", "entre todos", "entre todas", "todos los que", "todas las que",
        "cuál tiene más", "cual tiene más", "cuál tiene menos", "cual tiene menos", "qué tiene más", "que tiene más", "qué tiene menos", "que tiene menos",
        "cuál es el mayor", "cual es el mayor", "cuál es el menor", "cual es el menor",
    ),
    "listing": (
        "listado", "lista", "listar", "listame", "listáme", "listá todas", "listado completo", "enumerar", "enumerá", "enumera", "todos los controles", "todas las políticas", "todos los frameworks",
        "que frameworks", "qué frameworks", "que controles", "qué controles", "que certificaciones", "qué certificaciones", "que politicas", "qué políticas",
    ),
    "listed": ("controles", "control", "frameworks", "framework", "politicas", "políticas", "certificaciones", "requisitos"),
    "numeric": ("cuántos", "cuantos", "cuántas", "cuantas", "cuál es la versión", "cual es la versión", "qué versión", "que versión", "versión de", "version de", "cuántas veces", "cuantas veces"),
    "troubleshooting": (
        "por qué", "por que", "porque", "a qué se debe", "a que se debe", "qué causa", "que causa", "cuál es la causa", "cual es la causa", "cómo solucionar", "como solucionar", "cómo resolver", "como resolver",
        "qué hacer si", "que hacer si", "qué hacer cuando", "que hacer cuando", "problema", "falla", "error", "no funciona", "no arranca",
    ),
    "short_follow_up": (
        "que tipo", "cuantos", "cuantas", "donde", "cuando", "quien", "y su", "y la", "y el", "su potencia", "su ubicacion", "sus", "este parque", "esta central", "estos", "estas", "tiene?", "opera?", "usa?", "cuantos tiene",
    ),
    "conceptual": (
        "como funciona una", "cómo funciona una", "como funciona un", "cómo funciona un", "que es una", "qué es una", "que es un", "qué es un", "tipos de", "clases de", "en general", "en términos generales",
        "principio de funcionamiento", "tecnología de", "tecnologías de",
    ),
    "procedural": (
        "como", "cómo", "como hacer", "cómo hacer", "procedimiento", "proceso", "pasos para", "forma de", "manera de", "modo de", "instrucciones para", "protocolo", "protocolos",
        "resetear", "reset", "reiniciar", "configurar", "instalar", "operar",
    ),
    "count": ("cuantos", "cuántos", "cantidad", "cuenta", "número", "numero", "how many"),
    "counted": ("control", "controles", "requisito", "requisitos", "dominio", "dominios", "categoria", "categorías", "categorias", "modulo", "módulo", "modulos", "módulos"),
    "not_counted": ("versión", "version", "cvss", "severidad", "cada uno", "por control"),
    "explanation": ("explica", "explicame", "explícame", "detalla", "detallame", "profundiza", "profundizá", "a fondo", "en profundidad", "más sobre", "más info", "más información", "amplia", "ampliá"),
    "sum": ("suma", "sumá", "sumar", "sumatoria", "total"),
    "summed": ("control", "requisito", "framework", "politica", "política"),
    "coverage": ("cada control", "cada framework", "todos los controles", "todos los frameworks", "cada documento", "todos los documentos"),
}
ANAPHORA = ("este", "esta", "estos", "estas", "ese", "esa", "esos", "esas", "su", "sus")
GENERIC = ("iso", "nist", "pci", "framework", "control", "politica", "política", "requisito")
ASPECTS = (("maniobra", "procedimiento", "protocolo"), ("proteccion", "relay", "ansi"), ("notifica", "reporta", "comunica"), ("scada", "monitoreo", "alarma"), ("mantenimiento", "intervencion", "reparacion"))

# Types of factual questions in order of test: what asks for them, what counts as literal evidence.
FACTS = {
    "precio": ("precio|costo|cuanto cuesta|price|cost|tarifa|arancel", r"\$\s*\d|\b\d+\s*(?:usd|ars|eur|dolares|dólares|pesos|euros)\b|(?:price|cost|precio|costo)\s*[:\-]\s*\d"),
    "cve": ("cve", r"cve-\d{4}-\d{4,}"),
    "temperatura": ("temperatura|temperature|grados|celsius|fahrenheit", r"\b\d{2,3}\s*[°º]?\s*(?:c|f|celsius|fahrenheit)\b|(?:temperature|temperatura)\s*[:\-]\s*\d|\b\d{2,3}\s*(?:grados|degrees)\b"),
    "empleados": ("cuantos empleados|numero de empleados|how many employees|plantilla", r"\b\d{2,6}\s*(?:employees|empleados|staff|trabajadores)\b|(?:employees|empleados|plantilla)\s*[:\-]\s*\d"),
    "password": ("default password|password", r"(?:password|contrase[ñn]a)\s*[:\-]\s*\S+|default\s+(?:password|contrase[ñn]a)\s*[:\-]?\s*\S+"),
    "api_endpoint": ("endpoint|api de|api endpoint|endpoints de la api", r"https?://\S+|/api/\S+|endpoint\s*[:\-]\s*\S+"),
    "rfc": (r"rfc\s*\d|request for comments", r"rfc\s*\d{3,5}|request for comments\s*\d{3,5}"),
    "cantidad_requisitos": ("cuantos requisitos|numero de requisitos|how many requirements", r"\b\d{2,4}\s*(?:requisitos|requirements)\b|(?:requisitos|requirements)\s*[:\-]\s*\d|\b\d{2,4}\s*(?:controls|controles)\b"),
    "version_especifica": (r"versi[óo]n\s+\d+\.\d+|v\s*\d+\.\d+\.?\d*", r"v?\d+\.\d+\.\d+|versi[óo]n\s+\d+\.\d+"),
    "fecha_especifica": ("en que fecha|cuando se public|release date", r"\b(?:19|20)\d{2}\b|(?:released?|publicado|publicaci[óo]n)\s*(?:en|on|in)?\s*(?:19|20)\d{2}"),
}
# Where a factual question names its subject.
SUBJECTS = (
    r"(?:precio|costo|tarifa)\s+(?:de(?:l| la)?\s+)?(.+?)(?:\s+en\s+\d{4}|\s+en argentina|\?|$)",
    r"(?:cu[áa]ntos|n[úu]mero de)\s+(?:empleados|requisitos)\s+(?:tiene|de)?\s*(.+?)(?:\?|$)",
    r"(?:temperatura)\s+(?:ideal|recomendada)?\s*(?:de(?:l| un)?\s+)?(.+?)(?:\?|$)",
    r"(?:cve)\s+(?:espec[íi]fico|id)?\s+(?:usado|utilizado)?\s+(?:en(?:l| el)?\s+)?(.+?)(?:\?|$)",
    r"(?:qu[ée])\s+(?:dice|habla|trata)\s+(?:el\s+)?(.+?)(?:\s+sobre)?(?:\?|$)",
    r"(?:endpoints?)\s+(?:de(?:l| la)?\s+)?(.+?)(?:\?|$)",
    r"(?:versi[óo]n)\s+(\d+\.\d+\.?\d*)",
    r"(?:contrase[ñn]a)\s+(?:por defecto\s+)?(?:de(?:l| la)?\s+)?(.+?)(?:\?|$)",
)
_IN, _OUT = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"


def any_of(text: Column, parts) -> Column:
    """Whether a text holds any of the parts literally; parts that hold another are spared."""
    shortest = [p for p in parts if not any(o != p and o in p for o in parts)]
    test = F.lit(False)
    for part in shortest:
        test = test | F.contains(text, F.lit(part))
    return test


def question_flags(text: Column, entities: Column) -> dict[str, Column]:
    """The kinds of a question, not exclusive; null texts are of none. entities: those the question names, as an array."""
    text = F.coalesce(text, F.lit(""))
    q = F.lower(text)
    says = lambda name: any_of(q, CUES[name])
    follows = F.startswith(F.trim(q), F.lit("y "))
    words = F.split(F.trim(q), r"[\s\p{Z}]+")
    specific = F.coalesce(F.exists(entities, lambda e: ~F.lower(e).isin(*GENERIC)), F.lit(False))
    all_asked = any_of(q, ("toda", "todo"))
    names = F.filter(F.regexp_extract_all(text, F.lit(rf"{_IN}[A-Z][a-záéíóúñ]+(?:\s+[A-Z][a-záéíóúñ]+)*{_OUT}"), F.lit(0)), lambda x: ~F.lower(x).isin("cómo", "qué", "cuál"))
    listing = says("listing") & says("listed")
    aggregation = ~says("about_one") & ~says("area") & says("aggregation") & ~specific & ~listing
    comparison = says("comparison") & any_of(q, (" con ", " y ", " vs "))
    return {
        "detailed": ~(q.rlike(rf"{_IN}(?:lista|listado|cuáles|cuales|qué|que){_OUT}") & ~all_asked) & (q.rlike(rf"{_IN}\d+\s+(?:palabras?|caracteres){_OUT}") | says("detailed")),
        "multi_document": says("multi_document") | (~follows & any_of(q, (" y ", " o ", ",")) & text.rlike(r"(?:^|[\s\p{Z}])\p{Lu}[^\s\p{Z}]{2,}")),
        "comparison": comparison,
        "aggregation": aggregation,
        "listing": listing,
        "direct_comparison": says("comparison") & any_of(q, (" con ", " y ", " vs ", " versus ")) & ~aggregation,
        "simple_numeric": says("numeric") & ~comparison & ~aggregation & (F.size(entities) >= 1),
        "troubleshooting": says("troubleshooting"),
        "follow_up": follows | ((F.size(words) <= 3) & says("short_follow_up")) | F.arrays_overlap(words, F.array(*[F.lit(w) for w in ANAPHORA])),
        "conceptual": says("conceptual") & (F.size(names) == 0),
        "procedural": says("procedural"),
        "specific_count": says("count") & says("counted") & ~says("not_counted"),
        "doc_explanation": (F.contains(text, F.lit("[Doc")) | F.contains(q, F.lit("documento"))) & says("explanation"),
        "sum": says("sum") & (~F.contains(q, F.lit("total")) | says("summed")),
        "full_coverage": says("coverage"),
    }


def factual_type(question: Column) -> Column:
    """The first factual type that a question asks for, else null."""
    q, kind = F.lower(question), F.lit(None).cast("string")
    for name, (asks, _) in reversed(list(FACTS.items())):
        kind = F.when(q.rlike(asks), name).otherwise(kind)
    return kind


def subject_of(question: Column) -> Column:
    """What a factual question is about: the first pattern that gives more than two characters, else null. Only ``\\n`` ends a line (d)."""
    found = [F.btrim(F.trim(F.regexp_extract(F.trim(question), "(?id)" + p, 1)), F.lit(".,;:?")) for p in SUBJECTS]
    return F.coalesce(*[F.when(F.length(x) > 2, x) for x in found])


def factual_verdict(question: Column, context: Column) -> Column:
    """Why the gate of factual questions stops: 'short', 'evidence', 'rfc', 'subject'; 'pass', or null for other questions.

    A factual question needs 30 characters of context, literal evidence of its type, the number of the RFC it
    names, and half of the longer words of its subject, one at least.
    """
    context = F.coalesce(context, F.lit(""))
    kind, q, c = factual_type(question), F.lower(question), F.lower(context)
    literal = F.lit(False)
    for asks, evidence in reversed(list(FACTS.values())):
        literal = F.when(q.rlike(asks), c.rlike(evidence)).otherwise(literal)
    rfc = F.regexp_extract(q, r"(?:rfc|request for comments)\s*(\d{3,5})", 1)
    parts = F.filter(F.split(F.lower(subject_of(question)), r"\s+"), lambda w: F.length(w) > 2)
    held = F.size(F.filter(parts, lambda w: F.contains(c, w)))
    away = F.coalesce((F.size(parts) > 0) & (held < F.greatest(F.lit(1), F.floor(F.size(parts) / 2))), F.lit(False))
    stop = F.when(F.length(F.trim(context)) < 30, "short").when(~literal, "evidence").when((kind == "rfc") & (rfc != "") & ~F.contains(c, rfc), "rfc").when(away, "subject").otherwise("pass")
    return F.when(kind.isNotNull(), stop)


def several_documents(hits: DataFrame, questions: DataFrame, top: int = 5, near: float = 0.3) -> DataFrame:
    """Per search: the last reason found to answer from several documents: procedure, roles, spread, aspects; else null.

    questions: query_id, question, roles (preferred roles, may be null), one_annex (the first stage settled on one
    annex, so that one document does). Spread: three sources among the first ``top`` hits whose reranker scores,
    zero where missing, lie within ``near``.
    """
    flags = question_flags(F.col("question"), F.array().cast("array<string>"))
    q = F.lower(F.coalesce("question", F.lit("")))
    aspects = sum((any_of(q, group).cast("int") for group in ASPECTS), F.lit(0))
    asked = questions.select(
        "query_id", (flags["procedural"] | flags["troubleshooting"]).alias("steps"), (F.coalesce(F.size("roles"), F.lit(0)) >= 2).alias("roles"), (aspects >= 2).alias("aspects"), F.coalesce("one_annex", F.lit(False)).alias("one_annex")
    )
    score = F.coalesce(number("rerank_score"), F.lit(0.0))
    per = ranked(hits).where(F.col("rank") <= top).groupBy(*SEARCH).agg(F.countDistinct("source").alias("sources"), F.count("*").alias("n"), (F.max(score) - F.min(score)).alias("range"))
    m = per.join(small(asked), "query_id")
    reason = F.when(F.col("aspects"), "aspects").when((F.col("sources") >= 3) & (F.col("range") < near), "spread").when(F.col("roles"), "roles").when(F.col("steps"), "procedure")
    return m.select(*SEARCH, "sources", F.round("range", 6).alias("range"), F.when(~F.col("one_annex"), reason).alias("reason"))
