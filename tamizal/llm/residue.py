"""Problem 9: template residue and error-page text.

Message templates are mined with a fixed-depth prefix tree: every segment of text, masked, runs down a path of
its length, its first six words and its last one; at the leaf, places where segments differ become variable.
Each template is classified once and its verdict goes to all segments. Apart from that, unresolved slots inside
ordinary records are told from mentions by their place: a slot left open is one of many fillings of the same
sentence, a mentioned variable is always the same one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamizal.functions.text import strip_accents

from .common import Scratch, let, maybe_broadcast, spread

# HTML elements, words of the usual filler text, words that name parts of an outline.
HTML = "html|head|body|title|meta|link|div|span|p|br|hr|h[1-6]|ul|ol|li|a|b|i|em|strong|table|tr|td|th|img|script|style|center|pre|code|font|form|input|button|nav|footer|header|section|main"
LOREM = (
    "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam "
    "quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum "
    "eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum"
).split()
OUTLINE = (
    "item|point|bullet|heading|subheading|column|columna|punto|vineta|titulo|subtitulo|encabezado|seccion|section|paragraph|parrafo|row|fila|cell|celda|label|etiqueta"
    "|title|subtitle|slide|diapositiva|option|opcion|step|paso|level|nivel|tema|topic|entry|entrada|elemento|element|texto|text"
)
ORDINALS = "first|second|third|fourth|fifth|primer|segundo|tercer|cuarto|quinto"
# Words typed where a field is still open.
OPEN_WORDS = r"x{3,}|_{3,}|\.{5,}|tbd|tbc|to be (?:completed|defined|determined|confirmed|filled(?: in)?)|por (?:completar|definir|confirmar|rellenar)|a (?:completar|definir)|pendiente de (?:completar|definir)|fill in here|completar aqui"

_BRACKETED = (
    r"\$\{[^{}\n]{1,60}\}|\{\{[^{}\n]{1,60}\}\}|\{%[^{}\n]{1,60}%\}|<<[^<>\n]{1,60}>>|\[\[[^\[\]\n]{1,60}\]\]|@@[^@\n]{1,60}@@|«[A-Z0-9_]{2,60}»"
    r"|#[A-Z][A-Z0-9_]{1,60}#|\$[A-Z][A-Z0-9_]{1,60}\$|%[A-Z][A-Z0-9_]{1,60}%|\{[A-Za-z_][A-Za-z0-9_ ]{1,60}\}|<[A-Za-z_][^<>/=\n]{0,60}>"
    r"|\[(?:[A-ZÁÉÍÓÚÑ0-9_ ]{3,60}|(?i:insert|insertar|enter|ingrese|escriba|complete|completar|indicar|indique|specify|state|your|su|name|nombre|date|fecha|company|empresa|address|direccion|number|numero)\b[^\[\]\n]{0,60})\]|\((?i:insert|insertar|enter|ingrese|escriba|complete|completar|indicar|indique|specify|state)\b[^()\n]{1,60}\)"
)
# a look ahead at the first character spares the alternatives at most places
SLOT = rf"(?=[${{<\[@«#%(])(?:{_BRACKETED})|(?i:(?<![\p{{L}}\p{{N}}_])(?=[x_.tpafc])(?:{OPEN_WORDS})(?![\p{{L}}\p{{N}}_]))"

_START = r"^(?:oops|lo sentimos|sorry|perdon|ups|error|aviso|notice|warning|atencion)?[ !,.:-]*"
_NAV = r"(?:javascript|js|scripts?|cookies)"

# Classes of templates; each is matched against a whole masked template, lower case and without accents.
NOTICES = "|".join(
    [
        rf"(?:please |por favor |veuillez |bitte |per favore |por gentileza )?(?:enable|activate|turn on|allow|habilite|active|ative|active[zr]|activer|attiva|attivare|ativar|aktivieren|bitte)\b[^.]{{0,40}}{_NAV}",
        rf"(?:you|debe|necesita|es necesario|is necessary|vous devez|voce precisa|para ver|to view|to continue|to use)\b[^.]{{0,50}}{_NAV}",
        rf"(?:this|este|esta|our|the|el|la) (?:page|site|app|application|portal|sitio|pagina|website|aplicacion)\b[^.]{{0,40}}(?:requires?|needs?|requiere|necesita|no funciona sin|does(?: not|n.t) work without)[^.]{{0,30}}{_NAV}",
        rf"(?:su navegador|your browser|votre navigateur|seu navegador|ihr browser|il tuo browser)\b.{{0,60}}(?:{_NAV}|not supported|no es compatible|desactualizad|out of date|deshabilitad)",
        rf"{_NAV} (?:is|are|esta|estan|est|ist) (?:disabled|turned off|required|deshabilitad|desactivad|necesari|requerid|desactive|deaktiviert)",
        r"(?:turn|switch) (?:them|it) on and reload|habilitel[oa]s? y recargue|activel[oa]s? y recargue|update it and allow active content",
        r"checking (?:your|if the) (?:browser|connection|site)|estamos comprobando su navegador|verify(?:ing)? (?:that )?you are (?:a )?human|verifique que (?:es|usted es) humano|comprobando (?:su|que)|just a moment|un momento por favor|this process is automatic|este proceso es automatico",
        r"(?:we use|usamos|utilizamos|this site uses|este sitio usa|este sitio utiliza) cookies|(?:accept|aceptar|acepte) (?:all |todas las )?cookies",
    ]
)
ERRORS = "|".join(
    [
        r"(?:http )?(?:error )?(?:<num>|[45]\d\d)[ :|,-]*(?:not found|forbidden|bad gateway|bad request|unauthorized|internal (?:server )?error|service unavailable|gateway time ?-?out|too many requests|error interno|no encontrad|prohibido|acceso denegado|no autorizado|servicio no disponible|no disponible|page|pagina)[^.]{0,30}$",
        r"(?:http )?error (?:<num>|[45]\d\d)[ :|.,-]*$",
        r"(?:page|pagina|site|sitio|document|documento|file|archivo|recurso|resource) (?:not found|no encontrad[oa]|introuvable|nao encontrad[oa]|non trovata|no existe|no disponible|unavailable)[^.]{0,20}$",
        r"seite nicht gefunden|page introuvable|pagina nao encontrada|pagina non trovata|le document a ete deplace|verifique o endereco|die seite wurde",
        r"(?:not found|forbidden|bad gateway|internal server error|service unavailable|gateway time ?-?out|too many requests|access denied|acceso denegado|permission denied|backend fetch failed|acces refuse|zugriff verweigert|acesso negado)[ .!]*$",
        r"(?:the )?(?:requested |la pagina solicitada|el recurso solicitado)(?:url|page|resource|document)?.{0,80}(?:not found|no existe|no se encontro|could not be found|does not exist)",
        r"you (?:don.?t|do not) have (?:permission|access)|no tiene permisos? (?:para|de)|usted no tiene|you are not authorized|no esta autorizado",
        r"(?:we|sorry,? we) (?:can.?t|cannot|could ?n.t|could not) find|no (?:encontramos|pudimos encontrar) (?:lo que|la pagina)|es posible que el enlace haya cambiado|it may have been moved|the (?:page|link) (?:you|may)",
        r"(?:your|su|tu) (?:session|sesion) (?:has )?(?:expired|timed out|ha caducado|ha expirado|caduco|expiro)",
        r"(?:your|su) (?:request|solicitud|ip|connection) (?:was|has been|fue|ha sido) (?:blocked|denied|bloquead|rechazad)",
        r"(?:an|se produjo un) (?:unexpected |internal )?error (?:occurred|has occurred|inesperado|interno)|something went wrong|algo salio mal|ocurrio un error",
        r"(?:the )?(?:service|server|site|servicio|servidor|sitio)(?: is| esta)? ?(?:temporarily |temporalmente )?(?:unavailable|down|no disponible|fuera de servicio)[^.]{0,50}$",
        r"error (?:establishing a|de conexion con la|al conectar con la) (?:database connection|base de datos)|error de conexion|database error",
        r"upstream did not answer|gateway time-?out after|traceback \(most recent call last\)|fatal error|please slow down|try again later|intente (?:de nuevo )?mas tarde|we.ll be back soon|volveremos pronto",
        r"(?:this|the|este|el) (?:document|file|preview|documento|archivo|vista previa) (?:could not|cannot|can.t|is|no se pud[oe]|no puede|esta) ?(?:be )?(?:displayed|shown|opened|damaged|corrupt|protected|protegido|danado|mostrar|abrir)",
        r"no se (?:pudo|puede) (?:abrir|mostrar|visualizar) (?:el|este|la)|(?:unable|failed) to (?:open|display|load|render)",
    ]
)
FILLER = "|".join(
    [
        r"(?:sample|example|dummy|placeholder|filler) (?:text|copy|content)|this is (?:placeholder|dummy|sample|filler)|your (?:text|content|title|name) (?:here|goes here)|(?:body )?text goes (?:here|in this)|(?:sub)?title goes here|replace this (?:text|paragraph)|insert (?:your )?text here|add your text",
        r"texto de (?:ejemplo|relleno|prueba)[ .!]*$|escriba aqui|su texto aqui|(?:sub)?titulo aqui|contenido (?:provisorio|provisional|de ejemplo|de relleno)|este (?:parrafo|texto) es de (?:relleno|ejemplo|prueba)|reemplace este",
        r"click (?:icon )?to (?:add|edit)|haga clic (?:en el icono )?para (?:agregar|anadir|modificar|editar)|clique para adicionar|cliquez pour",
        r"(?:asdf|qwer|blah|bla)+\b",
    ]
)
REPEATED = r"(?:^|.*\s)(\p{L}\S*)(?: \1){4,}(?:\s.*|$)"
TITLE_LIKE = rf"^(?:(?:{OUTLINE})(?: (?:<num>|[a-z]))?|(?:{ORDINALS}) (?:{OUTLINE})|(?:add|agregar) (?:{OUTLINE}))[ .:]*$"


KEYBOARD = ("qwertyuiop", "asdfghjkl", "zxcvbnm")

# Concepts of messages in any order: what fails or is asked for, and how; read only where they make up the document.
_SUBJECT = r"page|pagina|site|sitio|website|content|contenido|contenu|document|documento|file|archivo|fichier|url|link|enlace|lien|server|servidor|serveur|service|servicio|session|sesion|request|solicitud|connection|conexion|upstream|gateway|resource|recurso|message|mensaje|viewer|visor|browser|navegador|navigateur|preview|seite|inhalt"
_FAILS = r"not found|not available|isn.t available|unavailable|no disponible|no esta disponible|indisponible|is gone|no longer|ya no|no existe|doesn.t exist|does not exist|expired|expirad|caducad|denied|denegad|refuse|blocked|bloquead|forbidden|prohibid|could not|couldn.t|cannot|can.t|may not be able|unable|no se pud|no se puede|no pudo|failed|fallo|error|reset|timed? ?-?out|went wrong|salio mal|moved|removed|eliminad|verfugbar|gefunden"
_ASKED = r"enable|allow|activ|habilit|turn on|reload|refresh|recarg|try again|intente|intentelo|please wait|espere|patient|veuillez|bitte|verif|checking|comproband|log ?in|sign in|inicie sesion|upgrade|update|actualice|accept|acept"
_READER = r"you|your|usted|su|sus|sorry|sentimos|please|por favor|we|we.re|desole|veuillez|bitte|disculpe|oops|ups|http|loading|cargando|if"


def prepared(text: Column) -> Column:
    """A text with one segment a line: sentences and lines, without HTML elements; escaped brackets are brackets again."""
    s = let(text, lambda t: F.when(t.contains("<"), F.regexp_replace(t, rf"(?i)</?(?:{HTML})(?:\s[^<>]*)?/?>", "\n")).otherwise(t))
    s = let(s, lambda t: F.when(t.contains("&"), F.regexp_replace(F.replace(F.replace(t, F.lit("&lt;"), F.lit("<")), F.lit("&gt;"), F.lit(">")), "&(?:amp|nbsp|quot);", " ")).otherwise(t))
    s = F.regexp_replace(s, r"[\p{Zs}\t\r\f\x0b\x{1c}-\x{1f}\x{85}\x{2028}\x{2029}]+", " ")
    return F.regexp_replace(s, r" ?\n[\n ]*|(?<=[.!?]) |(?<=[}>%$@#\]]) (?=\p{Lu})", "\n")


def may_have_slot(text: Column) -> Column:
    """A cheap test that every text with a slot passes."""
    return text.rlike(r"(?i)[$<\[@«#%({]|xxx|___|\.{5}|tb[dc]|to be |complet|defini|confirm|rellen|fill in")


def masked(lines: Column) -> Column:
    """Prepared lines with slots and numbers masked, lower case, without accents and outer marks; as many lines as before."""
    s = let(lines, lambda t: F.when(may_have_slot(t), F.regexp_replace(F.regexp_replace(t, SLOT, " <slot> "), " {2,}", " ")).otherwise(t))
    s = let(F.lower(s), strip_accents)
    return F.regexp_replace(F.regexp_replace(s, r"(?<!\S)[^\s\d]*+\d\S*+", "<num>"), r"(?m)^[-•*·> ]+| +$", "")


def mine_templates(scratch: Scratch, parts: DataFrame, depth: int = 6) -> DataFrame:
    """(masked, template, longest) of distinct masked segments of parts (masked, size): leaves of a prefix tree of fixed depth.

    The path is the number of words, the first ``depth`` words and the last one. In a leaf, a place whose words
    differ turns into <*>; only places off the path can. ``longest``: the most segments of a document the
    template stands in.
    """
    shapes = parts.groupBy("masked").agg(F.max("size").alias("size")).withColumn("w", F.split("masked", " "))
    shapes = shapes.withColumn("leaf", F.xxhash64(F.size("w"), F.slice("w", 1, depth), F.element_at("w", -1)))
    shapes = scratch.keep(shapes, "shapes")
    off = F.slice("w", depth + 1, F.greatest(F.size("w") - depth - 1, F.lit(0)))
    places = shapes.select("leaf", F.posexplode(off).alias("at", "word")).groupBy("leaf", "at").agg(F.min("word").alias("a"), F.max("word").alias("b"))
    varied = places.where("a <> b").groupBy("leaf").agg(F.collect_set((F.col("at") + depth).cast("int")).alias("open"))
    sizes = shapes.groupBy("leaf").agg(F.max("size").alias("longest"))
    known = shapes.join(varied, "leaf", "left").join(sizes, "leaf")
    template = F.when(F.col("open").isNull(), F.col("masked")).otherwise(F.array_join(F.transform("w", lambda x, i: F.when(F.array_contains("open", i), "<*>").otherwise(x)), " "))
    return scratch.keep(known.select("masked", template.alias("template"), "longest"), "templates")


def keyboard_run(word: Column) -> Column:
    """Whether a word is a run of neighbouring keys in either direction, or one letter typed again and again."""
    rows = [F.contains(F.lit(r), word) | F.contains(F.lit(r[::-1]), word) for r in KEYBOARD]
    return (F.length(word) >= 3) & (rows[0] | rows[1] | rows[2] | (F.regexp_replace(word, F.substring(word, 1, 1), F.lit("")) == ""))


def classify(template: Column) -> Column:
    """What a template is: notice, error, filler, outline, or null for ordinary text."""
    n = F.size(F.split(template, " "))
    plain = F.regexp_replace(template, r"[^\p{L}\p{N}<>* ]", "")
    words = F.filter(F.split(plain, " +"), lambda w: w != "")
    lorem = F.size(F.filter(words, lambda w: w.isin(*LOREM)))
    opens = lambda cues: template.rlike(_START + f"(?:{cues})")
    monotone = (F.size(F.array_distinct(words)) * 2 <= F.size(words)) & (F.size(words) >= 5)
    blank = (F.size(words) >= 5) & (F.array_max(words) == "<slot>") & (F.array_min(words) == "<slot>")
    mashed = F.size(F.filter(words, keyboard_run)) * 5 >= F.size(words) * 4
    return (
        F.when(((lorem >= 3) & (lorem * 2 >= n)) | (monotone & plain.rlike(REPEATED)) | ((F.size(words) >= 3) & mashed) | blank, "filler")
        .when(opens(FILLER), "filler")
        .when(opens(NOTICES), "notice")
        .when(opens(ERRORS), "error")
        .when(template.rlike(TITLE_LIKE), "outline")
    )


def message_like(template: Column) -> Column:
    """Whether a template speaks to a reader about a page that fails or about what must be done first."""
    has = lambda cues: template.rlike(rf"(?<!\p{{L}})(?:{cues})")
    reader = template.rlike(rf"(?<!\p{{L}})(?:{_READER})(?!\p{{L}})")
    return (has(_SUBJECT) & has(_FAILS) & reader) | (has(_ASKED) & (has(_SUBJECT) | template.rlike(rf"(?<!\p{{L}})(?:{_NAV}|human|robot|verificacion|verification)(?!\p{{L}})")) & reader)


def open_slots(slotted: DataFrame, fillings: int = 2) -> DataFrame:
    """(doc_id): documents of ``slotted`` (doc_id, segment) with a slot that stands open.

    A slot's place is the three words before it, or after it where none is before. A place with at least
    ``fillings`` different fillings in the corpus is a field; one that always has the same is a mention. By
    itself a slot is open after a salutation, as all that follows a label, and beside another slot of its sentence.
    """
    around = rf"((?:\S+\s+){{0,3}})({SLOT})(?=((?:\s*\S+){{0,3}}))"
    take = lambda g: F.regexp_extract_all("segment", F.lit(around), F.lit(g))
    alone = F.rlike("segment", F.lit(rf"(?i)^(?:dear|hi|hello|hola|estimad[oa](?:/[oa])?|estimad[oa]s)\s+(?-i:{SLOT})")) | F.rlike("segment", F.lit(rf"^[-•*\s]*\p{{L}}[\p{{L}} ]{{1,40}}:\s*(?:{SLOT})\s*\.?$")) | (F.size(F.array_distinct(take(2))) >= 2)
    found = slotted.select("doc_id", alone.alias("alone"), F.inline(F.arrays_zip(take(1).alias("before"), take(2).alias("filling"), take(3).alias("after"))))
    place = masked(F.when(F.trim("before") != "", F.concat(F.lit("< "), "before")).otherwise(F.concat(F.lit("> "), "after")))
    found = found.select("doc_id", "alone", "filling", place.alias("place"))
    fields = found.groupBy("place").agg(F.min("filling").alias("a"), F.max("filling").alias("b")).where("a <> b") if fillings == 2 else found.groupBy("place").agg(F.countDistinct("filling").alias("n")).where(F.col("n") >= fillings)
    return found.where("alone").select("doc_id").unionByName(found.join(fields, "place", "left_semi").select("doc_id")).distinct()


def residue(documents: DataFrame, outline_least: int = 3, short: int = 4) -> DataFrame:
    """(doc_id, kind): documents that are residue, with the first kind found: slot, filler, notice, error or outline.

    A document goes if a segment of it is a notice, an error or filler text, if at least ``outline_least``
    segments are names of empty outline parts and these are most of it, if a slot stands open, or if at least
    half of its segments or of its characters are sentences that speak to a reader about a page that fails, in templates
    that stand in no document of more than ``short`` segments. Segments of any length are judged. Null and empty texts have no
    rows; copies count each; other columns are ignored.
    """
    scratch = Scratch(documents.sparkSession, "residue")
    both = let(prepared(F.col("text")), lambda t: F.struct(F.split(t, "\n").alias("segment"), F.split(masked(t), "\n").alias("masked")))
    lines = spread(documents.where("text is not null").select("doc_id", "text")).select("doc_id", both.alias("b"))
    size = F.size(F.filter("b.masked", lambda x: x != ""))
    length = F.aggregate("b.masked", F.lit(0), lambda n, x: n + F.length(x))
    parts = lines.select("doc_id", size.alias("size"), length.alias("length"), F.inline(F.arrays_zip("b.segment", "b.masked"))).where("masked <> ''")
    parts = scratch.keep(parts.select("doc_id", "size", "length", "masked", F.when(F.col("masked").contains("<slot>"), F.col("segment")).alias("segment")), "parts")
    opened = open_slots(parts.where("segment is not null").select("doc_id", "segment"))
    templates = mine_templates(scratch, parts)
    kind = F.coalesce(classify(F.col("template")), F.when((F.col("longest") <= short) & message_like(F.col("template")), "message"))
    kinds = templates.groupBy("template").agg(F.max("longest").alias("longest")).select("template", kind.alias("kind")).where("kind is not null")
    verdicts = scratch.keep(templates.join(maybe_broadcast(scratch.keep(kinds, "kinds")), "template").select("masked", "kind"), "verdicts")
    judged = parts.join(maybe_broadcast(verdicts), "masked")
    by_doc = judged.groupBy("doc_id").agg(
        F.max("size").alias("all"), F.max("length").alias("length"), F.count_if(F.col("kind") == "outline").alias("outline"), F.count_if(F.col("kind") == "message").alias("message"),
        F.sum(F.when(F.col("kind") == "message", F.length("masked"))).alias("told"),
        F.max(F.when(~F.col("kind").isin("outline", "message"), F.col("kind"))).alias("kind"),
    )
    empty = (F.col("outline") >= outline_least) & (F.col("outline") * 2 > F.col("all"))
    kind = F.coalesce("kind", F.when(empty, "outline"), F.when((F.col("message") * 2 >= F.col("all")) | (F.col("told") * 2 >= F.col("length")), "error"))
    found = by_doc.select("doc_id", kind.alias("kind")).where("kind is not null")
    return found.unionByName(opened.withColumn("kind", F.lit("slot"))).groupBy("doc_id").agg(F.max("kind").alias("kind"))
