"""Problem 5: variant spellings of names typed by people.

Tokens of names meet in a prefix-filtered set-similarity join on positional q-grams (the rarest grams of each
token first), which finds misspelled tokens and the usual spelling they stand for. Names that share a rare
token, so corrected, and another one or its first letter, are verified by a soft weighted token similarity: tokens match whole, as initials, as
abbreviations or as nicknames, and count by their rarity.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tamizal.functions.text import fold

from .common import Scratch, maybe_broadcast, names_something
from .components import link
from .incremental import one_slip

# Titles, legal forms, joining words and common nicknames of public knowledge.
TITLES = "dr|dra|lic|ing|arq|abg|mr|mrs|ms|miss|sr|sra|srta|don|dona|prof|profa|c"
LEGAL = (
    r"s\.? ?a\.? ?s|s\.? ?r\.? ?l|s\.? ?a|g\.? ?m\.? ?b\.? ?h|l\.? ?t\.? ?d\.?a?|limited|limitada|i\.?n\.?c|incorporated|l\.? ?l\.? ?c|corp|corporation"
    r"|sociedad anonima|sociedad de responsabilidad limitada|sociedad por acciones simplificada|gesellschaft mit beschrankter haftung|s\.? ?l|a\.? ?g|p\.? ?l\.? ?c"
)
JOINING = ("y", "e", "and", "de", "del", "la", "of", "und", "et")
NICKNAMES = {
    "alejandra": "ale alex sandra", "beatriz": "bea", "concepcion": "concha conchita", "dolores": "lola loli", "eduardo": "lalo edu",
    "elizabeth": "liz betty beth lizzie eliza", "enrique": "quique kike", "francisco": "paco pancho curro", "gabriela": "gaby gabi",
    "gregory": "greg", "guadalupe": "lupe lupita", "helena": "lena nena", "henry": "hank harry", "ignacio": "nacho", "isabel": "chabela isa",
    "jesus": "chuy chucho", "jose": "pepe chepe", "katherine": "kate kathy katie kat", "manuel": "manolo manu", "margaret": "maggie meg peggy",
    "monica": "moni", "richard": "dick rick rich", "robert": "bob rob bobby", "rosario": "charo chayo", "theodore": "ted teddy theo",
    "tobias": "toby", "vicente": "chente", "victor": "vic", "walter": "wally walt", "william": "bill will billy", "yolanda": "yoli",
    "zulema": "zule", "oscar": "oski", "nadia": "nadi", "ursula": "ursi", "fabian": "fabi", "juan": "juancho", "antonio": "tono", "luis": "lucho",
    "rafael": "rafa", "roberto": "beto", "james": "jim jimmy", "john": "jack johnny", "michael": "mike", "thomas": "tom tommy", "edward": "ed eddie ned",
    "charles": "charlie chuck", "patricia": "pat patty", "susan": "sue", "rebecca": "becky", "mercedes": "meche", "teresa": "tere", "rosa": "rosita",
}


def name_tokens(folded: Column) -> Column:
    """Letter runs of a folded name without titles and legal forms; a '.' stays on abbreviations, '&' counts as a joining word."""
    s = F.regexp_replace(folded, rf"^(?:(?:{TITLES})\b\.? +)+", "")
    s = F.regexp_replace(s, rf"[ ,]+(?:{LEGAL})\.?$", "")
    found = F.regexp_extract_all(s, F.lit(r"\p{L}+\.?"), F.lit(0))
    return F.filter(found, lambda t: ~t.isin(*JOINING))


def grams(token: Column) -> Column:
    """(gram, place) of a token: trigrams over the padded token."""
    padded = F.concat(F.lit("^"), token, F.lit("$"))
    return F.transform(F.sequence(F.lit(1), F.length(padded) - 2), lambda i: F.struct(F.substring(padded, i, F.lit(3)).alias("gram"), i.alias("place")))


def usual_spellings(scratch: Scratch, tokens: DataFrame, broken: int = 4) -> DataFrame:
    """(token, head): for each token (token, n) the usual spelling it is one slip away from, or itself.

    One slip breaks at most ``broken`` trigrams, so two such tokens share one of the ``broken`` + 1 rarest
    trigrams of each, at a place that differs by one at most; only those meet. A token counts as a slip of
    another only if it is much rarer, or rare itself.
    """
    long = tokens.where(F.length("token") >= 4)
    all_grams = long.select("token", "n", F.inline(grams(F.col("token"))))
    spread = all_grams.groupBy("gram").agg(F.count("*").alias("df"))
    rarest = Window.partitionBy("token").orderBy("df", "gram", "place")
    prefix = scratch.keep(
        all_grams.join(maybe_broadcast(scratch.keep(spread, "grams")), "gram").withColumn("r", F.row_number().over(rarest)).where(F.col("r") <= broken + 1).select("token", "n", "gram", "place"),
        "prefix",
    )
    a = prefix.withColumn("place", F.explode(F.array(F.col("place") - 1, F.col("place"), F.col("place") + 1))).alias("a")
    b = prefix.alias("b")
    much_rarer = (F.col("a.n") <= 2) | (F.col("a.n") * 5 <= F.col("b.n"))
    pairs = a.join(b, (F.col("a.gram") == F.col("b.gram")) & (F.col("a.place") == F.col("b.place"))).where(
        (F.col("a.token") != F.col("b.token")) & (F.col("a.n") <= F.col("b.n")) & much_rarer & (F.abs(F.length("a.token") - F.length("b.token")) <= 1)
    )
    near = pairs.select(F.col("a.token").alias("token"), F.col("a.n").alias("own"), F.col("b.token").alias("head"), F.col("b.n").alias("n")).distinct()
    near = scratch.keep(near.where(one_slip(F.col("token"), F.col("head"))), "near")
    # among equally rare spellings the one with the most slips around it stands for the others
    around = scratch.keep(near.groupBy("head").agg(F.count("*").alias("slips")), "around")
    ranked = near.join(maybe_broadcast(around), "head").join(maybe_broadcast(around.select(F.col("head").alias("token"), F.col("slips").alias("mine"))), "token", "left")
    ranked = ranked.where(F.struct("n", "slips", "head") > F.struct(F.col("own"), F.coalesce("mine", F.lit(0).cast("long")), F.col("token")))
    heads = scratch.keep(ranked.groupBy("token").agg(F.max_by("head", F.struct("n", "slips", "head")).alias("head")), "heads")
    while True:  # a head may stand for another itself; each round doubles the steps followed, heads rise so there are no rings
        further = heads.select(F.col("token").alias("head"), F.col("head").alias("next"))
        step = scratch.keep(heads.join(maybe_broadcast(further), "head", "left").select("token", F.coalesce("next", "head").alias("head"), F.col("next").isNotNull().alias("moved")), "heads")
        heads = step.select("token", "head")
        if step.where("moved").isEmpty():
            return heads


def _short_for(a: Column, b: Column) -> Column:
    """Whether token ``a`` can be short for ``b``: an initial, a beginning, or letters of it in order (abbreviations)."""
    loose = F.regexp_replace(a, "(.)", "$1.*")
    return (F.length(a) < F.length(b)) & (F.substring(a, 1, 1) == F.substring(b, 1, 1)) & (b.startswith(a) | ((F.length(a) >= 3) & F.rlike(b, F.concat(F.lit("^"), loose))))


def soft_cover(a: Column, b: Column, short_a: Column, short_b: Column) -> Column:
    """Share of the weight of tokens ``a`` (struct t, w) that ``b`` matches; whole 1, short form .9.

    ``short_a``/``short_b``: tokens that were typed as initials or abbreviations.
    """
    def best(x):
        like = F.transform(b, lambda y: F.when(y["t"] == x["t"], 1.0).when((F.array_contains(short_a, x["t"]) & _short_for(x["t"], y["t"])) | (F.array_contains(short_b, y["t"]) & _short_for(y["t"], x["t"])), 0.9).otherwise(0.0))
        return F.array_max(like) * x["w"]

    total = F.aggregate(a, F.lit(0.0), lambda s, x: s + x["w"])
    return F.aggregate(F.transform(a, best), F.lit(0.0), lambda s, x: s + x) / total


def name_variants(names: DataFrame, threshold: float = 0.85, nicknames: dict[str, str] = NICKNAMES) -> DataFrame:
    """(name, entity): folded distinct names (column ``name``) that have variants, with a label per entity.

    ``nicknames``: names with their short and pet forms, separated by blanks; forms that two names share stay as they are.
    Null, blank and placeholder names are left out, repeated ones count once. Initials that fit two different
    names of one surname are not linked to either. An empty table gives an empty result.
    """
    scratch = Scratch(names.sparkSession, "names")
    distinct = names.where(names_something(F.col("name"))).select("name").distinct()
    parsed = distinct.select("name", name_tokens(F.col("name")).alias("raw"))
    # a lone run of letters may be a login: initial and surname
    login = (F.size("raw") == 1) & ~F.col("raw")[0].endswith(".") & (F.length(F.col("raw")[0]) >= 5)
    parsed = parsed.withColumn("login", login).withColumn("raw", F.when(login, F.array(F.substring(F.col("raw")[0], 2, 1000))).otherwise(F.col("raw")))
    parsed = parsed.withColumn("initial", F.when(login, F.substring("name", 1, 1)))
    parsed = scratch.keep(parsed, "parsed")
    forms = [(nick, name) for name, nicks in nicknames.items() for nick in nicks.split()]
    single = {nick: name for nick, name in forms if sum(n == nick for n, _ in forms) == 1}
    nick = F.create_map(*[F.lit(x) for kv in (single or {"": ""}).items() for x in kv])
    bare = lambda t: F.rtrim(t, F.lit("."))
    spread = parsed.select("name", "login", F.posexplode("raw").alias("at", "typed")).withColumn("token", bare(F.col("typed")))
    spread = spread.withColumn("token", F.coalesce(nick[F.col("token")], "token")).withColumn("dotted", F.col("typed").endswith("."))
    spread = scratch.keep(spread, "spread")
    # a login's surname counts for nothing by itself, so that it leans on names typed in full
    tokens = scratch.keep(spread.groupBy("token").agg(F.sum(F.when(F.col("login"), 0).otherwise(1)).alias("n"), F.min("dotted").alias("dotted")), "tokens")
    heads = usual_spellings(scratch, tokens.where("not dotted"))
    # abbreviated rare tokens: the one spelling that begins like them
    roots = tokens.join(heads.select("token"), "token", "left_anti").where("not dotted and length(token) > 4")
    starts = roots.select(F.col("token").alias("full"), F.explode(F.transform(F.sequence(F.lit(4), F.length("token") - 1), lambda k: F.substring("token", F.lit(1), k))).alias("token"))
    cut = tokens.where("dotted and length(token) >= 4").join(starts, "token").groupBy("token").agg(F.min("full").alias("head"), F.max("full").alias("other")).where("head = other")
    heads = scratch.keep(heads.unionByName(cut.select("token", "head")), "heads")
    fixed = spread.join(maybe_broadcast(heads), "token", "left").withColumn("t", F.coalesce("head", "token")).withColumn("short", (F.length("t") == 1) | (F.col("dotted") & F.col("head").isNull()))
    fixed = scratch.keep(fixed.select("name", "at", "t", "short"), "fixed")
    total = distinct.count()
    weights = scratch.keep(fixed.where(F.length("t") > 1).groupBy("t").agg(F.log(F.lit(float(total) + 1) / F.count("*")).alias("w")), "weights")
    weighed = fixed.join(maybe_broadcast(weights), "t", "left").withColumn("w", F.coalesce("w", F.lit(0.1)))
    lists = weighed.groupBy("name").agg(F.array_sort(F.collect_list(F.struct("at", "t", "w", "short"))).alias("all"))
    lists = lists.join(parsed.where("initial is not null").select("name", "initial"), "name", "left")
    # blocks: the rarest token, and any other that is nearly as rare
    full = F.filter("all", lambda x: ~x["short"])
    full = F.when(F.size(full) > 0, full).otherwise(F.filter("all", lambda x: F.length(x["t"]) > 1))
    top = F.array_max(F.transform(full, lambda x: x["w"]))
    keys = F.filter(full, lambda x: x["w"] >= 0.6 * top)

    def rest_of(k):
        rest = F.filter("all", lambda x: x["at"] != k["at"])
        words = F.filter(rest, lambda x: F.length(x["t"]) > 1)
        kept = F.when(F.size(words) > 0, words).otherwise(F.slice(rest, 1, 1))
        return F.when(F.col("initial").isNotNull(), F.array(F.struct(F.lit(0).alias("at"), F.col("initial").alias("t"), F.lit(0.1).cast("double").alias("w"), F.lit(True).alias("short")))).otherwise(kept)

    blocks = lists.select("name", F.explode(F.transform(keys, lambda k: F.struct(k["t"].alias("key"), rest_of(k).alias("rest")))).alias("b")).select("name", "b.*")
    blocks = blocks.where(F.size("rest") > 0).select(
        "name", "key",
        F.transform("rest", lambda x: F.struct(x["t"].alias("t"), x["w"].alias("w"))).alias("rest"),
        F.transform(F.filter("rest", lambda x: x["short"]), lambda x: x["t"]).alias("short"),
    )
    blocks = blocks.withColumn("sig", F.concat_ws(" ", "key", F.lit("|"), F.array_join(F.transform("rest", lambda x: x["t"]), " ")))
    blocks = scratch.keep(blocks, "blocks")
    sigs = scratch.keep(blocks.groupBy("sig", "key", "rest").agg(F.array_distinct(F.flatten(F.collect_set("short"))).alias("short")), "sigs")
    # within a key, names meet on another token they share, or on the first letter of one that is short in one of
    # them: many names of one surname are never all held against each other
    each = sigs.select("sig", "key", F.explode("rest").alias("x"), "short").select("sig", "key", F.col("x.t").alias("t"), F.array_contains("short", F.col("x.t")).alias("is_short"))
    each = scratch.keep(each.distinct(), "each")
    shared = each.where("not is_short").select("key", "t", F.col("sig").alias("x"))
    letters = each.select("key", F.substring("t", 1, 1).alias("letter"), F.col("sig").alias("y"))
    by_letter = each.where("is_short").select("key", F.substring("t", 1, 1).alias("letter"), F.col("sig").alias("x"))
    met = shared.join(shared.withColumnRenamed("x", "y"), ["key", "t"]).where("x < y").select("x", "y")
    met = met.unionByName(by_letter.join(letters, ["key", "letter"]).where("x <> y").select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))).distinct()
    side = lambda n: sigs.select(F.col("sig").alias(n), F.struct("sig", "rest", "short").alias(f"{n}_"))
    met = met.join(side("x"), "x").join(side("y"), "y").select(F.col("x_").alias("a"), F.col("y_").alias("b"))
    cover = F.least(
        soft_cover(F.col("a.rest"), F.col("b.rest"), F.col("a.short"), F.col("b.short")),
        soft_cover(F.col("b.rest"), F.col("a.rest"), F.col("b.short"), F.col("a.short")),
    )
    alike = met.where(cover >= threshold).select(F.col("a.sig").alias("a"), F.col("b.sig").alias("b"), F.size("a.short").alias("sa"), F.size("b.short").alias("sb"))
    alike = scratch.keep(alike, "alike")
    # a short form that fits several full forms which are not linked with each other fits none
    either = alike.select(F.col("a").alias("x"), F.col("b").alias("y"), F.col("sa").alias("sx"), F.col("sb").alias("sy")).unionByName(alike.select(F.col("b").alias("x"), F.col("a").alias("y"), F.col("sb").alias("sx"), F.col("sa").alias("sy")))
    to_full = either.where("sx > 0 and sy = 0").select("x", "y")
    among = link(scratch, alike.where("sa = 0 and sb = 0"), "a", "b").select(F.col("node").alias("y"), "label")
    meant = to_full.join(among, "y", "left").select("x", F.coalesce("label", "y").alias("label"))
    several = meant.groupBy("x").agg((F.min("label") < F.max("label")).alias("k")).where("k").select("x")
    unclear = scratch.keep(several, "several")
    clear = alike.join(maybe_broadcast(unclear.withColumnRenamed("x", "a")), "a", "left_anti").join(maybe_broadcast(unclear.withColumnRenamed("x", "b")), "b", "left_anti")
    edges = clear.select("a", "b").unionByName(blocks.select(F.concat(F.lit("\u0001"), "name").alias("a"), F.col("sig").alias("b")))
    labels = link(scratch, edges, "a", "b")
    return labels.where(F.col("node").startswith("\u0001")).select(F.substring("node", 2, 1 << 30).alias("name"), F.col("label").alias("entity"))


def typed_names(alias_claims: DataFrame, entity_claims: DataFrame, extractor: str = "manual:analyst-form") -> DataFrame:
    """The folded names (name) of rows that people typed."""
    a = alias_claims.where(F.col("extractor_id") == extractor).select(F.explode(F.array("alias", "canonical_name")).alias("name"))
    e = entity_claims.where(F.col("extractor_id") == extractor).select(F.explode(F.array("surface_form", "canonical_name")).alias("name"))
    return a.unionByName(e).distinct().select(fold(F.col("name")).alias("name"))


def variant_pairs(names: DataFrame) -> DataFrame:
    """(name_a, name_b), name_a < name_b: the spellings of one entity, as the stated result asks for."""
    labelled = Scratch(names.sparkSession, "pairs").keep(name_variants(names), "labelled")
    a, b = labelled.alias("a"), labelled.alias("b")
    return a.join(b, F.col("a.entity") == F.col("b.entity")).where("a.name < b.name").select(F.col("a.name").alias("name_a"), F.col("b.name").alias("name_b"))
