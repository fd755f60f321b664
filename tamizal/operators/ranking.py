"""Ranking operators on search hits: caps, diversity, fusion, filters with fallbacks, neighbours and injections.

A hit belongs to a search (``SEARCH``); its place is given by a score, ties by ``hit_id``. All operators are
windows or joins per search; fallbacks ("keep everything if nothing would be left") are window flags, so that no
operator needs a second pass or a driver-side count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tamizal.session import Scratch, small

SEARCH = ("run_id", "query_id")


def number(c: str | Column) -> Column:
    """A score as a number; NaN counts as missing."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(~F.isnan(c), c)


def search(*order: Column):
    w = Window.partitionBy(*SEARCH)
    return w.orderBy(*order) if order else w


def ranked(hits: DataFrame, score: str = "final_score", name: str = "rank") -> DataFrame:
    """Hits with their place in the search: higher score first, missing ones last, then the smaller id."""
    return hits.withColumn(name, F.row_number().over(search(F.desc_nulls_last(number(score)), F.asc("hit_id"))))


def limit_per_source(hits: DataFrame, n: int = 2) -> DataFrame:
    """The first ``n`` hits of each source of a search."""
    w = Window.partitionBy(*SEARCH, "source").orderBy("rank")
    return ranked(hits).withColumn("source_rank", F.row_number().over(w)).where(F.col("source_rank") <= n)


def diversify(hits: DataFrame, per_source: int = 2, total: int = 10) -> DataFrame:
    """Hits within the cap of their source first, the others behind, cut at ``total``."""
    w = Window.partitionBy(*SEARCH, "source").orderBy("rank")
    capped = ranked(hits).withColumn("within", (F.row_number().over(w) <= per_source).cast("int"))
    return capped.withColumn("place", F.row_number().over(search(F.desc("within"), F.asc("rank")))).where(F.col("place") <= total)


def reciprocal_rank_fusion(hits: DataFrame, first: str = "hybrid_score", second: str = "rerank_score", k: int = 60) -> DataFrame:
    """Fusion of two orders of the same hits: 1/(k+a) + 1/(k+b)."""
    both = ranked(ranked(hits, first, "first_rank"), second, "second_rank")
    return both.withColumn("rrf", 1.0 / (k + F.col("first_rank")) + 1.0 / (k + F.col("second_rank")))


def adaptive_quality(hits: DataFrame, score: str = "hybrid_score", keep: int = 3) -> DataFrame:
    """Hits over a threshold that follows the search's scores; the best ``keep`` always stay."""
    s = F.coalesce(number(score), F.lit(0.0))
    w = search()
    high, top, n = F.sum((s > 0.5).cast("int")).over(w), F.max(s).over(w), F.count("*").over(w)
    limit = F.when(high >= 5, 0.40).when((n < 3) & (top < 0.30), 0.15).otherwise(0.25)
    return ranked(hits, score).withColumn("threshold", limit).where((s >= F.col("threshold")) | (F.col("rank") <= keep))


def normalize_rerank(hits: DataFrame, weight: float = 0.7) -> DataFrame:
    """Reranker scores brought to 0..1 and blended: small scores are stretched, others go through a logistic curve."""
    s = F.coalesce(number("rerank_score"), F.lit(0.0))
    top = F.max(s).over(search())
    norm = F.when(top < 0.1, F.greatest(F.lit(0.0), F.least(F.lit(1.0), s / 0.1))).otherwise(1 / (1 + F.exp(-5 * s)))
    blend = weight * F.col("norm") + (1 - weight) * F.coalesce(number("hybrid_score"), F.lit(0.0))
    return hits.withColumn("norm", norm).withColumn("blend", blend)


def rerank_pool(hits: DataFrame, pool: int = 15, top_k: int = 10) -> DataFrame:
    """The hits that a reranker would see: the first max(pool, top_k) by hybrid score."""
    return ranked(hits, "hybrid_score").where(F.col("rank") <= max(pool, top_k))


def normalized_filter(hits: DataFrame, questions: DataFrame | None = None, limit: float = 0.15, low: float = 0.10, cap: int = 10, many: int = 3, keep: int = 2) -> DataFrame:
    """Hits whose normalized score reaches ``limit``, at most ``cap`` of a search.

    Searches whose best reranker score is under ``low`` pass whole, and so do those of questions with ``many``
    entities. questions (query_id, numeric, entities: their number): for numeric ones ``low`` is enough, and the
    first ``keep`` hits stay anyway.
    """
    weak = F.coalesce(F.max(number("rerank_score")).over(search()), F.lit(0.0)) < low
    kept = ranked(hits, name="before")
    kept = kept.join(small(questions.select("query_id", "numeric", "entities")), "query_id", "left") if questions is not None else kept.withColumns({"numeric": F.lit(False), "entities": F.lit(0)})
    numeric, free = F.coalesce("numeric", F.lit(False)), weak | (F.coalesce("entities", F.lit(0)) >= many)
    kept = kept.withColumn("weak", weak).withColumn("free", free).where(F.col("free") | (F.coalesce(number("rerank_norm"), F.lit(0.0)) >= F.when(numeric, low).otherwise(limit)) | (numeric & (F.col("before") <= keep)))
    return ranked(kept).where(F.col("rank") <= cap)


def preserve_top(hits: DataFrame, top_k: int = 5, before: str = "hybrid_score", after: str = "final_score") -> DataFrame:
    """The first ``top_k`` after reranking without pages that were not in the first ``top_k`` before; then the first hit of each such page that is lost, up to ``top_k``.

    A page is its source in lower case and its number; missing ones count as '' and 0. ``filled`` marks hits put back.
    """
    placed = ranked(hits, before, "before").withColumn("after", F.row_number().over(search(F.desc_nulls_last(number(after)), F.asc("before"))))
    placed = placed.withColumns({"_s": F.lower(F.coalesce("source", F.lit(""))), "_p": F.coalesce("page", F.lit(0))})
    page = Window.partitionBy(*SEARCH, "_s", "_p")
    placed = placed.withColumn("page_best", F.min("before").over(page)).where(F.col("page_best") <= top_k)
    placed = placed.withColumn("page_after", F.min("after").over(page))
    stays, back = F.col("after") <= top_k, (F.col("page_after") > top_k) & (F.col("before") == F.col("page_best"))
    kept = placed.where(stays | back).withColumn("filled", F.when(stays, 0).otherwise(1))
    place = F.row_number().over(search(F.asc("filled"), F.when(stays, F.col("after")).otherwise(F.col("before"))))
    return kept.drop("_s", "_p", "page_after").withColumn("place", place).where(F.col("place") <= top_k)


def first_per_page(hits: DataFrame) -> DataFrame:
    """The first hit of each page of a search, in order."""
    w = Window.partitionBy(*SEARCH, "source", "page").orderBy("rank")
    return ranked(hits).withColumn("nth", F.row_number().over(w)).where(F.col("nth") == 1)


def soft_scope(hits: DataFrame, inside: Column) -> DataFrame:
    """Hits inside the scope, or all hits of a search where none is inside."""
    flag = F.coalesce(inside, F.lit(False)).cast("int")
    return hits.withColumn("inside", flag).withColumn("any_inside", F.max("inside").over(search())).where((F.col("inside") == 1) | (F.col("any_inside") == 0))


def guarded_scope(hits: DataFrame, inside: Column, least: int = 5) -> DataFrame:
    """A scope that is dropped for searches where it would keep fewer than max(``least``, half) of the hits."""
    flag = F.coalesce(inside, F.lit(False)).cast("int")
    w = search()
    marked = hits.withColumn("inside", flag).withColumn("kept", F.sum("inside").over(w)).withColumn("all", F.count("*").over(w))
    applies = F.col("kept") >= F.greatest(F.lit(least), F.floor(F.col("all") / 2))
    return marked.withColumn("applies", applies.cast("int")).where((F.col("applies") == 0) | (F.col("inside") == 1))


def neighbour_pages(hits: DataFrame, top: int = 10, per_source: int = 4) -> DataFrame:
    """Pages next to those of the first ``top`` hits that the search has not found itself, at most ``per_source`` of a source.

    The page distance is turned into an equality join: each page is offered one step up and one down.
    """
    pages = ranked(hits).where("source is not null and page is not null")
    best = pages.groupBy(*SEARCH, "source", "page").agg(F.min("rank").alias("rank"))
    near = best.where(F.col("rank") <= top).withColumn("page", F.explode(F.array(F.col("page") - 1, F.col("page") + 1))).where("page > 0")
    near = near.groupBy(*SEARCH, "source", "page").agg(F.min("rank").alias("of_rank"))
    fresh = near.join(best.select(*SEARCH, "source", "page"), [*SEARCH, "source", "page"], "left_anti")
    w = Window.partitionBy(*SEARCH, "source").orderBy("of_rank", "page")
    return fresh.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= per_source)


def ensure_source(hits: DataFrame, wanted: DataFrame, limit: int = 2, top: int = 10, score: float = 0.85) -> DataFrame:
    """Hits of a wanted source (canonical_doc_id) put in front of searches whose first ``top`` lack it, with a fixed score."""
    placed = ranked(hits)
    mine = placed.join(small(wanted), "canonical_doc_id", "left_semi")
    present = mine.where(F.col("rank") <= top).select(*SEARCH).distinct()
    missing = mine.join(present, list(SEARCH), "left_anti")
    w = search(F.asc("rank"))
    return missing.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= limit).withColumn("forced_score", F.lit(score))


def ensure_entity(hits: DataFrame, entities: DataFrame, limit: int = 2, top: int = 10) -> DataFrame:
    """Hits whose text names an entity of their question, put in front of searches whose first ``top`` name none.

    entities: query_id, entities. They come with the scores .75 (semantic), .0 (keyword) and .72 (final).
    """
    placed = ranked(hits).join(small(entities.where("size(entities) > 0")), "query_id")
    named = F.exists("entities", lambda e: F.contains(F.lower(F.coalesce("text", F.lit(""))), F.lower(e)))
    placed = placed.withColumn("named", F.coalesce(named, F.lit(False)))
    seen = F.max((F.col("named") & (F.col("rank") <= top)).cast("int")).over(search())
    missing = placed.withColumn("seen", seen).where((F.col("seen") == 0) & F.col("named"))
    missing = missing.withColumn("nth", F.row_number().over(search(F.asc("rank")))).where(F.col("nth") <= limit)
    return missing.withColumns({"forced_semantic": F.lit(0.75), "forced_keyword": F.lit(0.0), "forced_score": F.lit(0.72)})


def best_per_source(hits: DataFrame, chars: int = 800) -> DataFrame:
    """The best hit of each source of a search, its text cut to ``chars``."""
    w = Window.partitionBy(*SEARCH, "source").orderBy("rank")
    best = ranked(hits).withColumn("nth", F.row_number().over(w)).where(F.col("nth") == 1)
    return best.withColumn("cut", F.substring("text", 1, chars))


def source_stats(hits: DataFrame, top: int = 20) -> DataFrame:
    """Per source of a search over its first ``top`` hits: best reranker score and number of hits."""
    few = ranked(hits).where(F.col("rank") <= top)
    return few.groupBy(*SEARCH, "source").agg(F.max(number("rerank_score")).alias("best"), F.count("*").alias("n"))


def nested_caps(hits: DataFrame, per_source: int = 8, total: int = 25) -> DataFrame:
    """At most ``per_source`` hits of a source and ``total`` of a search, by score, then page."""
    order = [F.desc_nulls_last(number("final_score")), F.asc_nulls_last("page"), F.asc("hit_id")]
    inner = Window.partitionBy(*SEARCH, "source").orderBy(*order)
    few = hits.withColumn("in_source", F.row_number().over(inner)).where(F.col("in_source") <= per_source)
    return few.withColumn("place", F.row_number().over(search(*order))).where(F.col("place") <= total)


def spread_of_sources(hits: DataFrame, top: int = 5) -> DataFrame:
    """Whether a search needs several documents: at least three sources among the first ``top`` with close scores."""
    few = ranked(hits).where(F.col("rank") <= top)
    s = F.coalesce(number("final_score"), F.lit(0.0))
    out = few.groupBy(*SEARCH).agg(F.countDistinct("source").alias("sources"), (F.max(s) - F.min(s)).alias("spread"))
    return out.withColumn("several", (F.col("sources") >= 3) & (F.col("spread") < 0.3))


def pick_sources(hits: DataFrame, preferred: Column, top: int = 15, n: int = 4) -> DataFrame:
    """The first ``n`` sources among the first ``top`` hits, preferred ones first."""
    few = ranked(hits).where((F.col("rank") <= top) & F.col("source").isNotNull()).withColumn("preferred", F.coalesce(preferred, F.lit(False)).cast("int"))
    by = few.groupBy(*SEARCH, "source").agg(F.min("rank").alias("first_rank"), F.max("preferred").alias("preferred"))
    return by.withColumn("place", F.row_number().over(search(F.desc("preferred"), F.asc("first_rank")))).where(F.col("place") <= n)


def expand_sources(hits: DataFrame, n: int = 1) -> DataFrame:
    """All hits of the run that come from the sources of a search's first ``n`` hits."""
    chosen = ranked(hits).where((F.col("rank") <= n) & F.col("source").isNotNull()).select("run_id", "source").distinct()
    return hits.join(chosen, ["run_id", "source"], "left_semi")


def context_budget(hits: DataFrame, budget: int = 6000, piece: int = 700) -> DataFrame:
    """Hits that fit a running budget of characters, each text cut to ``piece``; the first overflow ends the context."""
    running = Window.partitionBy(*SEARCH).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    cut = ranked(hits).withColumn("piece", F.substring(F.coalesce("text", F.lit("")), 1, piece))
    total = cut.withColumn("used", F.sum(F.length("piece")).over(running))
    # lengths are never negative, so the sums rise and the first overflow is the last that fits plus one
    return total.where(F.col("used") <= budget)


def reorder(hits: DataFrame, first: Column) -> DataFrame:
    """Hits that meet a condition moved to the front, both parts in their order."""
    flag = ranked(hits).withColumn("first", F.coalesce(first, F.lit(False)).cast("int"))
    return flag.withColumn("place", F.row_number().over(search(F.desc("first"), F.asc("rank"))))


def listing(hits: DataFrame, n: int = 20, chars: int = 1200) -> DataFrame:
    """The first ``n`` hits of a search in page order."""
    w = search(F.asc_nulls_last("page"), F.asc("hit_id"))
    return hits.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n).withColumn("cut", F.substring("text", 1, chars))


def word_set(c: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(c), r"[^a-z0-9áéíóúüñ]+"), lambda x: x != ""))


def word_classes(hits: DataFrame) -> DataFrame:
    """(run_id, query_id, hit_id, rank, class_id, words): hits of equal word sets in a search share the id of the first of them."""
    words = F.array_sort(word_set(F.coalesce("text", F.lit(""))))
    marked = ranked(hits).select(*SEARCH, "hit_id", "rank", words.alias("words"), F.xxhash64(F.array_join(words, " ")).alias("h"))
    return marked.withColumn("class_id", F.min_by("hit_id", "rank").over(Window.partitionBy(*SEARCH, "h", F.size("words"))))


def similar_classes(classes: DataFrame, threshold: float = 0.85) -> DataFrame:
    """(run_id, query_id, first_id, first_rank, second_id, second_rank, jaccard): pairs of different word sets of a search that are alike.

    A prefix-filtered join: two sets alike to ``threshold`` share one of the first words of each, in order of how
    few sets of the search hold them; so not all pairs of a search meet.
    """
    one = classes.where("hit_id = class_id and size(words) > 0").select(*SEARCH, "class_id", "rank", "words")
    spread = one.select(*SEARCH, "class_id", F.size("words").alias("n"), F.explode("words").alias("word"))
    held = spread.withColumn("df", F.count("*").over(Window.partitionBy(*SEARCH, "word")))
    nth = F.row_number().over(Window.partitionBy(*SEARCH, "class_id").orderBy("df", "word"))
    prefix = held.withColumn("nth", nth).where(F.col("nth") <= F.col("n") - F.ceil(F.lit(threshold) * F.col("n")) + 1).select(*SEARCH, "class_id", "n", "word")
    a, b = prefix.alias("a"), prefix.alias("b")
    met = a.join(b, [*SEARCH, "word"]).where((F.col("a.class_id") < F.col("b.class_id")) & (F.least("a.n", "b.n") >= F.lit(threshold) * F.greatest("a.n", "b.n")))
    met = met.select(*SEARCH, F.col("a.class_id").alias("x"), F.col("b.class_id").alias("y")).distinct()
    side = lambda n: one.select(*SEARCH, F.col("class_id").alias(n), F.col("rank").alias(f"{n}_rank"), F.col("words").alias(f"{n}_words"))
    met = met.join(side("x"), [*SEARCH, "x"]).join(side("y"), [*SEARCH, "y"])
    alike = F.size(F.array_intersect("x_words", "y_words")) / F.size(F.array_union("x_words", "y_words"))
    met = met.withColumn("jaccard", alike).where(F.col("jaccard") >= threshold)
    first = F.col("x_rank") < F.col("y_rank")
    pick = lambda p, q: F.when(first, F.col(p)).otherwise(F.col(q))
    return met.select(*SEARCH, pick("x", "y").alias("first_id"), pick("x_rank", "y_rank").alias("first_rank"), pick("y", "x").alias("second_id"), pick("y_rank", "x_rank").alias("second_rank"), "jaccard")


def similar_hits(hits: DataFrame, threshold: float = 0.85) -> DataFrame:
    """(run_id, query_id, hit_id, class_id, links): each hit with its class of equal word sets and how many other classes of the search are alike (Jaccard)."""
    classes = word_classes(hits)
    pairs = similar_classes(classes, threshold)
    both = pairs.select(*SEARCH, F.col("first_id").alias("class_id")).unionByName(pairs.select(*SEARCH, F.col("second_id").alias("class_id")))
    links = both.groupBy(*SEARCH, "class_id").agg(F.count("*").alias("links"))
    return classes.select(*SEARCH, "hit_id", "class_id").join(links, [*SEARCH, "class_id"], "left").na.fill(0, ["links"])


def greedy_dedup(hits: DataFrame, threshold: float = 0.85) -> DataFrame:
    """(run_id, query_id, hit_id, rank): the hits of a search without those alike to a better one that stays, in order.

    A dropped hit drops no other. Copies fall to their first; among classes the rule is settled in rounds: a class
    with no better undecided neighbour stays, its neighbours go. Each round is a kept table; chains of neighbours
    in order of rank set their number. Hits without words stay, of several of them the first.
    """
    scratch = Scratch(hits.sparkSession, "dedup")
    classes = scratch.keep(word_classes(hits), "classes")
    open_ = scratch.keep(similar_classes(classes, threshold).select(*SEARCH, "first_id", "second_id"), "pairs")
    gone = None
    while not open_.isEmpty():
        later = open_.select(*SEARCH, F.col("second_id").alias("first_id")).distinct()
        stay = open_.select(*SEARCH, "first_id").distinct().join(later, [*SEARCH, "first_id"], "left_anti")
        fall = scratch.keep(open_.join(stay, [*SEARCH, "first_id"], "left_semi").select(*SEARCH, F.col("second_id").alias("class_id")).distinct(), "fall")
        gone = fall if gone is None else gone.unionByName(fall)
        rest = open_.join(fall.withColumnRenamed("class_id", "second_id"), [*SEARCH, "second_id"], "left_anti")
        open_ = scratch.keep(rest.join(fall.withColumnRenamed("class_id", "first_id"), [*SEARCH, "first_id"], "left_anti"), "pairs")
    first = classes.where("hit_id = class_id").select(*SEARCH, "hit_id", "rank", "class_id")
    if gone is not None:
        first = first.join(gone, [*SEARCH, "class_id"], "left_anti")
    return first.drop("class_id")


def dynamic_budget(hits: DataFrame, budget: int = 6000, least: int = 600, top: int = 8) -> DataFrame:
    """Character budgets handed out one by one: each source gets max(least, what is left / sources left), as far as its text goes."""
    best = best_per_source(hits).where("source is not null").withColumn("nth", F.row_number().over(search(F.asc("rank")))).where(F.col("nth") <= top)
    lists = best.groupBy(*SEARCH).agg(F.array_sort(F.collect_list(F.struct("nth", "hit_id", F.length(F.coalesce("text", F.lit(""))).alias("size")))).alias("all"))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.slice(F.transform("all", lambda x: F.struct(x["hit_id"].alias("hit_id"), F.lit(0).cast("long").alias("chars"))), 1, 0).alias("out"))

    def step(acc, x):
        share = F.greatest(F.lit(least).cast("long"), F.floor((budget - acc["used"]) / (F.size("all") - x["nth"] + 1)))
        take = F.least(share, x["size"].cast("long"))
        return F.struct((acc["used"] + take).alias("used"), F.concat(acc["out"], F.array(F.struct(x["hit_id"].alias("hit_id"), take.alias("chars")))).alias("out"))

    return lists.select(*SEARCH, F.inline(F.aggregate("all", start, step)["out"]))
