"""Problem 4: deduplicating new batches against all history.

Each increment of the registry probes persisted tables instead of the history itself: blocking keys (content
hash, name key, name key with one slip corrected) with the entries that stand for the key, and the vocabulary
of file-name words with its one-deletion neighbourhood. The tables are append-only and lie in buckets; a batch
reads the buckets its keys fall into and adds what is new. A match through a corrected slip is scored with
Fellegi-Sunter weights learned by expectation-maximisation; accepted links run through union-find over cluster
representatives, and only clusters that a batch touches get a new representative.
"""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamizal.functions.text import fold

from .common import Buckets, Scratch, maybe_broadcast
from .components import link, rank_of

# File extensions, and words of place that one slip must never turn into each other.
EXTENSIONS = "pdf|txt|docx?|xlsx?|pptx?|html?|csv|md|rtf|odt|tiff?|jpe?g|png|zip"
PLACES = ("norte", "sur", "este", "oeste", "north", "south", "east", "west", "noreste", "noroeste", "sureste", "suroeste", "centro")
EMPTY_HASH = hashlib.sha256(b"").hexdigest()


def name_tokens(filename: Column) -> Column:
    """Words and numbers of a file name once folder, extensions, copy marks, case, accents, separators and URL escapes are set aside."""
    raw = F.when(filename.contains("%"), F.coalesce(F.try_url_decode(F.regexp_replace(filename, r"\+", "%2B")), filename)).otherwise(filename)
    s = fold(F.regexp_replace(F.regexp_replace(raw, r"^.*[/\\]", ""), "_", " "))
    mark = rf"\s*\.(?:{EXTENSIONS})|[\s-]*\(\d{{1,2}}\)|[\s-]+(?:copia|copy)(?:[\s-]+\d{{1,2}})?"
    s = F.regexp_replace(F.regexp_replace(s, rf"(?:{mark})+\s*$", ""), r"^(?:(?:copia de|copy of)\s+)+", "")
    return F.regexp_extract_all(s, F.lit(r"\d+(?:\.\d+)*|\p{L}+"), F.lit(0))


def joined(parts: Column) -> Column:
    """One name key: letters run together, numbers fenced."""
    return F.array_join(F.transform(parts, lambda t: F.when(t.rlike("^[0-9]"), F.concat(F.lit("#"), t, F.lit("#"))).otherwise(t)), "")


def one_slip(a: Column, b: Column) -> Column:
    """Whether two different words are one insertion, deletion, substitution or swap of neighbours apart."""
    swap = (F.length(a) == F.length(b)) & (F.array_sort(F.split(a, "")) == F.array_sort(F.split(b, "")))
    near = F.levenshtein(a, b, 2)
    inner = F.exists(
        F.sequence(F.lit(1), F.greatest(F.length(a) - 1, F.lit(1))),
        lambda i: F.concat(F.substring(a, F.lit(1), i - 1), F.substring(a, i + 1, F.lit(1)), F.substring(a, i, F.lit(1)), F.substring(a, i + 2, F.length(a))) == b,
    )
    return (a != b) & ((near == 1) | ((near == 2) & swap & inner))


def deletions(word: Column) -> Column:
    """Hashes of the word and of the word less one letter."""
    cut = F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, F.length(word))))
    return F.transform(F.array_distinct(F.concat(F.array(word), cut)), lambda w: F.xxhash64(w))


def learn_weights(patterns: list[tuple[int, int, int]], chance: tuple[float, float], rounds: int = 25) -> tuple[float, list[tuple[float, float]]]:
    """Fellegi-Sunter by EM over counted comparison patterns (pages, chunks, count); 1 agree, 0 disagree, -1 missing.

    ``chance``: how often two unrelated entries agree, from the frequencies of the values. Returns the prior's
    log odds and per field the weights (agree, disagree). The number of patterns is at most nine.
    """
    prior, m = 0.8, [0.9, 0.9]
    total = sum(n for *_, n in patterns) or 1
    for _ in range(rounds):
        matched, agree, seen = 0.0, [0.0, 0.0], [0.0, 0.0]
        for *fields, n in patterns:
            odds = prior / (1 - prior)
            for f, x in enumerate(fields):
                if x >= 0:
                    odds *= m[f] / chance[f] if x else (1 - m[f]) / (1 - chance[f])
            p = n * odds / (1 + odds)
            matched += p
            for f, x in enumerate(fields):
                if x >= 0:
                    seen[f] += p
                    agree[f] += p * x
        prior = min(max(matched / total, 0.05), 0.95)
        m = [min(max((a + 1) / (s + 2), 0.5), 0.99) for a, s in zip(agree, seen)]
    weights = [(math.log(m[f] / chance[f]), math.log((1 - m[f]) / (1 - chance[f]))) for f in (0, 1)]
    return math.log(prior / (1 - prior)), weights


def _agree(a: Column, b: Column, within: int) -> Column:
    return F.when(a.isNull() | b.isNull() | (a == 0) | (b == 0), -1).when(F.abs(a - b) <= within, 1).otherwise(0)


class Registry:
    """Linkage with persisted state in the folder ``home``: keys, words, forms of words, and moved representatives.

    A registry opened on the same folder, in this session or a later one, goes on where the last batch ended.
    """

    TABLES = {
        "keys": "key string, guess boolean, entry_id long, pages int, chunks int", "words": "word string, n long",
        "forms": "word string, form long", "moved": "rep long, root long",
    }

    def __init__(self, scratch: Scratch, home: str | None = None):
        self.scratch = scratch
        self.state = Buckets(scratch.spark, home or f"{scratch.root}/state", self.TABLES)

    def _slips(self, entries: DataFrame) -> DataFrame:
        """(word, other): slips to try for words of this increment; the vocabulary grows by its words."""
        sc, state = self.scratch, self.state
        fresh = entries.select(F.explode(F.array_distinct("tokens")).alias("word")).where(F.col("word").rlike(r"^\p{L}{2,}$")).groupBy("word").agg(F.count("*").alias("n"))
        fresh = sc.keep(fresh, "fresh")
        known = state.look_up("words", fresh, "word")
        now = fresh.withColumn("old", F.lit(False))
        if known is not None:
            now = fresh.unionByName(known.select("word", "n")).groupBy("word").agg(F.sum("n").alias("n"), (F.count("*") > 1).alias("old"))
        now = sc.keep(now, "now")
        forms = sc.keep(now.where(F.length("word") >= 3).select("word", "old", F.explode(deletions(F.col("word"))).alias("form")), "forms")
        other = forms.select("form", F.col("word").alias("other"))
        past = state.look_up("forms", forms, "form")
        if past is not None:
            other = other.unionByName(past.select("form", F.col("word").alias("other"))).distinct()
        both_places = F.col("word").isin(*PLACES) & F.col("other").isin(*PLACES)
        pairs = sc.keep(forms.select("word", "form").join(other, "form").where(~both_places & one_slip(F.col("word"), F.col("other"))).select("word", "other").distinct(), "near")
        count = now.select(F.col("word").alias("other"), F.col("n").alias("n_other"), F.col("old").alias("old_other"))
        asked = pairs.select(F.col("other").alias("word")).distinct().join(now, "word", "left_anti")
        past = state.look_up("words", asked, "word")
        if past is not None:
            count = count.unionByName(past.groupBy("word").agg(F.sum("n").alias("n")).select(F.col("word").alias("other"), F.col("n").alias("n_other"), F.lit(True).alias("old_other")))
        # towards the more usual spelling always; towards any spelling of the history when this word is new
        met = pairs.join(now, "word").join(count, "other")
        slips = sc.keep(met.where("n_other >= n or (old_other and not old)").select("word", "other"), "slips")
        state.append("words", fresh.select("word", "n"), "word")
        state.append("forms", forms.where("not old").select("word", "form"), "form")
        return slips

    def _roots(self, links: DataFrame) -> DataFrame:
        """(rep, root) of the representatives in ``links`` (entry_id, rep) that earlier batches moved; pointers are followed to their end."""
        asked, roots = links.select("rep").distinct(), None
        while True:
            moved = self.state.look_up("moved", asked, "rep")
            if moved is None:
                return roots if roots is not None else links.select("rep", F.col("rep").alias("root")).limit(0)
            step = self.scratch.keep(moved.groupBy("rep").agg(F.max_by("root", "batch").alias("root")), "step")
            if step.isEmpty():
                return roots if roots is not None else step
            if roots is None:
                roots = step
            else:
                roots = self.scratch.keep(roots.join(maybe_broadcast(step.select(F.col("rep").alias("root"), F.col("root").alias("next"))), "root", "left").select("rep", F.coalesce("next", "root").alias("root")), "roots")
            asked = step.select(F.col("root").alias("rep")).distinct()

    def add(self, batch: DataFrame) -> None:
        """Links one increment (entry_id, content_hash, filename, total_pages, attempted_chunks) to everything before it and to itself."""
        sc, state = self.scratch, self.state
        digest = F.lower(F.regexp_replace(F.trim("content_hash"), r"^.*:", ""))
        empty = (F.coalesce(F.col("attempted_chunks"), F.lit(-1)) == 0) | (F.coalesce(F.col("total_pages"), F.lit(-1)) == 0) | (digest == EMPTY_HASH) | (digest == "")
        entries = sc.keep(
            batch.select(
                F.col("entry_id").cast("long").alias("entry_id"),
                F.when(~empty, digest).alias("digest"),
                name_tokens(F.col("filename")).alias("tokens"),
                F.when(~empty, F.col("total_pages")).cast("int").alias("pages"),
                F.when(~empty, F.col("attempted_chunks")).cast("int").alias("chunks"),
            ),
            "entries",
        )
        slips = self._slips(entries)
        facts = ["entry_id", "pages", "chunks"]
        named = entries.where(F.size("tokens") > 0)
        by_hash = entries.where("digest is not null").select(F.concat(F.lit("h:"), "digest").alias("key"), F.lit(False).alias("guess"), *facts)
        by_name = named.select(F.concat(F.lit("n:"), joined(F.col("tokens"))).alias("key"), F.lit(False).alias("guess"), *facts)
        spread_ = named.select("tokens", *facts, F.posexplode("tokens").alias("at", "word"))
        by_slip = spread_.join(maybe_broadcast(slips), "word").select(
            F.concat(F.lit("n:"), joined(F.transform("tokens", lambda t, i: F.when(i == F.col("at"), F.col("other")).otherwise(t)))).alias("key"), F.lit(True).alias("guess"), *facts
        )
        probes = sc.keep(by_hash.unionByName(by_name).unionByName(by_slip), "probes")
        # the stand-ins of a key, one that has it for certain and one that is guessed to: of the history if it has one, else the smallest entry here
        own = probes.groupBy("key", "guess").agg(F.min(F.struct("entry_id", "pages", "chunks")).alias("s")).select("key", "guess", F.lit(1).alias("age"), "s")
        before = state.look_up("keys", own, "key")
        if before is not None:
            own = own.unionByName(before.select("key", "guess", F.lit(0).alias("age"), F.struct("entry_id", "pages", "chunks").alias("s")))
            own = own.groupBy("key", "guess").agg(F.min(F.struct("age", "s")).alias("x")).select("key", "guess", F.col("x.age").alias("age"), F.col("x.s").alias("s"))
        stands = sc.keep(own.select("key", "guess", "age", "s.*"), "stands")
        pairs = (
            probes.join(stands.select("key", F.col("guess").alias("guess2"), F.col("entry_id").alias("rep"), F.col("pages").alias("p2"), F.col("chunks").alias("c2")), "key")
            .where("entry_id <> rep")
            .select("entry_id", "rep", (F.col("guess") | F.col("guess2")).alias("guess"), _agree(F.col("pages"), F.col("p2"), 1).alias("pa"), _agree(F.col("chunks"), F.col("c2"), 0).alias("ca"))
        )
        pairs = sc.keep(pairs, "pairs")
        prior, ((pa, pd), (ca, cd)) = self._weights(entries, pairs)
        weight = F.lit(prior) + F.when(F.col("pa") == 1, pa).when(F.col("pa") == 0, pd).otherwise(0.0) + F.when(F.col("ca") == 1, ca).when(F.col("ca") == 0, cd).otherwise(0.0)
        links = sc.keep(pairs.where(~F.col("guess") | (weight >= 0)).select("entry_id", "rep").distinct(), "links")
        links = links.join(maybe_broadcast(self._roots(links)), "rep", "left").select("entry_id", F.coalesce("root", "rep").alias("rep"))
        links = links.select(rank_of(F.col("entry_id")).alias("a"), rank_of(F.col("rep")).alias("b"))
        solved = link(sc, links, "a", "b").select(F.col("node").cast("long").alias("rep"), F.col("label").cast("long").alias("root")).where("rep <> root")
        state.append("moved", solved, "rep")
        state.append("keys", stands.where("age = 1").drop("age"), "key")
        state.commit()

    def _weights(self, entries: DataFrame, pairs: DataFrame) -> tuple[float, list[tuple[float, float]]]:
        def chance(column: str) -> float:
            counts = entries.where(F.col(column).isNotNull()).groupBy(column).count()
            row = counts.agg(F.sum(F.col("count").cast("double") ** 2), F.sum("count")).first()
            return min(max((row[0] or 0) / max((row[1] or 0) ** 2, 1), 1e-4), 0.5)

        patterns = [tuple(r) for r in pairs.groupBy("pa", "ca").agg(F.count("*")).collect()]  # nine rows at most
        return learn_weights(patterns, (min(3 * chance("pages"), 0.5), chance("chunks")))

    def repeats(self) -> DataFrame:
        """(first_id, entry_id) of every entry that repeats an earlier one: the moves of all batches, followed to their ends."""
        moved = self.state.whole("moved")
        if moved is None:
            return self.scratch.spark.createDataFrame([], "first_id long, entry_id long")
        solved = link(self.scratch, moved.select(rank_of(F.col("rep")).alias("a"), rank_of(F.col("root")).alias("b")), "a", "b")
        return solved.select(F.col("label").cast("long").alias("first_id"), F.col("node").cast("long").alias("entry_id")).where("first_id <> entry_id")


def link_batches(registry: DataFrame, increments: list[Column]) -> DataFrame:
    """(first_id, entry_id): entries that repeat an earlier one, found increment by increment.

    ``increments``: disjoint conditions in order of arrival. Null hashes and empty extractions match nothing by
    hash, null or blank names nothing by name; rows that have neither stand alone. Repeated rows are repeats
    through their equal keys; other columns are ignored; an empty table gives an empty result.
    """
    state = Registry(Scratch(registry.sparkSession, "registry"))
    for now in increments:
        state.add(registry.where(now).select("entry_id", "content_hash", "filename", "total_pages", "attempted_chunks"))
    return state.repeats()


def registry_repeats(registry: DataFrame) -> DataFrame:
    """The registry in three arrivals: the first batch, then the later batches in two halves."""
    last = registry.agg(F.max("batch_no")).first()[0] or 0
    half = max(1, last // 2)
    b = F.coalesce(F.col("batch_no"), F.lit(0))
    return link_batches(registry, [b <= 0, (b > 0) & (b <= half), b > half])


__all__ = ["Registry", "link_batches", "registry_repeats"]
