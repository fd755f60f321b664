"""Problem 7: evaluation texts leaking into training text.

Documents and items meet through shared seeds, hashed word triples of the item. Only the rarest seeds of every
window of an item are looked up, as many as make sure that a window with all its allowed changes keeps some of
them; so frames shared by many items bring no pairs. Stretches of documents around such seeds are verified by
greedy string tiling: the longest common word runs, found by running Karp-Rabin hashes, are marked first and
never overlap; single words between two changes are put in afterwards. A leak is decided by the number of the
item's words found, over the whole question or any 20 consecutive words of the passage, inside a stretch of the
document not much longer; rarity only tells look-alikes. Tiles may be reordered inside that stretch.
"""

from __future__ import annotations

from collections import defaultdict

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tamizal.functions.text import strip_accents

from .common import Scratch, let, maybe_broadcast, spread

WINDOW = 20
SEED = 3


def words(text: Column) -> Column:
    """Lower-case words without accents, tags, punctuation; words cut by a hyphen at a line end are joined."""
    s = let(text, lambda t: F.when(t.contains("<"), F.regexp_replace(t, r"<[^<>]{1,300}>", " ")).otherwise(t))
    s = let(F.lower(F.regexp_replace(s, "[-‐­¬]\\s*\\n\\s*", "")), strip_accents)
    return F.regexp_extract_all(s, F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def _seeds(tokens: Column, sizes: list[int]) -> Column:
    """(at, seed) of every run of ``sizes`` words; a hash of the words' hashes."""

    def of(hashes: Column, k: int) -> Column:
        n = F.size(hashes) - (k - 1)
        at = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.struct(i.alias("at"), F.xxhash64(*[F.get(hashes, i + j - 1) for j in range(k)]).alias("seed")))

    return let(F.transform(tokens, lambda w: F.xxhash64(w)), lambda h: F.concat(*[of(h, k) for k in sizes]))


def _rarest(parts: DataFrame) -> DataFrame:
    """(seed, part, need, span): the seeds to look up, and how many of them a leak keeps within ``span`` words.

    parts: part, words, size (words of a window), k (words of a seed). Of the seeds of a window, its changes break
    at most ``k`` each; two more than they can break are chosen where there are as many, the rarest among the items first.
    """
    broken = F.col("k") * allowed_of(F.col("size"))
    lists = parts.withColumn("chosen", F.least(F.col("size") - F.col("k") + 1, broken + 3)).withColumn("need", F.greatest(F.lit(1), F.col("chosen") - broken).cast("int"))
    at = F.when(F.col("k") == 1, _seeds(F.col("words"), [1])).when(F.col("k") == 2, _seeds(F.col("words"), [2])).otherwise(_seeds(F.col("words"), [SEED]))
    seeds = lists.select("part", "need", "chosen", F.ceil(F.col("size") * 1.3).cast("int").alias("span"), (F.col("size") - F.col("k") + 1).alias("width"), F.size("words").alias("n"), "k", F.inline(at))
    common = seeds.groupBy("seed").agg(F.countDistinct("part").alias("df"))
    # every window that a seed lies in, by its first word
    last = F.col("n") - F.col("k") + 1
    windows = seeds.join(common, "seed").withColumn("window", F.explode(F.sequence(F.greatest(F.lit(1), F.col("at") - F.col("width") + 1), F.least(F.col("at"), F.greatest(F.lit(1), last - F.col("width") + 1)))))
    order = Window.partitionBy("part", "window").orderBy("df", "seed", "at")
    return windows.withColumn("r", F.row_number().over(order)).where(F.col("r") <= F.col("chosen")).select("seed", "part", "need", "span").distinct()


def tile(a: list[int], b: list[int], least: int = 2) -> list[int]:
    """Greedy string tiling of word ids: for each place in ``a`` the place in ``b`` its tile puts it to, or -1."""
    place, taken = [-1] * len(a), [False] * len(b)
    s = 16
    while s >= least:
        hashes = defaultdict(list)
        for j, h in _runs(b, s, taken):
            hashes[h].append(j)
        found = []
        for i, h in _runs(a, s, [p >= 0 for p in place]):
            for j in hashes.get(h, ()):
                k = 0
                while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k] and place[i + k] < 0 and not taken[j + k]:
                    k += 1
                if k >= s:
                    found.append((-k, i, j))
        for k, i, j in sorted(found):
            run = 0  # what is still free of this match; a shorter rest is met again at a smaller s
            while run < -k and place[i + run] < 0 and not taken[j + run]:
                run += 1
            if run >= s:
                for x in range(run):
                    place[i + x], taken[j + x] = j + x, True
        s = s // 2 if s > 2 * least or s == least else least
    return place


def _runs(ids: list[int], s: int, used: list[bool], base: int = 1_000_003, mod: int = (1 << 61) - 1):
    """(start, hash) of every unmarked run of ``s`` words, the hash rolled from run to run."""
    top, h, length = pow(base, s - 1, mod), 0, 0
    for i, x in enumerate(ids):
        if used[i]:
            h = length = 0
            continue
        if length == s:
            h = (h - ids[i - s] * top) % mod
            length -= 1
        h = (h * base + x) % mod
        length += 1
        if length == s:
            yield i - s + 1, h


class Item:
    """An item's words with what verification needs of them; slips are mended once for each word met."""

    def __init__(self, words: list[str], weights: list[float], whole: bool, remembered: int = 20_000):
        self.words, self.weights, self.known, self.remembered = words, weights, set(words), remembered
        self.size = len(words) if whole else min(WINDOW, len(words))
        self.least = self.size - allowed(self.size)
        self.ids = {t: k + 1 for k, t in enumerate(dict.fromkeys(words))}
        self.near, self.mended = {}, {}
        for w in self.known:
            if len(w) >= 5:
                self.near[w] = w
                for i in range(len(w)):
                    self.near.setdefault(w[:i] + w[i + 1 :], w)
        self.starts = range(len(words) - self.size + 1)
        self.totals = [sum(weights[s : s + self.size]) for s in self.starts]

    def mend(self, word: str) -> str:
        """The item's word that ``word`` is one slip away from, else the word."""
        if word in self.known:
            return word
        if (found := self.mended.get(word)) is None:
            if len(self.mended) >= self.remembered:
                self.mended.clear()
            found = self.mended[word] = self._nearest(word)
        return found

    def _nearest(self, word: str) -> str:
        if len(word) < 4:
            return word
        if word in self.near:
            return self.near[word]
        for i in range(len(word)):
            if (w := self.near.get(word[:i] + word[i + 1 :])) and abs(len(w) - len(word)) <= 1:
                return w
        return word

    def may_be_in(self, words: set[str], threshold: float) -> bool:
        """Whether any window has enough of its words or weight among ``words``, in whatever order."""
        counts, sums = [0], [0.0]
        for t, w in zip(self.words, self.weights):
            counts.append(counts[-1] + (t in words))
            sums.append(sums[-1] + (w if t in words else 0.0))
        return any(counts[s + self.size] - counts[s] >= self.least or sums[s + self.size] - sums[s] >= threshold * t - 1e-9 for s, t in zip(self.starts, self.totals))


def allowed(n: int) -> int:
    """How many of ``n`` words may be changed or missing: about one in ten, none of very few."""
    return -(-n // 10) if n >= 7 else 0


def allowed_of(n: Column) -> Column:
    """``allowed`` of a column."""
    return F.when(n >= 7, F.ceil(n / 10)).otherwise(0).cast("int")


def align(item: Item, doc: list[str]) -> list[int]:
    """For each word of ``item`` its place in ``doc`` (slips mended) or -1: tiles, then single words left between them."""
    words, ids = item.words, item.ids
    place = tile([ids[t] for t in words], [ids.get(t, 0) or len(ids) + 1 + j for j, t in enumerate(doc)])
    free, x = set(range(len(doc))) - set(place), 0
    while x < len(words):
        y = x
        while y < len(words) and place[y] < 0:
            y += 1
        if x < y and y - x < len(words):
            room = y - x + allowed(WINDOW)
            low = place[x - 1] + 1 if x else max(0, place[y] - room)
            high = place[y] if y < len(words) else min(len(doc), low + room)
            gap = [j for j in range(low, high) if j in free] if high - low <= 2 * room else []
            _fill(words, doc, place, range(x, y), gap)
        x = y + 1
    return place


def _fill(item: list[str], doc: list[str], place: list[int], at: range, gap: list[int]) -> None:
    """Puts words of a gap to the places of their longest common subsequence."""
    best = [[0] * (len(gap) + 1) for _ in range(len(at) + 1)]
    for u in range(len(at) - 1, -1, -1):
        for v in range(len(gap) - 1, -1, -1):
            best[u][v] = best[u + 1][v + 1] + 1 if item[at[u]] == doc[gap[v]] else max(best[u + 1][v], best[u][v + 1])
    u = v = 0
    while u < len(at) and v < len(gap):
        if item[at[u]] == doc[gap[v]]:
            place[at[u]] = gap[v]
            u, v = u + 1, v + 1
        elif best[u + 1][v] >= best[u][v + 1]:
            u += 1
        else:
            v += 1


def renumbered(item: list[str], doc: list[str], place: list[int], start: int, stop: int) -> bool:
    """Whether another number stands where the item has one, between words that match: the mark of a look-alike."""
    at = [x for x in range(max(start, 0), min(stop, len(item))) if place[x] >= 0]
    for x, y in zip(at, at[1:]):
        if 1 < y - x <= 4 and place[y] - place[x] == y - x:
            if any(item[x + k].isdigit() and doc[place[x] + k].isdigit() for k in range(1, y - x)):
                return True
    return False


def holds(item: Item, doc: list[str], threshold: float = 0.87, slack: float = 1.3) -> bool:
    """Whether one stretch of ``doc`` holds the whole item or, of a passage, any WINDOW words of it.

    All words but ``allowed`` must be there, whichever they are; where the missing ones outweigh 1 - ``threshold``,
    other numbers in their places show a look-alike. Text that holds ``threshold`` of the weight counts as well.
    """
    size, doc = item.size, [item.mend(w) for w in doc]
    if not item.may_be_in(set(doc), threshold):
        return False
    place = align(item, doc)
    for s, total in zip(item.starts, item.totals):
        at = sorted((place[x], item.weights[x]) for x in range(s, s + size) if place[x] >= 0)
        r, now = 0, 0.0
        for k, (p, w) in enumerate(at):
            while r < len(at) and at[r][0] < p + size * slack:
                now += at[r][1]
                r += 1
            if now >= threshold * total or (r - k >= item.least and not renumbered(item.words, doc, place, s - 8, s + size + 8)):
                return True
            now -= w
    return False


def _verify(threshold: float, remembered: int = 2000):
    def run(batches):
        known: dict[str, Item] = {}
        for pdf in batches:
            keep = []
            for part, text, weights, stretch, whole in zip(pdf["part"], pdf["item"], pdf["weights"], pdf["stretch"], pdf["whole"]):
                if (item := known.get(part)) is None:
                    if len(known) >= remembered:
                        known.clear()
                    item = known[part] = Item(text.split(" "), list(weights), bool(whole))
                keep.append(holds(item, stretch.split(" "), threshold))
            yield pdf.loc[keep, ["doc_id", "item_id"]]

    return run


def leaks(documents: DataFrame, items: DataFrame, threshold: float = 0.87) -> DataFrame:
    """(doc_id, item_id): documents that hold an item's whole question, or at least 20 consecutive words of its passage.

    About one word in ten may differ, rare or not. Words weigh by their rarity among items; text below ``threshold``
    of the weight that has other numbers in the places of the item's only resembles it. Questions of one or two
    words are looked up whole. Null and empty texts, questions and passages have no rows; repeated rows repeat no
    result; other columns are ignored. Documents of any length are read whole, and verified in stretches.
    """
    scratch = Scratch(documents.sparkSession, "leaks")
    parts = items.select("item_id", F.posexplode(F.array("question", "passage")).alias("kind", "text")).where("text is not null")
    parts = parts.select(F.concat_ws("-", "item_id", "kind").alias("part"), "item_id", (F.col("kind") == 0).alias("whole"), words(F.col("text")).alias("words")).where(F.size("words") > 0)
    parts = parts.withColumn("size", F.when(F.col("whole"), F.size("words")).otherwise(F.least(F.lit(WINDOW), F.size("words")))).withColumn("k", F.least(F.lit(SEED), F.size("words")))
    parts = scratch.keep(parts.distinct(), "parts")
    n_items = F.lit(float(max(parts.select("item_id").distinct().count(), 1)))
    rarity = parts.select("item_id", F.explode(F.array_distinct("words")).alias("word")).distinct().groupBy("word").agg(F.log(1 + n_items / F.count("*")).alias("w"))
    weighed = parts.select("part", F.posexplode("words").alias("at", "word")).join(rarity, "word").groupBy("part").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "w"))), lambda x: x["w"]).alias("weights"))
    parts = scratch.keep(parts.join(weighed, "part"), "weighed")
    sizes = sorted(r["k"] for r in parts.select("k").distinct().collect()) or [SEED]  # three values at most
    seeds = scratch.keep(_rarest(parts), "seeds")
    # seeds first, then their parts: most of a document's words are dropped before anything multiplies
    wanted = scratch.keep(seeds.select("seed").distinct(), "wanted")
    texts = spread(documents.where("text is not null").select("doc_id", "text"))
    met = texts.select("doc_id", F.inline(_seeds(words(F.col("text")), sizes))).join(maybe_broadcast(wanted), "seed", "left_semi")
    met = met.join(maybe_broadcast(seeds), "seed").groupBy("doc_id", "part", "need", "span").agg(F.array_sort(F.collect_set("at")).alias("places"))
    close = lambda k: F.get("places", k + F.col("need") - 1) - F.get("places", k) < F.col("span")
    starts = F.filter(F.sequence(F.lit(0), F.size("places") - F.col("need")), lambda k: close(k))
    met = met.where(F.size("places") >= F.col("need")).select("doc_id", "part", "span", F.explode(F.array_distinct(F.transform(starts, lambda k: F.floor(F.get("places", k) / (4 * F.col("span"))).cast("int")))).alias("nth"))
    pairs = scratch.keep(met.select("doc_id", "part", "span", "nth"), "pairs")
    low = F.greatest(F.lit(1), F.col("nth") * 4 * F.col("span") - F.col("span") - 8)
    stretch = F.array_join(F.slice("words", low, (F.col("nth") + 1) * 4 * F.col("span") + 2 * F.col("span") + 8 - low), " ")
    ours = documents.where("text is not null").select("doc_id", "text").join(maybe_broadcast(pairs.select("doc_id").distinct()), "doc_id", "left_semi")
    ours = scratch.keep(ours.select("doc_id", words(F.col("text")).alias("words")), "words")
    tried = (
        pairs.join(ours, "doc_id")
        .join(maybe_broadcast(parts.select("part", "item_id", "whole", F.array_join("words", " ").alias("item"), "weights")), "part")
        .select("doc_id", "part", "item_id", "whole", "item", "weights", stretch.alias("stretch"))
    )
    return spread(tried).mapInPandas(_verify(threshold), "doc_id long, item_id long").distinct()


def tiles_of(a: str, b: str) -> pd.Series:
    """The places of ``a``'s words in ``b``, for inspection."""
    x, y = a.split(), b.split()
    ids = {w: i + 1 for i, w in enumerate(dict.fromkeys(x + y))}
    return pd.Series(tile([ids[w] for w in x], [ids[w] for w in y]), index=x)
