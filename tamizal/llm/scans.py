"""Problem 3: noise in text from scanned pages.

An averaged perceptron predicts edits: keep, replace, insert or delete characters of a word, or join two lines.
Edits are the confusions a recogniser is known for, and any single replaced, lost or added letter that turns a
rare word of the corpus into a far more usual one. The editor is trained here, on clean words of the corpus that
both kinds of errors have spoiled, and sees the characters around an edit and how usual the word is before and
after it. A second perceptron on page-position features finds running headers, footers and page numbers. Word
statistics cover all different texts and stay in tables; only the bounded training samples come to the driver.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, maybe_broadcast, spread

# What a recogniser reads (left) for what is printed (right).
CONFUSIONS = [
    ("c", "e"), ("0", "o"), ("!", "i"), ("†", "t"), ("5", "s"), ("1", "l"), ("1", "i"), ("u", "v"), ("q", "g"), ("b", "h"), ("f", "t"), ("l", "i"), ("8", "b"),
    ("cl", "d"), ("ii", "u"), ("rn", "m"), ("vv", "w"), ("h", "li"), ("ɵ", "ti"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬀ", "ff"), ("|", "l"), ("$", "s"), ("@", "a"), ("6", "b"), ("9", "g"), ("í", "i"), ("ó", "o"),
]
DIGIT_LIKE = str.maketrans({"l": "1", "I": "1", "O": "0", "o": "0", "|": "1", "S": "5", "s": "5", "B": "8", "!": "1", "i": "1"})
CONJUNCTIONS = {"and", "or", "y", "o", "e", "u", "ni", "nor", "to", "a"}
HYPHENS = "-‐­¬"
PAGE = re.compile(r"^--- .* ---$")
HEAD = re.compile(r"^=== .* ===$")
OUTER = ".,;:()«»“”\"'?¿¡[]"
ROMAN = re.compile(r"^[ivxlc]+$")

#: Characters beyond which a run without blanks is no word to judge.
LONGEST = 1000
#: How much more usual a word must be to stand for one that is a letter off.
FAR_MORE = 20

#: Bounds of the training samples.
TRAIN_WORDS = 6000
#: Letters of the shortest word that a letter may be lost from or added to.
LETTERS = 5
TRAIN_LINES = 20000


class Perceptron:
    """Averaged perceptron over string features, two classes."""

    def __init__(self) -> None:
        self.w: dict[str, float] = defaultdict(float)

    def score(self, features: list[str]) -> float:
        return sum(self.w.get(f, 0.0) for f in features)

    def fit(self, rows: list[tuple[list[str], int]], rounds: int = 6, seed: int = 7) -> "Perceptron":
        total: dict[str, float] = defaultdict(float)
        order, shuffle, t, n = list(range(len(rows))), random.Random(seed), 0, max(len(rows) * rounds, 1)
        for _ in range(rounds):
            shuffle.shuffle(order)
            for k in order:
                features, y = rows[k]
                t += 1
                if (self.score(features) > 0) != bool(y):
                    step = 1.0 if y else -1.0
                    for f in features:
                        self.w[f] += step
                        total[f] += step * (n - t)  # what this step adds to the average
        self.w = {f: v / n for f, v in total.items()}
        return self


def bucket(n: float) -> int:
    """A count on a logarithmic scale."""
    return int(n).bit_length() if n > 0 else 0


def edits(token: str) -> list[tuple[str, int, str]]:
    """(corrected, place, edit): every single correction, the same correction at two places, and the number it may be."""
    out = []
    low = token.lower()
    if not any(ch.isalpha() or ch in "!†|$@" for ch in low):
        return out
    for seen, meant in CONFUSIONS:
        at = [i for i in range(len(low)) if low.startswith(seen, i)]
        for i in at:
            out.append((low[:i] + meant + low[i + len(seen) :], i, f"{seen}>{meant}"))
        if len(at) > 1 and not seen.isalpha():
            out.append((low.replace(seen, meant), at[0], f"{seen}>{meant}"))
    odd = [i for i, ch in enumerate(low) if not ch.isalpha() and ch not in "-'/.,"]
    if len(odd) > 1:  # several odd characters: all corrected
        table = {seen: meant for seen, meant in reversed(CONFUSIONS) if len(seen) == 1 and not seen.isalpha()}
        out.append(("".join(table.get(ch, ch) for ch in low), odd[0], "several"))
    number = token.translate(DIGIT_LIKE)
    if number != token and re.fullmatch(r"\d+(?:[.,/]\d+)*%?", number) and (any(ch.isdigit() for ch in token) or len(token) <= 3):
        out.append((number, next(i for i in range(len(token)) if number[i] != token[i]), "number"))
    return out


def edit_features(token: str, n: float, fixed: str, n_fixed: float, place: int, edit: str) -> list[str]:
    low, a, b = token.lower(), bucket(n), bucket(n_fixed)
    digits = sum(ch.isdigit() for ch in low)
    letters = sum(ch.isalpha() for ch in low)
    odd = any(ch in "!†ɵﬁﬂﬀ|$@" for ch in low)
    left, right = ("^^" + low)[place : place + 2], (low + "$$")[place + len(edit.split(">")[0]) :][:2]
    meant = edit.split(">")[-1]
    seen = edit.split(">")[0]
    mixed = "odd" if odd else "mixed" if digits and letters else "plain"
    caps = "caps" if sum(ch.isupper() for ch in token) > 1 or token[:1].isupper() and digits else "low"
    return [
        "bias", f"e={edit}", f"n={a}", f"f={b}", f"nf={a},{b}", f"d={max(-6, min(6, b - a))}", f"m={mixed}", f"m={mixed},{caps}", f"me={mixed},{edit}", f"mf={mixed},{min(b, 3)}", f"mn={mixed},{a}",
        f"l={left},{seen}", f"r={seen},{right}", f"l2={left[1:]},{seen},{right[:1]}", f"L={left},{meant}", f"R={meant},{right}", f"L2={left[1:]},{meant},{right[:1]}", f"len={min(len(low), 6)}", f"ef={edit},{min(b, 3)}",
    ]


def train_editor(words: list[tuple[str, int]], rare: list[tuple[str, int, str, int, int, str]] = (), seed: int = 11) -> Perceptron:
    """The editor from trusted words (word, n): spoiled copies are to be corrected, the words themselves kept.

    ``rare``: edits of rare words with their counts (word, n, corrected, n_corrected, place, edit). A rare word
    with an edit to a far more usual word is taken for spoiled, one without any such edit for right.
    """
    rnd, counts, rows = random.Random(seed), dict(words), []
    of = defaultdict(list)
    for word, n, fixed, n_fixed, place, edit in rare:
        of[word].append((n_fixed, n, fixed, place, edit))
    for word, found in of.items():
        best = max(found)
        spoiled = best[0] >= 20 * best[1]
        if spoiled or (best[0] <= 1 and word.isalpha() and not any(ch in "ɵﬁﬂﬀ" for ch in word.lower())):
            rows += [(edit_features(word, n, fixed, n_fixed, place, edit), int(spoiled and fixed == best[2])) for n_fixed, n, fixed, place, edit in found]
    for word, n in words:
        for fixed, place, edit in edits(word):
            rows.append((edit_features(word, n, fixed, counts.get(fixed, 0), place, edit), 0))
        low = word.lower()
        spoiled = []
        for seen, meant in CONFUSIONS:
            spoiled += [(low[:i] + seen + low[i + len(meant) :]) for i in range(len(low)) if low.startswith(meant, i)]
        if word.isdigit():
            spoiled += [word.replace("1", "l", 1), word.replace("0", "O", 1)]
        for bad in rnd.sample(spoiled, min(len(spoiled), 4)):
            if bad == low or bad in counts:
                continue
            mine = 1 if n < 20 else rnd.choice((1, 1, 2, 3, max(1, n // 60)))
            rest = max(n - 1, 0) if rnd.random() < 0.75 else 0  # some words occur spoiled only
            for fixed, place, edit in edits(bad):
                rows.append((edit_features(bad, mine, fixed, rest if fixed == low else counts.get(fixed, 0), place, edit), int(fixed == low)))
        if word.isalpha() and len(word) > LETTERS and n >= FAR_MORE:
            i, other = rnd.randrange(1, len(low) - 2), rnd.choice("abcdefghijlmnopqrstuvz")
            for bad, edit in ((low[:i] + low[i + 1 :], f">{low[i]}"), (low[:i] + other + low[i:], f"{other}>"), (low[:i] + other + low[i + 1 :], f"{other}>{low[i]}")):
                if bad not in counts:
                    rows.append((edit_features(bad, 1, low, n - 1, i, edit), 1))
    return Perceptron().fit(rows)


def join_features(kind: str, left: str, right: str, n_left: float, n_right: float, n_whole: float) -> list[str]:
    a, b, c = bucket(n_left), bucket(n_right), bucket(n_whole)
    conj, lower = right.lower().strip(OUTER) in CONJUNCTIONS, right[:1].islower() or right[:1].isdigit()
    return ["bias", f"k={kind}", f"k={kind},{conj}", f"k={kind},{lower}", f"kc={kind},{min(c, 4)}", f"kab={kind},{min(a, 4)},{min(b, 4)}", f"kabc={kind},{min(a, 3)},{min(b, 3)},{min(c, 3)}", f"kd={kind},{max(-4, min(4, c - min(a, b)))}"]


def train_joiner(words: list[tuple[str, int]], seed: int = 5) -> Perceptron:
    """When a line end joins the next line: split words, against neighbouring words that stay apart."""
    rnd, counts, rows = random.Random(seed), dict(words), []
    usual = [w for w, n in words if w.isalpha()]
    for word, n in words:
        if not word.isalpha() or len(word) < 4:
            continue
        k = rnd.randint(2, len(word) - 2)
        left, right = word[:k], word[k:]
        few = lambda x: counts.get(x, 0) + rnd.choice((0, 1, 2))
        rows.append((join_features("hyphen", left, right, few(left), few(right), n if rnd.random() < 0.8 else 0), 1))
        rows.append((join_features("none", left, right, few(left), few(right), n), int(n > 3)))
        rows.append((join_features("mark", left, right, few(left), few(right), n), 1))
        other = rnd.choice(usual)
        rows.append((join_features("none", word, other, n, counts[other], counts.get(word + other, 0)), 0))
        conj = rnd.choice(("and", "y", "o", "or"))
        rows.append((join_features("hyphen", word, conj, n, 500, counts.get(word + conj, 0)), 0))
        rows.append((join_features("hyphen", word, other, n, counts[other], 0), 1))  # compounds
    return Perceptron().fit(rows)


def numeric(token: str) -> bool:
    t = token.translate(DIGIT_LIKE)
    return bool(re.fullmatch(r"\d+", t)) or bool(ROMAN.match(token.lower()) and len(token) <= 5)


ROBUST = str.maketrans({"0": "o", "1": "i", "l": "i", "!": "i", "|": "i", "5": "s", "8": "b", "h": "b", "e": "c", "q": "g", "v": "u", "f": "t", "†": "t"})


def skeleton(line: str, known: dict[str, str]) -> str:
    """A line with numbers masked and characters that are often confused made one; ``known`` remembers words."""
    parts = []
    for raw in PIECES.findall(line):
        if (t := known.get(raw)) is None:
            if len(known) >= 100_000:
                known.clear()
            if numeric(raw):
                t = "#"
            else:
                t = raw.lower().replace("rn", "m").replace("cl", "d").replace("vv", "w").replace("ii", "u").replace("li", "h").replace("ﬁ", "fi").replace("ɵ", "ti").translate(ROBUST)
            known[raw] = t
        parts.append(t)
    return " ".join(parts)


PIECES = re.compile(r"[^\s/|.\-]+|[/|.\-]")
LINES = "text_id long, first boolean, line_no int, line string, page int, top int, bottom int, recur int, pages int, skel long"


def edge_depths(pages: dict[int, list[int]], skel: list[int], place: dict[int, tuple[int, int]], side: int) -> None:
    """Lines behind repeated furniture count as outer ones: from the third line of a page on, each that most of three or more pages repeat at its place, as long as the line outside it is repeated too."""
    most = max(3, len(pages) // 2 + 1)
    depth, going = 2, {p: ids for p, ids in pages.items() if len(ids) > 2}
    at = lambda ids, k: ids[k] if side == 0 else ids[-1 - k]
    seen = lambda k: Counter(skel[at(ids, k)] for ids in pages.values() if len(ids) > k)
    outer = seen(1)
    going = {p: ids for p, ids in going.items() if outer[skel[at(ids, 1)]] >= most}
    while going:
        here = seen(depth)
        going = {p: ids for p, ids in going.items() if len(ids) > depth and here[skel[at(ids, depth)]] >= most}
        for ids in going.values():
            i = at(ids, depth)
            place[i] = (1, place[i][1]) if side == 0 else (place[i][0], 1)
        depth += 1


def page_lines(batches):
    """Non-blank lines of each text with their places on the page and how many other pages repeat them at an edge."""
    known: dict[str, str] = {}
    for pdf in batches:
        out = []
        for text_id, text, first in zip(pdf["text_id"], pdf["text"], pdf["first"]):
            pages, page, where = defaultdict(list), 0, []
            for no, line in enumerate(text.split("\n"), 1):
                if PAGE.match(line):
                    page += 1
                elif line.strip() and not HEAD.match(line):
                    pages[page].append(len(where))
                    where.append((no, line, page))
            skel = [int.from_bytes(hashlib.blake2b(skeleton(x[1], known).encode(), digest_size=8).digest(), "big", signed=True) for x in where]
            place, edge = {}, defaultdict(set)
            for ids in pages.values():
                for k, i in enumerate(ids):
                    place[i] = (k, len(ids) - 1 - k)
            if len(pages) > 2:
                edge_depths(pages, skel, place, 0)
                edge_depths(pages, skel, place, 1)
            for p, ids in pages.items():
                for i in ids:
                    if min(place[i]) < 2:
                        edge[skel[i]].add(p)
            for i, (no, line, p) in enumerate(where):
                out.append((text_id, first, no, line, p, *place[i], len(edge[skel[i]] - {p}), len(pages), skel[i]))
        yield pd.DataFrame(out, columns=["text_id", "first", "line_no", "line", "page", "top", "bottom", "recur", "pages", "skel"])


def furniture_features(line: str, top: int, bottom: int, recur: int, pages: int, n_edge: float, n_all: float, with_recur: bool) -> list[str]:
    s = line.strip()
    where = f"t{top}" if top < 2 and top <= bottom else f"b{bottom}" if bottom < 2 else "mid"
    words = len(s.split())
    share = int(10 * n_edge / max(n_all, 1))
    f = ["bias", where, f"w={min(words, 8)}", f"dot={s[-1:] in '.,;'}", f"low={s[:1].islower()}", f"num={numeric(s)}", f"share={share},{min(bucket(n_all), 4)}", f"sharew={share > 8},{where}", f"mark={bool(re.search('[|/]', s))}", f"dotw={s[-1:] in '.,;'},{where}", f"len={min(len(s) // 12, 5)},{where}"]
    return [*f, f"recur={min(recur, 3)},{where}", f"rp={min(recur, 2)},{min(pages, 3)}"] if with_recur else f


def find_furniture(scratch: Scratch, lines: DataFrame) -> DataFrame:
    """``lines`` with a column ``furniture``."""
    shapes = lines.groupBy("skel").agg(F.count_if(F.least("top", "bottom") < 2).alias("n_edge"), F.count("*").alias("n_all"))
    shapes = maybe_broadcast(scratch.keep(shapes, "shapes"))
    near = (F.least("top", "bottom") < 2) & (F.col("recur") >= 1)
    far = F.least("top", "bottom") >= 2
    sample = lambda c: lines.where(c).orderBy(F.xxhash64("text_id", "line_no")).limit(TRAIN_LINES // 2).join(shapes, "skel").orderBy(F.xxhash64("text_id", "line_no")).select("line", "top", "bottom", "recur", "pages", "n_edge", "n_all").collect()
    labelled = [(r, 1) for r in sample(near)] + [(r, 0) for r in sample(far)]
    rnd = random.Random(3)
    # now and then the repetition is hidden, so that furniture of single pages is known by what the corpus says of it
    alone = lambda r: (0, 1) if rnd.random() < 0.4 else (r[3], r[4])
    rows = [(furniture_features(*r[:3], *alone(r), *r[5:], with_recur=rnd.random() < 0.8), y) for r, y in labelled]
    # lines from the middle of a page, put at its edge, teach what body text there looks like: whole lines, and short
    # last lines of paragraphs, which are as often alone as repeated
    for r, y in labelled:
        if not y:
            at, n = rnd.choice(((0, 9), (1, 9), (9, 0), (9, 1))), rnd.choice((1, 1, 2, 4, 9))
            rows.append((furniture_features(r[0], *at, 0, r[4], r[6], r[6], with_recur=True), 0))
            tail = " ".join(r[0].split()[-rnd.randint(1, 6) :]).rstrip(".,;-‐­¬") + "."
            rows.append((furniture_features(tail, *at, int(rnd.random() < 0.1), r[4], rnd.randint(1, n), n, with_recur=True), 0))
            # and a line like furniture that stays alone in a text of several pages is none
            rows.append((furniture_features(" ".join(r[0].split()[:3]), *at, 0, max(r[4], 2), n * 9, n * 9, with_recur=True), 0))
    weights = dict(Perceptron().fit(rows).w)

    def judge(batches):
        model = Perceptron()
        model.w = weights
        for pdf in batches:
            score = [
                min(t, b) < 2 and model.score(furniture_features(x, t, b, r, p, e, n, with_recur=True)) > 0
                for x, t, b, r, p, e, n in zip(pdf["line"], pdf["top"], pdf["bottom"], pdf["recur"], pdf["pages"], pdf["n_edge"], pdf["n_all"])
            ]
            yield pdf[["text_id", "first", "line_no", "line", "page"]].assign(furniture=score)

    return scratch.keep(lines.join(shapes, "skel").mapInPandas(judge, "text_id long, first boolean, line_no int, line string, page int, furniture boolean"), "judged")


def trusted_words(lexicon: DataFrame, least: int = 4) -> list[tuple[str, int]]:
    """A bounded sample of words of letters or digits that occur at least ``least`` times, in order of a hash; the usual ones first."""
    fine = lexicon.where((F.col("n") >= least) & F.col("token").rlike(r"^(?:\p{L}+|\d{1,3})$") & ~F.col("token").rlike("[ﬁﬂƟ]"))
    usual = fine.orderBy(F.desc("n"), "token").limit(TRAIN_WORDS // 3).collect()
    rare = fine.orderBy(F.xxhash64("token")).limit(TRAIN_WORDS * 2 // 3).collect()
    words = {r["token"]: r["n"] for r in [*usual, *rare]}
    # a word much rarer than a word it may be a misreading of is no example
    return sorted((w, n) for w, n in words.items() if not any(words.get(f, 0) > 8 * n for f, _, _ in edits(w)))


def letters_off(counts: DataFrame, proposed: DataFrame) -> DataFrame:
    """(typed, n, fixed, n_fixed, place, edit): rare words of letters, and the far more usual words a replaced, lost or added letter away.

    Words meet through their forms with one letter left out. First and last letters, which inflection changes,
    stay; words that a known confusion explains are left to it.
    """
    words = counts.where(F.rlike("token", F.lit(rf"^\p{{L}}{{{LETTERS},60}}$")))
    cut = F.transform(F.sequence(F.lit(2), F.length("token") - 2), lambda i: F.struct(i.alias("at"), F.concat(F.substring("token", F.lit(1), i - 1), F.substring("token", i + 1, F.length("token"))).alias("form")))
    forms = words.select("token", "n", F.inline(F.concat(F.array(F.struct(F.lit(0).alias("at"), F.col("token").alias("form"))), cut)))
    settled = proposed.where(F.col("n") * FAR_MORE <= F.col("n_fixed")).select(F.lower("typed").alias("token")).distinct()
    rare = forms.where("n <= 3").join(settled, "token", "left_anti").alias("a")
    usual = forms.where(F.col("n") >= FAR_MORE).select(F.col("token").alias("fixed"), F.col("n").alias("n_fixed"), F.col("at").alias("gap"), "form").alias("b")
    met = rare.join(usual, "form").where((F.col("n") * FAR_MORE <= F.col("n_fixed")) & ((F.col("at") == 0) != (F.col("gap") == 0)) | ((F.col("at") == F.col("gap")) & (F.col("at") > 0) & (F.col("n") * FAR_MORE <= F.col("n_fixed"))))
    seen = F.when(F.col("at") > 0, F.substring("token", F.col("at"), F.lit(1))).otherwise("")
    meant = F.when(F.col("gap") > 0, F.substring("fixed", F.col("gap"), F.lit(1))).otherwise("")
    return met.select(F.col("token").alias("typed"), "n", "fixed", "n_fixed", (F.greatest("at", "gap") - 1).cast("int").alias("place"), F.concat(seen, F.lit(">"), meant).alias("edit"))


def bare(c):
    """A word without outer marks."""
    return F.btrim(c, F.lit(OUTER))


def judge_texts(texts: DataFrame) -> tuple[Scratch, DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    """The kept tables of one run: lines with ``furniture``, body lines in words, line ends to join, words to judge and verdicts on them."""
    scratch = Scratch(texts.sparkSession, "scans")
    texts = texts.where("text is not null").select(F.col("text_id").cast("long").alias("text_id"), "text")
    # of equal texts only the first counts for what is usual, so that a copied misreading stays rare
    firsts = scratch.keep(texts.groupBy(F.xxhash64("text").alias("h"), F.length("text").alias("n")).agg(F.min("text_id").alias("text_id")).select("text_id").distinct(), "firsts")
    marked = texts.join(maybe_broadcast(firsts.withColumn("first", F.lit(True))), "text_id", "left").na.fill(False, ["first"])
    lines = scratch.keep(spread(marked).mapInPandas(page_lines, LINES), "lines")
    judged = find_furniture(scratch, lines)
    body = judged.where("not furniture")
    order = Window.partitionBy("text_id").orderBy("line_no")
    body = body.select("text_id", "first", "line_no", F.split(F.trim(F.regexp_replace("line", r"[\s\p{Z}]+", " ")), " ").alias("words"))
    body = body.withColumn("next", F.lead(F.col("words")[0]).over(order)).withColumn("next_no", F.lead("line_no").over(order))
    body = scratch.keep(body, "body")
    tokens = body.where("first").select(F.explode("words").alias("w")).select(bare(F.col("w")).alias("typed")).where("typed <> ''")
    lexicon = scratch.keep(tokens.groupBy(F.lower("typed").alias("token")).agg(F.count("*").alias("n")), "lexicon")
    words = trusted_words(lexicon)
    joiner = dict(train_joiner(words).w)

    # line ends: the last word with the first of the next body line, and how usual they are apart and together
    ends = body.where("next is not null").select("text_id", F.col("first").alias("counts"), "line_no", "next_no", F.element_at("words", -1).alias("last"), F.col("next").alias("first"))
    ends = ends.withColumn("kind", F.when(F.col("last").rlike(r"\p{L}[‐­¬]$"), "mark").when(F.col("last").rlike(r"[\p{L}\p{N}]-$"), "hyphen").when(F.col("last").rlike(r"\p{L}$") & F.col("first").rlike(r"^\p{Ll}"), "none")).where("kind is not null")
    ends = ends.withColumn("left", F.lower(bare(F.regexp_replace("last", "[-‐­¬]$", "")))).withColumn("right", F.lower(bare(F.col("first")))).withColumn("whole", F.concat("left", "right"))
    count_of = lambda name: lexicon.select(F.col("token").alias(name), F.col("n").alias(f"n_{name}"))
    whole = ends.join(count_of("whole"), "whole", "left").where("kind <> 'none' or n_whole is not null")
    met = whole.join(count_of("left"), "left", "left").join(count_of("right"), "right", "left").na.fill(0, ["n_whole", "n_left", "n_right"])

    def join_lines(batches):
        model = Perceptron()
        model.w = joiner
        for pdf in batches:
            cols = zip(pdf["kind"], pdf["left"], pdf["first"], pdf["n_left"], pdf["n_right"], pdf["n_whole"])
            keep = [model.score(join_features(*x)) > 0 for x in cols]
            pdf["compound"] = (pdf["kind"] == "hyphen") & (pdf["n_whole"] == 0) & (pdf["n_left"] > 0) & (pdf["n_right"] > 0)
            yield pdf.loc[keep, ["text_id", "counts", "line_no", "next_no", "left", "right", "compound"]]

    broken = scratch.keep(met.select("text_id", "counts", "line_no", "next_no", "kind", "left", "first", "right", "n_left", "n_right", "n_whole").mapInPandas(join_lines, "text_id long, counts boolean, line_no int, next_no int, left string, right string, compound boolean"), "broken")

    # words to judge: inner words as they are, words across line ends joined
    inner = body.join(broken.select("text_id", "line_no", F.lit(1).alias("cut")), ["text_id", "line_no"], "left").join(broken.select("text_id", F.col("next_no").alias("line_no"), F.lit(1).alias("goes_on")), ["text_id", "line_no"], "left")
    first = F.when(F.col("goes_on").isNull(), 1).otherwise(2)
    kept = F.slice("words", first, F.greatest(F.size("words") - first + 1 - F.when(F.col("cut").isNull(), 0).otherwise(1), F.lit(0)))
    inner = inner.select("text_id", F.col("first").alias("counts"), "line_no", F.explode(kept).alias("w")).select("text_id", "counts", "line_no", F.lit(None).cast("int").alias("next_no"), F.lit(None).cast("int").alias("border"), bare(F.col("w")).alias("typed"))
    across = broken.select("text_id", "counts", "line_no", "next_no", F.length("left").alias("border"), F.concat("left", "right").alias("typed"))
    typed = scratch.keep(inner.unionByName(across).where("typed <> ''"), "typed")
    usual = scratch.keep(typed.groupBy("typed").agg(F.count_if("counts").alias("m")), "usual")
    counts = scratch.keep(usual.groupBy(F.lower("typed").alias("token")).agg(F.sum("m").alias("n")), "counts")

    def propose(batches):
        for pdf in batches:
            rows = [(t, n, f, p, e) for t, n in zip(pdf["typed"], pdf["n"]) if len(t) <= LONGEST for f, p, e in edits(t)]
            yield pd.DataFrame(rows, columns=["typed", "n", "fixed", "place", "edit"])

    asked = usual.withColumn("token", F.lower("typed")).join(counts, "token").select("typed", "n")
    proposals = asked.mapInPandas(propose, "typed string, n long, fixed string, place int, edit string")
    proposals = proposals.join(counts.select(F.col("token").alias("fixed"), F.col("n").alias("n_fixed")), "fixed", "left").na.fill(0, ["n_fixed"])
    # a misreading is rarer than what it misreads; characters that no word has tell by themselves
    odd = F.rlike("typed", F.lit(r"[†ɵﬁﬂﬀ]|\p{L}[!|$@]\p{L}"))
    proposals = proposals.where((F.col("n") <= 3) | (F.col("n") * 5 <= F.col("n_fixed")) | odd)
    proposals = scratch.keep(proposals.select("typed", "n", "fixed", "n_fixed", "place", "edit"), "proposals")
    proposals = scratch.keep(proposals.unionByName(letters_off(counts, proposals)), "edits")
    known = F.col("edit").isin(*[f"{a}>{b}" for a, b in CONFUSIONS], "several", "number")
    rare = proposals.where((F.col("n") <= 3) & known).select("typed").distinct().orderBy(F.xxhash64("typed")).limit(TRAIN_WORDS // 2)
    editor = dict(train_editor(words, [tuple(r) for r in proposals.where(known).join(rare, "typed").select("typed", "n", "fixed", "n_fixed", "place", "edit").collect()]).w)

    def judge(batches):
        model = Perceptron()
        model.w = editor
        for pdf in batches:
            cols = zip(pdf["typed"], pdf["n"], pdf["fixed"], pdf["n_fixed"], pdf["place"], pdf["edit"])
            yield pdf[["typed", "place", "fixed"]].assign(score=[model.score(edit_features(*x)) for x in cols])

    scored = proposals.mapInPandas(judge, "typed string, place int, fixed string, score double")
    verdicts = scored.groupBy("typed").agg(F.max(F.struct("score", "place", "fixed")).alias("x")).where("x.score > 0").select("typed", F.col("x.place").alias("place"), F.col("x.fixed").alias("fixed"))
    return scratch, judged, body, broken, typed, scratch.keep(verdicts, "verdicts")


def flaws(texts: DataFrame) -> DataFrame:
    """(text_id, line_no, flaw): furniture, broken and misread lines of extracted texts.

    Lines are counted from 1 over ``text`` split at line feeds; file and page marks and blank lines are never
    flawed. Null and empty texts have no rows, repeated rows repeat no result, other columns are ignored. Texts
    of any length are read whole, one text at a time; words are judged once over the corpus.
    """
    _, judged, _, broken, typed, verdicts = judge_texts(texts)
    wrong = typed.join(maybe_broadcast(verdicts.select("typed", "place")), "typed").select("text_id", F.when(F.col("place") >= F.col("border"), F.col("next_no")).otherwise(F.col("line_no")).alias("line_no"))
    found = (
        judged.where("furniture").select("text_id", "line_no", F.lit("furniture").alias("flaw"))
        .unionByName(broken.select("text_id", "line_no", F.lit("broken").alias("flaw")))
        .unionByName(wrong.select("text_id", "line_no", F.lit("misread").alias("flaw")))
    )
    return found.distinct()


def as_typed(typed: str, fixed: str) -> str:
    """The correction in the case of the word."""
    letters = [ch for ch in typed if ch.isalpha()]
    if len(letters) > 1 and all(ch.isupper() for ch in letters):
        return fixed.upper()
    return fixed[:1].upper() + fixed[1:] if typed[:1].isupper() else fixed


def corrected(word: str, typed: str, fixed: str) -> str:
    """The word as it stands, with its inner part ``typed`` corrected and outer marks kept."""
    at = word.lower().find(typed.lower())
    return word if at < 0 else word[:at] + as_typed(word[at : at + len(typed)], fixed) + word[at + len(typed) :]


def paragraphs(lines) -> str:
    """Body lines of one text (line_no, page, furniture, words, whole, fixed, border, compound) as paragraphs with a blank line between.

    A blank line ends a paragraph; a new page ends it only after a full sentence, a cut word never.
    """
    done, now, cut, gap, before, page = [], [], None, False, None, None
    for x in lines:
        gap = gap or (before is not None and x["page"] == before["page"] and x["line_no"] > before["line_no"] + 1)
        before = x
        if x["furniture"]:
            continue
        words = list(x["words"])
        ended = bool(now) and now[-1].rstrip("»”\"')")[-1:] in (".", "!", "?", ":")
        if cut is not None:
            last = re.sub(f"[{HYPHENS}]$", "", now.pop())
            whole, border = last + words.pop(0), len(last)
            if cut["fixed"] is not None:
                mended = corrected(whole, cut["whole"], cut["fixed"])
                border += len(mended) - len(whole) if (cut["place"] or 0) < cut["border"] else 0
                whole = mended
            words.insert(0, whole[:border] + "-" + whole[border:] if cut["compound"] else whole)
        elif now and (gap and x["page"] == page or ended and x["page"] != page):
            done.append(" ".join(now))
            now = []
        now += words
        cut, gap, page = (x if x["whole"] is not None else None), False, x["page"]
    return "\n\n".join([*done, " ".join(now)] if now else done)


def repaired(texts: DataFrame) -> DataFrame:
    """(text_id, text): the texts as continuous paragraphs, without running headers, footers, page numbers and page marks.

    Cut words are joined across lines and pages, misread words replaced by the correction judged best. Null texts
    have no rows, a text without body is empty. Finds the same flaws as ``flaws``.
    """
    scratch, judged, body, broken, _, verdicts = judge_texts(texts)
    # the first word of a line goes with the line before if that one is cut, its last with the next; both are judged joined
    cut = broken.select("text_id", "line_no", F.lit(True).alias("cut"))
    goes_on = broken.select("text_id", F.col("next_no").alias("line_no"), F.lit(True).alias("goes_on"))
    words = body.join(cut, ["text_id", "line_no"], "left").join(goes_on, ["text_id", "line_no"], "left")
    words = words.select("text_id", "line_no", F.size("words").alias("n"), "cut", "goes_on", F.posexplode("words").alias("at", "word"))
    edge = (F.col("goes_on").isNotNull() & (F.col("at") == 0)) | (F.col("cut").isNotNull() & (F.col("at") == F.col("n") - 1))
    words = words.where(~edge).select("text_id", "line_no", "at", bare(F.col("word")).alias("typed"))
    met = words.join(maybe_broadcast(verdicts.select("typed", "fixed")), "typed").groupBy("text_id", "line_no").agg(F.collect_list(F.struct("at", "typed", "fixed")).alias("mends"))
    joins = broken.select("text_id", "line_no", F.concat("left", "right").alias("whole"), F.length("left").alias("border"), "compound")
    joins = joins.join(maybe_broadcast(verdicts.withColumnRenamed("typed", "whole")), "whole", "left")
    lines = judged.select("text_id", "line_no", "page", "furniture").join(body.select("text_id", "line_no", F.array_join("words", " ").alias("words")), ["text_id", "line_no"], "left")
    lines = lines.join(met, ["text_id", "line_no"], "left").join(joins, ["text_id", "line_no"], "left")
    whole = lines.groupBy("text_id").agg(F.array_sort(F.collect_list(F.struct("line_no", "page", "furniture", "words", "mends", "whole", "border", "compound", "place", "fixed"))).alias("lines"))

    def assemble(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 16):  # few texts at a time are Python objects
                some, out = batch.slice(k, 16), []
                for lines_ in some.column("lines").to_pylist():
                    rows = []
                    for x in lines_:
                        inner = (x["words"] or "").split(" ")
                        for m in x["mends"] if x["mends"] is not None else ():
                            inner[m["at"]] = corrected(inner[m["at"]], m["typed"], m["fixed"])
                        rows.append({**x, "words": inner})
                    out.append(paragraphs(rows))
                yield pa.RecordBatch.from_arrays([some.column("text_id"), pa.array(out, pa.string())], names=["text_id", "text"])

    read = whole.mapInArrow(assemble, "text_id long, text string")
    every = texts.where("text is not null").select(F.col("text_id").cast("long").alias("text_id")).distinct()
    return every.join(read, "text_id", "left").na.fill("", ["text"])


__all__ = ["Perceptron", "edits", "flaws", "repaired", "train_editor", "train_joiner"]
