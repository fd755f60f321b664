"""Lexical and vector retrieval for batches of questions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tamizal.functions.text import tokens
from tamizal.session import Scratch, small, spread

# Words that carry no meaning in questions.
STOPWORDS = "de la el los las y o a en del al un una con por para que se es su sus lo como sobre sin entre desde hasta".split()


def content_tokens(text: Column) -> Column:
    """Tokens of a text without stopwords; repeats stay."""
    return F.filter(tokens(text), lambda t: ~t.isin(*STOPWORDS))


def corpus_stats(chunks: DataFrame, text: str = "text") -> DataFrame:
    """One row: number of chunks and average length in tokens."""
    return chunks.agg(F.count("*").alias("n"), F.avg(F.size(content_tokens(F.coalesce(F.col(text), F.lit(""))))).alias("avg_len"))


def document_frequency(chunks: DataFrame, text: str = "text") -> DataFrame:
    """(token, df): in how many chunks each token occurs."""
    return chunks.select(F.explode(F.array_distinct(content_tokens(F.col(text)))).alias("token")).groupBy("token").agg(F.count("*").alias("df"))


def vocabulary(chunks: DataFrame) -> DataFrame:
    """(token, df, total): in how many chunks each token occurs; the row '' has the number of chunks and their tokens in all. One pass."""
    t = chunks.select(content_tokens(F.coalesce("text", F.lit(""))).alias("t"))
    return t.select(F.size("t").alias("len"), F.explode(F.concat(F.array(F.lit("")), F.array_distinct("t"))).alias("token")).groupBy("token").agg(F.count("*").alias("df"), F.sum("len").alias("total"))


def bm25(chunks: DataFrame, questions: DataFrame, top: int = 80, k1: float = 1.5, b: float = 0.75, floor: float = 0.25) -> DataFrame:
    """(query_id, doc_id, bm25, bm25_rank): the best ``top`` chunks of each question.

    chunks: doc_id, text; questions: query_id, text. idf = ln(N - df + 0.5) - ln(df + 0.5); where it is negative,
    ``floor`` times the mean idf of all tokens. One pass counts the vocabulary, a second builds the postings of
    asked words only; term frequencies are counted before anything is joined further.
    """
    scratch = Scratch(chunks.sparkSession, "bm25")
    asked = scratch.keep(questions.select("query_id", F.explode(F.array_distinct(content_tokens(F.col("text")))).alias("token")), "asked")
    words = scratch.keep(vocabulary(spread(chunks.select("text"))), "words")
    size = words.where("token = ''").first()  # one row
    n, avg_len = (size["df"], max(size["total"] / size["df"], 1e-9)) if size else (0, 1.0)
    raw = F.log(F.lit(float(n)) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
    mean = words.where("token <> ''").agg(F.avg(raw)).first()[0] or 0.0
    weights = scratch.keep(words.join(small(asked.select("token").distinct()), "token", "left_semi").select("token", F.when(raw < 0, floor * mean).otherwise(raw).alias("idf")), "weights")
    sized = spread(chunks.select("doc_id", "text")).select("doc_id", content_tokens(F.coalesce("text", F.lit(""))).alias("tokens"))
    postings = sized.select("doc_id", F.size("tokens").alias("len"), F.explode("tokens").alias("token")).join(small(weights), "token")
    postings = postings.groupBy("doc_id", "len", "token", "idf").agg(F.count("*").alias("tf"))
    part = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / avg_len))
    scores = postings.select("doc_id", "token", part.alias("part")).join(small(asked), "token")
    scores = scores.groupBy("query_id", "doc_id").agg(F.round(F.sum("part"), 6).alias("bm25"))
    w = Window.partitionBy("query_id").orderBy(F.desc("bm25"), "doc_id")
    return scores.withColumn("bm25_rank", F.row_number().over(w)).where(F.col("bm25_rank") <= top)


def _usable(vectors: DataFrame) -> DataFrame:
    return vectors.where("v is not null and size(v) > 0").select("id", F.col("v").cast("array<double>").alias("v"))


def _packed(vectors: DataFrame, keys: list[str], size: int, ids: str, values: str) -> DataFrame:
    """Vectors packed into blocks of about ``size`` rows: (keys, ids, values). With keys, the blocks of a key grow in number with its rows."""
    if keys:
        counted = vectors.groupBy(*keys).agg(F.count("*").alias("n"))
        vectors = vectors.join(counted, keys).withColumn("b", F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / size)))
    else:
        vectors = vectors.withColumn("b", F.pmod(F.xxhash64("id"), F.lit(max(1, -(-vectors.count() // size)))))
    return vectors.groupBy(*keys, "b").agg(F.collect_list("id").alias(ids), F.flatten(F.collect_list("v")).alias(values)).drop("b")


def _rows_packed(vectors: DataFrame, size: int) -> DataFrame:
    """(v_ids, x): rows packed as they come, without a shuffle."""

    def pack(batches):
        for pdf in batches:
            for k in range(0, len(pdf), size):
                some = pdf.iloc[k : k + size]
                yield pd.DataFrame({"v_ids": [some["id"].to_numpy()], "x": [np.concatenate(some["v"].to_numpy())]})

    return vectors.mapInPandas(pack, "v_ids array<long>, x array<double>")


def _best(pairs: DataFrame, top: int) -> DataFrame:
    """(query_id, doc_id, cosine, cosine_rank) of pairs of blocks (q_ids, q, v_ids, x): one matrix product a pair, of which only the best leave the task."""

    def product(batches):
        for pdf in batches:
            for q_ids, q, v_ids, x in zip(pdf["q_ids"], pdf["q"], pdf["v_ids"], pdf["x"]):
                a = np.asarray(q, dtype=np.float64).reshape(len(q_ids), -1)
                b = np.asarray(x, dtype=np.float64).reshape(len(v_ids), -1)
                norm = np.linalg.norm(a, axis=1)[:, None] * np.linalg.norm(b, axis=1)[None, :]
                sim = np.round(np.divide(a @ b.T, norm, out=np.zeros_like(norm), where=norm > 0), 9)
                ids = np.asarray(v_ids)
                k = min(top, sim.shape[1])
                order = np.lexsort((np.broadcast_to(ids, sim.shape), -sim), axis=1)[:, :k]
                yield pd.DataFrame({"query_id": np.repeat(np.asarray(q_ids), k), "doc_id": ids[order].ravel(), "cosine": np.take_along_axis(sim, order, 1).ravel()})

    found = pairs.select("q_ids", "q", "v_ids", "x").mapInPandas(product, "query_id long, doc_id long, cosine double")
    w = Window.partitionBy("query_id").orderBy(F.desc("cosine"), "doc_id")
    return found.withColumn("cosine_rank", F.row_number().over(w)).where(F.col("cosine_rank") <= top)


def cosine_top(vectors: DataFrame, queries: DataFrame, top: int = 20, block: int = 2048) -> DataFrame:
    """(query_id, doc_id, cosine, cosine_rank): exact nearest vectors of each query.

    vectors: id, v (array of numbers); queries: id, v. Vectors stream once, packed as they come, against bounded
    blocks of queries; the cosine has nine digits, so that ties are the same wherever it is computed.
    """
    scratch = Scratch(vectors.sparkSession, "cosine")
    left = scratch.keep(_packed(_usable(queries), [], 256, "q_ids", "q"), "queries")
    return _best(_rows_packed(_usable(vectors), block).crossJoin(small(left)), top)  # blocks against blocks, the stated form of a search over all rows


class CellIndex:
    """Vectors in cells of nearest centroids (an inverted file): kept table (id, v, cell) and the centroids.

    Centroids are fitted on a bounded sample of ``sample`` rows; every vector is indexed. Their number is the
    square root of that of the vectors, ``most`` at most.
    """

    def __init__(self, vectors: DataFrame, sample: int = 100_000, most: int = 4096, seed: int = 7):
        from pyspark.ml.clustering import KMeans
        from pyspark.ml.functions import array_to_vector

        self.scratch = Scratch(vectors.sparkSession, "cells")
        rows = _usable(vectors)
        norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
        unit = rows.withColumn("features", array_to_vector(F.transform("v", lambda x: F.when(norm > 0, x / norm).otherwise(0.0))))
        n = rows.count()
        self.centers = np.zeros((0, 0))
        self.vectors = None
        if n:
            few = unit if n <= sample else unit.orderBy(F.xxhash64("id")).limit(sample)
            model = KMeans(k=max(1, min(most, int(n**0.5))), maxIter=8, seed=seed, featuresCol="features", predictionCol="cell").fit(few.select("features"))
            self.centers = np.asarray(model.clusterCenters())
            self.vectors = self.scratch.keep(model.transform(unit).select("id", "v", "cell"), "vectors")

    def top(self, queries: DataFrame, top: int = 20, probes: int = 12, block: int = 2048) -> DataFrame:
        """(query_id, doc_id, cosine, cosine_rank): the best of the ``probes`` nearest cells of each query, by exact cosine."""
        asked = _usable(queries)
        if self.vectors is None:
            return asked.select(F.col("id").alias("query_id"), F.col("id").alias("doc_id"), F.lit(0.0).alias("cosine"), F.lit(1).alias("cosine_rank")).limit(0)
        centers = self.centers

        def nearest(batches):
            for pdf in batches:
                q = np.stack([np.asarray(v) for v in pdf["v"]]) if len(pdf) else np.zeros((0, centers.shape[1]))
                k = min(probes, len(centers))
                cells = np.argsort(-(q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-12)) @ centers.T + 0.5 * (centers**2).sum(axis=1), axis=1)[:, :k]
                yield pd.DataFrame({"id": np.repeat(pdf["id"].to_numpy(), k), "v": [v for v in pdf["v"] for _ in range(k)], "cell": cells.ravel()})

        probed = asked.mapInPandas(nearest, "id long, v array<double>, cell int")
        left = _packed(probed, ["cell"], 256, "q_ids", "q")
        right = _packed(self.vectors, ["cell"], block, "v_ids", "x")
        return _best(right.join(left, "cell"), top)


def compare_entities(chunks: DataFrame, questions: DataFrame, scores: DataFrame, top: int = 9) -> DataFrame:
    """(query_id, entity, doc_id, score, place): for questions that name several entities, the best chunks that contain each.

    questions: query_id, entities (array); scores: query_id, doc_id, score. Each entity gets an equal part of
    ``top``, one at least. Chunks are matched by their words, so that the join is one of equality.
    """
    wanted = questions.select("query_id", F.array_distinct("entities").alias("entities")).where(F.size("entities") >= 2).select("query_id", F.greatest(F.lit(1), F.floor(F.lit(top) / F.size("entities"))).alias("part"), F.explode("entities").alias("entity")).withColumn("token", F.lower("entity"))
    found = chunks.select("doc_id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("token")).join(small(wanted, growth=16), "token").join(scores, ["query_id", "doc_id"])
    w = Window.partitionBy("query_id", "entity").orderBy(F.desc("score"), "doc_id")
    return found.withColumn("place", F.row_number().over(w)).where(F.col("place") <= F.col("part")).select("query_id", "entity", "doc_id", "score", "place")


def hybrid(lexical: DataFrame, semantic: DataFrame, weight: float = 0.6, top: int = 10) -> DataFrame:
    """(query_id, doc_id, bm25_norm, cosine, hybrid, rank): candidates of either search, weight * cosine + (1 - weight) * bm25 / best bm25.

    A candidate that one search lacks has 0 there; scores are rounded once, to five digits; ties keep the smaller id.
    """
    both = lexical.select("query_id", "doc_id", "bm25").join(semantic.select("query_id", "doc_id", "cosine"), ["query_id", "doc_id"], "full_outer").na.fill(0.0, ["bm25", "cosine"])
    best = F.max("bm25").over(Window.partitionBy("query_id"))
    both = both.withColumn("bm25_norm", F.col("bm25") / F.when(best > 0, best).otherwise(1.0))
    both = both.withColumn("hybrid", F.round(weight * F.col("cosine") + (1 - weight) * F.col("bm25_norm"), 5))
    w = Window.partitionBy("query_id").orderBy(F.desc("hybrid"), "doc_id")
    return both.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)
