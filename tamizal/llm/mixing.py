"""Problem 8: mixing sources to target weights.

Each source gets a budget of tokens. Complete epochs come first: every document of the source once per epoch.
What is left of the budget is filled by Efraimidis-Spirakis sampling: each document draws an exponential key
scaled by its quality weight, documents are taken in order of their keys, and a prefix sum over tokens cuts the
order at the budget. The prefix sum runs over key ranges first, so that only the range where the budget ends is
sorted; a source that holds most of the corpus is never one task's work.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tamizal.functions.text import fold

from .common import Scratch, maybe_broadcast

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
#: Documents of one key range of a source, on the average; what one task puts in order.
RANGE_ROWS = 500_000


def count_tokens(documents: DataFrame, text: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """``documents`` (any columns) with ``tokens``: the size of ``text`` in tokens of a public tokenizer; null and empty texts have none.

    The file ``tokenizer`` on the driver is shipped to the workers once.
    """
    sc = documents.sparkSession.sparkContext
    sc.addFile(tokenizer)
    name = tokenizer.rpartition("/")[2]

    def run(batches):
        import os

        from pyspark import SparkFiles

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        coder = Tokenizer.from_file(SparkFiles.get(name))
        coder.encode_special_tokens = True
        for pdf in batches:
            sizes = [len(e.ids) for k in range(0, len(pdf), 256) for e in coder.encode_batch([t or "" for t in pdf[text].iloc[k : k + 256]], add_special_tokens=False)]
            yield pdf.drop(columns=[text]).assign(tokens=pd.Series(sizes, index=pdf.index, dtype="int64"))

    kept = [f for f in documents.schema.fields if f.name != text]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", tokens long"
    return documents.mapInPandas(run, schema)


def default_quality() -> Column:
    """Longer documents with a language and a date weigh more; always positive."""
    size = F.least(F.coalesce(F.col("n_chars"), F.lit(0)), F.lit(4000)) / 4000.0
    known = F.when(F.col("lang").isNull(), 0.0).otherwise(0.25) + F.when(F.col("doc_date").isNull(), 0.0).otherwise(0.25)
    return F.lit(0.25) + size + known


def mix(documents: DataFrame, targets: DataFrame, quality: Column | None = None, total_tokens: int | None = None, seed: int = 17, tokenizer: str = TOKENIZER) -> DataFrame:
    """One row per sampled document: doc_id, source, tokens, copies, target_share, actual_share.

    ``targets``: source, target_share, max_repeats. ``total_tokens``: the size wanted; by default the largest at
    which every source can hold its share. A source gives at most ``max_repeats`` times its tokens, so with a
    larger size actual shares fall short and say so. Sources are compared trimmed and folded; documents of other
    or no sources, and null or empty texts, have no row. A target without documents counts as absent: its share
    is spread over the others in proportion. Repeated rows count each; ties of keys fall to the smaller id.
    """
    scratch = Scratch(documents.sparkSession, "mix")
    goals = targets.select(fold(F.col("source")).alias("source"), F.col("target_share").cast("double").alias("target_share"), F.col("max_repeats").cast("int").alias("max_repeats")).where("target_share > 0 and max_repeats > 0")
    goals = scratch.keep(goals.groupBy("source").agg(F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats")), "goals")
    ours = documents.where("text is not null and text <> ''").withColumns({"source": fold(F.col("source")), "weight": F.greatest(quality if quality is not None else default_quality(), F.lit(1e-6))})
    ours = ours.select("doc_id", "source", "weight", "text").join(maybe_broadcast(goals.select("source")), "source", "left_semi")
    u = (F.xxhash64(F.lit(seed), "doc_id").bitwiseAND(F.lit((1 << 52) - 1)) + 1) / F.lit(float((1 << 52) + 1))
    sized = scratch.keep(count_tokens(ours, "text", tokenizer).select("doc_id", "source", "tokens", (-F.log(u) / F.col("weight")).alias("key")), "sized")
    # as many ranges as the largest source needs
    most = sized.groupBy("source").count().agg(F.max("count")).first()[0] or 0  # one number
    ranges = min(max(16, -(-most // RANGE_ROWS)), 20_000)
    cuts = F.percentile_approx("key", [(i + 1) / ranges for i in range(ranges - 1)], max(1000, 5 * ranges))
    stock = goals.join(sized.groupBy("source").agg(F.sum("tokens").alias("stock"), cuts.alias("cuts")), "source").where("stock > 0")
    everything = Window.partitionBy()  # one row per source
    stock = stock.withColumn("target_share", F.col("target_share") / F.sum("target_share").over(everything))
    reach = F.min(F.col("stock") * F.col("max_repeats") / F.col("target_share")).over(everything)
    size = F.lit(float(total_tokens)) if total_tokens is not None else reach
    budget = F.least(F.floor(F.col("target_share") * size), F.col("stock") * F.col("max_repeats"))
    plan = stock.withColumn("budget", budget).select("source", "target_share", "cuts", F.floor(F.col("budget") / F.col("stock")).alias("epochs"), (F.col("budget") % F.col("stock")).alias("left"))
    plan = scratch.keep(plan, "plan")
    placed = sized.join(maybe_broadcast(plan), "source").withColumn("range", F.size(F.filter("cuts", lambda c: c < F.col("key")))).drop("cuts")
    ranges = placed.groupBy("source", "range").agg(F.sum("tokens").alias("of_range"))
    ranges = ranges.withColumn("before", F.sum("of_range").over(Window.partitionBy("source").orderBy("range")) - F.col("of_range"))
    ranges = scratch.keep(ranges, "ranges")
    met = placed.join(maybe_broadcast(ranges), ["source", "range"])
    whole = met.where(F.col("before") + F.col("of_range") <= F.col("left")).withColumn("extra", F.lit(1))
    none = met.where(F.col("before") >= F.col("left")).withColumn("extra", F.lit(0))
    border = met.where((F.col("before") < F.col("left")) & (F.col("before") + F.col("of_range") > F.col("left")))
    order = Window.partitionBy("source").orderBy("key", "doc_id")
    border = border.withColumn("extra", (F.col("before") + F.sum("tokens").over(order) <= F.col("left")).cast("int"))
    taken = whole.unionByName(none).unionByName(border).withColumn("copies", (F.col("epochs") + F.col("extra")).cast("int")).where("copies > 0 and tokens > 0")
    taken = scratch.keep(taken.select("doc_id", "source", "tokens", "copies", "target_share"), "taken")
    shares = taken.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("of_source"))
    shares = shares.select("source", (F.col("of_source") / F.sum("of_source").over(everything)).alias("actual_share"))
    return taken.join(maybe_broadcast(scratch.keep(shares, "shares")), "source").select("doc_id", "source", "tokens", "copies", "target_share", "actual_share")


def shares(sample: DataFrame) -> DataFrame:
    """The report of a sample, one row per source: documents, tokens with copies, target and actual share, most copies."""
    return sample.groupBy("source", "target_share", "actual_share").agg(
        F.count("*").alias("documents"), F.sum(F.col("tokens") * F.col("copies")).alias("tokens"), F.max("copies").alias("most_copies")
    )
