"""Problem 2: the best representative of each group of duplicate records.

Records group by their name once case, accents, punctuation and blanks are set aside. Which values of the
multi-valued field are true is judged by a latent two-sided quality model: each source has a sensitivity (it
names a true value) and a specificity (it leaves out a false one), inferred by expectation-maximisation over
counted observation patterns; every value judged true is kept. Single-valued fields come from the survivor,
the best record by a lexicographic order; one it lacks comes from the best record of its group that has it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamizal.functions.text import squeeze, strip_accents

from .common import Scratch, maybe_broadcast


def name_key(c: Column) -> Column:
    """The name without case, accents, punctuation and blanks; null if nothing is left."""
    key = F.regexp_replace(F.lower(strip_accents(c)), r"[\p{P}\p{Z}\p{Cc}\p{Cf}\s]+", "")
    return F.when(key != "", key)


def clean_set(c: Column) -> Column:
    """Distinct trimmed lower-case values of an array; null and blank ones don't count; never null."""
    tidy = F.transform(c, lambda x: squeeze(F.lower(x)))
    return F.coalesce(F.array_distinct(F.filter(tidy, lambda x: x.isNotNull() & (x != ""))), F.array().cast("array<string>"))


def learn_quality(scratch: Scratch, observed: DataFrame, rounds: int = 20, enough: float = 1e-3) -> tuple[DataFrame, DataFrame]:
    """EM over ``observed`` (pattern, n, source, said): one row per source of each counted pattern.

    Returns (source, sens, spec) and (pattern, n, p_true). Beta priors keep rates off 0 and 1; the share of true
    values is estimated as well. Ends when no pattern's probability moves by ``enough``, after ``rounds`` at most.
    """
    p = observed.groupBy("pattern").agg(F.max("n").alias("n"), F.avg(F.col("said").cast("double")).alias("p_true"))
    truth = scratch.keep(p, "truth")
    quality = None
    for _ in range(rounds):
        share = truth.agg(F.sum(F.col("n") * F.col("p_true")) / F.sum("n")).first()[0]  # one number
        prior = min(max(share if share is not None else 0.5, 0.01), 0.99)
        x = observed.join(maybe_broadcast(truth.select("pattern", "p_true")), "pattern")
        said, pt, n = F.col("said").cast("double"), F.col("p_true"), F.col("n")
        quality = scratch.keep(
            x.groupBy("source").agg(
                ((F.sum(n * pt * said) + 8) / (F.sum(n * pt) + 10)).alias("sens"),
                ((F.sum(n * (1 - pt) * (1 - said)) + 9) / (F.sum(n * (1 - pt)) + 10)).alias("spec"),
            ),
            "quality",
        )
        y = observed.join(maybe_broadcast(quality), "source")
        odds = F.when(F.col("said"), F.log(F.col("sens") / (1 - F.col("spec")))).otherwise(F.log((1 - F.col("sens")) / F.col("spec")))
        judged = y.groupBy("pattern").agg(F.max("n").alias("n"), (1 / (1 + F.exp(-(F.sum(odds) + math.log(prior / (1 - prior)))))).alias("p_true"))
        moved = judged.join(maybe_broadcast(truth.select("pattern", F.col("p_true").alias("was"))), "pattern")
        moved = scratch.keep(moved, "truth")
        truth = moved.select("pattern", "n", "p_true")
        change = moved.agg(F.max(F.abs(F.col("p_true") - F.col("was")))).first()[0]  # one number
        if change is None or change < enough:
            break
    return quality, truth


def true_values(scratch: Scratch, records: DataFrame, rounds: int = 20) -> DataFrame:
    """(key, values): per group the values judged true, the most probable one where none reaches a half.

    ``records``: key, sources and values (arrays of distinct strings). A source of a group that never names a
    value speaks against it. Groups without any value or source have no row.
    """
    claims = records.where((F.size("sources") > 0) & (F.size("values") >= 0))
    said = claims.select("key", F.explode("sources").alias("source"), "values")
    by_source = said.groupBy("key", "source").agg(F.array_distinct(F.flatten(F.collect_set("values"))).alias("named"))
    values = claims.select("key", F.explode("values").alias("value")).distinct()
    heard = values.join(by_source, "key").select("key", "value", F.struct("source", F.array_contains("named", F.col("value")).alias("said")).alias("o"))
    facts = heard.groupBy("key", "value").agg(F.array_sort(F.collect_list("o")).alias("pattern"))
    facts = scratch.keep(facts.select("key", "value", F.xxhash64("pattern").alias("pattern"), F.col("pattern").alias("seen")), "facts")
    counted = facts.groupBy("pattern").agg(F.count("*").alias("n"), F.first("seen").alias("seen"))
    observed = scratch.keep(counted.select("pattern", "n", F.inline("seen")), "observed")
    _, truth = learn_quality(scratch, observed, rounds)
    judged = facts.select("key", "value", "pattern").join(maybe_broadcast(truth.drop("n")), "pattern")
    return judged.groupBy("key").agg(
        F.array_sort(F.collect_set(F.when(F.col("p_true") >= 0.5, F.col("value")))).alias("kept"),
        F.max_by("value", F.struct("p_true", "value")).alias("best"),
    ).select("key", F.when(F.size("kept") > 0, F.col("kept")).otherwise(F.array("best")).alias("values"))


def survivors(entities: DataFrame) -> DataFrame:
    """One row per group of two or more records: record_id, canonical_name, confidence, types, extractor_ids, built_at, n_records.

    The survivor has the highest confidence (null, NaN and values outside 0..1 last), then the most different
    extractors (case and outer blanks set aside; null and blank don't count), then the latest ``built_at`` (null
    last), then the smallest ``record_id``. A ``built_at`` it lacks is that of the next best record. ``types`` holds every value judged true over the group. Records whose
    name is null or has no letter or digit belong to no group. Repeated rows are records of their own. An empty
    table gives an empty result; other columns are ignored.
    """
    scratch = Scratch(entities.sparkSession, "survivors")
    conf = F.col("confidence").cast("double")
    good = conf.isNotNull() & ~F.isnan(conf) & conf.between(0, 1)
    age = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col("built_at").cast("timestamp_ntz"))
    records = entities.select(
        name_key(F.col("canonical_name")).alias("key"),
        "record_id",
        "canonical_name",
        F.when(good, conf).alias("confidence"),
        clean_set(F.col("extractor_ids")).alias("sources"),
        clean_set(F.col("types")).alias("values"),
        "built_at",
        F.struct(
            F.when(good, -conf).otherwise(F.lit(1.0)).alias("c"),
            (-F.size(clean_set(F.col("extractor_ids")))).alias("e"),
            F.coalesce(-age, F.lit((1 << 63) - 1)).alias("b"),
            F.col("record_id").alias("i"),
        ).alias("place"),
    ).where("key is not null")
    records = scratch.keep(records, "records")
    dated = F.min(F.when(F.col("built_at").isNotNull(), F.struct("place", "built_at")))
    best = records.groupBy("key").agg(F.min("place").alias("place"), dated.alias("dated"), F.count("*").alias("n_records")).where("n_records > 1")
    best = scratch.keep(best.select("key", F.col("place.i").alias("record_id"), F.col("dated.built_at").alias("group_built_at"), "n_records"), "best")
    in_groups = records.join(maybe_broadcast(best.select("key")), "key", "left_semi")
    truth = true_values(scratch, in_groups.select("key", "sources", "values"))
    extractors = in_groups.select("key", F.explode("sources").alias("s")).groupBy("key").agg(F.array_sort(F.collect_set("s")).alias("extractor_ids"))
    chosen = records.select("key", "record_id", "canonical_name", "confidence", "built_at").join(maybe_broadcast(best), ["key", "record_id"])
    return (
        chosen.join(truth.withColumnRenamed("values", "types"), "key", "left")
        .join(extractors, "key", "left")
        .select("record_id", "canonical_name", "confidence", "types", "extractor_ids", F.coalesce("built_at", "group_built_at").alias("built_at"), "n_records")
    )
