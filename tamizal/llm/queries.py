"""Queries of the numbered problems; each runs over its whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamizal.session import table

from .capping import capped_hits
from .components import alias_groups
from .incremental import registry_repeats
from .leaks import leaks
from .mixing import mix
from .names import typed_names, variant_pairs
from .residue import residue
from .scans import flaws, repaired
from .survivors import survivors


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return alias_groups(table(spark, d, "alias_claims"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return survivors(table(spark, d, "canonical_entities")).select("record_id")


def p2_survivors(spark: SparkSession, d: str) -> DataFrame:
    """The whole surviving records; arrays as text, so that results compare."""
    df = survivors(table(spark, d, "canonical_entities"))
    return df.withColumns({c: F.concat_ws("|", c) for c in ("types", "extractor_ids")})


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return flaws(table(spark, d, "extracted_texts"))


def p3_repaired(spark: SparkSession, d: str) -> DataFrame:
    """The texts as readable paragraphs."""
    return repaired(table(spark, d, "extracted_texts"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return registry_repeats(table(spark, d, "ingest_registry"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return variant_pairs(typed_names(table(spark, d, "alias_claims"), table(spark, d, "entity_claims")))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return capped_hits(table(spark, d, "hits"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks(table(spark, d, "documents"), table(spark, d, "eval_questions"))


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    return mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return residue(table(spark, d, "documents")).select("doc_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"p1_found": p1_found, "p2_found": p2_found, "p2_survivors": p2_survivors, "p3_found": p3_found, "p3_repaired": p3_repaired, "p4_found": p4_found, "p5_found": p5_found, "p6_found": p6_found, "p7_found": p7_found, "p8_mix": p8_mix, "p9_found": p9_found}


_FOLD = r"trim(regexp_replace(lower(strip_accents(%s)), '[\s\x{1c}-\x{1f}\x{85}\pZ]+', ' ', 'g'))"

_P2 = r"""WITH r AS (SELECT record_id, regexp_replace(lower(strip_accents(canonical_name)), '[\pP\pZ\p{Cc}\p{Cf}\s]+', '', 'g') AS key,
CASE WHEN confidence IS NOT NULL AND NOT isnan(confidence) AND confidence BETWEEN 0 AND 1 THEN confidence ELSE -1 END AS c,
len(list_distinct(list_filter(list_transform(extractor_ids, lambda x: lower(trim(x))), lambda x: x IS NOT NULL AND x <> ''))) AS e, built_at FROM canonical_entities),
g AS (SELECT *, count(*) OVER (PARTITION BY key) AS n, row_number() OVER (PARTITION BY key ORDER BY c DESC, coalesce(e, 0) DESC, built_at DESC NULLS LAST, record_id) AS place FROM r WHERE key <> '')
SELECT record_id FROM g WHERE n > 1 AND place = 1"""

_P6 = (
    r"WITH h AS (SELECT hit_id, run_id, CASE WHEN isnan(final_score) THEN NULL ELSE final_score END AS s, trim(regexp_replace(regexp_replace("
    + _FOLD % "replace(source, '_', ' ')"
    + r", '^.*[/\\]', ''), '\.[a-z][a-z0-9]{0,4}$', '')) AS f FROM hits) "
    "SELECT hit_id FROM (SELECT hit_id, row_number() OVER (PARTITION BY run_id, f ORDER BY s DESC NULLS LAST, hit_id) AS place FROM h WHERE f <> '') WHERE place > 20"
)


def oracle_sql() -> dict[str, str]:
    return {"p2_found": _P2, "p6_found": _P6}
