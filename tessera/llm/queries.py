"""Queries of this package and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut
from . import components, disguise, mixing, packing, stuffing, survivors, terms, tokens

Query = Callable[[SparkSession, str], DataFrame]


def _read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return survivors.catalog_survivors(_read(spark, sf, "catalog_records"))


def p2_current(spark: SparkSession, sf: str) -> DataFrame:
    return survivors.current_values(_read(spark, sf, "catalog_records"), "id", "row_id", survivors.catalog_moment(), survivors.CLOSED)


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return terms.most_distinctive(_read(spark, sf, "catalog_records"), _read(spark, sf, "term_probes"))


def p3_scores(spark: SparkSession, sf: str) -> DataFrame:
    return terms.term_scores(_read(spark, sf, "catalog_records")).drop("id").withColumn("score", F.round("score", 6))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    groups = components.components(components.latest_links(_read(spark, sf, "match_pairs")))
    return groups.select(F.col("vertex").alias("row_id"), F.col("group").alias("group_id"))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    records = disguise.disguised(_read(spark, sf, "catalog_records"), "row_id", ["name", "description"])
    return records.unionByName(disguise.disguised(_read(spark, sf, "query_aliases"), "alias_id", ["aliases"]))


def p4_plain(spark: SparkSession, sf: str) -> DataFrame:
    r = _read(spark, sf, "catalog_records")
    return r.select("row_id", disguise.normalize(F.col("name")).alias("name"), disguise.normalize(F.col("description")).alias("description"))


def _sized(spark: SparkSession, sf: str, *more: str) -> DataFrame:
    # sizes are used several times: texts are cut into tokens once
    return cut(tokens.sized(_read(spark, sf, "documents"), "doc_id", "text", *more))


def p7_containers(spark: SparkSession, sf: str) -> DataFrame:
    return packing.containers(_sized(spark, sf), _read(spark, sf, "context_sizes"))


def p7_fill(spark: SparkSession, sf: str) -> DataFrame:
    sizes = _read(spark, sf, "context_sizes")
    return packing.fill(packing.containers(_sized(spark, sf), sizes), sizes)


def _mixed(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    docs = _read(spark, sf, "documents").withColumn("text_id", F.sha2(F.col("text"), 256))
    return mixing.mix(tokens.sized(docs, "doc_id", "text", "source", "text_id"), _read(spark, sf, "mix_targets"))


def p8_uses(spark: SparkSession, sf: str) -> DataFrame:
    return _mixed(spark, sf)[0]


def p8_shares(spark: SparkSession, sf: str) -> DataFrame:
    return _mixed(spark, sf)[1]


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    return stuffing.stuffed_pages(_read(spark, sf, "documents"))


def p9_scores(spark: SparkSession, sf: str) -> DataFrame:
    return stuffing.page_scores(_read(spark, sf, "documents"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (p2_found, p2_current, p3_found, p3_scores, p4_found, p4_plain, p5_found, p7_containers, p7_fill, p8_uses, p8_shares, p9_found, p9_scores)}
_NOTHING = ", ".join("'" + w + "'" for w in survivors.NOTHING)
_TIME = r"^\d{4}-\d{2}-\d{2}[Tt ](?:[01]\d|2[0-3]):[0-5]\d:[0-5]\d(?:\.\d+)?(?:[Zz]|[+-](?:[01]\d|2[0-3]):[0-5]\d)$"


def _known(x: str) -> str:
    return f"coalesce(lower(trim({x})) NOT IN ({_NOTHING}), false)"


def _valid(x: str) -> str:
    return f"coalesce(regexp_matches({x}, '{_TIME}') AND try_cast(substr({x}, 1, 10) AS DATE) IS NOT NULL, false)"


P2_SQL = f"""WITH r AS (SELECT row_id, id, CASE WHEN {_valid("last_checked_at")} AND epoch_us(try_cast(last_checked_at AS TIMESTAMPTZ)) <= epoch_us(ingested_at) THEN epoch_us(try_cast(last_checked_at AS TIMESTAMPTZ)) END AS stamp,
  len(list_distinct(list_filter(auth, lambda a: {_known("a.type")}))) AS auth_n, len(list_filter(map_values(rights), lambda v: {_known("v")})) AS rights_n,
  len(list_distinct(list_transform(list_filter(provenance, lambda p: {_known("p.source_id")} AND {_known("p.source_url")} AND {_known("p.revision")} AND {_valid("p.retrieved_at")} AND coalesce(regexp_matches(p.content_hash, '^[0-9a-fA-F]{{64}}$'), false)),
    lambda p: struct_pack(a := p.source_id, b := p.source_url, c := p.revision, d := p.retrieved_at, e := p.content_hash)))) AS prov_n FROM catalog_records WHERE id IS NOT NULL),
m AS (SELECT *, count(*) OVER (PARTITION BY id) AS n FROM r),
f AS (SELECT id, row_id, stamp, n, unnest(['auth', 'last_checked_at', 'provenance', 'rights']) AS field, unnest([auth_n, CAST(stamp IS NOT NULL AS INT), prov_n, rights_n]) AS score FROM m WHERE n >= 2)
SELECT id, field, row_id FROM f WHERE coalesce(score, 0) > 0 QUALIFY row_number() OVER (PARTITION BY id, field ORDER BY score DESC, stamp DESC NULLS LAST, row_id) = 1"""

_TEXT = "concat_ws(chr(10), name, description, array_to_string(list_filter(tags, lambda v: v IS NOT NULL), chr(10)), array_to_string(list_filter(categories, lambda v: v IS NOT NULL), chr(10)))"
_SCORED = f"""w AS (SELECT row_id, id, regexp_extract_all(lower({_TEXT}), '[\\p{{L}}\\p{{N}}]+') AS ws FROM catalog_records),
s AS (SELECT count(DISTINCT id) AS n, greatest(1.0, avg(len(ws))) AS avg_len FROM w),
t AS (SELECT row_id, id, len(ws) AS length, unnest(ws) AS term FROM w),
d AS (SELECT term, count(DISTINCT id) AS df FROM t GROUP BY term),
tf AS (SELECT row_id, id, length, term, count(*) AS tf FROM t GROUP BY ALL),
scored AS (SELECT row_id, id, term, tf, df, ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * length / avg_len)) AS score FROM tf JOIN d USING (term) CROSS JOIN s)"""
P3_SCORES_SQL = f"WITH {_SCORED} SELECT row_id, term, tf, df, round(score, 6) AS score FROM scored"
P3_SQL = f"""WITH {_SCORED}
SELECT row_id, term FROM scored WHERE row_id IN (SELECT row_id FROM term_probes) AND df > CASE WHEN id IS NULL THEN 0 ELSE 1 END
QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY round(score, 9) DESC, term) = 1"""

P5_SQL = """WITH RECURSIVE l AS (SELECT least(row_a, row_b) AS u, greatest(row_a, row_b) AS v, arg_max(lower(trim(coalesce(verdict, ''))), struct_pack(a := decided_at, b := pair_id)) AS said FROM match_pairs WHERE row_a <> row_b GROUP BY ALL),
e AS (SELECT u AS x, v AS y FROM l WHERE said = 'match' UNION SELECT v, u FROM l WHERE said = 'match'),
walk(x, g) AS (SELECT x, x FROM e UNION SELECT e.y, walk.g FROM walk JOIN e ON e.x = walk.x WHERE walk.g < e.y)
SELECT x AS row_id, min(g) AS group_id FROM walk GROUP BY x"""

ORACLE: dict[str, str] = {"p2_found": P2_SQL, "p3_found": P3_SQL, "p3_scores": P3_SCORES_SQL, "p5_found": P5_SQL}
