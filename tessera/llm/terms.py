"""How distinctive a term is for a record: relevance weights with saturating term frequency and length normalisation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.skew import FLOOR, SHARE, heavy_keys, is_heavy, skew_join
from ..session import cut

K1, B = 1.2, 0.75
FIELDS = ("name", "description", "tags", "categories")


def terms_of(text: Column) -> Column:
    """Unbroken runs of letters or digits, in lower case; null gives none."""
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), F.array().cast("array<string>"))


def record_text(df: DataFrame, fields=FIELDS) -> Column:
    """All fields of a record as one text, parted by line feeds; lists are joined, nulls skipped."""
    kind = dict(df.dtypes)
    return F.concat_ws("\n", *[F.concat_ws("\n", F.col(f)) if kind[f].startswith("array") else F.col(f).cast("string") for f in fields])


def document_frequencies(records: DataFrame, key: str, text: Column) -> DataFrame:
    """term, df, rows: the number of different keys with the term in any of their records, and of records with it.

    Texts are shuffled by key, once, and cut into terms after it, which moves a fraction
    of what pairs of term and key would. Records of a key with more than a small share of
    all rows are cut into terms before the shuffle instead. Records without a key belong
    to no one and count for no df.
    """
    slim = records.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), text.alias("text"))
    heavy = heavy_keys(slim, ["key"])
    light = slim.where(~is_heavy(["key"], heavy)).repartition("key")
    of_key = lambda df: df.select("key", F.explode(F.array_distinct(terms_of(F.col("text")))).alias("term")).groupBy("key", "term").agg(F.count(F.lit(1)).alias("rows"))
    pairs = of_key(light)
    if heavy:
        pairs = pairs.unionByName(of_key(slim.where(is_heavy(["key"], heavy))))
    return pairs.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("rows").alias("rows"))


def heavy_terms(freq: DataFrame) -> list[tuple]:
    """Terms that are in more than a small share of all pairs of record and term: fewer than 1 / SHARE, whatever the data."""
    total = freq.agg(F.sum("rows")).first()[0] or 0
    return [tuple(r) for r in freq.where(F.col("rows") > max(FLOOR, SHARE * total)).select("term").collect()]


def collection(records: DataFrame, key: str, text: Column) -> DataFrame:
    """One row: n (different keys) and avg_len (terms a record, at least 1)."""
    return records.agg(F.count_distinct(F.when(F.col(key).isNotNull(), F.xxhash64(key))).alias("n"), F.greatest(F.lit(1.0), F.coalesce(F.avg(F.size(terms_of(text))), F.lit(1.0))).alias("avg_len"))


def weight(tf: Column, df: Column, length: Column, n: Column, avg_len: Column) -> Column:
    """ln(1 + (n - df + 0.5) / (df + 0.5)) times the saturated frequency; a df of 0 counts as it is."""
    idf = F.log1p((n - df + 0.5) / (df + 0.5))
    return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / avg_len))


def term_scores(records: DataFrame, row_id: str = "row_id", key: str = "id", of: DataFrame | None = None, fields=FIELDS) -> DataFrame:
    """row_id, key, term, tf, df, score of every term of every record, or only of the records whose row_id is in of.

    Counts and averages are over all records. df counts different keys. Empty records
    have no terms; repeated row_ids are scored each on its own text, then kept once.
    """
    text = record_text(records, fields)
    asked = records.select(F.col(row_id).alias("row"), F.col(key).alias("key"), text.alias("text"))
    if of is not None:
        asked = asked.join(of.select(F.col(row_id).alias("row")).distinct(), "row", "left_semi")
    words = asked.select("row", "key", terms_of(F.col("text")).alias("ws"))
    tf = words.select("row", "key", F.size("ws").alias("length"), F.explode("ws").alias("term"))
    # of one record only, so reduced before the shuffle; rows are spread by row and term
    tf = tf.groupBy("row", "key", "term").agg(F.count(F.lit(1)).alias("tf"), F.first("length").alias("length"))
    freq = cut(document_frequencies(records, key, text))
    stats = F.broadcast(collection(records, key, text))  # one row
    # a term may be in nearly every record
    scored = skew_join(tf, freq, ["term"], "left", heavy_terms(freq)).crossJoin(stats)
    score = weight(F.col("tf"), F.coalesce("df", F.lit(0)), F.col("length"), F.col("n"), F.col("avg_len"))
    return scored.select(F.col("row").alias(row_id), F.col("key").alias(key), "term", "tf", F.coalesce("df", F.lit(0)).alias("df"), score.alias("score"))


def most_distinctive(records: DataFrame, of: DataFrame, row_id: str = "row_id", key: str = "id") -> DataFrame:
    """row_id, term: of the terms shared with at least one record of another key, the one with the highest score; ties go to the first term in order."""
    scores = term_scores(records, row_id, key, of)
    own = F.when(F.col(key).isNull(), 0).otherwise(1)
    return scores.where(F.col("df") > own).groupBy(row_id).agg(F.min_by("term", F.struct(-F.round("score", 9), "term")).alias("term"))
