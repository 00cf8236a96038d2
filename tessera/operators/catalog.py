"""Catalogue snapshots: building records from index tables, versions, differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import records as R
from ..functions import urls as U


def entries_to_records(entries: DataFrame, source_id: str, source_url: str, revision: str, retrieved_at: str, content_hash: str, license: str | None = None, rights: dict[str, str] | None = None, excluded: tuple[tuple[str, ...], dict[str, str]] = ((), {})) -> DataFrame:
    """Records made of index entries (key line_id, name, url, description, auth, https, cors, category); entries without a name or a usable address, or with an excluded one, give none.

    rights: of all records (the license, if none are given). excluded: hosts, and paths by host, as for urls.is_excluded.
    """
    url = U.canonical_url(F.col("url"))
    e = entries.withColumn("u", url).where((F.trim("name") != "") & F.col("u").isNotNull() & ~U.is_excluded(F.col("u"), *excluded))
    provider = U.provider_from_url(F.col("u"), F.col("name"))
    source = F.struct(F.lit(source_id).alias("source_id"), F.lit(source_url).alias("source_url"), F.lit(revision).alias("revision"), F.lit(retrieved_at).alias("retrieved_at"), F.lit(content_hash).alias("content_hash"), F.lit(license).cast("string").alias("license"))
    none = F.array().cast("array<string>")
    return e.select(
        F.col("line_id").alias("row_id"), R.stable_record_id(provider, F.col("name")).alias("id"), F.trim("name").alias("name"), none.alias("aliases"), F.trim(F.coalesce("description", F.lit(""))).alias("description"),
        (F.when(F.coalesce("category", F.lit("")) != "", F.array("category")).otherwise(none) if "category" in entries.columns else none).alias("categories"), none.alias("tags"), provider.alias("provider"), F.lit("public").alias("source_tier"),
        F.col("u").alias("docs_url"), F.col("u").alias("homepage_url"), R.auth_entry(F.col("auth"), source_id).alias("auth"), R.tri_state(F.col("https")).alias("https"), R.tri_state(F.col("cors")).alias("cors"),
        F.lit("unknown").alias("status"), F.array(source).alias("provenance"), F.lit(retrieved_at).alias("last_checked_at"), F.array(F.lit("community_metadata_unverified")).alias("quality_flags"),
        F.create_map(*[F.lit(x).cast("string") for pair in (rights or {"license": license}).items() for x in pair]).alias("rights"),
    )


def row_hash(columns: list[str]) -> Column:
    """SHA-256 of the row's values as text, parted by unit separators; null is written as U+0000."""
    return F.sha2(F.array_join(F.array(*[F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in columns]), "\x1f"), 256)


def record_text() -> Column:
    """A record as one text: every field of the schema, with last_checked_at and the sources' retrieved_at as null, maps by key.

    row_id and ingested_at belong to the table a record is delivered in, not to the
    record: the same records under other numbers, or loaded at another time, are the
    same catalogue. Lists keep their order, nulls are written.
    """
    blank = {
        "last_checked_at": F.lit(None).cast("string"),
        "provenance": F.transform("provenance", lambda p: F.when(p.isNotNull(), p.withField("retrieved_at", F.lit(None).cast("string")))),
        "rights": F.array_sort(F.map_entries("rights")),
    }
    fields = [c.split()[0] for c in R.RECORD.replace("\n", " ").split(", ")]
    return F.to_json(F.struct(*[blank.get(n, F.col(n)).alias(n) for n in fields if n != "row_id"]), {"ignoreNullFields": "false"})


def content_version(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row, version: v1- and 16 hex digits of a hash of all rows, whatever their order.

    A tree of SHA-256: the hash of each different row with the number of times it comes, in
    order, hashed together by their first six digits, these by the first three, and these
    once more. So no task holds more than a small part of the hashes, and a table without
    rows has a version too.
    """
    rows = df.select(row_hash(columns).alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    leaf = rows.select(F.substring("h", 1, 6).alias("b"), F.concat_ws("x", "h", "n").alias("h"))
    together = lambda c: F.sha2(F.array_join(F.array_sort(F.collect_list(c)), ","), 256)
    six = leaf.groupBy("b").agg(together("h").alias("h"))
    three = six.groupBy(F.substring("b", 1, 3).alias("p")).agg(together(F.concat_ws(":", "b", "h")).alias("h"))
    return three.agg(together(F.concat_ws(":", "p", "h")).alias("h")).select(F.concat(F.lit("v1-"), F.substring("h", 1, 16)).alias("version"))


def snapshot_diff(old: DataFrame, new: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """keys, change (added, removed, changed) between two tables with one row a key; null is a value."""
    o = old.select(*keys, F.struct(*values).alias("o"))
    n = new.select(*keys, F.struct(*values).alias("n"))
    both = o.join(n, keys, "full_outer")
    change = F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "removed").when(~F.col("o").eqNullSafe(F.col("n")), "changed")
    return both.select(*keys, change.alias("change")).where(F.col("change").isNotNull())


def canonical_sets(df: DataFrame, by: str, value: Column, name: str = "members") -> DataFrame:
    """by, name: the different values of a group whatever the letter case (the smallest spelling), sorted, joined by |."""
    each = df.select(by, F.trim(value).alias("v")).where(F.col("v") != "")
    once = each.groupBy(by, F.lower("v").alias("k")).agg(F.min("v").alias("v"))
    return once.groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "v"))), lambda p: p["v"]), "|").alias(name))


