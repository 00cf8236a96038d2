"""Linking records that describe one thing, and merging each group into one record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import records as R
from ..functions import urls as U
from ..session import cut, spread
from .skew import FLOOR, SHARE, heavy_keys, skew_join


def identity_tokens(records: DataFrame, key: str = "row_id") -> DataFrame:
    """key, token: what a record may be known by: its id, its provider with each of its names, its documentation address.

    Null and blank values give no token; a record without any is in no row.
    """
    records = spread(records.select(key, "id", "provider", "docs_url", "name", "aliases"), key)
    flat = records.select(key, "id", "provider", "docs_url", F.explode(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("called"))
    label = R.identity_label(F.col("called"))
    named = flat.where((F.trim(F.coalesce("provider", F.lit(""))) != "") & (F.trim(F.coalesce("called", F.lit(""))) != ""))
    names = named.select(key, F.concat_ws(":", F.lit("provider-name"), R.identity_label(F.col("provider")), label).alias("token"))
    ids = records.where(F.coalesce("id", F.lit("")) != "").select(key, F.concat(F.lit("id:"), F.lower("id")).alias("token"))
    docs = records.select(key, F.concat(F.lit("docs:"), U.url_identity(F.col("docs_url"))).alias("token")).where(F.col("token").isNotNull())
    return ids.unionByName(names).unionByName(docs).distinct()


def _heavy(df: DataFrame, key: str, rows: int) -> list[tuple]:
    return heavy_keys(df, [key], SHARE, FLOOR) if rows > FLOOR else []


def linked(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """vertex, group: each vertex of edges with the smallest vertex it reaches; a vertex that is only linked to itself is its own group.

    Labels go to the smallest among the neighbours' and are then looked up through each
    other, so their number of steps halves in each round. Null ends are ignored.
    """
    e = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).dropna()
    e = cut(e.select(F.inline(F.array(F.struct("x", "y"), F.struct(F.col("y").alias("x"), F.col("x").alias("y"))))).distinct())
    n = e.count()
    heavy = _heavy(e, "x", n)
    labels = cut(e.groupBy("x").agg(F.least(F.min("y"), F.min("x")).alias("g")))
    while True:
        told = skew_join(e.select(F.col("x").alias("y"), F.col("y").alias("x")), labels.select(F.col("x").alias("y"), "g"), ["y"], heavy=heavy)
        least = told.groupBy("x").agg(F.min("g").alias("m"))
        step = cut(labels.join(least, "x").select("x", F.col("g").alias("old"), F.least("g", "m").alias("g")))
        if not step.where(F.col("g") != F.col("old")).limit(1).count():
            return labels.select(F.col("x").alias("vertex"), F.col("g").alias("group"))
        jump = skew_join(step.select("x", "g"), step.select(F.col("x").alias("g"), F.col("g").alias("g2")), ["g"], "left", heavy=_heavy(step, "g", n))
        labels = cut(jump.select("x", F.least("g", F.coalesce("g2", "g")).alias("g")))


def entity_groups(records: DataFrame, key: str = "row_id") -> DataFrame:
    """key, group: records that share identity tokens, directly or through others; a record alone is its own group.

    Each token links its records to the smallest of them, so a token of any number of
    records gives as many edges, not pairs.
    """
    tokens = cut(identity_tokens(records, key).select(F.col(key).alias("x"), "token"))
    owner = tokens.groupBy("token").agg(F.min("x").alias("o"))
    edges = skew_join(tokens, owner, ["token"], heavy=_heavy(tokens, "token", tokens.count())).select(F.col("x").alias("a"), F.col("o").alias("b")).distinct()
    found = linked(edges)
    return records.select(key).distinct().join(found.withColumnRenamed("vertex", key), key, "left").select(key, F.coalesce("group", F.col(key)).alias("group"))


def meaningful(c: Column, kind: str) -> Column:
    if kind.startswith(("array", "map")):
        return F.size(c) > 0
    return c.isNotNull() & ~c.cast("string").isin("", "unknown") if kind == "string" else c.isNotNull()


def merge_groups(records: DataFrame, groups: DataFrame, key: str = "row_id") -> DataFrame:
    """One record for each group: columns of the record schema (openapi is null), group and merged_rows.

    Rows are ordered by id and content (the fields in the order of their names, as JSON).
    Scalars: the last value that says something; id, name, provider and tier of the last row
    come first. Names and aliases, categories, tags and flags are united whatever the letter
    case; of provenance with the same source, address, revision and hash the last holds; auth
    is the last with a known kind, else the last; rights are those of the last row.

    One sort over all rows gives each a number, by which all that follows compares; it is
    split by content too, so a group may hold any share of the rows. Lists are gathered by
    different values, never by rows.
    """
    kinds = dict(records.dtypes)
    named = [c for c in (x.split()[0] for x in R.RECORD.replace("\n", " ").split(", ")) if c in kinds and c != key]
    rows = records.select(key, *named).join(groups.select(key, "group"), key)
    content = F.to_json(F.struct(*sorted(named)), {"ignoreNullFields": "false"})
    order = ["group", "__id", "__content", key]
    rows = rows.withColumns({"__id": F.coalesce("id", F.lit("")), "__content": content}).repartitionByRange(*order).sortWithinPartitions(*order)
    rows = rows.withColumn("ord", F.monotonically_increasing_id()).drop("__id", "__content", "openapi")
    rows = cut(rows.withColumn("known_auth", F.coalesce(F.exists("auth", lambda x: x["type"] != "unknown"), F.lit(False))))
    last = lambda c: F.max_by(c, F.when(meaningful(F.col(c), kinds[c]), F.col("ord")))
    primary = lambda c: F.coalesce(F.max_by(F.when(meaningful(F.col(c), kinds[c]), F.col(c)), "ord"), last(c))
    one = rows.groupBy("group").agg(
        *[primary(c).alias(c) for c in ("id", "name", "provider", "source_tier")],
        *[F.coalesce(last(c), F.max_by(c, "ord")).alias(c) for c in ("description", "docs_url", "homepage_url", "https", "cors", "status")],
        F.max("last_checked_at").alias("last_checked_at"), F.max_by("rights", "ord").alias("rights"),
        F.max_by("auth", F.when(F.size("auth") > 0, F.struct("known_auth", "ord"))).alias("auth"), F.count(F.lit(1)).alias("merged_rows"),
    )
    empty = F.array().cast("array<string>")
    lists = {"aliases": F.concat(F.array("name"), F.coalesce("aliases", empty)), **{c: F.coalesce(c, empty) for c in ("categories", "tags", "quality_flags")}}
    listed = lambda n: lambda x: F.struct(F.lit(n).alias("list"), F.regexp_replace(x, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "").alias("v"))
    entries = F.concat(*[F.transform(v, listed(n)) for n, v in lists.items()])
    each = rows.select("group", F.inline(entries)).where(F.col("v") != "")
    once = each.groupBy("group", "list", F.lower("v").alias("k")).agg(F.min("v").alias("v"))
    united = once.groupBy("group").agg(F.array_sort(F.collect_list(F.struct("list", "k", "v"))).alias("all"))
    of = lambda n: F.transform(F.filter("all", lambda x: x["list"] == n), lambda x: x["v"]).alias(n)
    p = rows.select("group", "ord", F.explode("provenance").alias("p"))
    p = p.groupBy("group", "p.source_id", "p.source_url", "p.revision", "p.content_hash").agg(F.max_by("p", "ord").alias("p"))
    by = F.struct(F.coalesce("source_id", F.lit("")).alias("a"), F.coalesce("revision", F.lit("")).alias("b"), F.coalesce("source_url", F.lit("")).alias("c"), F.coalesce("content_hash", F.lit("")).alias("d"), "p")
    p = p.groupBy("group").agg(F.transform(F.array_sort(F.collect_list(by)), lambda x: x["p"]).alias("provenance"))
    out = one.join(united.select("group", *[of(n) for n in lists]), "group", "left").join(p, "group", "left")
    out = out.withColumn("aliases", F.filter("aliases", lambda v: F.lower(v) != F.lower(F.coalesce("name", F.lit("")))))
    if "openapi" in kinds:
        out = out.withColumn("openapi", F.lit(None).cast(records.schema["openapi"].dataType))
    return out.withColumns({c: F.coalesce(c, empty) for c in lists})
