"""Checks of records that give error rows: key, path, message."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import records as R
from ..functions import urls as U
from ..functions.times import is_rfc3339
from ..session import cut, spread

RIGHTS_KEYS = ("attribution", "authorization", "community_attribution", "community_license", "license", "license_url", "notes", "repository_visibility", "scope", "terms_url", "usage_basis")
MAX_NAME, MAX_TEXT, MAX_ITEMS, MAX_ENTRIES, MAX_RIGHT = 512, 8192, 256, 64, 4096
SOURCE_KEYS = ("source_id", "source_url", "revision", "content_hash")
SPECIFICATIONS = ("openapi", "swagger")


def _err(bad: Column, path: str, message: Column | str) -> Column:
    m = F.lit(message) if isinstance(message, str) else message
    return F.when(F.coalesce(bad, F.lit(True)), F.struct(F.lit(path).alias("path"), m.alias("message")))


def _list_errors(name: str) -> list[Column]:
    c = F.col(name)
    bad = F.exists(c, lambda v: v.isNull() | (F.trim(v) == "") | (F.trim(v) != v))
    clean = F.coalesce(F.transform(c, lambda v: F.coalesce(v, F.lit(""))), F.array().cast("array<string>"))
    pairs = F.transform(clean, lambda v: F.struct(F.lower(v).alias("k"), v.alias("v")))
    return [
        _err(c.isNull(), name, "must be a list"),
        _err(F.coalesce(bad, F.lit(False)), name, "items must be non-empty trimmed strings"),
        _err(F.size(F.array_distinct(F.transform(clean, lambda v: F.lower(v)))) < F.size(clean), name, "items must be unique"),
        _err(F.array_sort(pairs) != pairs, name, "items must be in canonical order"),
        _err(F.size(clean) > MAX_ITEMS, name, f"must have at most {MAX_ITEMS} items"),
        _err(F.exists(clean, lambda v: F.length(v) > MAX_NAME), name, f"items must have at most {MAX_NAME} characters"),
    ]


def _openapi_errors() -> list[Column]:
    """Of a description that is there; a record without one breaks none of these."""
    c = lambda n: F.col(f"openapi.{n}")
    problem = U.url_problem(c("spec_url"))
    checks = [
        F.when(problem.isNotNull(), F.struct(F.lit("openapi.spec_url").alias("path"), problem.alias("message"))),
        _err(~c("specification").isin(*SPECIFICATIONS), "openapi.specification", f"must be one of {', '.join(SPECIFICATIONS)}"),
        *[_err(c(n).isNull(), f"openapi.{n}", "must be a string") for n in ("specification_version", "api_version", "title")],
        *[_err(c(n) < 0, f"openapi.{n}", "must be a non-negative integer") for n in ("path_count", "operation_count")],
        *[x for n in ("tags", "security_schemes") for x in _list_errors(f"openapi.{n}")],
    ]
    return [F.when(F.col("openapi").isNotNull(), x) for x in checks]


def record_errors(records: DataFrame, key: str = "row_id") -> DataFrame:
    """key, path, message of each rule that a record breaks by itself."""
    text = lambda n, most, empty=False: [
        _err(F.col(n).isNull(), n, "must be a string"),
        *([] if empty else [_err(F.coalesce(F.trim(n) == "", F.lit(False)), n, "must not be blank")]),
        _err(F.coalesce(F.length(n) > most, F.lit(False)), n, f"must have at most {most} characters"),
    ]
    enum = lambda n, allowed: [_err(~F.col(n).isin(*allowed), n, f"must be one of {', '.join(allowed)}")]
    url = lambda n: [F.when(U.url_problem(F.col(n)).isNotNull(), F.struct(F.lit(n).alias("path"), U.url_problem(F.col(n)).alias("message")))]
    some = lambda c: F.coalesce(c, F.lit(False))
    kinds = F.transform("auth", lambda a: a["type"])
    entry = lambda a: F.struct(a["type"], a["location"], *[F.lower(F.coalesce(a[n], F.lit(""))) for n in ("name", "source")], a["confidence"])
    right = lambda n: F.try_element_at("rights", F.lit(n))
    checks = [
        *text("id", MAX_NAME), *text("name", MAX_NAME), *text("provider", MAX_NAME),
        *enum("source_tier", R.TIERS), *enum("https", R.TRI_STATES), *enum("cors", R.TRI_STATES), *enum("status", R.STATUSES),
        *url("docs_url"), *url("homepage_url"),
        *[x for n in ("aliases", "categories", "tags", "quality_flags") for x in _list_errors(n)],
        _err(some(F.col("last_checked_at").isNotNull() & ~is_rfc3339(F.col("last_checked_at"))), "last_checked_at", "must be an RFC 3339 time or null"),
        _err(F.col("auth").isNull() | (F.size("auth") == 0), "auth", "must be a non-empty list"),
        _err(some(F.exists(kinds, lambda k: ~F.coalesce(k.isin(*R.AUTH_TYPES), F.lit(False)))), "auth", "type must be a known kind"),
        _err(some(F.exists("auth", lambda a: ~F.coalesce(a["location"].isin(*R.AUTH_LOCATIONS), F.lit(False)))), "auth", "location must be a known place"),
        _err(some(F.exists("auth", lambda a: ~F.coalesce((a["confidence"] >= 0) & (a["confidence"] <= 1), F.lit(False)))), "auth", "confidence must be from 0 to 1"),
        _err(some(F.array_contains(kinds, "none") & (F.size("auth") > 1)), "auth", "none must stand alone"),
        _err(some(F.size(F.array_distinct(F.transform("auth", entry))) < F.size("auth")), "auth", "entries must be unique"),
        *[_err(some(F.exists(F.col(f"auth.{n}"), lambda v: v.isNull())), "auth", f"{n} must be a string") for n in ("name", "source")],
        _err(some(F.size("auth") > MAX_ENTRIES), "auth", f"must have at most {MAX_ENTRIES} entries"),
        *_openapi_errors(),
        _err(F.col("provenance").isNull() | (F.size("provenance") == 0), "provenance", "must be a non-empty list"),
        _err(some(F.exists("provenance", lambda p: F.trim(F.coalesce(p["source_id"], F.lit(""))) == "")), "provenance", "source_id must not be blank"),
        _err(some(F.exists("provenance", lambda p: p["retrieved_at"].isNotNull() & ~is_rfc3339(p["retrieved_at"]))), "provenance", "retrieved_at must be an RFC 3339 time or null"),
        _err(some(F.exists("provenance", lambda p: ~F.coalesce(p["content_hash"].rlike("^[0-9a-f]{64}$"), F.lit(False)))), "provenance", "content_hash must be 64 hex digits"),
        _err(some(F.size(F.array_distinct(F.transform("provenance", lambda p: F.struct(*[p[n] for n in SOURCE_KEYS])))) < F.size("provenance")), "provenance", "entries must be unique"),
        _err(some(F.size("provenance") > MAX_ENTRIES), "provenance", f"must have at most {MAX_ENTRIES} entries"),
        _err(F.col("rights").isNull(), "rights", "must be a map"),
        _err(some(F.exists(F.map_values("rights"), lambda v: F.length(v) > MAX_RIGHT)), "rights", f"values must have at most {MAX_RIGHT} characters"),
        *[F.when(right(n).isNotNull() & U.url_problem(right(n)).isNotNull(), F.struct(F.lit(f"rights.{n}").alias("path"), U.url_problem(right(n)).alias("message"))) for n in ("license_url", "terms_url")],
        _err(some(F.size(F.array_except(F.map_keys("rights"), F.array(*[F.lit(k) for k in RIGHTS_KEYS]))) > 0), "rights", "has an unknown key"),
    ]
    # the sources of a record may break different rules of addresses; each rule is told once
    told = F.array_distinct(F.array_compact(F.transform(F.coalesce("provenance", F.array().cast(records.schema["provenance"].dataType)), lambda p: U.url_problem(p["source_url"], https_only=True))))
    sources = F.transform(told, lambda m: F.struct(F.lit("provenance.source_url").alias("path"), m.alias("message")))
    # descriptions are the longest values and cheap to check: that is done before rows are moved, so they stay where they are
    rows = records.withColumn("__described", F.array_compact(F.array(*text("description", MAX_TEXT, True)))).drop("description")
    return spread(rows, key).select(key, F.inline(F.concat("__described", F.array_compact(F.array(*checks)), sources)))


def repeated_keys(records: DataFrame, by: Column, path: str, message: str, key: str = "row_id") -> DataFrame:
    """key, path, message of every row but the smallest of those with an equal value of by; null is equal to nothing.

    The first of a value is found by an aggregation, not by a window, so one value may
    hold any share of the rows.
    """
    from .skew import FLOOR, heavy_keys, skew_join

    rows = records.select(key, by.alias("__by")).where(F.col("__by").isNotNull())
    first = rows.groupBy("__by").agg(F.min(key).alias("__first"), F.count(F.lit(1)).alias("__n")).where(F.col("__n") > 1)
    joined = skew_join(rows, first, ["__by"], heavy=heavy_keys(rows, ["__by"], floor=FLOOR))
    return joined.where(F.col(key) > F.col("__first")).select(key, F.lit(path).alias("path"), F.lit(message).alias("message"))


def catalog_errors(records: DataFrame, key: str = "row_id") -> DataFrame:
    """record_errors, and rows whose id, documentation address, or provider with one of their names another row before them has."""
    from .resolve import identity_tokens

    errors = record_errors(records, key)
    ids = repeated_keys(records, F.lower("id"), "id", "must be unique", key)
    tokens = cut(identity_tokens(records, key))  # made once: forms of names are made in Python
    docs = repeated_keys(tokens.where(F.col("token").startswith("docs:")), F.col("token"), "docs_url", "is the documentation of another record", key)
    names = repeated_keys(tokens.where(F.col("token").startswith("provider-name:")), F.col("token"), "name", "is a name of another record of the provider", key).distinct()
    return errors.unionByName(ids).unionByName(docs).unionByName(names)


def assert_valid(errors: DataFrame, show: int = 20) -> None:
    """Raise with the first messages if there is any error row."""
    rows = errors.limit(show + 1).collect()
    if rows:
        raise ValueError("; ".join(f"{r.path}: {r.message}" for r in rows[:show]) + (" ..." if len(rows) > show else ""))


def out_of_order(records: DataFrame, position: str, value: str) -> DataFrame:
    """position of rows whose value is smaller than that of the position before."""
    before = records.select((F.col(position) + 1).alias(position), F.col(value).alias("__before"))
    return records.join(before, position).where(F.col(value) < F.col("__before")).select(position)


