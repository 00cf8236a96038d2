"""Checks of a whole delivery: where its records come from, that they agree, that its report fits, and what each step left."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import snapshots
from .quality import _err


@dataclass(frozen=True)
class SourcePolicy:
    """What records of one published source must say. url: the source's address, with {revision} where the revision stands; rights: all of the rights map."""

    source_id: str
    url: str
    license: str
    tier: str = "public"
    auth_source: str | None = None
    rights: tuple[tuple[str, str], ...] = ()


def policy_errors(records: DataFrame, policy: SourcePolicy, key: str = "row_id") -> DataFrame:
    """key, path, message of records that hold anything but the metadata of the policy's source: each rule once a record; null lists break none of the rules on their entries."""
    any_of = lambda c, bad: F.coalesce(F.exists(c, lambda x: F.coalesce(bad(x), F.lit(True))), F.lit(False))
    start, end = policy.url.split("{revision}")
    rights = F.array_sort(F.map_entries("rights"))
    wanted = F.array(*[F.struct(F.lit(k).alias("key"), F.lit(v).alias("value")) for k, v in sorted(policy.rights)]) if policy.rights else F.array().cast("array<struct<key:string,value:string>>")
    checks = [
        _err(F.col("source_tier") != policy.tier, "source_tier", f"must be {policy.tier}"),
        _err(F.col("openapi").isNotNull(), "openapi", "must be null"),
        _err(rights != wanted, "rights", "must be those of the source"),
        *([_err(any_of("auth", lambda a: a["source"] != policy.auth_source), "auth.source", f"must be {policy.auth_source}")] if policy.auth_source else []),
        _err(any_of("provenance", lambda p: p["source_id"] != policy.source_id), "provenance.source_id", f"must be {policy.source_id}"),
        _err(any_of("provenance", lambda p: ~p["revision"].rlike("^[0-9a-f]{40}$")), "provenance.revision", "must be a full commit"),
        _err(any_of("provenance", lambda p: p["source_url"] != F.concat(F.lit(start), p["revision"], F.lit(end))), "provenance.source_url", "must be pinned to the revision"),
        _err(any_of("provenance", lambda p: p["license"] != policy.license), "provenance.license", f"must be {policy.license}"),
        _err(F.coalesce(F.exists("provenance", lambda p: ~p["retrieved_at"].eqNullSafe(F.col("last_checked_at"))), F.lit(False)), "last_checked_at", "must be the time the source was retrieved at"),
    ]
    return records.select(key, F.inline(F.array_compact(F.array(*checks))))


def disagreements(records: DataFrame, lists: dict[str, Column]) -> DataFrame:
    """path, message of each of lists whose entries, over all records, are not one value; null is a value.

    lists: arrays of text by the path that is shown. One aggregation of two values each, so
    a path with any number of different values is no burden.
    """
    ends = [F.min(F.array_min(c)).alias(f"lo{k}") for k, c in enumerate(_filled(lists))] + [F.max(F.array_max(c)).alias(f"hi{k}") for k, c in enumerate(_filled(lists))]
    one = records.agg(*ends)
    rows = F.array(*[F.when(F.col(f"lo{k}") != F.col(f"hi{k}"), F.struct(F.lit(path).alias("path"), F.lit("must be one value in all records").alias("message"))) for k, path in enumerate(lists)])
    return one.select(F.inline(F.array_compact(rows)))


def _filled(lists: dict[str, Column]) -> list[Column]:
    return [F.transform(c, lambda x: F.coalesce(x, F.lit("\0"))) for c in lists.values()]


def key_differences(docs: DataFrame, key: str, json: Column, allowed: tuple[str, ...]) -> DataFrame:
    """key, name, problem (missing, unexpected, repeated) for the keys of JSON objects against a closed set; what is no object has the problem "no object", with a null name."""
    found = F.json_object_keys(json)
    wanted = F.array(*[F.lit(k) for k in allowed])
    as_rows = lambda names, problem: F.transform(names, lambda n: F.struct(n.alias("name"), F.lit(problem).alias("problem")))
    again = F.array_distinct(F.filter(found, lambda n: F.size(F.filter(found, lambda m: m == n)) > 1))
    rows = F.when(found.isNotNull(), F.concat(as_rows(F.array_except(wanted, found), "missing"), as_rows(F.array_except(found, wanted), "unexpected"), as_rows(again, "repeated")))
    none = F.array(F.struct(F.lit(None).cast("string").alias("name"), F.lit("no object").alias("problem")))
    return docs.select(key, F.inline(F.coalesce(rows, none)))


def report_errors(s: snapshots.Snapshots, reports: DataFrame, feed: str, no: str, counts: str = "counts", version: str = "catalog_version") -> DataFrame:
    """feed, no, path, message of reports that don't fit their snapshot; reports of snapshots that are not there have one row that says so.

    Counts are compared with the snapshot and the one before it; a step of the pipeline
    can't have made records, so normalized must not be above parsed.
    """
    real = snapshots.counts_of(s)
    r = reports.select(F.col(feed).alias("feed"), F.col(no).cast("int").alias("no"), F.col(counts).alias("counts"), F.col(version).alias("version")).dropna(subset=["feed", "no"])
    r = r.join(real.withColumn("there", F.lit(True)), ["feed", "no"], "left")
    there = F.coalesce("there", F.lit(False))
    c = lambda n: F.col(f"counts.{n}")
    row = lambda bad, path, message: F.when(bad, F.struct(F.lit(path).alias("path"), F.lit(message).alias("message")))
    given = there & F.col("counts").isNotNull()
    checks = [
        row(~there, "snapshot_no", "has no snapshot"),
        row(there & ~F.coalesce(F.col("version").rlike("^v1-[0-9a-f]{16}$"), F.lit(False)), "catalog_version", "must be v1- and 16 hex digits"),
        row(there & F.col("counts").isNull(), "counts", "must be an object"),
        row(given & ~c("after").eqNullSafe(F.col("after")), "counts.after", "does not match the snapshot"),
        row(given & ~c("before").eqNullSafe(F.col("before")), "counts.before", "does not match the snapshot before"),
        row(given & F.coalesce(c("normalized") > c("parsed"), F.lit(False)), "counts.normalized", "is above parsed"),
    ]
    return r.select("feed", "no", F.inline(F.array_compact(F.array(*checks)))).distinct()


def pipeline_counts(before: DataFrame, parsed: DataFrame, normalized: DataFrame, after: DataFrame) -> DataFrame:
    """One row: how many records there were, and how many each step left."""
    one = None
    for name, df in (("before", before), ("parsed", parsed), ("normalized", normalized), ("after", after)):
        n = df.agg(F.count(F.lit(1)).alias(name))
        one = n if one is None else one.crossJoin(n)
    return one


def first_errors(errors: DataFrame, most: int = 100) -> DataFrame:
    """The first errors in the order of their columns, and one row that says so if there are more."""
    order = errors.columns
    top = errors.orderBy(*order).limit(most + 1)
    ranked = top.withColumn("__k", F.row_number().over(_by(order)))
    stop = F.lit(f"stopped after {most} errors")
    return ranked.select(*[F.when(F.col("__k") <= most, F.col(c)).otherwise(stop if c == "message" else None).alias(c) for c in order])


def _by(order: list[str]):
    from pyspark.sql import Window

    return Window.orderBy(*order)  # of a bounded number of rows
