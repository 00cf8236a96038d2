"""The best representative of each group of duplicates, field by field.

Where the order of a field's values is declared in full (more knowledge, then the latest
moment, then the smallest row), nothing is left to learn: survivors() takes the greatest
row of each group in that order.

Currency reasoning serves closed fields, for which no order is declared. Timestamped rows
of one group that show value a only before value b vote for a -> b; over all groups the
winning transitions form a precedence graph of the field's values, which places values of
rows without a time stamp (current_values()).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.times import is_rfc3339, rfc3339_micros

#: Words that say that nothing is known (in lower case).
NOTHING = ["", "unknown", "not known", "n/a", "na", "not available", "tbd", "tba", "to be determined", "unspecified", "undefined", "null", "nil", "-", "--", "?"]
BLANKS = " \t\n\r\x0b\x0c\u00a0\u3000"
BEFORE_ALL = -(1 << 62)


def known(text: Column) -> Column:
    """Whether a text says something: not null, not blank, none of NOTHING. Never null."""
    return F.coalesce(~F.lower(F.regexp_replace(text, r"^[\s ]+|[\s ]+$", "")).isin(NOTHING), F.lit(False))


#: Without effect, as survivors() has no states any more; a test of it still sets this name.
MOST_STATES = 64


def survivors(rows: DataFrame, key: str, row_id: str, moment: Column, scores: dict[str, Column], least: int = 2) -> DataFrame:
    """key, field, row_id: for each field the row whose value survives in the group.

    scores: by field, how much the row's value knows (0 or null: no value). The row that
    knows most survives; of several the latest, rows without a moment being before all
    others; of equals the smallest row_id. No two rows are left open, so nothing is learned
    here. Groups of fewer than least rows, null keys and fields without any value give no
    row. One aggregation, reduced before the shuffle, so a group may hold any share of the
    rows.
    """
    lean = rows.where(F.col(key).isNotNull()).select(key, row_id, F.coalesce(moment, F.lit(BEFORE_ALL)).alias("__at"), *[F.coalesce(s.cast("long"), F.lit(0)).alias(f"__s{k}") for k, s in enumerate(scores.values())])
    order = lambda k: F.struct(F.col(f"__s{k}").alias("s"), F.col("__at").alias("t"), (-F.col(row_id)).alias("r"))
    best = lean.groupBy(key).agg(F.count(F.lit(1)).alias("__n"), *[F.max(order(k)).alias(f"__f{k}") for k in range(len(scores))])
    each = F.array(*[F.struct(F.lit(name).alias("field"), F.col(f"__f{k}").alias("b")) for k, name in enumerate(scores)])
    out = best.where(F.col("__n") >= least).select(key, F.inline(each)).where(F.col("b.s") > 0)
    return out.select(key, "field", (-F.col("b.r")).alias(row_id))


# ---- learned order -------------------------------------------------------------------


def transitions(rows: DataFrame, key: str, moment: Column, fields: dict[str, list[str]]) -> DataFrame:
    """field, a, b, votes: groups whose dated rows show value a only before value b.

    fields: by name, the values of a closed domain; others are no evidence. Rows are
    first reduced to a span of moments for each group and value, so pairs are formed of
    at most a domain's values, never of rows.
    """
    return votes_of(_values(rows, key, moment, fields).where(F.col("at").isNotNull()))


def votes_of(dated: DataFrame) -> DataFrame:
    """field, a, b, votes of dated values (key, field, value, at)."""
    spans = dated.groupBy("key", "field", "value").agg(F.min("at").alias("lo"), F.max("at").alias("hi"))
    all_of = spans.groupBy("key", "field").agg(F.collect_list(F.struct("value", "lo", "hi")).alias("vs")).where(F.size("vs") > 1)
    pairs = all_of.select("field", F.explode("vs").alias("x"), "vs").select("field", "x", F.explode("vs").alias("y")).where(F.col("x.hi") < F.col("y.lo"))
    return pairs.groupBy("field", F.col("x.value").alias("a"), F.col("y.value").alias("b")).agg(F.count(F.lit(1)).alias("votes"))


def precedence(votes: list[tuple], declared: list[tuple] = ()) -> dict[str, dict]:
    """By field and value, the values after it.

    votes: (field, a, b, number) for a before b. declared: (field, a, b) that hold whatever
    the votes say. Then transitions that win against their reverse, strongest first, none
    that closes a circle.
    """
    count = {(f, a, b): n for f, a, b, n in votes}
    learned = sorted(((n - count.get((f, b, a), 0), f, a, b) for (f, a, b), n in count.items()), key=lambda e: (-e[0], e[1:]))
    after: dict[str, dict] = {}
    # the last declared edge first, so that each one adds to few sets
    for won, f, a, b in [*[(1, *d) for d in reversed(declared)], *learned]:
        graph = after.setdefault(f, {})
        if won <= 0 or a in graph.get(b, ()) or b in graph.get(a, ()):
            continue
        later = {b} | graph.get(b, set())
        for x in [a, *[v for v, s in graph.items() if a in s]]:
            graph[x] = graph.get(x, set()) | later
    return after


def _values(rows: DataFrame, key: str, moment: Column, fields: dict[str, list[str]], row_id: str | None = None) -> DataFrame:
    each = F.array(*[F.struct(F.lit(f).alias("field"), F.when(F.col(f).isin(vs), F.col(f)).alias("value")) for f, vs in fields.items()])
    rid = F.col(row_id) if row_id else F.lit(None).cast("long")
    return rows.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), rid.alias("rid"), moment.alias("at"), F.inline(each)).where(F.col("value").isNotNull())


def current_values(rows: DataFrame, key: str, row_id: str, moment: Column, fields: dict[str, list[str]]) -> DataFrame:
    """key, field, value, row_id, basis: the current value of each closed field in each group.

    The latest dated value holds ("dated"), unless an undated row has a value which the
    learned precedence puts after it, or no row is dated: then the topologically latest
    of these ("learned"; of equals the one in most rows, then the smallest). The graph has at most the
    square of a domain's values, which is written down in fields.
    """
    spark = rows.sparkSession
    after = precedence([tuple(r) for r in transitions(rows, key, moment, fields).collect()])
    depth = {(f, v): len([x for x, s in after.get(f, {}).items() if v in s]) for f, vs in fields.items() for v in vs}
    learned = [(f, v, depth[f, v], sorted(after.get(f, {}).get(v, ()))) for f, vs in fields.items() for v in vs]
    graph = F.broadcast(spark.createDataFrame(learned, "field string, value string, depth int, later array<string>"))
    # a row for each group, field and value: at most a domain's values for a group
    per = _values(rows, key, moment, fields, row_id).groupBy("key", "field", "value").agg(
        F.max("at").alias("at"), F.count(F.lit(1)).alias("n"), F.sum(F.isnull("at").cast("int")).alias("undated"),
        F.min(F.when(F.isnull("at"), F.col("rid"))).alias("rid_undated"), F.max(F.struct(F.coalesce("at", F.lit(BEFORE_ALL)).alias("t"), (-F.col("rid")).alias("r"))).alias("top"),
    ).join(graph, ["field", "value"])
    group = per.groupBy("key", "field").agg(
        F.max_by(F.struct("value", (-F.col("top.r")).alias("rid"), "later"), F.struct(F.col("top.t").alias("t"), F.col("top.r").alias("r"))).alias("d"),
        F.max("at").alias("any"),
        F.collect_list(F.when(F.col("undated") > 0, F.struct("depth", "n", (-F.col("rid_undated")).alias("r"), "value"))).alias("us"),
    )
    fit = F.when(F.col("any").isNull(), F.col("us")).otherwise(F.filter("us", lambda u: F.array_contains(F.col("d.later"), u["value"])))
    best = F.array_max(fit)
    got = group.withColumn("u", best)
    return got.select(
        F.col("key").alias(key), "field",
        F.coalesce(F.col("u.value"), F.col("d.value")).alias("value"),
        F.coalesce(-F.col("u.r"), F.col("d.rid")).alias(row_id),
        F.when(F.col("u").isNull(), "dated").otherwise("learned").alias("basis"),
    )


# ---- the catalogue's own fields --------------------------------------------------------


def catalog_moment() -> Column:
    """Microseconds of last_checked_at where it is a valid moment not after the row's own arrival, else null."""
    at = rfc3339_micros(F.col("last_checked_at"))
    return F.when(at <= F.unix_micros(F.col("ingested_at").cast("timestamp")), at)


def catalog_scores() -> dict[str, Column]:
    """How much a row knows in each of auth, last_checked_at, provenance and rights."""
    five = F.transform("provenance", lambda p: F.struct(p["source_id"], p["source_url"], p["revision"], p["retrieved_at"], p["content_hash"]))
    whole = F.filter(
        five,
        lambda p: F.coalesce(
            known(p["source_id"]) & known(p["source_url"]) & known(p["revision"]) & is_rfc3339(p["retrieved_at"]) & p["content_hash"].rlike("^[0-9a-fA-F]{64}$"),
            F.lit(False),
        ),
    )
    return {
        "auth": F.size(F.array_distinct(F.filter("auth", lambda a: known(a["type"])))),
        "last_checked_at": catalog_moment().isNotNull().cast("int"),
        "provenance": F.size(F.array_distinct(whole)),
        "rights": F.size(F.map_keys(F.map_filter("rights", lambda k, v: known(v)))),
    }


def catalog_survivors(records: DataFrame) -> DataFrame:
    """id, field, row_id of the surviving values of catalogue records."""
    return survivors(records, "id", "row_id", catalog_moment(), catalog_scores())


#: Closed domains of the record schema ("unknown" is no value).
CLOSED = {"status": ["active", "coming_soon", "stale", "candidate"], "https": ["yes", "no"], "cors": ["yes", "no"], "source_tier": ["public", "apilayer"]}
