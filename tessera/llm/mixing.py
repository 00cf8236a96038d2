"""Mixing sources to target shares, with a low-discrepancy schedule.

The mix is a row of slots of equal size in tokens. Slot k takes the source in whose part
of the cumulative targets the point frac((k + 1) * golden ratio) falls, so every stretch
of the schedule is close to the targets. Slots are ranked in each source; the j-th slot
of a source gets the j-th block of that source's stream: its texts in shuffled order, cut
into blocks of the same size, then once more in another order, as often as is allowed.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

GOLDEN = (math.sqrt(5) - 1) / 2
#: Tokens of a slot at most and at least; the smallest share of the mix has so many slots where that allows.
SLOT, LEAST_SLOT, LEAST_SLOTS = 2048, 32, 100
#: Texts of a bucket and slots of a chunk, about: the units of the running sums.
BUCKET, CHUNK = 10_000, 65_536


def _streams(texts: DataFrame, passes: DataFrame, n: int) -> DataFrame:
    """source, rep, pass, middle, n: where the middle of each text is in its source's stream.

    Running sums over a source in hash order, in two steps, so that a source with any
    share of the texts is worked on by many tasks: buckets of a range of hashes, then
    texts inside a bucket.
    """
    buckets = max(1, -(-n // BUCKET))
    each = texts.join(F.broadcast(passes), "source").select("source", "rep", "n", "tokens", F.explode(F.sequence(F.lit(0), F.col("max_repeats") - 1)).alias("pass"))
    h = F.xxhash64("rep", "pass", F.lit("order"))
    each = each.withColumn("h", h).withColumn("bucket", F.floor((F.col("h").cast("double") / 2.0**64 + 0.5) * buckets).cast("int"))
    sums = each.groupBy("source", "pass", "bucket").agg(F.sum("n").alias("s"))
    before = Window.partitionBy("source", "pass").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offset = sums.select("source", "pass", "bucket", F.coalesce(F.sum("s").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("source", "pass", "bucket").orderBy("h", "rep").rowsBetween(Window.unboundedPreceding, -1)
    placed = each.withColumn("run", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(offset, ["source", "pass", "bucket"])
    return placed.select("source", "rep", "pass", "n", (F.col("pass") * F.col("tokens") + F.col("offset") + F.col("run") + F.floor(F.col("n") / 2)).alias("middle"))


def targets_of(targets: DataFrame) -> DataFrame:
    """source, target_share, max_repeats: rows with a source, a positive share and at least one use."""
    ok = targets.where(F.col("source").isNotNull() & (F.col("target_share") > 0) & (F.col("max_repeats") > 0))
    return ok.groupBy("source").agg(F.max("target_share").cast("double").alias("target_share"), F.max("max_repeats").cast("int").alias("max_repeats"))


def mix(sized: DataFrame, targets: DataFrame, key: str = "doc_id", text_id: str = "text_id", slot: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(uses, shares) of the largest mix that keeps to the targets.

    sized: key, source, text_id (equal for equal texts), n_tokens.
    uses: key, source, n_tokens, uses for every row. A text that comes several times in a
    source is one text: its smallest key stands for it, the copies have 0 uses. Sources
    without a target are not used.
    shares: source, target_share, max_repeats, tokens_available, tokens_used,
    actual_share of each target. A source without any tokens cannot give its share; the
    others share the mix in proportion to their targets. The mix is as large as the
    source that runs out first allows, within its repeats. targets is a small table of
    parameters. A share is off its target by a slot and a text of the source at most.
    """
    spark = sized.sparkSession
    want = targets_of(targets)
    rows = cut(sized.select(F.col(key).alias("key"), "source", F.col(text_id).alias("text"), F.col("n_tokens").cast("long").alias("n")))
    reps = rows.where(F.col("source").isNotNull() & (F.col("n") > 0)).groupBy("source", "text").agg(F.min("key").alias("rep"), F.max("n").alias("n"))
    reps = cut(reps.join(F.broadcast(want), "source", "left_semi").select("source", "rep", "n"))
    sums = reps.groupBy("source").agg(F.sum("n").alias("tokens"), F.count(F.lit(1)).alias("texts"))
    plan = want.join(sums, "source", "left").orderBy("source").collect()  # a row a target
    live = [r for r in plan if r.tokens]
    share = sum(r.target_share for r in live)
    size = min((r.max_repeats * r.tokens * share / r.target_share for r in live), default=0.0)
    if slot is None:
        least = min((r.target_share / share for r in live), default=1.0)
        slot = int(min(SLOT, max(LEAST_SLOT, size * least // LEAST_SLOTS)))
    slots = math.floor(size / slot)
    passes = spark.createDataFrame([(r.source, int(r.tokens), r.max_repeats) for r in live], "source string, tokens long, max_repeats int")
    # slots to sources: the bounds are as many as targets
    point = (F.col("k") + 1) * F.lit(GOLDEN)
    point = point - F.floor(point)
    chain, upto = None, 0.0
    for r in live[:-1]:
        upto += r.target_share / share
        chain = F.when(point < upto, r.source) if chain is None else chain.when(point < upto, r.source)
    which = F.lit(live[-1].source if live else None) if chain is None else chain.otherwise(live[-1].source)
    schedule = spark.range(slots).select(F.col("id").alias("k")).select("k", which.cast("string").alias("source"), F.floor(F.col("k") / CHUNK).alias("chunk"))
    per = schedule.groupBy("source", "chunk").agg(F.count(F.lit(1)).alias("c"))
    before = Window.partitionBy("source").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    first = per.select("source", "chunk", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("first"))
    inside = Window.partitionBy("source", "chunk").orderBy("k")
    ranked = schedule.withColumn("r", F.row_number().over(inside) - 1).join(first, ["source", "chunk"]).select("source", (F.col("first") + F.col("r")).alias("block"))
    stream = _streams(reps, passes, sum(r.texts for r in live)).withColumn("block", F.floor(F.col("middle") / slot))
    used = stream.join(ranked, ["source", "block"]).groupBy("source", "rep").agg(F.count(F.lit(1)).alias("uses"))
    uses = rows.join(used.withColumnRenamed("rep", "key"), ["key", "source"], "left")
    uses = cut(uses.select(F.col("key").alias(key), "source", F.col("n").alias("n_tokens"), F.coalesce("uses", F.lit(0)).alias("uses")))
    got = uses.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("uses")).alias("tokens_used"))
    table = spark.createDataFrame([(r.source, r.target_share, r.max_repeats, int(r.tokens or 0)) for r in plan], "source string, target_share double, max_repeats int, tokens_available long")
    all_used = got.agg(F.sum("tokens_used").alias("all"))
    shares = table.join(got, "source", "left").crossJoin(F.broadcast(all_used)).select(
        "source", "target_share", "max_repeats", "tokens_available", F.coalesce("tokens_used", F.lit(0)).alias("tokens_used"),
        F.round(F.coalesce(F.col("tokens_used") / F.nullif("all", F.lit(0)), F.lit(0.0)), 6).alias("actual_share"),
    )
    return uses, shares
