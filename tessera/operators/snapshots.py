"""What changed between full snapshots of a table.

Every key of a feed gets an ordinal that it keeps through all snapshots, and through all
calls that name the same table of ordinals. A snapshot is a compressed bitmap of ordinals:
AND-NOT with the neighbour gives the keys added and removed, AND gives the common ones,
whose values are compared in column vectors that are aligned by ordinal. Feeds are spread
over buckets, and the keys of a large feed over several by hash, so that a feed with a
third of all rows is worked on by many tasks; bitmaps of a bucket stand on their own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut, partitions_for
from .skew import FLOOR, SHARE, is_heavy, skew_join

#: Rows of a bucket, about; a bucket is held by one Python worker at a time.
BUCKET_ROWS = 40_000
#: Keys of a feed are numbered in so many slots by hash, each on its own: an ordinal is SLOTS times the number in the slot, plus the slot.
SLOTS = 4096
#: A table of so many snapshots at most is broadcast; a row has four numbers and the feed's name.
MOST_CHAIN = 100_000
_CHUNK, _SPARSE = 1 << 16, 4096


class Bitmap:
    """A set of ordinals in chunks of 65,536: a sorted array where few are set, else packed bits."""

    def __init__(self, chunks: dict[int, np.ndarray] | None = None):
        self.chunks = chunks or {}

    @staticmethod
    def _pack(low: np.ndarray) -> np.ndarray:
        if len(low) <= _SPARSE:
            return low.astype(np.uint16)
        bits = np.zeros(_CHUNK, np.uint8)
        bits[low] = 1
        return np.packbits(bits)

    @staticmethod
    def _low(chunk: np.ndarray) -> np.ndarray:
        return chunk if chunk.dtype == np.uint16 else np.flatnonzero(np.unpackbits(chunk))

    @classmethod
    def of(cls, ordinals: np.ndarray) -> Bitmap:
        ordinals = np.unique(ordinals)
        high = ordinals >> 16
        return cls({int(h): cls._pack(ordinals[high == h] & (_CHUNK - 1)) for h in np.unique(high)})

    def _with(self, other: Bitmap, sparse, dense, keep_alone: bool) -> Bitmap:
        out = {}
        for h, a in self.chunks.items():
            b = other.chunks.get(h)
            if b is None:
                if keep_alone:
                    out[h] = a
            elif a.dtype == np.uint8 and b.dtype == np.uint8:
                out[h] = self._pack(np.flatnonzero(np.unpackbits(dense(a, b))))
            else:
                out[h] = self._pack(sparse(self._low(a).astype(np.int64), self._low(b).astype(np.int64)))
        return Bitmap({h: c for h, c in out.items() if len(c)})

    def and_not(self, other: Bitmap) -> Bitmap:
        return self._with(other, lambda a, b: np.setdiff1d(a, b, True), lambda a, b: a & ~b, True)

    def both(self, other: Bitmap) -> Bitmap:
        return self._with(other, lambda a, b: np.intersect1d(a, b, True), lambda a, b: a & b, False)

    def ordinals(self) -> np.ndarray:
        parts = [(h << 16) + self._low(c).astype(np.int64) for h, c in sorted(self.chunks.items())]
        return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def _whole_buckets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One frame a bucket, from batches of rows that are sorted by bucket."""
    held: list[pd.DataFrame] = []
    for pdf in batches:
        if len(pdf):
            edges = np.flatnonzero(np.diff(pdf["bucket"].to_numpy())) + 1
            for part in np.split(np.arange(len(pdf)), edges):
                one = pdf.iloc[part]
                if held and held[0]["bucket"].iloc[0] != one["bucket"].iloc[0]:
                    yield pd.concat(held)
                    held = []
                held.append(one)
    if held:
        yield pd.concat(held)


def _bucket_changes(values: list[str]):
    def all_changes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in _whole_buckets(batches):
            yield changes(pdf)

    def changes(pdf: pd.DataFrame) -> pd.DataFrame:
        out: list[pd.DataFrame] = []
        for feed, rows in pdf.groupby("feed", sort=False):
            rows = rows.sort_values("no", kind="stable")
            # where an ordinal stands in the vectors of this bucket
            known, at = np.unique(rows["ordinal"].to_numpy(np.int64), return_inverse=True)
            ids = np.empty(len(known), object)
            ids[at] = rows["id"].to_numpy()
            columns = [rows[v].to_numpy(object) for v in values]
            ends = np.flatnonzero(np.append(np.diff(rows["no"].to_numpy()) != 0, True)) + 1

            def tell(no: int, ordinals: np.ndarray, change: str, feed=feed, ids=ids, known=known) -> None:
                if len(ordinals):
                    out.append(pd.DataFrame({"feed": feed, "no": no, "id": ids[np.searchsorted(known, ordinals)], "change": change}))

            seen: tuple[int, Bitmap, list[np.ndarray], int | None] | None = None
            for start, end in zip(np.append(0, ends[:-1]), ends, strict=True):
                first, places = rows.iloc[start], at[start:end]
                no, here, vectors = int(first["no"]), Bitmap.of(known[places]), []
                for column in columns:
                    vector = np.full(len(known), None, object)
                    vector[places] = column[start:end]
                    vectors.append(vector)
                before, after = first["prev"], first["next"]
                old = seen if seen is not None and not pd.isna(before) and seen[0] == int(before) else None
                if not pd.isna(before):
                    tell(no, here.and_not(old[1] if old else Bitmap()).ordinals(), "added")
                if old:
                    tell(no, old[1].and_not(here).ordinals(), "removed")
                    common = here.both(old[1]).ordinals()
                    place = np.searchsorted(known, common)
                    differs = np.zeros(len(common), bool)
                    for a, b in zip(vectors, old[2], strict=True):
                        differs |= (a[place] != b[place]).astype(bool)
                    tell(no, common[differs], "changed")
                if seen is not None and not old:
                    # the snapshot after the last one has no key of this bucket
                    tell(seen[3], seen[1].ordinals(), "removed")
                seen = (no, here, vectors, None if pd.isna(after) else int(after))
            if seen is not None and seen[3] is not None:
                tell(seen[3], seen[1].ordinals(), "removed")
        return pd.concat(out) if out else pd.DataFrame({"feed": [], "no": [], "id": [], "change": []}).astype({"no": "int32"})

    return all_changes


@dataclass
class Snapshots:
    """Full snapshots, each key once. rows: feed, no, prev, next, id, ordinal, v0, v1, ..., bucket; buckets are whole in a partition and sorted in it.
    chain: feed, no, prev, next (the neighbours present in the feed), rows (keys); a row a snapshot."""

    rows: DataFrame
    chain: DataFrame
    values: list[str]


def current(snaps: DataFrame, feed: str, no: str, key: str, delivered: str, values: dict[str, Column], store: str | None = None) -> Snapshots:
    """The snapshots of a table of deliveries: of the rows of a key in a snapshot, the one delivered last holds.

    Rows without feed or number are left out; a snapshot of which all keys are null is
    present, and empty. Of rows delivered at the same moment the one with the largest values
    holds; a null moment is before any other. Rows are shuffled once, to their bucket; only
    keys that were sent very often are put together before. The result is written to the
    checkpoint folder.
    store: folder of the table of ordinals (feed, id, ordinal). Keys in it keep their
    ordinals, new ones are added to it. Without it ordinals hold for this call.
    """
    spark = snaps.sparkSession
    names = [f"v{k}" for k in range(len(values))]
    rows = snaps.where(F.col(feed).isNotNull() & F.col(no).isNotNull())
    row = F.struct(F.col(delivered).alias("at"), *[v.cast("string").alias(n) for n, v in zip(names, values.values(), strict=True)])
    rows = rows.select(F.col(feed).alias("feed"), F.col(no).cast("int").alias("no"), F.col(key).cast("string").alias("id"), row.alias("row"))
    slot = F.pmod(F.xxhash64("id"), F.lit(SLOTS))
    sent = cut(rows.groupBy("feed", "no").agg(F.count("id").alias("n")))
    w = Window.partitionBy("feed").orderBy("no")
    parts = F.greatest(F.lit(1), F.ceil(F.sum("n").over(Window.partitionBy("feed")) / BUCKET_ROWS)).cast("int")
    chain = cut(sent.select("feed", "no", F.lag("no").over(w).alias("prev"), F.lead("no").over(w).alias("next"), "n", parts.alias("parts")))
    size, total = chain.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    most = max(FLOOR, SHARE * total)
    # slots of a feed in which a key may have been sent very often: fewer than 1 / SHARE
    hot = [tuple(r) for r in rows.where(F.col("id").isNotNull()).groupBy("feed", slot.alias("slot")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select("feed", "slot").collect()] if total > FLOOR else []
    rows = rows.where(F.col("id").isNotNull()).withColumn("slot", slot)
    if hot:
        again = is_heavy(["feed", "slot"], hot)
        rows = rows.where(~again).unionByName(rows.where(again).groupBy("feed", "no", "id", "slot").agg(F.max("row").alias("row")))
    links = chain.drop("n")
    if size <= MOST_CHAIN:
        rows = rows.join(F.broadcast(links), ["feed", "no"])
    else:
        rows = skew_join(rows, links, ["feed", "no"], heavy=[tuple(r) for r in chain.where(F.col("n") > most).select("feed", "no").collect()])
    # a small feed is whole in one bucket, a large one is in as many as its rows are worth
    buckets = max(1, -(-total // BUCKET_ROWS))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("feed", F.pmod("slot", "parts")), F.lit(buckets)).cast("int")).drop("parts")
    rows = rows.repartition(partitions_for(spark, buckets), "bucket")
    rows = rows.groupBy("bucket", "feed", "no", "id").agg(F.max("row").alias("row"), *[F.first(c).alias(c) for c in ("slot", "prev", "next")])
    known = None
    if store is not None:
        try:
            known = cut(spark.read.parquet(store))
        except AnalysisException:  # the first call
            known = spark.createDataFrame([], "feed string, id string, ordinal long")
    rows = with_ordinals(rows, known).select("bucket", "feed", "no", "id", "prev", "next", "ordinal", *[f"row.{n}" for n in names])
    rows = cut((rows if known is None else rows.repartition(partitions_for(spark, buckets), "bucket")).sortWithinPartitions("bucket", "feed", "no"))
    if known is not None:
        rows.select("feed", "id", "ordinal").distinct().join(known, ["feed", "id"], "left_anti").write.mode("append").parquet(store)
    counts = rows.groupBy("feed", "no").agg(F.count(F.lit(1)).alias("rows"))
    chain = cut(chain.select("feed", "no", "prev", "next").join(counts, ["feed", "no"], "left").withColumn("rows", F.coalesce("rows", F.lit(0))))
    return Snapshots(rows, chain, names)


def with_ordinals(rows: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """rows (bucket, feed, id, slot, ...) with the ordinal of each key: the one in known (feed, id, ordinal), else the next free one of its slot.

    Keys of a bucket lie together, so keys are numbered without another shuffle.
    """
    slot = Window.partitionBy("bucket", "feed", "slot")
    if known is None:
        return rows.withColumn("ordinal", (F.dense_rank().over(slot.orderBy("id")) - 1) * SLOTS + F.col("slot")).drop("slot")
    # keys that are in none of these snapshots keep their numbers too
    free = known.groupBy("feed", F.pmod("ordinal", F.lit(SLOTS)).alias("slot")).agg((F.max(F.floor(F.col("ordinal") / SLOTS)) + 1).alias("free"))
    rows = rows.join(known.select("feed", "id", F.col("ordinal").alias("had")), ["feed", "id"], "left").join(free, ["feed", "slot"], "left")
    new = F.dense_rank().over(Window.partitionBy("bucket", "feed", "slot", F.col("had").isNull()).orderBy("id")) - 1
    return rows.withColumn("ordinal", F.coalesce("had", (F.coalesce("free", F.lit(0)) + new) * SLOTS + F.col("slot"))).drop("slot", "had", "free")


def changes_of(s: Snapshots) -> DataFrame:
    """feed, no, id, change (added, removed, changed) of each snapshot against the one with the next lower number."""
    return s.rows.mapInPandas(_bucket_changes(s.values), "feed string, no int, id string, change string")


def snapshot_changes(snaps: DataFrame, feed: str, no: str, key: str, delivered: str, values: dict[str, Column], store: str | None = None) -> DataFrame:
    """feed, no, id, change of the snapshots of a table of deliveries (see current, changes_of).

    A feed's first snapshot gives no rows. values: the content compared, by name, exactly;
    null is a value. An empty table gives no rows.
    """
    return changes_of(current(snaps, feed, no, key, delivered, values, store))


def counts_of(s: Snapshots) -> DataFrame:
    """feed, no, before, after: different keys in the snapshot and in the one before it (0 for the first)."""
    before = F.coalesce(F.lag("rows").over(Window.partitionBy("feed").orderBy("no")), F.lit(0))
    return s.chain.select("feed", "no", before.alias("before"), F.col("rows").alias("after"))


def miscounted(s: Snapshots, reports: DataFrame, feed: str, no: str, before: Column, after: Column) -> DataFrame:
    """feed, no of snapshots with a report whose counts are not those of the data; a null count is a wrong one."""
    said = reports.select(F.col(feed).alias("feed"), F.col(no).cast("int").alias("no"), before.alias("b"), after.alias("a"))
    wrong = ~(F.col("b").eqNullSafe(F.col("before")) & F.col("a").eqNullSafe(F.col("after")))
    return said.join(counts_of(s), ["feed", "no"]).where(wrong).select("feed", "no").distinct()
