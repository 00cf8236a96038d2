"""Joins that stay balanced when one key holds a large part of the rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is heavy when it holds more than this share of the rows; so fewer than 1 / SHARE keys are heavy, whatever the data.
SHARE = 1 / 500
#: Below this number of rows no key is called heavy.
FLOOR = 20_000


def heavy_keys(df: DataFrame, keys: list[str], share: float = SHARE, floor: int = FLOOR) -> list[tuple]:
    """Keys of df with more than max(floor, share * rows) rows.

    At most 1 / share keys reach the driver, whatever the data. Null keys are left
    out, as they join with nothing.
    """
    counts = df.dropna(subset=keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > floor)
    total = df.count() if floor else 0
    rows = counts.where(F.col("__n") > max(floor, share * total)).select(*keys).collect()
    return [tuple(r) for r in rows]


def is_heavy(keys: list[str], heavy: list[tuple]):
    """Whether the row's key is among the heavy ones (at most 1 / SHARE, so a literal list)."""
    if not heavy:
        return F.lit(False)
    if len(keys) == 1:
        return F.coalesce(F.col(keys[0]).isin([h[0] for h in heavy]), F.lit(False))
    each = [reduce(lambda a, b: a & b, [F.col(k) == F.lit(v) for k, v in zip(keys, h, strict=True)]) for h in heavy]
    return F.coalesce(reduce(lambda a, b: a | b, each), F.lit(False))


def skew_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", heavy: list[tuple] | None = None) -> DataFrame:
    """left join right, where right has one row a key.

    Rows of heavy keys meet the few rows of right with those keys in a broadcast of
    at most 1 / SHARE rows; all others are joined by a shuffle. how: inner or left.
    """
    heavy = heavy_keys(left, keys) if heavy is None else heavy
    if not heavy:
        return left.join(right, keys, how)
    hot = is_heavy(keys, heavy)
    few = right.where(is_heavy(keys, heavy))
    return left.where(~hot).join(right, keys, how).unionByName(left.where(hot).join(F.broadcast(few), keys, how))
