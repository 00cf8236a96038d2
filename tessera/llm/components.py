"""Consolidating pairwise matches into groups by pruning seed trees.

In each round every vertex connects its neighbourhood to the smallest vertex in it.
A vertex that is no one's smallest drops out and hangs on its smallest neighbour in a
propagation forest; the others go on with the edges between the minima they met. When
no edge is left, the smallest vertex of each component is a root, and its identifier
flows down the forest, in the order opposite to that of dropping out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.skew import FLOOR, SHARE, heavy_keys, skew_join
from ..session import cut


def latest_links(pairs: DataFrame, a: str = "row_a", b: str = "row_b", at: str = "decided_at", verdict: str = "verdict", tie: str = "pair_id", wanted: str = "match") -> DataFrame:
    """u < v: pairs of two rows whose latest verdict, in whichever order they are named, is wanted.

    Letter case and outer blanks of verdicts are ignored. Of verdicts of the same moment
    the one with the largest tie column holds; a null moment is before all others. Pairs
    of a row with itself or with null are no links.
    """
    said = F.lower(F.trim(F.regexp_replace(F.coalesce(F.col(verdict), F.lit("")), r"\s+", " ")))
    rows = pairs.where((F.col(a) != F.col(b)) & F.col(a).isNotNull() & F.col(b).isNotNull())
    rows = rows.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v"), F.struct(F.col(at).alias("at"), F.col(tie).alias("tie"), said.alias("said")).alias("d"))
    return rows.groupBy("u", "v").agg(F.max("d").alias("d")).where(F.col("d.said") == wanted).select("u", "v")


def _heavy(df: DataFrame, key: str, rows: int) -> list[tuple]:
    """Keys with more than a small share of rows; there are none in a small table."""
    return heavy_keys(df, [key], SHARE, FLOOR) if rows > FLOOR else []


def components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """vertex, group: each vertex of an edge between two different vertices, with the smallest vertex it reaches.

    Edges may repeat and stand in either order; loops and nulls are ignored; no edge, no row.
    """
    graph = edges.select(F.col(u).alias("x"), F.col(v).alias("y")).where(F.col("x") != F.col("y"))
    graph = cut(graph.select(F.inline(F.array(F.struct("x", "y"), F.struct(F.col("y").alias("x"), F.col("x").alias("y"))))).distinct())
    forest: list[DataFrame] = []
    while left := graph.count():
        # the smallest vertex of each neighbourhood, told to every vertex in it
        least = graph.groupBy("x").agg(F.min("y").alias("y")).select("x", F.least("x", "y").alias("m"))
        told = skew_join(graph, least, ["x"], heavy=_heavy(graph, "x", left)).select(F.col("y").alias("x"), "m")
        told = cut(told.unionByName(least).distinct())
        # what a vertex heard: its smallest, and whether it is a smallest itself
        heard = cut(told.groupBy("x").agg(F.min("m").alias("p"), F.max(F.col("m") == F.col("x")).alias("stays")))
        forest.append(heard.where(~F.col("stays")).select("x", "p"))
        on = skew_join(told, heard.select("x", "p"), ["x"], heavy=_heavy(told, "x", left)).where(F.col("m") != F.col("p")).select(F.col("m").alias("x"), F.col("p").alias("y"))
        graph = cut(on.select(F.inline(F.array(F.struct("x", "y"), F.struct(F.col("y").alias("x"), F.col("x").alias("y"))))).distinct())
    found: DataFrame | None = None
    for level in reversed(forest):
        if found is None:
            found = level.select("x", F.col("p").alias("g"))
        else:
            up = found.select(F.col("x").alias("p"), "g")
            found = cut(found.unionByName(skew_join(level, up, ["p"], "left", heavy=_heavy(level, "p", level.count())).select("x", F.coalesce("g", "p").alias("g"))))
    if found is None:
        kind = dict(edges.dtypes)[u]
        return edges.sparkSession.createDataFrame([], f"vertex {kind}, `group` {kind}")
    roots = found.select(F.col("g").alias("x"), "g").distinct()
    return found.unionByName(roots).select(F.col("x").alias("vertex"), F.col("g").alias("group"))
