import random
from datetime import datetime, timedelta

import numpy as np
from pyspark.sql import functions as F

from tessera.operators import snapshots as S

SCHEMA = "feed_id string, snapshot_no int, id string, name string, tags array<string>, delivered_at timestamp"


def values():
    return {"name": F.col("name"), "tags": F.to_json(F.sort_array("tags"))}



def brute(rows):
    snaps, nos = {}, {}
    for f, n, i, name, tags, at in rows:
        if f is None or n is None:
            continue
        nos.setdefault(f, set()).add(n)
        if i is None:
            continue
        cur = snaps.setdefault((f, n), {})
        if i not in cur or at > cur[i][0]:
            cur[i] = (at, (name, None if tags is None else tuple(sorted(tags))))
    out = set()
    for f, ns in nos.items():
        order = sorted(ns)
        for a, b in zip(order, order[1:]):
            x, y = snaps.get((f, a), {}), snaps.get((f, b), {})
            out |= {(f, b, i, "added") for i in y.keys() - x.keys()} | {(f, b, i, "removed") for i in x.keys() - y.keys()}
            out |= {(f, b, i, "changed") for i in x.keys() & y.keys() if x[i][1] != y[i][1]}
    return out


def run(spark, rows, **kw):
    df = spark.createDataFrame(rows, SCHEMA)
    return {tuple(r) for r in S.snapshot_changes(df.withColumns({"bucket": F.lit(1), "ordinal": F.lit("x"), "feed": F.lit(0)}), "feed_id", "snapshot_no", "id", "delivered_at", values()).select("feed", "no", "id", "change").collect()}


def test_against_brute_force(spark, monkeypatch):
    r = random.Random(5)
    rows = []
    for _ in range(600):
        at = datetime(2025, 1, 1) + timedelta(seconds=r.randrange(10**7))
        rows.append((r.choice(["a", "a", "b", None]), r.choice([1, 2, 4, 7]), r.choice([None, *"uvwxyz"]), r.choice(["n", "m", None]), r.choice([["p", "q"], ["q", "p"], [], None]), at))
    want = brute(rows)
    assert run(spark, rows) == want
    monkeypatch.setattr(S, "BUCKET_ROWS", 7)
    assert run(spark, rows) == want


def test_vanishing_bucket_and_empty(spark):
    at = datetime(2025, 1, 1)
    rows = [("a", 1, "x", "n", None, at), ("a", 2, None, "n", None, at), ("a", 3, "x", "n", None, at)]
    assert run(spark, rows) == {("a", 2, "x", "removed"), ("a", 3, "x", "added")}
    assert run(spark, []) == set()


def test_counts(spark):
    at = datetime(2025, 1, 1)
    snaps = spark.createDataFrame([("a", 1, "x", "n", None, at), ("a", 1, "x", "n", None, at), ("a", 3, "y", "n", None, at), ("a", 3, "z", "n", None, at)], SCHEMA)
    reports = spark.createDataFrame([("a", 1, 0, 1), ("a", 3, 1, 2), ("a", 3, 1, None), ("a", 9, 5, 5), (None, 1, 0, 0)], "feed_id string, snapshot_no int, b long, a long")
    got = S.miscounted(S.current(snaps, "feed_id", "snapshot_no", "id", "delivered_at", values()), reports, "feed_id", "snapshot_no", F.col("b"), F.col("a"))
    assert [tuple(r) for r in got.collect()] == [("a", 3)]


def test_ordinals_are_kept(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(S, "SLOTS", 4)
    store = str(tmp_path / "ordinals")
    at = datetime(2025, 1, 1)
    rows = [(f, n, f"k{i}", "n", None, at) for f in "ab" for n in (1, 2) for i in range(3 * n)]

    def call(rows):
        got = {tuple(r) for r in S.snapshot_changes(spark.createDataFrame(rows, SCHEMA), "feed_id", "snapshot_no", "id", "delivered_at", values(), store).collect()}
        return got, {(r.feed, r.id): r.ordinal for r in spark.read.parquet(store).collect()}

    got, first = call(rows)
    assert got == brute(rows) and len(first) == 12 and len({(f, o) for (f, _), o in first.items()}) == 12
    # keys before, between and after the old ones, and old ones that are gone: no number changes or comes twice
    more = [(f, n, i, "m", None, at) for f in "abc" for n in (3, 4) for i in ("a", "k00", "k1", "k4", "z", *(f"x{j}" for j in range(n * 3)))]
    got, second = call(more)
    assert got == brute(more) and second.items() >= first.items()
    assert len({(f, o) for (f, _), o in second.items()}) == len(second) == spark.read.parquet(store).count()
    assert call(more)[1] == second


def test_values_are_compared_exactly(spark):
    at = datetime(2025, 1, 1)
    rows = [("a", n, i, name, tags, at) for i, x, y in (("p", ("n", []), ("n", [""])), ("q", ("n", None), ("n", [])), ("r", (None, ["t"]), ("", ["t"])), ("s", ("n", ["t", "u"]), ("n", ["u", "t"]))) for n, (name, tags) in ((1, x), (2, y))]
    assert run(spark, rows) == {("a", 2, i, "changed") for i in "pqr"}


def test_bitmap():
    r = np.random.default_rng(1)
    for n, m in ((10, 200_000), (50_000, 60_000), (30_000, 65_536), (0, 5)):
        a, b = (np.unique(r.integers(0, m, n)) for _ in range(2))
        x, y = S.Bitmap.of(a), S.Bitmap.of(b)
        assert np.array_equal(x.and_not(y).ordinals(), np.setdiff1d(a, b))
        assert np.array_equal(x.both(y).ordinals(), np.intersect1d(a, b))


def test_diff_sees_tags(spark, tiny, tmp_path):
    """Ids of which only the tags differ are found, in whatever order they come."""
    import duckdb

    from tessera import queries

    def kept(r):
        return tuple(r[c] for c in ("name", "description", "provider", "docs_url", "auth_type", "https", "cors", "status"))

    def tags(r):
        return None if r["tags"] is None else sorted(r["tags"], key=lambda t: (t is not None, t))

    def tag_only(rows):
        ends, last = {}, {}
        for r in rows:
            ends.setdefault(r["feed_id"], set()).add(r["snapshot_no"])
            k = r["feed_id"], r["snapshot_no"], r["id"]
            if k not in last or r["delivered_at"] > last[k]["delivered_at"]:
                last[k] = r
        out = set()
        for (f, n, i), r in last.items():
            new = last.get((f, max(ends[f]), i))
            if n == min(ends[f]) and new and kept(r) == kept(new) and tags(r) != tags(new):
                out.add((f, i, "changed"))
        return out

    base = "feed_id string, snapshot_no int, id string, name string, description string, provider string, docs_url string, auth_type string, https string, cors string, status string, tags array<string>, delivered_at timestamp"
    import datetime

    at = datetime.datetime(2025, 1, 1)
    row = lambda no, i, t: ("f", no, i, "n", None, "p", "u", "none", "yes", "no", "active", t, at)
    small = [row(n, i, t) for i, a, b in (("same", ["x", "y"], ["y", "x"]), ("more", ["x"], ["x", "y"]), ("null", None, []), ("hole", ["x", None], ["x"]), ("twice", ["x"], ["x", "x"])) for n, t in ((1, a), (3, b))]
    spark.createDataFrame(small, base).write.parquet(f"{tmp_path}/catalog_snapshots.parquet")
    for folder, most in ((str(tmp_path), "/*.parquet"), (tiny, "")):
        rows = [r.asDict() for r in queries.read(spark, folder, "catalog_snapshots").collect()]
        got = [tuple(r) for r in queries.snapshot_diff(spark, folder).select("feed_id", "id", "change").collect()]
        db = duckdb.connect()
        db.execute(f"CREATE VIEW catalog_snapshots AS SELECT * FROM read_parquet('{folder}/catalog_snapshots.parquet{most}')")
        sql = set(db.execute(queries.DIFF_SQL).fetchall())
        assert len(got) == len(set(got)) and set(got) == sql and tag_only(rows) <= set(got)
    assert {r[1] for r in tag_only(small and [dict(zip([c.split()[0] for c in base.split(", ")], r)) for r in small])} == {"more", "null", "hole", "twice"}
