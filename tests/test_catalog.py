import itertools
import os
import random

import pytest
from pyspark.sql import functions as F

from tessera.functions import records as R
from tessera.functions import urls as U
from tessera.functions.times import is_rfc3339, rfc3339_micros
from tessera.functions.records import RECORD
from tessera.operators import catalog, quality, resolve
from tessera.operators.skew import skew_join
from tessera.sources import catalogs as C


def column(spark, f, values, kind="string"):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k int, v {kind}")
    return [r.x for r in df.select("k", f(F.col("v")).alias("x")).orderBy("k").collect()]


def test_urls(spark):
    v = ["https://A.Example/docs?utm_source=x&lang=en#r", "https://u:p@a.example/", "https://a.example/?Api-Key=1", "ftp://a.example/", None, "", "not a url", "http://a.example:80", "//b.example/x", "c.example/y"]
    assert column(spark, U.safe_public_url, v)[:3] == ["https://a.example/docs?lang=en", None, None]
    assert column(spark, U.canonical_url, v) == ["https://a.example/docs?utm_source=x&lang=en", None, None, None, None, None, None, "http://a.example", "https://b.example/x", "https://c.example/y"]
    p = column(spark, U.url_problem, v)
    assert p[0] is None and "userinfo" in p[1] and p[2].endswith("api_key") and "HTTP(S)" in p[3] and "non-empty" in p[4]
    assert column(spark, lambda c: U.url_problem(c, True), ["http://a.example", "https://a.example:8443/"]) == ["must use HTTPS", "must not use a non-443 port"]
    assert column(spark, lambda c: U.provider_from_url(c, F.lit("f")), ["https://www2.a.example/", "https://api.b.example", None]) == ["a.example", "b.example", "f"]


def test_values(spark):
    assert column(spark, R.tri_state, ["Yes", " n ", "✓", None, "perhaps", "1"]) == ["yes", "no", "yes", "unknown", "unknown", "yes"]
    assert column(spark, R.auth_type, ["`apiKey`", "No", None, "OAuth 2", "X-Mashape-Key", "User-Agent", "TBD", "cookie", "?"]) == ["api_key", "none", "none", "oauth2", "api_key", "user_agent", "unknown", "other", "none"]
    assert column(spark, R.slugify, ["Größe Éa  API!", "ＡＢ", None, "+++"])[:2] == ["grosse-ea-api", "ab"]
    assert column(spark, R.slugify, ["+++"])[0].startswith("item-")
    assert column(spark, R.identity_label, ["Weather API Service", "API"]) == ["weather", "api"]
    assert column(spark, R.canonical_strings, [["b", " A", "a", "", None, "B"], None], "array<string>") == [["A", "B"], []]
    assert column(spark, R.ordered_unique, [["b", "A", "a", " b "], None], "array<string>") == [["b", "A"], []]


def test_times(spark):
    v = ["2025-02-30T10:00:00Z", "2025-01-01T00:00:00Z", "2025-01-01T05:30:00.5+05:30", "2025-04-09T25:10:00Z", "yesterday", None, "", "2025-01-01T00:00:00", "2025-01-01t00:00:00z"]
    assert column(spark, is_rfc3339, v) == [False, True, True, False, False, False, False, False, True]
    t = 1735689600_000_000
    assert column(spark, rfc3339_micros, v) == [None, t, t + 500_000, None, None, None, None, None, t]


def groups_of(n, pairs):
    g = list(range(n))
    for _ in range(n):
        for a, b in pairs:
            g[a] = g[b] = min(g[a], g[b])
    return g


def test_linked(spark):
    r = random.Random(3)
    for n, m in ((30, 20), (40, 60)):
        pairs = [(r.randrange(n), r.randrange(n)) for _ in range(m)] + [(k, k + 1) for k in range(5)]
        got = {x.vertex: x.group for x in resolve.linked(spark.createDataFrame(pairs, "a int, b int")).collect()}
        want = groups_of(n, pairs)
        assert got == {v: want[v] for v in set(itertools.chain(*pairs))}
    assert resolve.linked(spark.createDataFrame([], "a int, b int")).count() == 0


def rec(k, id, name, **kw):
    base = dict(zip([c.split()[0] for c in RECORD.replace("\n", " ").split(", ")], [None] * 20))
    base |= {"row_id": k, "id": id, "name": name, "aliases": [], "description": "", "categories": [], "tags": [], "provider": "P", "source_tier": "public", "docs_url": None, "homepage_url": None, "auth": [], "https": "unknown", "cors": "unknown", "status": "unknown", "openapi": None, "provenance": [], "last_checked_at": None, "quality_flags": [], "rights": {}}
    order = "row_id id name aliases description categories tags provider source_tier docs_url homepage_url auth https cors status openapi provenance last_checked_at quality_flags rights".split()
    return tuple((base | kw)[c] for c in order)


def test_groups_and_merge(spark):
    rows = [
        rec(1, "a", "Lake Notes", tags=["x", "B"], auth=[("api_key", "header", "k", "s", 1.0)], https="yes", docs_url="https://c.example/#a"),
        rec(2, "b", "Lake Notes API", tags=["b"], auth=[("unknown", "unknown", "", "s", 0.5)], https="unknown"),
        rec(3, "c", "Other", aliases=["lake notes"], description="text", provider="Q", docs_url="HTTPS://C.example"),
        rec(4, "d", "Alone", provider=None),
        rec(5, None, None, provider=None, aliases=None, tags=None, auth=None, provenance=None, rights=None),
    ]
    df = spark.createDataFrame(rows, RECORD)
    g = resolve.entity_groups(df)
    assert {r.row_id: r.group for r in g.collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5}
    m = {r.group: r for r in resolve.merge_groups(df, g).collect()}
    one = m[1]
    assert (one.id, one.name, one.provider, one.https, one.description) == ("c", "Other", "Q", "yes", "text")
    assert one.tags == ["B", "x"] and one.auth[0].type == "api_key" and one.merged_rows == 3
    assert one.aliases == ["Lake Notes", "Lake Notes API"]
    assert set(m) == {1, 4, 5}


def test_quality(spark):
    df = spark.createDataFrame([rec(1, "a", "A", provider=" ", https="maybe", tags=["b", "a"]), rec(2, "A", "B", docs_url="https://u@c.example/")], RECORD)
    got = {(r.row_id, r.path, r.message) for r in quality.catalog_errors(df).collect()}
    assert (1, "provider", "must not be blank") in got and (1, "tags", "items must be in canonical order") in got and (2, "id", "must be unique") in got
    assert (2, "docs_url", "must not contain URL userinfo or credentials") in got
    with pytest.raises(ValueError):
        quality.assert_valid(quality.record_errors(df))
    assert quality.record_errors(df.limit(0)).count() == 0


def test_version_and_diff(spark):
    a = spark.createDataFrame([(1, "x"), (2, None), (2, None)], "k int, v string")
    same = a.repartition(3)
    other = a.dropDuplicates()
    v = [catalog.content_version(d, ["k", "v"]).first().version for d in (a, same, other)]
    assert v[0] == v[1] != v[2] and v[0].startswith("v1-")
    new = spark.createDataFrame([(2, "y"), (3, None)], "k int, v string")
    assert sorted(tuple(r) for r in catalog.snapshot_diff(a.dropDuplicates(), new, ["k"], ["v"]).collect()) == [(1, "removed"), (2, "changed"), (3, "added")]


def test_skew_join(spark):
    left = spark.createDataFrame([(k % 3 if k % 2 else 0, k) for k in range(50)] + [(None, 99)], "key int, n int")
    right = spark.createDataFrame([(0, "a"), (1, "b")], "key int, w string")
    for how in ("inner", "left"):
        want = sorted(map(repr, left.join(right, ["key"], how).collect()))
        assert sorted(map(repr, skew_join(left, right, ["key"], how, heavy=[(0,)]).collect())) == want


def test_strict_json_and_files(tmp_path, spark):
    for bad in (b'{"a":1,"a":2}', b"\xff", b"[" * 70 + b"]" * 70, b"{", b"[NaN]", b"[1] x"):
        with pytest.raises(C.CatalogError):
            C.strict_json(bad)
    with pytest.raises(C.CatalogError):
        C.strict_json(b"[" + b"1," * 300_000 + b"1]")
    with pytest.raises(C.CatalogError):
        C.read_bytes(str(tmp_path))
    fifo = tmp_path / "f"
    os.mkfifo(fifo)
    with pytest.raises(C.CatalogError):
        C.read_bytes(str(fifo))
    doc = {"schema_version": 1, "catalog_version": "v", "generated_at": None, "records": [dict.fromkeys(c.split()[0] for c in RECORD.replace("\n", " ").split(", ")[1:]) | {"id": "a", "name": "A", "tags": ["t"]}]}
    path = tmp_path / "c.json"
    C.publish({str(path): C.canonical_json(doc)})
    cat = C.load_catalog(spark, str(path))
    assert cat.records.first().tags == ["t"] and cat.metadata["record_count"] == 1 and cat.source == "bundled"
    with pytest.raises(C.CatalogError):
        C.load_catalog(spark, str(path), str(tmp_path / "missing.json"))
    with pytest.raises(OSError):
        C.publish({str(path): b"new", str(tmp_path / "no" / "x"): b"y"})
    assert path.read_bytes() == C.canonical_json(doc)
    (tmp_path / "l.md").write_text("a\n| b |\n")
    assert [r.line_no for r in C.read_markdown(spark, str(tmp_path / "l.md")).orderBy("line_no").collect()] == [1, 2, 3]
    assert C.valid_ref("v1.2") and not C.valid_ref("../master")
    with pytest.raises(C.CatalogError):
        (tmp_path / "a.json").write_text('{"aliases": {"x": []}}')
        C.load_alias_file(str(tmp_path / "a.json"))
