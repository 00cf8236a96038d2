import json

import pytest
from pyspark.sql import functions as F

from tessera.functions import times
from tessera.functions import urls as U
from tessera.functions.records import RECORD
from tessera.operators import policy, quality
from tessera.operators import snapshots as S
from tessera.sources import catalogs as C

RIGHTS = {"license": "MIT", "license_url": "https://l.example/"}
POLICY = policy.SourcePolicy("list", "https://raw.example/{revision}/index.md", "MIT", auth_source="list", rights=tuple(RIGHTS.items()))
REVISION = "0123456789abcdef0123456789abcdef01234567"


def rec(k, **kw):
    source = ("list", f"https://raw.example/{REVISION}/index.md", REVISION, "2026-01-01T00:00:00Z", "a" * 64, "MIT")
    base = dict(row_id=k, id=f"r{k}", source_tier="public", auth=[("none", "unknown", "", "list", 1.0)], provenance=[source], last_checked_at="2026-01-01T00:00:00Z", rights=RIGHTS)
    names = [c.split()[0] for c in RECORD.replace("\n", " ").split(", ")]
    return tuple((base | kw).get(n) for n in names)


def test_policy(spark):
    good = rec(1)[-4]
    rows = [
        rec(1), rec(2, source_tier=None), rec(3, rights=dict(reversed(RIGHTS.items()))), rec(4, rights={"license": "MIT"}), rec(5, rights=None), rec(6, auth=[("none", None, None, "other", 1.0)]), rec(7, auth=None, provenance=None),
        rec(8, openapi=(None, "openapi", None, None, None, None, None, None, None)), rec(9, provenance=[(*good[0][:2], "main", *good[0][3:])]), rec(10, last_checked_at=None), rec(11, provenance=[None]),
    ]
    df = spark.createDataFrame(rows, RECORD).withColumns({"path": F.lit(1), "message": F.lit(2)})
    got = {}
    for r in policy.policy_errors(df, POLICY).collect():
        got.setdefault(r.row_id, set()).add(r.path)
    one = {"provenance.source_id", "provenance.revision", "provenance.source_url", "provenance.license"}
    assert got == {2: {"source_tier"}, 4: {"rights"}, 5: {"rights"}, 6: {"auth.source"}, 8: {"openapi"}, 9: {"provenance.revision", "provenance.source_url"}, 10: {"last_checked_at"}, 11: one | {"last_checked_at"}}
    assert policy.policy_errors(df.limit(0), POLICY).count() == 0


def test_disagreements(spark):
    df = spark.createDataFrame([(["x"], ["a"]), (["x", "x"], ["a", None]), (None, []), ([], ["a"])], "p array<string>, q array<string>")
    assert [tuple(r) for r in policy.disagreements(df, {"p": F.col("p"), "q": F.col("q")}).collect()] == [("q", "must be one value in all records")]
    assert policy.disagreements(df.limit(0), {"p": F.col("p")}).count() == 0


def test_key_differences(spark):
    rows = [(1, '{"a":1,"b":2}'), (2, '{"a":1,"x":2,"x":3}'), (3, "[1]"), (4, None), (5, "{}"), (6, "no json")]
    df = spark.createDataFrame(rows, "k int, j string").withColumn("name", F.lit(0))
    got = sorted((tuple(r) for r in policy.key_differences(df, "k", F.col("j"), ("a", "b")).collect()), key=str)
    assert got == sorted([(2, "b", "missing"), (2, "x", "unexpected"), (2, "x", "repeated"), (3, None, "no object"), (4, None, "no object"), (5, "a", "missing"), (5, "b", "missing"), (6, None, "no object")], key=str)


def test_reports(spark):
    snaps = spark.createDataFrame([("f", 1, "x"), ("f", 1, "y"), ("f", 4, "x"), ("g", 1, None)], "feed string, no int, id string").withColumn("at", F.lit(None).cast("timestamp"))
    v = "v1-0123456789abcdef"
    reports = [("f", 1, v, (0, 5, 4, 2)), ("f", 4, "v1", (2, 1, 2, 2)), ("f", 4, "v1", (2, 1, 2, 2)), ("f", 9, v, (0, 0, 0, 0)), ("g", 1, v, None), ("g", 1, v, (0, None, 0, 0)), (None, 1, v, None)]
    df = spark.createDataFrame(reports, "feed string, no int, v string, c struct<before:bigint,parsed:bigint,normalized:bigint,after:bigint>")
    s = S.current(snaps, "feed", "no", "id", "at", {})
    got = {(r.feed, r.no, r.path) for r in policy.report_errors(s, df, "feed", "no", "c", "v").collect()}
    assert got == {("f", 4, "catalog_version"), ("f", 4, "counts.after"), ("f", 4, "counts.normalized"), ("f", 9, "snapshot_no"), ("g", 1, "counts")}
    assert policy.report_errors(s, df.limit(0), "feed", "no", "c", "v").count() == 0


def test_counts_and_first_errors(spark):
    e = spark.createDataFrame([(k, "p", "m") for k in range(7)], "row_id int, path string, message string")
    assert policy.pipeline_counts(e.limit(0), e, e.limit(3), e.limit(2)).first().asDict() == {"before": 0, "parsed": 7, "normalized": 3, "after": 2}
    assert [tuple(r) for r in policy.first_errors(e, 2).collect()] == [(0, "p", "m"), (1, "p", "m"), (None, None, "stopped after 2 errors")]
    assert policy.first_errors(e, 7).count() == 7 and policy.first_errors(e.limit(0)).count() == 0
    assert [r.row_id for r in quality.out_of_order(spark.createDataFrame([(1, "b"), (2, "a"), (3, None), (4, "c")], "row_id int, id string"), "row_id", "id").collect()] == [2]


def test_excluded(spark):
    urls = ["https://Shop.example./a", "https://m.example/list", "https://m.example/LIST/x", "https://m.example/lists", "https://n.example", "ftp://shop.example", None, ""]
    df = spark.createDataFrame(enumerate(urls), "k int, u string")
    got = [r.k for r in df.where(U.is_excluded(F.col("u"), ("shop.example",), {"m.example": "/list", "n.example": "/"})).orderBy("k").collect()]
    assert got == [0, 1, 2, 4, 5]
    assert df.where(U.is_excluded(F.col("u"))).count() == 0
    assert df.select(times.now_rfc3339().alias("t")).first().t.endswith("Z")


def test_documents():
    listing = f"{'b' * 40}\trefs/heads/v1\n{'A' * 40}\trefs/tags/v1\n{'c' * 40}\trefs/tags/v2^{{}}\n{'d' * 40}\trefs/tags/v2\nshort\trefs/heads/v2\n"
    assert C.pick_ref("v1", listing) == "b" * 40 and C.pick_ref("v2", listing) == "d" * 40 and C.pick_ref("E" * 40, "") == "e" * 40
    for bad in ("v3", "-x", "a..b", ""):
        with pytest.raises(C.CatalogError):
            C.pick_ref(bad, listing)
    doc = {"generated_at": "2026-01-01T00:00:00Z", "records": [{"provenance": [{"revision": "r", "content_hash": "h"}]}]}
    assert C.kept_time(doc, "r", "h") == doc["generated_at"] and C.kept_time(doc, "r", "x") is None and C.kept_time(None, "r", "h") is None and C.kept_time({"records": []}, "r", "h") is None
    assert C.alias_errors({"version": 1, "aliases": {"a": ["x", "Y"], "b": ["z"]}}) == []
    assert C.alias_errors({"version": 2, "aliases": {"b": ["y", "x"], "a ": [""], "c": ["x", "X"]}}) == ["version: must equal 1", "aliases: keys must be in canonical order", "aliases.b: items must be unique and in canonical order", "aliases.a : key must be trimmed", "aliases.a : items must be non-empty trimmed strings", "aliases.c: items must be unique and in canonical order"]
    assert C.alias_errors([]) and C.alias_errors({"version": 1, "aliases": {}})
    assert C.policy_document_errors({"policy_version": 1, "public_only": True, "source": {"license": "MIT"}}, {"license": "MIT"}) == []
    assert len(C.policy_document_errors({"policy_version": 2, "public_only": 1, "source": {}}, {"license": "MIT"})) == 3 and C.policy_document_errors(3, {})
    assert C.file_errors({"a.json", "secret.json", "z", ".x"}, {"a.json", "b.json"}, {"secret.json"}) == ["secret.json: forbidden", "z: unexpected", "b.json: missing"]


def test_json_bounds():
    for bad in ({str(k): 0 for k in range(1025)}, [0] * 20_001, ["x" * 65_537], {"x" * 65_537: 1}, ["😀" * 32_769]):
        with pytest.raises(C.CatalogError):
            C.strict_json(json.dumps(bad, ensure_ascii=False))
    assert C.strict_json(json.dumps(["😀" * 32_768, "x" * 65_536])) and C.strict_json(json.dumps([0] * 20_000))


def test_closed_records_and_sizes(spark, tmp_path):
    names = [c.split()[0] for c in RECORD.replace("\n", " ").split(", ")][1:]
    record = dict.fromkeys(names)
    for extra, ok in (({}, True), ({"more": 1}, False)):
        p = tmp_path / "c.json"
        p.write_text(json.dumps({"schema_version": 1, "catalog_version": "v", "generated_at": None, "records": [record | extra]}))
        if ok:
            assert C.load_catalog(spark, str(p)).records.count() == 1
        else:
            with pytest.raises(C.CatalogError):
                C.load_catalog(spark, str(p))
    (tmp_path / "l.md").write_text("# a\nb")
    assert C.read_markdown(spark, str(tmp_path / "l.md")).count() == 2
    with pytest.raises(C.CatalogError):
        C.read_markdown(spark, str(tmp_path / "l.md"), most=3)
