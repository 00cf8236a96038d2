"""Rules of records and catalogues that the SQL of validation_errors does not hold, against fixed cases and plain Python."""

import os
import re
import unicodedata
from collections import Counter

import duckdb

from tessera import queries
from tessera.functions.records import RECORD
from tessera.operators import catalog, quality

from .test_catalog import rec

URL, HASH = "https://s.example/x", "a" * 64
NONE = ("none", "unknown", "", "s", 1.0)


def api(**kw):
    base = {"spec_url": URL, "specification": "openapi", "specification_version": "3.1.0", "api_version": "1", "title": "T", "path_count": 0, "operation_count": 2, "tags": ["a", "B"], "security_schemes": []}
    return tuple((base | kw).values())


def source(**kw):
    base = {"source_id": "s", "source_url": URL, "revision": "r", "retrieved_at": None, "content_hash": HASH, "license": None}
    return tuple((base | kw).values())


def test_each_rule(spark):
    key = ("api_key", "header", "K", "s", 1.0)
    cases = [
        ({}, set()),
        ({"auth": [("api_key", "header", None, "s", 1.0)]}, {("auth", "name must be a string")}),
        ({"auth": [("api_key", "header", "k", None, 1.0)]}, {("auth", "source must be a string")}),
        ({"auth": [key, ("api_key", "header", "k", "S", 1.0)]}, {("auth", "entries must be unique")}),
        ({"auth": [("api_key", "header", f"k{i}", "s", 1.0) for i in range(65)]}, {("auth", "must have at most 64 entries")}),
        ({"auth": [("api_key", "header", f"k{i}", "s", 1.0) for i in range(64)]}, set()),
        ({"provenance": [source(source_url=None)]}, {("provenance.source_url", "must be a non-empty absolute URL without whitespace")}),
        ({"provenance": [source(source_url="http://s.example"), source(source_url="http://t.example"), source(source_url="x")]}, {("provenance.source_url", "must use HTTPS"), ("provenance.source_url", "must be an absolute HTTP(S) URL")}),
        ({"provenance": [source(), source(license="MIT", retrieved_at="2025-01-01T00:00:00Z")]}, {("provenance", "entries must be unique")}),
        ({"provenance": [source(), source(revision=None)]}, set()),
        ({"provenance": [source(revision=str(i)) for i in range(65)]}, {("provenance", "must have at most 64 entries")}),
        ({"rights": {"license_url": "x", "terms_url": "https://u@s.example/"}}, {("rights.license_url", "must be an absolute HTTP(S) URL"), ("rights.terms_url", "must not contain URL userinfo or credentials")}),
        ({"rights": {"license_url": None, "terms_url": URL, "notes": "n" * 4096}}, set()),
        ({"rights": {"notes": "n" * 4097}}, {("rights", "values must have at most 4096 characters")}),
        ({"tags": ["t" * 513]}, {("tags", "items must have at most 512 characters")}),
        ({"openapi": api()}, set()),
        ({"openapi": api(spec_url="ftp://s.example/x")}, {("openapi.spec_url", "must be an absolute HTTP(S) URL")}),
        ({"openapi": api(specification="raml")}, {("openapi.specification", "must be one of openapi, swagger")}),
        ({"openapi": api(specification_version=None, api_version=None, title=None)}, {(f"openapi.{n}", "must be a string") for n in ("specification_version", "api_version", "title")}),
        ({"openapi": api(path_count=-1, operation_count=None)}, {(f"openapi.{n}", "must be a non-negative integer") for n in ("path_count", "operation_count")}),
        ({"openapi": api(tags=None, security_schemes=["b", "a"])}, {("openapi.tags", "must be a list"), ("openapi.security_schemes", "items must be in canonical order")}),
    ]
    sound = {"docs_url": URL, "homepage_url": URL, "auth": [NONE], "provenance": [source()]}
    df = spark.createDataFrame([rec(k, f"i{k}", f"N{k}", **sound | kw) for k, (kw, _) in enumerate(cases)], RECORD)
    got = Counter((r.row_id, r.path, r.message) for r in quality.record_errors(df).collect())
    assert got == Counter((k, *e) for k, (_, want) in enumerate(cases) for e in want)


def test_names_of_one_provider(spark):
    rows = [
        rec(1, "a", "Lake Notes", aliases=["Ponds"]),
        rec(2, "b", "Dogs", aliases=["PONDS API", "lake-notes", "Fish"]),
        rec(3, "c", "Lake Notes", provider="Q"),
        rec(4, "d", "Fish", provider="p"),
        rec(5, "e", "Dogs", provider=None),
    ]
    found = quality.catalog_errors(spark.createDataFrame(rows, RECORD)).where("path = 'name'").collect()
    assert sorted((r.row_id, r.message) for r in found) == [(k, "is a name of another record of the provider") for k in (2, 4)]


def label(text):
    slug = "".join(c for c in unicodedata.normalize("NFKD", text).lower().replace("ß", "ss") if not unicodedata.category(c).startswith("M"))
    parts = [p for p in re.split(r"[\W_]+", slug) if p]
    return "-".join([p for p in parts if p not in ("api", "service")] or parts)


def test_table(spark, tiny):
    """All rows the SQL gives, and of some rules those that plain Python finds."""
    db = duckdb.connect()
    db.execute(f"CREATE VIEW catalog_records AS SELECT * FROM read_parquet('{tiny}/catalog_records.parquet{'/*' if os.path.isdir(f'{tiny}/catalog_records.parquet') else ''}')")
    sql = Counter(db.execute(queries.ORACLE["validation_errors"]).fetchall())
    got = Counter(tuple(r) for r in queries.validation_errors(spark, tiny).collect())
    want = Counter()
    assert got == sql
    rows = sorted(queries.read(spark, tiny, "catalog_records").collect(), key=lambda r: r.row_id)
    seen, same = set(), set()
    for r in rows:
        for a in ("name", "source"):
            want[r.row_id, "auth", f"{a} must be a string"] = any(x is None or x[a] is None for x in r.auth or [])
        entries = [x and (x.type, x.location, (x.name or "").lower(), (x.source or "").lower(), x.confidence) for x in r.auth or []]
        want[r.row_id, "auth", "entries must be unique"] = len(set(entries)) < len(entries)
        keys = [x and (x.source_id, x.source_url, x.revision, x.content_hash) for x in r.provenance or []]
        want[r.row_id, "provenance", "entries must be unique"] = len(set(keys)) < len(keys)
        urls = [("provenance.source_url", x and x.source_url) for x in r.provenance or []]
        urls += [(f"rights.{k}", v) for k, v in (r.rights or {}).items() if k in ("license_url", "terms_url") and v is not None]
        for path, u in urls:
            if not u or re.search(r"\s", u):
                want[r.row_id, path, "must be a non-empty absolute URL without whitespace"] = 1
            elif not re.match(r"https?://[^/?#]", u, re.I):
                want[r.row_id, path, "must be an absolute HTTP(S) URL"] = 1
        tokens = {(label(r.provider), label(n)) for n in [r.name, *(r.aliases or [])] if n and n.strip()} if r.provider and r.provider.strip() else set()
        if tokens & seen:
            same.add(r.row_id)
        seen |= tokens
    kinds = {k[1:] for k in want}
    assert Counter({k: n for k, n in got.items() if k[1:] in kinds}) == +Counter({k: int(v) for k, v in want.items()})
    whole = queries.catalog_errors(spark, tiny).collect()
    assert {r.row_id for r in whole if r.path == "name" and r.message.startswith("is a name")} == same and same
    assert Counter(tuple(r) for r in whole) > got


def test_version_of_whole_records(spark):
    """Every field of a record makes another version, but the two times that are no content and the number of the row."""
    base = {"docs_url": URL, "auth": [NONE], "provenance": [source()], "openapi": api(), "rights": {"license": "MIT", "notes": None}}
    version = lambda *rows: catalog.content_version(spark.createDataFrame(rows, RECORD).select(catalog.record_text().alias("record")), ["record"]).first().version
    first = version(rec(1, "a", "A", **base), rec(2, "b", "B"))
    same = [
        (rec(2, "b", "B"), rec(1, "a", "A", **base)),
        (rec(8, "a", "A", **base), rec(9, "b", "B")),
        (rec(1, "a", "A", **base | {"last_checked_at": "2025-01-01T00:00:00Z"}), rec(2, "b", "B")),
        (rec(1, "a", "A", **base | {"provenance": [source(retrieved_at="2025-01-01T00:00:00Z")]}), rec(2, "b", "B")),
        (rec(1, "a", "A", **base | {"rights": {"notes": None, "license": "MIT"}}), rec(2, "b", "B")),
    ]
    assert [version(*rows) for rows in same] == [first] * len(same)
    changes = [
        {"aliases": ["x"]}, {"description": "x"}, {"categories": ["x"]}, {"tags": ["x"]}, {"tags": None}, {"provider": "x"}, {"source_tier": "x"}, {"docs_url": None}, {"homepage_url": "x"}, {"auth": [("none", "unknown", "", "s", 0.5)]}, {"auth": None},
        {"https": "x"}, {"cors": "x"}, {"status": "x"}, {"openapi": None}, {"openapi": api(path_count=1)}, {"provenance": [source(revision="x")]}, {"provenance": [source(license="x")]}, {"provenance": []}, {"quality_flags": ["x"]}, {"rights": {"license": "MIT"}}, {"rights": {"license": "x", "notes": None}},
    ]
    others = [version(rec(1, "a", "A", **base | c), rec(2, "b", "B")) for c in changes] + [version(rec(1, "x", "A", **base), rec(2, "b", "B")), version(rec(1, "a", "x", **base), rec(2, "b", "B"))]
    assert len({first, *others}) == len(others) + 1
