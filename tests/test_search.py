import json
import math

import pytest

from tessera.functions import text as T
from tessera.functions.records import RECORD
from tessera.plans import search as S

ALIASES = [("tide", ["tides", "sea level", "潮汐"]), ("table", ["timetable", "tide table", "潮汐表"]), ("berth", ["mooring", "泊位"]), ("harbor fee", ["harbor price", "dues", "港口费"])]
OPENAPI = ("https://kelp.example/spec.json?token=x", "openapi", "3.1.0", "2", "Kelp *beds*", 7, None, ["a"], None)


def record(k, id, name, description, tags, category, provider, aliases=(), tier="public", cors="yes", status="active", auth="api_key", openapi=None):
    a = [(auth, "unknown" if auth == "none" else "header", "" if auth == "none" else "apikey", "made up", 1.0)]
    p = [("harbor-list" if tier == "public" else "apilayer-made-up", "https://list.example/all", "r-7", "2025-12-01T00:00:00Z", "b" * 64, None)]
    return (k, id, name, list(aliases), description, [category], list(tags), provider, tier, f"https://{id}.example/start?utm_source=x&page=2#top", f"https://{id}.example/", a, "yes", cors, status, openapi, p, "2025-12-01T00:00:00Z", [], {})


ROWS = [
    record(0, "ebb-flow", "Ebb-Flow", "Tide times and sea level records for small ports.", ["tide", "ports", "gauge"], "Tide", "Ebb-Flow", ["Ebb Flow Tides"], auth="none", openapi=(None, "openapi", "3.0.3", "1", None, 4, 9, None, None)),
    record(1, "quay-books", "Quay Books", "Past berth bookings and harbor fee lists by quarter.", ["berths", "fee history", "PDF"], "Ports", "Pier Ledger", cors="unknown"),
    record(2, "tide-clock", "Plain Tide Clock", "Present and coming tide tables.", ["tide", "table"], "Tide", "Slack Water Works", tier="apilayer", cors="no", openapi=OPENAPI),
    record(3, "rope-yard", "Plain Rope Yard", "Rope strength and knot lists.", ["rope", "knots"], "Ports", "Slack Water Works", tier="apilayer", cors="unknown", status="candidate"),
]
WEIGHTS = {"name": 8.0, "aliasesTags": 4.5, "categories": 2.75, "description": 1.0}


def fields_of(r):
    return {"name": T.terms_of(r[2]), "aliasesTags": T.terms_of("\n".join([*r[3], *r[6]])), "categories": T.terms_of("\n".join(r[5])), "description": T.terms_of(r[4])}


def by_rule(query, rows=ROWS):
    """(id, score) by the rules, record by record; all rows are fresh."""
    fields = [fields_of(r) for r in rows]
    avg = {f: max(1.0, sum(len(x[f]) for x in fields) / len(rows)) for f in WEIGHTS}
    said = " ".join(T.words_of(query))
    hit = [c for c, s in ALIASES if any((T.words_of(p) and (("".join(T.words_of(p)) in said.replace(" ", "")) if T.has_han(p) else f" {' '.join(T.words_of(p))} " in f" {said} ")) for p in [c, *s])]
    w = {t: 1.0 for t in T.terms_of(query)}
    for c in hit:
        for t in T.terms_of(c):
            w[t] = max(w.get(t, 0), 0.6 if T.has_han(query) else 0.25)
    out = []
    for r, fs in zip(rows, fields):
        every = {t for f in fs.values() for t in f}
        score = 0.0
        for t, wt in w.items():
            df = sum(any(t in f for f in x.values()) for x in fields)
            idf = math.log(1 + (len(rows) - df + 0.5) / (df + 0.5))
            for f, wf in WEIGHTS.items():
                tf = fs[f].count(t)
                score += wf * wt * idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(fs[f]) / avg[f]))
        p, name = T.phrase_of(query), T.phrase_of(r[2])
        if w and p:
            score += 14 if name == p else 7 if len(p) >= 3 and name.startswith(p) else 2 if len(name) >= 3 and p.startswith(name) else 0
        wanted = [t for t in w if w[t] == 1 and t in S.MANDATORY]
        whole = [all(t in every for t in T.terms_of(c)) for c in hit]
        if any(t not in every for t in wanted) or (len(hit) >= 2 and not all(whole)) or not w:
            score = 0.0
        if score > 0 or not query.strip():
            out.append((-round(score + 0.04 + (0.04 if r[14] == "active" else 0) + (0.005 if r[8] == "apilayer" else 0), 6), r[1]))
    return [(i, -s) for s, i in sorted(out)]


@pytest.fixture(scope="module")
def index(spark):
    return S.build_index(spark.createDataFrame(ROWS, RECORD)).cache()


def ask(index, **a):
    return [(r.id, r.score) for r in S.search(index, ALIASES, "2026-01-01T00:00:00Z", **a).orderBy("rank").collect()]


@pytest.mark.parametrize(
    ("query", "ids"),
    [
        ("tide", {"tide-clock", "ebb-flow"}),
        ("我要查潮汐表 API", {"tide-clock"}),
        ("潮汐", {"tide-clock", "ebb-flow"}),
        ("past berth bookings", {"quay-books"}),
        ("泊位港口费", {"quay-books"}),
        ("harbor dues for a mooring", {"quay-books"}),
        ("tide mooring", set()),
        ("Ebb-Flow", {"ebb-flow"}),
        ("Ebb-Flow API service of a small port", {"ebb-flow", "quay-books", "rope-yard"}),
        ("Plain", {"tide-clock", "rope-yard"}),
        ("pdf lists", {"quay-books"}),
        ("   ", {"ebb-flow", "quay-books", "tide-clock", "rope-yard"}),
        ("🚀✨", set()),
        ("!!!", set()),
        ("please find me an API", set()),
        ("\u200b", set()),
        ("sms tide", set()),
    ],
)
def test_scores(index, query, ids):
    got = ask(index, query=query)
    assert {i for i, _ in got} == ids
    assert got == [(i, pytest.approx(s, abs=2e-6)) for i, s in by_rule(query)]


def test_openapi(index):
    top = {r.id: r for r in S.search(index, ALIASES, query="tide").collect()}
    assert top["ebb-flow"].openapi.asDict() == {"spec_url": None, "specification": "openapi", "specification_version": "3.0.3", "api_version": "1", "title": None, "path_count": 4, "operation_count": 9, "tags": None, "security_schemes": None}
    assert top["tide-clock"].openapi.spec_url is None and top["tide-clock"].openapi.tags == ["a"]  # an address with a secret is not shown
    assert S.search(index, ALIASES, query="rope").first().openapi is None
    blocks = {r.rank: r.block for r in S.render_rows(S.search(index, ALIASES, query="tide")).collect()}
    assert "\nOpenAPI: openapi 3.1.0 · 7 paths\n" in blocks[1] and "\nOpenAPI: openapi 3.0.3 · 4 paths · 9 operations\n" in blocks[2]
    assert "OpenAPI" not in S.render_rows(S.search(index, ALIASES, query="rope")).first().block


def test_lists_and_sources(spark):
    r = list(record(9, "x", "X", "d", ["Ａ&B", "a and b", " ", "API!", "é", None, "ö"], "ＴＩＤＥ", "p"))
    r[5], r[8], r[16] = ["ＴＩＤＥ", "tide", None, "Fees"], None, [("public-apis-readme", None, None, None, None, None), ("apilayer-x", None, None, None, None, None)]
    one = S.build_index(spark.createDataFrame([tuple(r)], RECORD)).first()
    assert one.categories == ["ＴＩＤＥ", "Fees"] and one.tags == ["Ａ&B", "API!", "é"] and one.tiers == ["apilayer", "public"]
    assert one.category_ids == ["tide", "tide", "", "fees"]
    found = S.search(S.build_index(spark.createDataFrame([tuple(r)], RECORD)), ALIASES, categories=["Tide"]).first()
    assert found.source_tier == "merged"


def test_index_table(spark, index, tmp_path):
    table = S.write_index(spark.createDataFrame(ROWS, RECORD), str(tmp_path / "ix"))
    assert ask(table, query="tide") == ask(index, query="tide")
    plan = S.search(table, ALIASES, query="tide", cors="no")._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(cors), EqualTo(cors,no)]" in plan


def test_budget(index):
    S.check_budget(index)
    for limits in ({"record_terms": 5}, {"all_terms": 20}):
        with pytest.raises(S.SearchIndexLimitError):
            S.check_budget(index, **limits)


def test_filters(index):
    assert [i for i, _ in ask(index, query="tide", auth="none", https="yes", cors="yes")] == ["ebb-flow"]
    assert {i for i, _ in ask(index, cors="unknown")} == {"quay-books", "rope-yard"}
    assert {i for i, _ in ask(index, categories=["潮汐"])} == {"ebb-flow", "tide-clock"}
    assert ask(index, query="tide", source_tier="apilayer", auth="none") == []
    top = S.search(index, ALIASES, query="tide", limit=1).first()
    assert top.docs_url == "https://tide-clock.example/start?page=2"
    assert top.reasons[0] == "name matches 'tide'" and "active product boost" in top.reasons


def test_frame(index):
    meta = {"catalog_version": "v1-0", "generated_at": "2026-01-01T00:00:00Z", "record_count": 4, "source": "exter_nal"}
    found, summary = S.search(index, ALIASES, query="tide", limit=1), S.search_summary(index, ALIASES, metadata=meta, query="tide", limit=1)
    s = summary.first()
    assert (s.total_matches, s.truncated, s.expanded, s.matched_aliases) == (2, True, "tide", "tide")
    assert json.loads(s.filters) == {"categories": [], "source_tier": "all", "auth": None, "https": None, "cors": None, "status": None, "limit": 1}
    text = S.render(found, summary)
    assert text.startswith("## API search: 2 matches\n\nCatalog v1-0 · exter\\_nal · snapshot 2026-01-01T00:00:00Z\nQuery: tide\n\nShowing 1 of 2") and "### 1. [Plain Tide Clock](<" in text and text.endswith(S.NOTICE)
    none = S.render(S.search(index, ALIASES, query="no [such] word"), S.search_summary(index, ALIASES, query="no [such] word"))
    assert "Query: no \\[such\\] word" in none and "No filter was relaxed." in none and none.endswith(S.NOTICE) and "Catalog unknown · unknown" in none


@pytest.mark.parametrize("bad", [{"limit": 0}, {"limit": 21}, {"limit": 1.5}, {"limit": "5"}, {"colour": 1}, {"auth": "x"}, {"query": "a" * 2049}, {"categories": ["x"] * 21}, {"query": " ".join(f"w{k}" for k in range(257))}])
def test_arguments(index, bad):
    with pytest.raises(S.SearchArgumentError):
        S.search(index, **bad)


def test_text(spark):
    rows = ["  ＩＰ & APIs  天气预报 ", "APIs categories 天气预报", None, "", "Open-Meteo API v2.1 classes", "x" * 100_000]
    df = spark.createDataFrame([(k, r) for k, r in enumerate(rows)], "k int, t string")
    got = df.select("k", T.normalize_text(df.t).alias("n"), T.tokenize(df.t).alias("w"), T.canonical_phrase(df.t).alias("c")).orderBy("k").collect()
    assert got[0].n == "ip and apis 天气预报"
    assert got[1].w == ["category", "天气预报", "天气", "气预", "预报"]
    for r, t in zip(got, rows):
        assert r.w == T.terms_of(t) and r.c == T.phrase_of(t) and r.n == " ".join(T.words_of(t))


def test_expansion():
    e = S.expand_query("我要查潮汐表 API", ALIASES)
    assert e.matched == ["tide", "table"]
    assert {"berth", "harbor", "fee"} <= set(S.expand_query("泊位港口费", ALIASES).terms)


def test_empty_and_null_records(spark):
    none = tuple([7] + [None] * 19)
    ix = S.build_index(spark.createDataFrame([none, *ROWS], RECORD))
    assert S.search(ix, ALIASES, query="tide").count() == 2
    assert S.search(S.build_index(spark.createDataFrame([], RECORD)), ALIASES, query="tide").count() == 0
