"""Queries of the core over the test tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import markdownsql as M
from . import searchsql as X
from . import sqltext as Q
from .functions import records as R
from .functions import text as T
from .functions import urls as U
from .operators import catalog, policy, quality, rejects, resolve, snapshots
from .plans import search as S
from .session import cut, shared_folder, spread

Query = Callable[[SparkSession, str], DataFrame]


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# ---- rows that fail to parse, changes between snapshots --------------------------------------


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return rejects.index_rejects(read(spark, sf, "readme_lines"))


def p1_clean(spark: SparkSession, sf: str) -> DataFrame:
    return rejects.index_clean(read(spark, sf, "readme_lines"))


def _content() -> dict:
    names = ("name", "description", "provider", "docs_url", "auth_type", "https", "cors", "status")
    return {n: F.col(n) for n in names} | {"tags": F.to_json(F.sort_array("tags"))}


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    s = snapshots.current(read(spark, sf, "catalog_snapshots"), "feed_id", "snapshot_no", "id", "delivered_at", _content())
    changes = snapshots.changes_of(s)
    wrong = snapshots.miscounted(s, read(spark, sf, "update_reports"), "feed_id", "snapshot_no", F.col("counts.before"), F.col("counts.after"))
    both = changes.unionByName(wrong.select("feed", "no", F.lit("").alias("id"), F.lit("miscounted").alias("change")))
    return both.select(F.col("feed").alias("feed_id"), F.col("no").alias("snapshot_no"), "id", "change")


P6_SQL = """WITH cur AS (
  SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY feed_id, snapshot_no, id ORDER BY delivered_at DESC) AS rn FROM catalog_snapshots WHERE id IS NOT NULL) WHERE rn = 1),
c AS (SELECT feed_id, snapshot_no, id, struct_pack(a := name, b := description, c := provider, d := docs_url, e := auth_type, f := https, g := cors, h := status, i := list_sort(tags)) AS content FROM cur),
nos AS (SELECT feed_id, snapshot_no, lag(snapshot_no) OVER w AS prev FROM (SELECT DISTINCT feed_id, snapshot_no FROM catalog_snapshots) WINDOW w AS (PARTITION BY feed_id ORDER BY snapshot_no)),
n AS (SELECT feed_id, snapshot_no, count(*) AS n FROM cur GROUP BY ALL)
SELECT coalesce(b.feed_id, a.feed_id) AS feed_id, coalesce(b.no, a.no) AS snapshot_no, coalesce(b.id, a.id) AS id, CASE WHEN a.id IS NULL THEN 'added' WHEN b.id IS NULL THEN 'removed' ELSE 'changed' END AS change
FROM (SELECT c.feed_id, c.snapshot_no AS no, id, content FROM c JOIN nos USING (feed_id, snapshot_no) WHERE prev IS NOT NULL) b
FULL JOIN (SELECT c.feed_id, nos.snapshot_no AS no, id, content FROM c JOIN nos ON c.feed_id = nos.feed_id AND c.snapshot_no = nos.prev) a ON a.feed_id = b.feed_id AND a.no = b.no AND a.id = b.id
WHERE a.id IS NULL OR b.id IS NULL OR a.content IS DISTINCT FROM b.content
UNION ALL
SELECT DISTINCT r.feed_id, r.snapshot_no, '' AS id, 'miscounted' AS change FROM update_reports r JOIN nos USING (feed_id, snapshot_no) LEFT JOIN n x ON x.feed_id = r.feed_id AND x.snapshot_no = r.snapshot_no LEFT JOIN n y ON y.feed_id = r.feed_id AND y.snapshot_no = nos.prev
WHERE r.counts.after IS DISTINCT FROM coalesce(x.n, 0) OR r.counts.before IS DISTINCT FROM coalesce(y.n, 0)"""


# ---- text and index ----------------------------------------------------------------------------


def token_stats(spark: SparkSession, sf: str) -> DataFrame:
    docs = spread(read(spark, sf, "documents").select("doc_id", "text"), "doc_id")
    words = docs.select("doc_id", F.explode(T.tokenize(F.col("text"))).alias("term"))
    per = words.groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("tf"))
    return per.groupBy("term").agg(F.sum("tf").alias("occurrences"), F.count(F.lit(1)).alias("df"))


TOKEN_SQL = f"""SELECT term, CAST(sum(tf) AS BIGINT) AS occurrences, count(*) AS df FROM (
  SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({Q.terms(Q.words("text"))}) AS term FROM documents) GROUP BY ALL) GROUP BY term"""


def field_lengths(spark: SparkSession, sf: str) -> DataFrame:
    stats = S.statistics(search_index(spark, sf), [])
    return stats.select(F.inline(F.array(*[F.struct(F.lit(f).alias("field"), F.round(f"avg_{f}", 6).alias("avg_len")) for f in S.WEIGHTS])))


_SRC = {"name": "name", "aliasesTags": f"{Q.joined('aliases')} || chr(10) || {Q.joined('tags')}", "categories": Q.joined("categories"), "description": "description"}
LENGTH_SQL = " UNION ALL ".join(f"SELECT '{f}' AS field, round(greatest(1.0::DOUBLE, avg(len({Q.terms(Q.words(x))}))), 6) AS avg_len FROM catalog_records" for f, x in _SRC.items())


def name_phrases(spark: SparkSession, sf: str) -> DataFrame:
    r = read(spark, sf, "catalog_records")
    return r.select("row_id", T.normalize_text(F.col("name")).alias("normalized"), T.canonical_phrase(F.col("name")).alias("canonical"))


PHRASE_SQL = f"SELECT row_id, array_to_string({Q.words('name')}, ' ') AS normalized, {Q.phrase('name')} AS canonical FROM catalog_records"

#: Searches of catalog_records. All expand with the latest concepts of query_aliases.
SEARCHES = {
    "search_english": {"query": "weather humidity pressure feed", "limit": 20},
    "search_concepts": {"query": "sports roster calendar", "limit": 20},
    "search_chinese": {"query": "我想找音乐歌词 API", "limit": 20},
    "search_filtered": {"query": "music lyric feed", "source_tier": "apilayer", "https": "yes", "cors": "yes", "status": "active", "auth": "none", "limit": 20},
    "search_delivered": {"query": "music lyric feed", "limit": 20},
    "search_category": {"query": "", "categories": ["天气", "Open Data"], "cors": "unknown", "limit": 20},
    "search_name": {"query": "Weather by Momamorusa", "limit": 20},
}
#: A search of documents: no record of the catalogue has any of the words that a query with them must find.
GATED = {"query": "url rows fetch sample", "limit": 20}
EXPANDED = ("weather forecast", "stock archive", "我想找音乐歌词 API", "ledger API", "sports roster calendar", "open level β-free timezone")
_DOCUMENTS = """(SELECT doc_id AS row_id, record_id AS id, title AS name, CAST([] AS VARCHAR[]) AS aliases, text AS description, CAST([] AS VARCHAR[]) AS categories, CAST([] AS VARCHAR[]) AS tags, provider, NULL::VARCHAR AS source_tier, url AS docs_url,
CAST([] AS STRUCT("type" VARCHAR)[]) AS auth, NULL::VARCHAR AS https, NULL::VARCHAR AS cors, NULL::VARCHAR AS status, NULL::STRUCT(specification VARCHAR, specification_version VARCHAR, path_count BIGINT, operation_count BIGINT) AS openapi,
CAST([] AS STRUCT(source_id VARCHAR, retrieved_at VARCHAR)[]) AS provenance, strftime(published_at, '%Y-%m-%dT%H:%M:%SZ') AS last_checked_at, CAST([] AS VARCHAR[]) AS quality_flags FROM documents)"""
_INDEXES: dict[tuple[str, str], DataFrame] = {}


def search_index(spark: SparkSession, sf: str) -> DataFrame:
    """The index of catalog_records, written once in an application as a table in the checkpoint folder."""
    key = spark.sparkContext.applicationId, sf
    if key not in _INDEXES:
        _INDEXES[key] = S.write_index(read(spark, sf, "catalog_records"), f"{shared_folder(spark)}/index-{key[0]}-{len(_INDEXES)}")
    return _INDEXES[key]


def _shown(found: DataFrame) -> DataFrame:
    return found.select("rank", "doc", "id", "name", "score", F.array_join("reasons", "; ").alias("reasons"), "source_tier", "freshness", "docs_url", F.col("openapi.specification").alias("specification"), F.col("openapi.path_count").alias("path_count"))


def _search(arguments: dict) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return _shown(S.search(search_index(spark, sf), S.load_aliases(read(spark, sf, "query_aliases")), **arguments))

    return run


def search_gated(spark: SparkSession, sf: str) -> DataFrame:
    """A search of documents with a word that must be found."""
    d = read(spark, sf, "documents")
    none = F.array().cast("array<string>")
    given = {"row_id": F.col("doc_id"), "id": F.col("record_id"), "name": F.col("title"), "description": F.col("text"), "provider": F.col("provider"), "docs_url": F.col("url"), "last_checked_at": F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ss'Z'")}
    kinds = [c.split(" ", 1) for c in R.RECORD.replace("\n", " ").split(", ")]
    records = d.select(*[given.get(n, none if t.startswith("array<string") else F.lit(None)).cast(t).alias(n) for n, t in kinds])
    index = cut(S.build_index(records))  # read twice: statistics, scores
    return _shown(S.search(index, S.load_aliases(read(spark, sf, "query_aliases")), **GATED))


def search_totals(spark: SparkSession, sf: str) -> DataFrame:
    aliases, index = S.load_aliases(read(spark, sf, "query_aliases")), search_index(spark, sf)
    out = None
    for a in SEARCHES.values():
        one = S.search_summary(index, aliases, **a).drop("filters", "catalog")
        out = one if out is None else out.unionByName(one)
    return out


def render_results(spark: SparkSession, sf: str) -> DataFrame:
    return S.render_rows(S.search(search_index(spark, sf), S.load_aliases(read(spark, sf, "query_aliases")), query="weather", limit=20))


def query_terms(spark: SparkSession, sf: str) -> DataFrame:
    aliases = S.load_aliases(read(spark, sf, "query_aliases"))
    rows = [(a, k, t, float(e.weights[t])) for a in EXPANDED for e in [S.expand_query(a, aliases)] for k, t in enumerate(e.terms)]
    return spark.createDataFrame(rows, "query string, pos int, term string, weight double")


def freshness(spark: SparkSession, sf: str) -> DataFrame:
    index = search_index(spark, sf)
    ref = F.broadcast(index.agg(F.max("latest.at").alias("ref")))  # one row
    age = F.greatest(F.lit(0), F.floor((F.col("ref") - F.col("latest.at")) / S.DAY))
    state = F.when(F.col("marked_stale"), "stale").when(F.col("age_days").isNull(), "unknown").when(F.col("age_days") <= 365, "fresh").otherwise("stale")
    return index.crossJoin(ref).select(F.col("doc").alias("row_id"), age.alias("age_days"), "marked_stale").select("row_id", "age_days", state.alias("state"))


FRESH_SQL = f"WITH {X.fresh()} SELECT doc AS row_id, age AS age_days, freshness AS state FROM fresh"


# ---- values of records -----------------------------------------------------------------------------


def record_values(spark: SparkSession, sf: str) -> DataFrame:
    r = read(spark, sf, "catalog_records")
    tiers = R.source_tiers(F.col("source_tier"), F.col("provenance"))
    return r.select("row_id", F.array_join(F.array_sort(R.auth_types(F.col("auth"))), ",").alias("auth_types"), F.array_join(tiers, ",").alias("tiers"), F.when(F.size(tiers) == 1, F.get(tiers, F.lit(0))).otherwise("merged").alias("shown_tier"), R.one_of(F.col("https"), R.TRI_STATES).alias("https"), R.one_of(F.col("cors"), R.TRI_STATES).alias("cors"), R.one_of(F.col("status"), R.STATUSES).alias("status"))


VALUE_SQL = f"""SELECT row_id, array_to_string(list_sort({Q.AUTH}), ',') AS auth_types, array_to_string({Q.tiers()}, ',') AS tiers, CASE WHEN len({Q.tiers()}) = 1 THEN {Q.tiers()}[1] ELSE 'merged' END AS shown_tier,
{Q.tri("https")} AS https, {Q.tri("cors")} AS cors, {Q.STATUS} AS status FROM catalog_records"""


def spelled_values(spark: SparkSession, sf: str) -> DataFrame:
    """How often each spelling of HTTPS, CORS and Auth cells of index tables means what."""
    from .operators import markdown

    rows = markdown.index_rows(read(spark, sf, "readme_lines"))
    cell = lambda n: F.trim(F.get("cells", (F.array_position("header", n) - 1).cast("int")))
    each = F.array(*[F.struct(F.lit(n).alias("column"), cell(n).alias("raw")) for n in ("auth", "https", "cors")])
    v = rows.select(F.inline(each)).where(F.col("raw").isNotNull())
    meant = F.when(F.col("column") == "auth", R.auth_type(F.col("raw"))).otherwise(R.tri_state(F.replace(F.col("raw"), F.lit("`"), F.lit(""))))
    return v.groupBy("column", "raw", meant.alias("meant")).agg(F.count(F.lit(1)).alias("n"))


def slug_ids(spark: SparkSession, sf: str) -> DataFrame:
    p = read(spark, sf, "part")
    return p.select("p_partkey", R.slugify(F.col("p_name")).alias("slug"), R.identity_label(F.concat_ws(" ", "p_name", F.lit("API"))).alias("label"), R.stable_record_id(F.col("p_brand"), F.col("p_name")).alias("record_id"))


def _slug(x: str) -> str:
    return f"regexp_replace(regexp_replace(lower({x}), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')"


SLUG_SQL = f"SELECT p_partkey, {_slug('p_name')} AS slug, {_slug('p_name')} AS label, {_slug('p_brand')} || ':' || {_slug('p_name')} AS record_id FROM part"


def url_forms(spark: SparkSession, sf: str) -> DataFrame:
    r = spread(read(spark, sf, "catalog_records").select("row_id", "docs_url", "provider"), "row_id")
    u = F.col("docs_url")
    return r.select("row_id", U.safe_public_url(u).alias("safe"), U.canonical_url(u).alias("canonical"), U.url_identity(u).alias("same"), U.provider_from_url(u, F.col("provider")).alias("provider_host"), U.url_problem(u).alias("problem"))


def _canon() -> str:
    u = "regexp_replace(docs_url, '^\\s+|\\s+$', '', 'g')"
    return f"CASE WHEN {Q.part(u, 'scheme')} IN ('http', 'https') AND {Q.host(u)} <> '' AND NOT contains({Q.part(u, 'authority')}, '@') AND NOT ({Q.sensitive(u)}) THEN {Q.part(u, 'scheme')} || '://' || {Q.host(u)} || {Q.part(u, 'path')} || CASE WHEN {Q.part(u, 'query')} <> '' THEN '?' || {Q.part(u, 'query')} ELSE '' END END"


URL_SQL = f"""SELECT row_id, {Q.safe_url("docs_url")} AS safe, canonical, lower({Q.part("canonical", "scheme")} || '://' || {Q.part("canonical", "authority")} || CASE WHEN {Q.part("canonical", "path")} = '' THEN '/' ELSE {Q.part("canonical", "path")} END || CASE WHEN {Q.part("canonical", "query")} <> '' THEN '?' || {Q.part("canonical", "query")} ELSE '' END) || CASE WHEN canonical IS NULL THEN NULL ELSE '' END AS same,
CASE WHEN {Q.host("docs_url")} <> '' THEN regexp_replace({Q.host("docs_url")}, '^(?:www\\d*|api)\\.', '') ELSE provider END AS provider_host,
CASE WHEN docs_url IS NULL OR docs_url = '' OR regexp_matches(docs_url, '\\s') THEN 'must be a non-empty absolute URL without whitespace' WHEN {Q.part("docs_url", "scheme")} NOT IN ('http', 'https') OR {Q.host("docs_url")} = '' THEN 'must be an absolute HTTP(S) URL' WHEN contains({Q.part("docs_url", "authority")}, '@') THEN 'must not contain URL userinfo or credentials' END AS problem
FROM (SELECT *, {_canon()} AS canonical FROM catalog_records)"""


# ---- quality, identity, snapshots -------------------------------------------------------------------


def validation_errors(spark: SparkSession, sf: str) -> DataFrame:
    return quality.record_errors(read(spark, sf, "catalog_records"))


def catalog_errors(spark: SparkSession, sf: str) -> DataFrame:
    return quality.catalog_errors(read(spark, sf, "catalog_records"))


def _checks() -> str:
    out = []

    def rule(path: str, bad: str, message: str) -> None:
        out.append(f"SELECT row_id, '{path}' AS path, {Q.q(message)} AS message FROM catalog_records WHERE {bad}")

    for n, most, blank in (("id", 512, True), ("name", 512, True), ("description", 8192, False), ("provider", 512, True)):
        rule(n, f"{n} IS NULL", "must be a string")
        if blank:
            rule(n, f"trim({n}) = ''", "must not be blank")
        rule(n, f"length({n}) > {most}", f"must have at most {most} characters")
    for n, allowed in (("source_tier", R.TIERS), ("https", R.TRI_STATES), ("cors", R.TRI_STATES), ("status", R.STATUSES)):
        rule(n, f"coalesce({n} NOT IN ({', '.join(map(Q.q, allowed))}), true)", f"must be one of {', '.join(allowed)}")
    for path, source, given in (
        ("docs_url", "docs_url", "true"), ("homepage_url", "homepage_url", "true"), ("openapi.spec_url", "openapi.spec_url", "openapi IS NOT NULL"),
        ("rights.license_url", "rights['license_url']", "rights['license_url'] IS NOT NULL"), ("rights.terms_url", "rights['terms_url']", "rights['terms_url'] IS NOT NULL"),
    ):
        out.append(f"SELECT row_id, '{path}' AS path, message FROM (SELECT row_id, {Q.url_problem('u')} AS message FROM (SELECT row_id, {source} AS u FROM catalog_records WHERE {given})) WHERE message IS NOT NULL")
    out.append(f"SELECT DISTINCT row_id, 'provenance.source_url' AS path, message FROM (SELECT row_id, {Q.url_problem('u', True)} AS message FROM (SELECT row_id, unnest(list_transform(provenance, lambda p: p.source_url)) AS u FROM catalog_records)) WHERE message IS NOT NULL")
    for n, given in (("aliases", "true"), ("categories", "true"), ("tags", "true"), ("quality_flags", "true"), ("openapi.tags", "openapi IS NOT NULL"), ("openapi.security_schemes", "openapi IS NOT NULL")):
        low = f"list_transform({n}, lambda v: lower(coalesce(v, '')))"
        rule(n, f"{given} AND {n} IS NULL", "must be a list")
        rule(n, f"{given} AND len(list_filter({n}, lambda v: v IS NULL OR trim(v) = '' OR trim(v) <> v)) > 0", "items must be non-empty trimmed strings")
        rule(n, f"{given} AND len(list_distinct({low})) < len({n})", "items must be unique")
        rule(n, f"{given} AND list_sort(list_transform({n}, lambda v: struct_pack(k := lower(coalesce(v, '')), v := coalesce(v, '')))) <> list_transform({n}, lambda v: struct_pack(k := lower(coalesce(v, '')), v := coalesce(v, '')))", "items must be in canonical order")
        rule(n, f"{given} AND len({n}) > 256", "must have at most 256 items")
        rule(n, f"{given} AND len(list_filter({n}, lambda v: length(v) > 512)) > 0", "items must have at most 512 characters")
    rule("openapi.specification", "openapi IS NOT NULL AND coalesce(openapi.specification NOT IN ('openapi', 'swagger'), true)", "must be one of openapi, swagger")
    for n in ("specification_version", "api_version", "title"):
        rule(f"openapi.{n}", f"openapi IS NOT NULL AND openapi.{n} IS NULL", "must be a string")
    for n in ("path_count", "operation_count"):
        rule(f"openapi.{n}", f"openapi IS NOT NULL AND coalesce(openapi.{n} < 0, true)", "must be a non-negative integer")
    for n in ("name", "source"):
        rule("auth", f"len(list_filter(auth, lambda a: a.{n} IS NULL)) > 0", f"{n} must be a string")
    rule("auth", "len(auth) > 64", "must have at most 64 entries")
    rule("provenance", "len(list_distinct(list_transform(provenance, lambda p: struct_pack(a := p.source_id, b := p.source_url, c := p.revision, d := p.content_hash)))) < len(provenance)", "entries must be unique")
    rule("provenance", "len(provenance) > 64", "must have at most 64 entries")
    rule("rights", "len(list_filter(map_values(rights), lambda v: length(v) > 4096)) > 0", "values must have at most 4096 characters")
    rule("last_checked_at", f"last_checked_at IS NOT NULL AND NOT {Q.is_time('last_checked_at')}", "must be an RFC 3339 time or null")
    rule("auth", "auth IS NULL OR len(auth) = 0", "must be a non-empty list")
    rule("auth", f"len(list_filter(auth, lambda a: coalesce(a.type NOT IN ({', '.join(map(Q.q, R.AUTH_TYPES))}), true))) > 0", "type must be a known kind")
    rule("auth", f"len(list_filter(auth, lambda a: coalesce(a.location NOT IN ({', '.join(map(Q.q, R.AUTH_LOCATIONS))}), true))) > 0", "location must be a known place")
    rule("auth", "len(list_filter(auth, lambda a: coalesce(a.confidence < 0 OR a.confidence > 1, true))) > 0", "confidence must be from 0 to 1")
    rule("auth", "len(auth) > 1 AND len(list_filter(auth, lambda a: a.type = 'none')) > 0", "none must stand alone")
    rule("auth", "len(list_distinct(list_transform(auth, lambda a: struct_pack(a := a.type, b := a.location, c := lower(coalesce(a.name, '')), d := lower(coalesce(a.source, '')), e := a.confidence)))) < len(auth)", "entries must be unique")
    rule("provenance", "provenance IS NULL OR len(provenance) = 0", "must be a non-empty list")
    rule("provenance", "len(list_filter(provenance, lambda p: trim(coalesce(p.source_id, '')) = '')) > 0", "source_id must not be blank")
    rule("provenance", f"len(list_filter(provenance, lambda p: p.retrieved_at IS NOT NULL AND NOT {Q.is_time('p.retrieved_at')})) > 0", "retrieved_at must be an RFC 3339 time or null")
    rule("provenance", "len(list_filter(provenance, lambda p: NOT coalesce(regexp_matches(p.content_hash, '^[0-9a-f]{64}$'), false))) > 0", "content_hash must be 64 hex digits")
    rule("rights", "rights IS NULL", "must be a map")
    rule("rights", f"len(list_filter(map_keys(rights), lambda k: k NOT IN ({', '.join(map(Q.q, quality.RIGHTS_KEYS))}))) > 0", "has an unknown key")
    return " UNION ALL ".join(out)


def repeated_ids(spark: SparkSession, sf: str) -> DataFrame:
    r = read(spark, sf, "catalog_records")
    return quality.repeated_keys(r, F.lower("id"), "id", "must be unique")


REPEATED_SQL = "SELECT row_id, 'id' AS path, 'must be unique' AS message FROM (SELECT row_id, row_number() OVER (PARTITION BY lower(id) ORDER BY row_id) AS k FROM catalog_records WHERE id IS NOT NULL) WHERE k > 1"


_SAME = f"lower({Q.part('canonical', 'scheme')} || '://' || {Q.part('canonical', 'authority')} || CASE WHEN {Q.part('canonical', 'path')} = '' THEN '/' ELSE {Q.part('canonical', 'path')} END || CASE WHEN {Q.part('canonical', 'query')} <> '' THEN '?' || {Q.part('canonical', 'query')} ELSE '' END)"
def _tokens(source: str = "catalog_records") -> str:
    return f"""called AS (SELECT row_id, provider, unnest(list_concat([name], coalesce(aliases, []))) AS c FROM {source} WHERE trim(coalesce(provider, '')) <> ''),
tokens AS (SELECT row_id, 'id:' || lower(id) AS token FROM {source} WHERE coalesce(id, '') <> ''
UNION SELECT row_id, 'provider-name:' || {Q.label('provider')} || ':' || {Q.label('c')} FROM called WHERE trim(coalesce(c, '')) <> ''
UNION SELECT row_id, 'docs:' || {_SAME} FROM (SELECT row_id, {_canon()} AS canonical FROM {source}) WHERE canonical IS NOT NULL)"""


_TOKENS = _tokens()
_GROUPS = f"""{_TOKENS},
owned AS (SELECT row_id, min(row_id) OVER (PARTITION BY token) AS owner FROM tokens),
linked AS (SELECT row_id AS x, owner AS y FROM owned WHERE row_id <> owner UNION SELECT owner, row_id FROM owned WHERE row_id <> owner),
walk(x, g) AS (SELECT x, x FROM linked UNION SELECT linked.y, walk.g FROM walk JOIN linked ON linked.x = walk.x WHERE walk.g < linked.y),
groups AS (SELECT r.row_id, coalesce(min(w.g), r.row_id) AS "group" FROM (SELECT DISTINCT row_id FROM catalog_records) r LEFT JOIN walk w ON w.x = r.row_id GROUP BY r.row_id)"""
TOKENS_SQL = f"WITH {_TOKENS} SELECT row_id, token FROM tokens"
GROUPS_SQL = f"WITH RECURSIVE {_GROUPS} SELECT row_id, \"group\" FROM groups"
def _merged_sql() -> str:
    named = sorted(c.split()[0] for c in R.RECORD.replace("\n", " ").split(", ") if not c.startswith("row_id"))
    says = lambda c: f"coalesce({c} NOT IN ('', 'unknown'), false)"
    last = lambda c: f"arg_max({c}, ord) FILTER (WHERE {says(c)})"
    primary = lambda c: f"coalesce(max(CASE WHEN final AND {says(c)} THEN {c} END), {last(c)}) AS {c}"
    other = lambda c: f"coalesce({last(c)}, max(CASE WHEN final THEN {c} END)) AS {c}"
    entries = " UNION ALL ".join(f"SELECT \"group\", '{n}' AS list, trim(unnest({v})) AS v FROM r" for n, v in {"aliases": "list_concat([name], coalesce(aliases, []))", "categories": "categories", "tags": "tags", "quality_flags": "quality_flags"}.items())
    united = lambda n, keep="true": f"coalesce(string_agg(v, '|' ORDER BY k, v) FILTER (WHERE list = '{n}' AND {keep}), '') AS {n}"
    return f"""WITH RECURSIVE {_GROUPS},
q AS (SELECT c.*, g."group", row_number() OVER (ORDER BY g."group", coalesce(c.id, ''), CAST(to_json(struct_pack({", ".join(f"{n} := c.{n}" for n in named)})) AS VARCHAR), c.row_id) AS ord FROM catalog_records c JOIN groups g USING (row_id)),
r AS (SELECT *, ord = max(ord) OVER (PARTITION BY "group") AS final, len(list_filter(coalesce(auth, []), lambda a: a.type <> 'unknown')) > 0 AS known FROM q),
one AS (SELECT "group", {", ".join(map(primary, ("id", "name", "provider", "source_tier")))}, {", ".join(map(other, ("description", "docs_url", "https", "cors", "status")))}, max(last_checked_at) AS last_checked_at, count(*) AS merged_rows,
  arg_max(auth, struct_pack(a := known, b := ord)) FILTER (WHERE len(auth) > 0) AS auth FROM r GROUP BY "group"),
e AS (SELECT "group", list, lower(v) AS k, min(v) AS v FROM ({entries}) WHERE v <> '' GROUP BY ALL),
lists AS (SELECT e."group", {united("aliases", "k <> lower(coalesce(one.name, ''))")}, {united("categories")}, {united("tags")}, {united("quality_flags")} FROM e JOIN one USING ("group") GROUP BY e."group"),
sources AS (SELECT "group", count(*) AS sources FROM (SELECT DISTINCT "group", p.source_id, p.source_url, p.revision, p.content_hash FROM (SELECT "group", unnest(provenance) AS p FROM r)) GROUP BY "group")
SELECT one.* EXCLUDE (auth), coalesce(aliases, '') AS aliases, coalesce(categories, '') AS categories, coalesce(tags, '') AS tags, coalesce(quality_flags, '') AS quality_flags, CAST(to_json(list_transform(auth, lambda a: a.type)) AS VARCHAR) AS auth, coalesce(sources, -1) AS sources
FROM one LEFT JOIN lists USING ("group") LEFT JOIN sources USING ("group")"""


MERGED_SQL = _merged_sql()
CATALOG_SQL = f"""WITH {_TOKENS} {_checks()} UNION ALL {REPEATED_SQL}
UNION ALL SELECT row_id, 'docs_url', 'is the documentation of another record' FROM tokens WHERE token LIKE 'docs:%' QUALIFY row_number() OVER (PARTITION BY token ORDER BY row_id) > 1
UNION ALL SELECT DISTINCT row_id, 'name', 'is a name of another record of the provider' FROM (SELECT row_id, row_number() OVER (PARTITION BY token ORDER BY row_id) AS k FROM tokens WHERE token LIKE 'provider-name:%') WHERE k > 1"""


def identity_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """Tokens in composed form."""
    return resolve.identity_tokens(read(spark, sf, "catalog_records")).withColumn("token", T.nfkc(F.col("token"), "NFC"))


def entity_groups(spark: SparkSession, sf: str) -> DataFrame:
    return resolve.entity_groups(read(spark, sf, "catalog_records"))


def merged_records(spark: SparkSession, sf: str) -> DataFrame:
    r = read(spark, sf, "catalog_records")
    m = resolve.merge_groups(r, cut(resolve.entity_groups(r)))
    return m.select("group", "id", "name", "provider", "source_tier", "description", "docs_url", "https", "cors", "status", "last_checked_at", "merged_rows", *[F.array_join(c, "|").alias(c) for c in ("aliases", "categories", "tags", "quality_flags")], F.to_json(F.col("auth.type")).alias("auth"), F.coalesce(F.array_size("provenance"), F.lit(-1)).alias("sources"))


def part_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Parts of one name linked by brand or by size, directly or through other parts."""
    p = read(spark, sf, "part")
    tokens = F.array(F.concat_ws("\x1f", "p_name", F.lit("brand"), "p_brand"), F.concat_ws("\x1f", "p_name", F.lit("size"), "p_size"))
    t = p.select(F.col("p_partkey").alias("x"), F.explode(tokens).alias("token"))
    owner = t.groupBy("token").agg(F.min("x").alias("o"))
    found = resolve.linked(t.join(owner, "token").select(F.col("x").alias("a"), F.col("o").alias("b")))
    return found.select(F.col("vertex").alias("p_partkey"), F.col("group").alias("group_key"))


PART_SQL = """WITH RECURSIVE t AS (SELECT p_partkey AS x, p_name || ' brand ' || p_brand AS token FROM part UNION ALL SELECT p_partkey, p_name || ' size ' || p_size FROM part),
e AS (SELECT a.x, b.o AS y FROM t a JOIN (SELECT token, min(x) AS o FROM t GROUP BY token) b USING (token) WHERE a.x <> b.o),
l AS (SELECT x, y FROM e UNION SELECT y, x FROM e),
walk(x, g) AS (SELECT p_partkey, p_partkey FROM part UNION SELECT l.y, walk.g FROM walk JOIN l ON l.x = walk.x WHERE walk.g < l.y)
SELECT x AS p_partkey, min(g) AS group_key FROM walk GROUP BY x"""


def provider_tags(spark: SparkSession, sf: str) -> DataFrame:
    r = read(spark, sf, "catalog_records").where(F.col("provider").isNotNull())
    return catalog.canonical_sets(r.select("provider", F.explode("tags").alias("tag")), "provider", F.col("tag"), "tags")


TAGS_SQL = """SELECT provider, string_agg(v, '|' ORDER BY k, v) AS tags FROM (
  SELECT provider, lower(trim(t)) AS k, min(trim(t)) AS v FROM (SELECT provider, unnest(tags) AS t FROM catalog_records WHERE provider IS NOT NULL) WHERE trim(t) <> '' GROUP BY ALL) GROUP BY provider"""


def snapshot_diff(spark: SparkSession, sf: str) -> DataFrame:
    """Between the first and the last snapshot of each feed, in all content columns; the order of tags is no content."""
    content = _content()
    s = snapshots.current(read(spark, sf, "catalog_snapshots"), "feed_id", "snapshot_no", "id", "delivered_at", content)
    rows = s.rows.withColumnsRenamed({"feed": "feed_id"} | dict(zip(s.values, content, strict=True)))
    return catalog.snapshot_diff(rows.where("prev IS NULL"), rows.where("next IS NULL"), ["feed_id", "id"], list(content))


DIFF_SQL = """WITH e AS (SELECT feed_id, min(snapshot_no) AS lo, max(snapshot_no) AS hi FROM catalog_snapshots GROUP BY feed_id),
r AS (SELECT feed_id, snapshot_no, id, arg_max(struct_pack(a := name, b := description, c := provider, d := docs_url, e := auth_type, f := https, g := cors, h := status, i := list_sort(tags)), delivered_at) AS v FROM catalog_snapshots WHERE id IS NOT NULL GROUP BY ALL),
o AS (SELECT r.feed_id, id, v FROM r JOIN e ON r.feed_id = e.feed_id AND snapshot_no = lo), n AS (SELECT r.feed_id, id, v FROM r JOIN e ON r.feed_id = e.feed_id AND snapshot_no = hi)
SELECT coalesce(o.feed_id, n.feed_id) AS feed_id, coalesce(o.id, n.id) AS id, CASE WHEN o.id IS NULL THEN 'added' WHEN n.id IS NULL THEN 'removed' ELSE 'changed' END AS change
FROM o FULL JOIN n ON o.feed_id = n.feed_id AND o.id = n.id WHERE o.id IS NULL OR n.id IS NULL OR o.v IS DISTINCT FROM n.v"""


def row_hashes(spark: SparkSession, sf: str) -> DataFrame:
    n = read(spark, sf, "customer")
    return n.select("c_custkey", catalog.row_hash(["c_custkey", "c_name", "c_nationkey", "c_mktsegment"]).alias("content_hash"))


HASH_SQL = "SELECT c_custkey, sha256(c_custkey || chr(31) || c_name || chr(31) || c_nationkey || chr(31) || c_mktsegment) AS content_hash FROM customer"


def content_version(spark: SparkSession, sf: str) -> DataFrame:
    r = read(spark, sf, "catalog_records")
    return catalog.content_version(r.select(catalog.record_text().alias("record")), ["record"])


def _version_sql() -> str:
    blank = {"last_checked_at": "CAST(NULL AS VARCHAR)", "provenance": "list_transform(provenance, lambda p: CASE WHEN p IS NOT NULL THEN struct_pack(source_id := p.source_id, source_url := p.source_url, revision := p.revision, retrieved_at := CAST(NULL AS VARCHAR), content_hash := p.content_hash, license := p.license) END)", "rights": "list_sort(map_entries(rights))"}
    named = [c.split()[0] for c in R.RECORD.replace("\n", " ").split(", ") if not c.startswith("row_id")]
    text = f"CAST(to_json(struct_pack({', '.join(f'{n} := {blank.get(n, n)}' for n in named)})) AS VARCHAR)"
    return f"""WITH h AS (SELECT h, count(*) AS n FROM (SELECT sha256({text}) AS h FROM catalog_records) GROUP BY h),
six AS (SELECT substr(h, 1, 6) AS b, sha256(string_agg(h || 'x' || n, ',' ORDER BY h || 'x' || n)) AS h FROM h GROUP BY ALL),
three AS (SELECT substr(b, 1, 3) AS p, sha256(string_agg(b || ':' || h, ',' ORDER BY b || ':' || h)) AS h FROM six GROUP BY ALL)
SELECT 'v1-' || substr(sha256(coalesce(string_agg(p || ':' || h, ',' ORDER BY p || ':' || h), '')), 1, 16) AS version FROM three"""


VERSION_SQL = _version_sql()


def index_records(spark: SparkSession, sf: str) -> DataFrame:
    """Records made of the sound rows of index tables."""
    entries = rejects.index_clean(read(spark, sf, "readme_lines"))
    r = catalog.entries_to_records(entries, "index", "https://lists.example/index.md", "fixture-1", "2026-01-01T00:00:00Z", "a" * 64)
    return r.select("row_id", "id", "name", "description", F.array_join("categories", "|").alias("categories"), "provider", "docs_url", F.to_json("auth").alias("auth"), "https", "cors", "status")


# ---- policy, reports, steps ----------------------------------------------------------------------

#: What the records of one source of the test tables would have to say.
POLICY = policy.SourcePolicy("partner-feed", "https://git.partner-feed.example/raw/{revision}", "MIT", rights=(("license", "MIT"),))
#: Hosts, and paths by host, that are left out of catalogues in the test of excluded addresses.
EXCLUDED = (("docs.norvane-data.test",), {"docs.harrow-finch.test": "/sokirezope-weather", "docs.fapikiroga.test": "/"})


def source_policy(spark: SparkSession, sf: str) -> DataFrame:
    return policy.policy_errors(read(spark, sf, "catalog_records"), POLICY)


def _policy_sql() -> str:
    some = lambda bad: f"len(list_filter(provenance, lambda p: coalesce({bad}, true))) > 0"
    rules = [
        ("source_tier", "coalesce(source_tier <> 'public', true)", "must be public"), ("openapi", "openapi IS NOT NULL", "must be null"), ("rights", "coalesce(list_sort(map_entries(rights)) <> [struct_pack(key := 'license', value := 'MIT')], true)", "must be those of the source"),
        ("provenance.source_id", some("p.source_id <> 'partner-feed'"), "must be partner-feed"), ("provenance.revision", some("NOT regexp_matches(p.revision, '^[0-9a-f]{40}$')"), "must be a full commit"),
        ("provenance.source_url", some("p.source_url <> 'https://git.partner-feed.example/raw/' || p.revision"), "must be pinned to the revision"), ("provenance.license", some("p.license <> 'MIT'"), "must be MIT"),
        ("last_checked_at", "len(list_filter(provenance, lambda p: p.retrieved_at IS DISTINCT FROM last_checked_at)) > 0", "must be the time the source was retrieved at"),
    ]
    return " UNION ALL ".join(f"SELECT row_id, '{path}' AS path, '{message}' AS message FROM catalog_records WHERE {bad}" for path, bad, message in rules)


def source_values(spark: SparkSession, sf: str) -> DataFrame:
    """Fields of sources that are not one value in all records of a source: each record's own, of revision, content hash and license."""
    r = read(spark, sf, "catalog_records")
    return policy.disagreements(r, {f"provenance.{n}": F.col(f"provenance.{n}") for n in ("revision", "content_hash", "license")} | {"source_tier": F.array("source_tier"), "rights.license": F.array(F.try_element_at("rights", F.lit("license")))})


def _values_sql() -> str:
    lists = {f"provenance.{n}": f"list_transform(provenance, lambda p: p.{n})" for n in ("revision", "content_hash", "license")} | {"source_tier": "[source_tier]", "rights.license": "[rights['license']]"}
    return " UNION ALL ".join(f"SELECT '{path}' AS path, 'must be one value in all records' AS message FROM (SELECT count(DISTINCT coalesce(v, chr(1))) AS n FROM (SELECT unnest({x}) AS v FROM catalog_records)) WHERE n > 1" for path, x in lists.items())


def record_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Keys of the rights of records against some of the closed set."""
    return policy.key_differences(read(spark, sf, "catalog_records"), "row_id", F.to_json("rights"), quality.RIGHTS_KEYS[:5])


KEYS_SQL = f"""WITH k AS (SELECT row_id, map_keys(rights) AS ks FROM catalog_records), a AS (SELECT [{', '.join(map(Q.q, quality.RIGHTS_KEYS[:5]))}] AS allowed)
SELECT row_id, unnest(list_filter(allowed, lambda x: NOT list_contains(ks, x))) AS name, 'missing' AS problem FROM k, a WHERE ks IS NOT NULL
UNION ALL SELECT row_id, unnest(list_filter(ks, lambda x: NOT list_contains(allowed, x))), 'unexpected' FROM k, a WHERE ks IS NOT NULL UNION ALL SELECT row_id, NULL, 'no object' FROM k WHERE ks IS NULL"""


def report_errors(spark: SparkSession, sf: str) -> DataFrame:
    s = snapshots.current(read(spark, sf, "catalog_snapshots"), "feed_id", "snapshot_no", "id", "delivered_at", {})
    return policy.report_errors(s, read(spark, sf, "update_reports"), "feed_id", "snapshot_no").withColumnsRenamed({"feed": "feed_id", "no": "snapshot_no"})


REPORT_SQL = """WITH n AS (SELECT feed_id, snapshot_no, count(DISTINCT id) AS n FROM catalog_snapshots WHERE feed_id IS NOT NULL AND snapshot_no IS NOT NULL GROUP BY ALL),
b AS (SELECT *, coalesce(lag(n) OVER (PARTITION BY feed_id ORDER BY snapshot_no), 0) AS b FROM n),
r AS (SELECT u.feed_id, u.snapshot_no, catalog_version AS v, counts AS c, n, b FROM update_reports u LEFT JOIN b USING (feed_id, snapshot_no) WHERE u.feed_id IS NOT NULL AND u.snapshot_no IS NOT NULL)
SELECT feed_id, snapshot_no, 'snapshot_no' AS path, 'has no snapshot' AS message FROM r WHERE n IS NULL
UNION SELECT feed_id, snapshot_no, 'catalog_version', 'must be v1- and 16 hex digits' FROM r WHERE n IS NOT NULL AND NOT coalesce(regexp_matches(v, '^v1-[0-9a-f]{16}$'), false)
UNION SELECT feed_id, snapshot_no, 'counts', 'must be an object' FROM r WHERE n IS NOT NULL AND c IS NULL
UNION SELECT feed_id, snapshot_no, 'counts.after', 'does not match the snapshot' FROM r WHERE n IS NOT NULL AND c IS NOT NULL AND c.after IS DISTINCT FROM n
UNION SELECT feed_id, snapshot_no, 'counts.before', 'does not match the snapshot before' FROM r WHERE n IS NOT NULL AND c IS NOT NULL AND c.before IS DISTINCT FROM b
UNION SELECT feed_id, snapshot_no, 'counts.normalized', 'is above parsed' FROM r WHERE n IS NOT NULL AND c.normalized > c.parsed"""


def excluded_addresses(spark: SparkSession, sf: str) -> DataFrame:
    r = read(spark, sf, "catalog_records")
    return r.where(U.is_excluded(F.col("docs_url"), *EXCLUDED)).select("row_id", "docs_url")


EXCLUDED_SQL = f"SELECT row_id, docs_url FROM (SELECT *, rtrim({Q.host('docs_url')}, '.') AS h, lower(coalesce(nullif({Q.part('docs_url', 'path')}, ''), '/')) AS p FROM catalog_records) WHERE h = 'docs.norvane-data.test' OR (h = 'docs.harrow-finch.test' AND (p = '/sokirezope-weather' OR starts_with(p, '/sokirezope-weather/'))) OR (h = 'docs.fapikiroga.test' AND starts_with(p, '/'))"


def unsorted_ids(spark: SparkSession, sf: str) -> DataFrame:
    return quality.out_of_order(read(spark, sf, "catalog_records"), "row_id", "id")


UNSORTED_SQL = "SELECT r.row_id FROM catalog_records r JOIN catalog_records b ON b.row_id + 1 = r.row_id WHERE r.id < b.id"


def pipeline_counts(spark: SparkSession, sf: str) -> DataFrame:
    """From index tables to a catalogue: entries, records, and records once merged."""
    entries = cut(rejects.index_clean(read(spark, sf, "readme_lines")))
    r = cut(catalog.entries_to_records(entries, "index", "https://lists.example/index.md", "fixture-1", "2026-01-01T00:00:00Z", "a" * 64))
    merged = resolve.entity_groups(r).select("group").distinct()
    return policy.pipeline_counts(r.limit(0), entries, r, merged)


_MADE = f"""made AS (SELECT line_id AS row_id, CASE WHEN {Q.slug('provider')} = {Q.slug('name')} THEN {Q.slug('name')} ELSE {Q.slug('provider')} || ':' || {Q.slug('name')} END AS id, trim(name, ' ') AS name, CAST([] AS VARCHAR[]) AS aliases, provider, canonical AS docs_url, description, auth, https, cors, category
FROM (SELECT *, coalesce(nullif(regexp_replace({Q.host('canonical')}, '^(?:www\\d*|api)\\.', ''), ''), name) AS provider FROM (SELECT * EXCLUDE (docs_url), {_canon()} AS canonical FROM (SELECT *, url AS docs_url FROM entries)) WHERE trim(name) <> '' AND canonical IS NOT NULL))"""


def _records_sql() -> str:
    raw = "regexp_replace(trim(auth, ' '), '^`+|`+$', '', 'g')"
    header = f"(kind = 'api_key' AND regexp_matches({raw}, '[-_]'))"
    place = f"CASE WHEN {header} OR kind IN ('basic', 'bearer', 'user_agent') THEN 'header' WHEN contains(lower({raw}), 'query') THEN 'query' ELSE 'unknown' END"
    auth = f"""'[{{"type":"' || kind || '","location":"' || {place} || '","name":"' || CASE WHEN {header} THEN {raw} ELSE '' END || '","source":"index","confidence":' || CASE WHEN kind = 'unknown' THEN '0.5' ELSE '1.0' END || '}}]'"""
    return f"WITH entries AS ({M.CLEAN}), {_MADE} SELECT row_id, id, name, description, category AS categories, provider, docs_url, {auth} AS auth, {M.tri_state('https')} AS https, {M.tri_state('cors')} AS cors, 'unknown' AS status FROM (SELECT *, {M.auth_type('auth')} AS kind FROM made)"


def _pipeline_sql() -> str:
    return f"""WITH RECURSIVE entries AS ({M.CLEAN}), {_MADE}, {_tokens("made")},
owned AS (SELECT row_id, min(row_id) OVER (PARTITION BY token) AS owner FROM tokens),
linked AS (SELECT row_id AS x, owner AS y FROM owned WHERE row_id <> owner UNION SELECT owner, row_id FROM owned WHERE row_id <> owner),
walk(x, g) AS (SELECT x, x FROM linked UNION SELECT linked.y, walk.g FROM walk JOIN linked ON linked.x = walk.x WHERE walk.g < linked.y)
SELECT CAST(0 AS BIGINT) AS before, (SELECT count(*) FROM entries) AS parsed, (SELECT count(*) FROM made) AS normalized, (SELECT count(DISTINCT coalesce(g, row_id)) FROM made LEFT JOIN (SELECT x, min(g) AS g FROM walk GROUP BY x) ON x = row_id) AS after"""


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        p1_found, p1_clean, p6_found, token_stats, field_lengths, name_phrases, query_terms, search_gated, search_totals, render_results, freshness, record_values, spelled_values, slug_ids, url_forms, validation_errors, catalog_errors, repeated_ids,
        identity_tokens, entity_groups, merged_records, part_groups, provider_tags, snapshot_diff, row_hashes, content_version, index_records, source_policy, source_values, record_keys, report_errors, excluded_addresses, unsorted_ids, pipeline_counts,
    )
} | {k: _search(a) for k, a in SEARCHES.items()}

ORACLE: dict[str, str] = {
    "p1_found": M.FOUND, "p1_clean": M.CLEAN, "spelled_values": M.SPELLED, "p6_found": P6_SQL, "token_stats": TOKEN_SQL, "field_lengths": LENGTH_SQL, "name_phrases": PHRASE_SQL, "freshness": FRESH_SQL, "record_values": VALUE_SQL, "slug_ids": SLUG_SQL, "url_forms": URL_SQL,
    "validation_errors": _checks(), "repeated_ids": REPEATED_SQL, "identity_tokens": TOKENS_SQL, "entity_groups": GROUPS_SQL, "source_policy": _policy_sql(), "source_values": _values_sql(), "record_keys": KEYS_SQL, "report_errors": REPORT_SQL, "excluded_addresses": EXCLUDED_SQL, "unsorted_ids": UNSORTED_SQL, "pipeline_counts": _pipeline_sql(), "content_version": VERSION_SQL, "merged_records": MERGED_SQL, "catalog_errors": CATALOG_SQL, "provider_tags": TAGS_SQL, "snapshot_diff": DIFF_SQL, "row_hashes": HASH_SQL,
    "part_groups": PART_SQL, "index_records": _records_sql(),
    "search_gated": X.search(S.check_arguments(**GATED), _DOCUMENTS), "search_totals": " UNION ALL ".join(X.totals(S.check_arguments(**a)) for a in SEARCHES.values()),
    "query_terms": X.expanded(EXPANDED), "render_results": X.rendered(S.check_arguments(query="weather", limit=20)),
} | {k: X.search(S.check_arguments(**a)) for k, a in SEARCHES.items()}
