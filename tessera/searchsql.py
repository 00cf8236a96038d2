"""The DuckDB SQL of searches. Expansion, gates and scores are written here from their rules; nothing of it is taken from the Python that plans searches but the fixed values."""

from __future__ import annotations

from .plans.search import B, K1, LABELS, MANDATORY, WEIGHTS
from .sqltext import AUTH, STATUS, joined, micros, phrase, q, safe_url, terms, tiers, tri, words

#: The records that are searched, as a relation with the columns of the record schema.
RECORDS = "catalog_records"


def fresh(source: str = RECORDS) -> str:
    return f"""fresh AS (
  SELECT *, CASE WHEN marked THEN 'stale' WHEN age IS NULL THEN 'unknown' WHEN age <= 365 THEN 'fresh' ELSE 'stale' END AS freshness
  FROM (SELECT *, greatest(0, CAST(floor((max(stamp) OVER () - stamp) / 86400000000) AS BIGINT)) AS age FROM (
    SELECT row_id AS doc, list_max(list_filter(list_concat([{micros("last_checked_at")}], list_transform(coalesce(provenance, []), lambda p: {micros("p.retrieved_at")})), lambda x: x IS NOT NULL)) AS stamp,
      regexp_matches(lower({joined("quality_flags")}), 'stale|outdated') OR coalesce(status, '') = 'stale' AS marked
    FROM {source})))"""


def expansion(text: str, name: str) -> str:
    """Tables name_hit (pos, concept), name_ct (pos, concept, t, i) and name_terms (t, w, k: order) of a query, with the latest concepts of query_aliases."""
    lit = q(text)
    return f"""{name}_q AS (SELECT array_to_string({words(lit)}, ' ') AS said, regexp_matches({lit}, '\\p{{Han}}') AS han),
{name}_hit AS (SELECT DISTINCT pos, concept FROM (SELECT pos, concept, array_to_string({words("p")}, ' ') AS p FROM (
    SELECT pos, concept, unnest(list_concat([concept], list_filter(coalesce(aliases, []), lambda x: trim(coalesce(x, '')) <> ''))) AS p FROM query_aliases WHERE version = (SELECT max(version) FROM query_aliases) AND coalesce(concept, '') <> '')), {name}_q
  WHERE p <> '' AND CASE WHEN regexp_matches(p, '\\p{{Han}}') THEN contains(replace(said, ' ', ''), replace(p, ' ', '')) ELSE contains(' ' || said || ' ', ' ' || p || ' ') END),
{name}_ct AS (SELECT pos, concept, unnest(ts) AS t, generate_subscripts(ts, 1) AS i FROM (SELECT pos, concept, {terms(words("concept"))} AS ts FROM {name}_hit)),
{name}_terms AS (SELECT t, max(w) AS w, min(k) AS k FROM (SELECT unnest(ts) AS t, 1.0::DOUBLE AS w, generate_subscripts(ts, 1) AS k FROM (SELECT {terms(words(lit))} AS ts)
  UNION ALL SELECT t, CASE WHEN han THEN 0.6::DOUBLE ELSE 0.25::DOUBLE END, 1000000 + pos * 1000 + i FROM {name}_ct, {name}_q) GROUP BY t)"""


def scored(a: dict, source: str = RECORDS) -> str:
    """Tables of a search: s, the records that fit with all that is shown of them, and top, the first ones with their rank."""
    fields = list(WEIGHTS)
    src = {"name": "name", "aliasesTags": f"{joined('aliases')} || chr(10) || {joined('tags')}", "categories": joined("categories"), "description": "description"}
    said = f"(SELECT {phrase(q(a['query']))})"
    where = ["true"]
    tables = [expansion(a["query"], "main")]
    if a["categories"]:
        each = []
        for k, c in enumerate(a["categories"]):
            tables.append(expansion(c, f"cat{k}"))
            each.append(f"list_contains(cat_ids, (SELECT {phrase(q(c))})) OR list_has_any(t_categories, (SELECT coalesce(list(t), CAST([] AS VARCHAR[])) FROM cat{k}_terms))")
        where.append("(" + " OR ".join(each) + ")")
    if a["source_tier"] != "all":
        where.append(f"list_contains(tiers, {q(a['source_tier'])})")
    if a["auth"]:
        where.append(f"list_contains(kinds, {q(a['auth'])})")
    where += [f"{k} = {q(a[k])}" for k in ("https", "cors", "status") if a[k]]

    def gain(f: str) -> str:
        return f"{WEIGHTS[f]}::DOUBLE * w * ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * {K1 + 1}::DOUBLE / (tf + {K1}::DOUBLE * ({1 - B}::DOUBLE + {B}::DOUBLE * len(t_{f}) / avg_{f})))"

    gains = " UNION ALL ".join(
        f"SELECT doc, {j} AS f, t, {gain(f)} AS c FROM (SELECT r.doc, d.t, d.w, d.df, CAST(len(list_filter(r.t_{f}, lambda x: x = d.t)) AS DOUBLE) AS tf, r.t_{f} FROM rows r CROSS JOIN dfs d) CROSS JOIN stats WHERE tf > 0" for j, f in enumerate(fields)
    )
    mandatory = ", ".join(map(q, MANDATORY))
    labels = "[" + ", ".join(q(LABELS.get(f, f)) for f in fields) + "]"
    listed = AUTH.removeprefix("list_distinct(").removesuffix(")")
    kinds = f"list_filter({listed}, lambda v, i: list_position({listed}, v) = i)"
    clean = "list_filter(list_transform(coalesce(categories, []), lambda v: trim(v)), lambda v: v <> '')"
    return f"""{", ".join(tables)},
rows AS (SELECT *, list_concat(list_concat(t_name, t_aliasesTags), list_concat(t_categories, t_description)) AS every FROM (
  SELECT row_id AS doc, id, trim(coalesce(name, '')) AS name, trim(coalesce(description, '')) AS description, trim(coalesce(provider, '')) AS provider, {clean} AS categories, docs_url, openapi, {tri("https")} AS https, {tri("cors")} AS cors, {STATUS} AS status, {tiers()} AS tiers, {kinds} AS kinds,
    {phrase("name")} AS canon, array_to_string({words("name")}, ' ') AS norm, list_transform(coalesce(categories, []), lambda c: {phrase("c")}) AS cat_ids, {", ".join(f"{terms(words(src[f]))} AS t_{f}" for f in fields)}
  FROM {source})),
stats AS (SELECT greatest(1, count(*)) AS n, {", ".join(f"greatest(1.0::DOUBLE, avg(len(t_{f}))) AS avg_{f}" for f in fields)} FROM rows),
dfs AS (SELECT m.t, m.w, (SELECT count(*) FROM rows r WHERE list_contains(r.every, m.t)) AS df FROM main_terms m),
{fresh(source)},
gains AS ({gains}),
sums AS (SELECT doc, sum(c) AS total, list(struct_pack(c := -c, f := f, t := t) ORDER BY -c, f, t) AS parts FROM gains WHERE c > 0 GROUP BY doc),
cover AS (SELECT doc, count(*) FILTER (WHERE ok) AS covered, string_agg(concept, ', ' ORDER BY pos) FILTER (WHERE ok) AS names FROM (SELECT r.doc, c.pos, c.concept, bool_and(list_contains(r.every, c.t)) AS ok FROM rows r CROSS JOIN main_ct c GROUP BY ALL) GROUP BY doc),
hits AS (SELECT count(*) AS n, string_agg(concept, ', ' ORDER BY pos) AS names FROM main_hit),
p AS (SELECT r.*, freshness, age, coalesce(parts, []) AS parts, coalesce(total, 0) AS total, coalesce(covered, 0) AS covered, coalesce(cover.names, '') AS cover_names, {said} AS qp, (SELECT count(*) FROM main_terms) AS nterms FROM rows r JOIN fresh USING (doc) LEFT JOIN sums USING (doc) LEFT JOIN cover USING (doc)),
b AS (SELECT *, CASE WHEN nterms = 0 OR qp = '' THEN NULL WHEN canon = qp THEN 'exact name match' WHEN length(qp) >= 3 AND starts_with(canon, qp) THEN 'name prefix match' WHEN length(canon) >= 3 AND starts_with(qp, canon) THEN 'query starts with API name' END AS said,
  NOT EXISTS (SELECT 1 FROM main_terms m WHERE m.w = 1 AND m.t IN ({mandatory}) AND NOT list_contains(every, m.t)) AND ((SELECT n FROM hits) < 2 OR covered = (SELECT n FROM hits)) AS gate FROM p),
l AS (SELECT *, CASE WHEN gate THEN total + CASE said WHEN 'exact name match' THEN 14 WHEN 'name prefix match' THEN 7 WHEN 'query starts with API name' THEN 2 ELSE 0 END ELSE 0 END AS lexical FROM b WHERE {" AND ".join(where)}),
s AS (SELECT *, lexical + (CASE freshness WHEN 'fresh' THEN 0.04::DOUBLE WHEN 'stale' THEN -0.18::DOUBLE ELSE 0 END + CASE WHEN age > 730 THEN -0.08::DOUBLE ELSE 0 END) + CASE WHEN status = 'active' THEN 0.04::DOUBLE ELSE 0 END + CASE WHEN list_contains(tiers, 'apilayer') THEN 0.005::DOUBLE ELSE 0 END AS raw,
  list_filter(list_concat(list_concat([said], list_transform(parts[1:(CASE WHEN said IS NULL THEN 6 ELSE 5 END)], lambda g: {labels}[g.f + 1] || ' matches ' || chr(39) || g.t || chr(39))), ['query aliases: ' || (SELECT names FROM hits), CASE WHEN cover_names <> '' THEN 'concept coverage: ' || cover_names END,
    CASE freshness WHEN 'fresh' THEN 'fresh source snapshot' WHEN 'stale' THEN 'stale source penalty' END, CASE WHEN status = 'active' THEN 'active product boost' END]), lambda x: x IS NOT NULL) AS reasons
  FROM l WHERE {"lexical > 0" if a["query"].strip() else "true"}),
top AS (SELECT *, CAST(row_number() OVER (ORDER BY raw DESC, CAST(list_contains(tiers, 'apilayer') AS INT) DESC, norm, id NULLS FIRST, doc) AS INTEGER) AS rank, CASE WHEN len(tiers) = 1 THEN tiers[1] ELSE 'merged' END AS tier, coalesce({safe_url("docs_url")}, '') AS shown_url FROM s QUALIFY rank <= {a["limit"]})"""


def search(a: dict, source: str = RECORDS) -> str:
    """The SQL of a search; arguments as plans.search.check_arguments gives them."""
    return f"""WITH {scored(a, source)}
SELECT rank, doc, id, name, round(raw, 6) AS score, array_to_string(reasons, '; ') AS reasons, tier AS source_tier, freshness, shown_url AS docs_url, openapi.specification AS specification, openapi.path_count AS path_count FROM top"""


def totals(a: dict) -> str:
    return f"""SELECT * FROM (WITH {scored(a)} SELECT {q(a["query"])} AS query, coalesce((SELECT string_agg(t, ' ' ORDER BY k) FROM main_terms), '') AS expanded, coalesce((SELECT names FROM hits), '') AS matched_aliases, count(*) AS total_matches, count(*) > {a["limit"]} AS truncated FROM s)"""


def expanded(queries: tuple[str, ...]) -> str:
    return " UNION ALL ".join(f"SELECT * FROM (WITH {expansion(x, 'main')} SELECT {q(x)} AS query, CAST(row_number() OVER (ORDER BY k) - 1 AS INTEGER) AS pos, t AS term, w AS weight FROM main_terms)" for x in queries)


def inline(x: str) -> str:
    one = f"regexp_replace(coalesce({x}, ''), '[\\r\\n]+', ' ', 'g')"
    return f"trim(regexp_replace(replace({one}, '\\', '\\\\'), '([\\[\\]_*`#<>|])', '\\\\\\1', 'g'))"


def rendered(a: dict) -> str:
    """rank, block of a search."""

    def some(x: str) -> str:
        return f"coalesce(nullif({x}, ''), 'unknown')"

    def many(c: str) -> str:
        return f"CASE WHEN len({c}) > 0 THEN array_to_string(list_transform({c}, lambda v: {inline('v')}), ', ') ELSE 'unknown' END"

    key = f"array_to_string({words('v')}, ' ')"
    unique = f"list_filter(categories, lambda v, i: list_position(list_transform(categories, lambda v: {key}), {key}) = i)"
    label = f"regexp_replace({inline('CASE WHEN length(name) > 0 THEN name ELSE coalesce(id, chr(45)) END')}, '([()])', '\\\\\\1', 'g')"
    pieces = f"concat_ws(' · ', CASE WHEN coalesce(openapi.specification, '') <> '' THEN trim({inline('openapi.specification')} || ' ' || {inline('openapi.specification_version')}) END, openapi.path_count || ' paths', openapi.operation_count || ' operations')"
    return f"""WITH {scored(a)} SELECT rank, concat_ws(chr(10), '### ' || rank || '. ' || CASE WHEN shown_url <> '' THEN '[' || {label} || '](<' || shown_url || '>)' ELSE {label} END, '', coalesce(nullif({inline("description")}, ''), 'No description available.'), '',
'Provider: ' || {some(inline("provider"))} || ' · Category: ' || {many(f"({unique})")} || ' · Auth: ' || {many("kinds")}, 'HTTPS: ' || https || ' · CORS: ' || cors || ' · Status: ' || {inline("status")} || ' · Source: ' || tier,
'Score: ' || printf('%.3f', round(raw, 6)) || ' · Freshness: ' || freshness, CASE WHEN {pieces} <> '' THEN 'OpenAPI: ' || {pieces} END, 'Matched because: ' || array_to_string(list_transform(reasons, lambda v: {inline("v")}), '; ')) AS block FROM top"""
