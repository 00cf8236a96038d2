"""The DuckDB SQL of index tables: their rows, what is wrong with them, and the sound ones."""

from __future__ import annotations

from .functions import records as R
from .operators.markdown import COLUMNS
from .sqltext import q

_CELLS = "regexp_extract_all(regexp_replace(CASE WHEN rtrim(line, '| ') LIKE '%\\' THEN line ELSE rtrim(line, '| ') END, '^\\|', '') || '|', '((?:[^|`\\\\]|\\\\.|`(?:[^`\\\\]|\\\\.)*`)*(?:[`\\\\].*)?)\\|', 1)"
_WANTED = "[" + ", ".join(map(q, COLUMNS)) + "]"

#: Table rows: line_id, category, header, cells of each row of an index table.
ROWS = f"""l AS (SELECT *, trim(translate(raw, chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '     '), ' ') AS line FROM (SELECT line_id, file_id, line_no, coalesce(raw_line, '') AS raw FROM readme_lines)),
c AS (SELECT *, length(regexp_extract(rtrim(raw), '^ {{0,3}}(#{{1,6}})(?:\\s|$)', 1)) AS level, CASE WHEN contains(line, '|') THEN list_transform({_CELLS}, lambda x: trim(x, ' ')) END AS split FROM l),
d AS (SELECT *, split[1:coalesce(list_max(list_filter(range(1, len(split) + 1), lambda i: split[i] <> '')), 0)] AS cells,
  contains(line, '|') AND contains(line, '-') AND regexp_matches(line, '^\\|?(?:\\s*:?-+:?\\s*\\|)*\\s*(?:\\:?-+:?\\s*)?$') AS sep, CASE WHEN level > 0 THEN trim(regexp_replace(regexp_replace(line, '^#+\\s*', ''), '\\s*#*$', '')) END AS title FROM c),
e AS (SELECT *, list_transform(cells, lambda x: lower(trim(regexp_replace(x, '[`*_]', '', 'g'), ' '))) AS names FROM d),
f AS (SELECT *, lag(CASE WHEN list_has_all(names, {_WANTED}) THEN names END) OVER w AS before FROM e WINDOW w AS (PARTITION BY file_id ORDER BY line_no, line_id)),
g AS (SELECT *, coalesce(sep AND before IS NOT NULL, false) AS starts FROM f),
h AS (SELECT *, last_value(CASE WHEN starts THEN before WHEN line = '' OR level > 0 THEN CAST([] AS VARCHAR[]) END IGNORE NULLS) OVER w AS header,
  last_value(CASE WHEN level = 2 THEN lower(title) = 'index' END IGNORE NULLS) OVER w AS inside, last_value(CASE WHEN level = 3 THEN title WHEN level = 2 THEN '' END IGNORE NULLS) OVER w AS category
  FROM g WINDOW w AS (PARTITION BY file_id ORDER BY line_no, line_id ROWS UNBOUNDED PRECEDING)),
table_rows AS (SELECT line_id, category, header, cells, {", ".join(f"cells[list_position(header, {q(n)})] AS {n}" for n in COLUMNS)} FROM h WHERE contains(line, '|') AND NOT starts AND len(header) > 0 AND inside)"""


def _count(x: str, ch: str) -> str:
    return f"(length({x}) - length(replace({x}, {q(ch)}, '')))"


def _is(x: str, pattern: str) -> str:
    return f"coalesce(regexp_matches({x}, {q(pattern)}), false)"


_BARE = "regexp_replace({}, '\\\\.', '', 'g')"
_API = _BARE.format("api")
_BAD = "[\\p{Cc}\\p{Cs}\\x{FFFD}]"
_REASONS = f"""judged AS (SELECT *, CASE
  WHEN {_count(_BARE.format("array_to_string(cells, '|')"), "`")} % 2 = 1 THEN 'quoting'
  WHEN {_is(_API, "[\\[\\]]|\\(\\s*(?i:https?:|www\\.)")} AND NOT ({_is(_API, "^\\[.*\\]\\(.*\\)$")} AND {_count(_API, "[")} = {_count(_API, "]")} AND {_count(_API, "(")} = {_count(_API, ")")}) THEN 'quoting'
  WHEN len(cells) <> len(header) THEN 'column_count'
  WHEN NOT {_is("api", "^\\[\\s*\\S.*\\]\\((?i:https?)://[^\\s/?#@:]+[^\\s]*\\)$")} OR {_is("api", _BAD)} OR NOT {_is("description", "\\S")} OR {_is("description", _BAD)} OR lower(trim(replace(auth, '`', ''))) NOT IN ('no', 'apikey', 'oauth', 'x-mashape-key', 'user-agent')
    OR lower(trim(replace(https, '`', ''))) NOT IN ('yes', 'no') OR lower(trim(replace(cors, '`', ''))) NOT IN ('yes', 'no', 'unknown') THEN 'invalid_value' END AS reason FROM table_rows)"""

FOUND = f"WITH {ROWS}, {_REASONS} SELECT line_id, reason FROM judged WHERE reason IS NOT NULL"


def plain_text(x: str) -> str:
    t = f"regexp_replace({x}, '!?\\[([^\\]]*)\\]\\([^)]*\\)', '\\1', 'g')"
    t = f"regexp_replace(regexp_replace({t}, '(?i)<br\\s*/?>', ' ', 'g'), '<[^<>]+>', '', 'g')"
    t = f"regexp_replace(regexp_replace({t}, '`|\\*\\*|__', '', 'g'), '\\\\([\\\\|_*`\\[\\]()<>#])', '\\1', 'g')"
    for name, ch in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&eacute;", "é"), ("&amp;", "&")):
        t = f"replace({t}, {q(name)}, {q(ch)})"
    return f"trim(regexp_replace({t}, '\\s+', ' ', 'g'), ' ')"


CLEAN = f"""WITH {ROWS}, {_REASONS} SELECT line_id, {plain_text("regexp_extract(api, '^\\[(.*)\\]\\(', 1)")} AS name, regexp_extract(api, '\\]\\(\\s*([^()\\s]+)', 1) AS url, {plain_text("description")} AS description,
trim(replace(auth, '`', ''), ' ') AS auth, lower(trim(replace(https, '`', ''), ' ')) AS https, lower(trim(replace(cors, '`', ''), ' ')) AS cors, {plain_text("coalesce(category, '')")} AS category FROM judged WHERE reason IS NULL"""


def _among(x: str, values: tuple[str, ...]) -> str:
    return f"{x} IN ({', '.join(map(q, values))})"


def auth_type(x: str) -> str:
    v = f"regexp_replace(lower({x}), '[^a-z0-9]+', '', 'g')"
    later = " ".join(f"WHEN {_among(v, R.AUTH_NAMES[k])} THEN '{k}'" for k in ("basic", "bearer", "signed", "user_agent", "unknown"))
    return f"CASE WHEN {_among(v, R.AUTH_NAMES['none'])} THEN 'none' WHEN {_among(v, R.AUTH_NAMES['api_key'])} THEN 'api_key' WHEN contains({v}, 'oauth') THEN 'oauth2' {later} ELSE 'other' END"


def tri_state(x: str) -> str:
    v = f"lower(trim({x}, ' '))"
    return f"CASE WHEN {_among(v, R.YES)} THEN 'yes' WHEN {_among(v, R.NO)} THEN 'no' ELSE 'unknown' END"


SPELLED = f"""WITH {ROWS}, s AS (SELECT 'auth' AS "column", auth AS raw, {auth_type("auth")} AS meant FROM table_rows UNION ALL SELECT n, raw, {tri_state("replace(raw, '`', '')")} FROM (SELECT 'https' AS n, https AS raw FROM table_rows UNION ALL SELECT 'cors', cors FROM table_rows))
SELECT "column", raw, meant, count(*) AS n FROM s WHERE raw IS NOT NULL GROUP BY ALL"""
