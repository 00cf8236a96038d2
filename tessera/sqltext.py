"""Pieces of DuckDB SQL that say what the Column functions say; the SQL of the queries is put together from them."""

from __future__ import annotations

import unicodedata

from .functions import text as T
from .functions import urls as U

_RFC = r"^\d{4}-\d{2}-\d{2}[Tt ](?:[01]\d|2[0-3]):[0-5]\d:[0-5]\d(?:\.\d+)?(?:[Zz]|[+-](?:[01]\d|2[0-3]):[0-5]\d)$"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def nfkc(x: str) -> str:
    """Compatibility forms of one character by a table made from Unicode's data, of several by name; then composition."""
    one = [(chr(c), unicodedata.normalize("NFKC", chr(c))) for c in range(0x80, 0x10000) if not 0xD800 <= c <= 0xDFFF and not 0xAC00 <= c <= 0xD7A3]
    pairs = [(a, b) for a, b in one if a != b and len(b) == 1 and b != "'"]
    out = f"translate({x}, {q(''.join(a for a, _ in pairs))}, {q(''.join(b for _, b in pairs))})"
    for c in "½¼¾™№ﬀﬁﬂﬃﬄ…":
        out = f"replace({out}, {q(c)}, {q(unicodedata.normalize('NFKC', c))})"
    return f"nfc_normalize({out})"


def words(x: str, fold: bool = True) -> str:
    t = f"coalesce({x}, '')"
    return f"regexp_extract_all(replace(lower({nfkc(t) if fold else t}), '&', ' and '), '[a-z0-9]+(?:[._+\\-][a-z0-9]+)*|\\p{{Han}}+')"


def stem(t: str) -> str:
    return f"CASE WHEN {t} = 'apis' THEN 'api' WHEN length({t}) > 4 AND {t} LIKE '%ies' THEN substr({t}, 1, length({t}) - 3) || 'y' WHEN length({t}) > 3 AND {t} LIKE '%s' AND {t} NOT LIKE '%ss' THEN substr({t}, 1, length({t}) - 1) ELSE {t} END"


def terms(ws: str) -> str:
    stops = ", ".join(map(q, T.STOP_WORDS))
    return (
        f"flatten(list_transform({ws}, lambda t: CASE WHEN regexp_matches(t, '^\\p{{Han}}') THEN list_concat([t], CASE WHEN length(t) > 2 THEN list_transform(range(1, length(t)), lambda k: substr(t, k, 2)) ELSE CAST([] AS VARCHAR[]) END) "
        f"ELSE list_filter([{stem('t')}], lambda s: s NOT IN ({stops})) END))"
    )


def phrase(x: str, fold: bool = True) -> str:
    return f"array_to_string(regexp_extract_all(regexp_replace(array_to_string({words(x, fold)}, ' '), '\\bapis?\\b', ' ', 'g'), '[a-z0-9]+(?:[._+\\-][a-z0-9]+)*|\\p{{Han}}+'), '')"


def is_time(x: str) -> str:
    return f"coalesce(regexp_matches({x}, '{_RFC}') AND try_cast(substr({x}, 1, 10) AS DATE) IS NOT NULL, false)"


def micros(x: str) -> str:
    return f"CASE WHEN {is_time(x)} THEN epoch_us(try_cast({x} AS TIMESTAMPTZ)) END"


_PARTS = r"^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?$"


def part(u: str, which: str) -> str:
    k = {"scheme": 1, "authority": 2, "path": 3, "query": 4, "fragment": 5}[which]
    got = f"coalesce(regexp_extract({u}, '{_PARTS}', {k}), '')"
    return f"lower({got})" if which == "scheme" else f"regexp_replace({got}, '^[?#]', '')" if k > 3 else got


def host(u: str) -> str:
    return f"lower(regexp_replace(regexp_replace({part(u, 'authority')}, '^.*@', ''), ':\\d*$', ''))"


def query_key(k: str) -> str:
    return f"regexp_replace(regexp_replace(lower(trim({k})), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')"


def sensitive(u: str) -> str:
    names = ", ".join(map(q, U.SENSITIVE_KEYS))
    ends = "|".join(U.SENSITIVE_ENDINGS)
    return f"len(list_filter(string_split({part(u, 'query')}, '&'), lambda p: p <> '' AND ({query_key('string_split(p, chr(61))[1]')} IN ({names}) OR regexp_matches({query_key('string_split(p, chr(61))[1]')}, '({ends})$')))) > 0"


def safe_url(url: str) -> str:
    u = f"trim({url})"
    kept = f"list_filter(string_split({part(u, 'query')}, '&'), lambda p: p <> '' AND NOT starts_with({query_key('string_split(p, chr(61))[1]')}, 'utm_'))"
    return (
        f"CASE WHEN {part(u, 'scheme')} IN ('http', 'https') AND {host(u)} <> '' AND NOT contains({part(u, 'authority')}, '@') AND NOT ({sensitive(u)}) AND NOT regexp_matches({u}, '\\s') THEN "
        f"{part(u, 'scheme')} || '://' || lower({part(u, 'authority')}) || CASE WHEN {part(u, 'path')} = '' THEN '/' ELSE {part(u, 'path')} END || CASE WHEN len({kept}) > 0 THEN '?' || array_to_string({kept}, '&') ELSE '' END END"
    )


def url_problem(u: str, https_only: bool = False) -> str:
    """The first rule that an address breaks, as text."""
    place = f"regexp_replace({part(u, 'authority')}, '^.*@', '')"
    port = f"try_cast(nullif(regexp_extract({part(u, 'authority')}, ':(\\d+)$', 1), '') AS INTEGER)"
    names = ", ".join(map(q, U.SENSITIVE_KEYS))
    ends = "|".join(U.SENSITIVE_ENDINGS)
    keys = f"list_transform(list_filter(string_split({part(u, 'query')}, '&'), lambda p: p <> ''), lambda p: {query_key('replace(string_split(p, chr(61))[1], chr(43), chr(32))')})"
    secret = f"list_sort(list_distinct(list_filter({keys}, lambda k: k IN ({names}) OR regexp_matches(k, '({ends})$'))))"
    out = f"CASE WHEN {u} IS NULL OR {u} = '' OR regexp_matches({u}, '\\s') THEN 'must be a non-empty absolute URL without whitespace' WHEN (regexp_matches({place}, ':[^\\]]*$') AND NOT regexp_matches({place}, ':\\d{{0,5}}$')) OR coalesce({port}, 0) > 65535 THEN 'has an invalid host or port' WHEN {part(u, 'scheme')} NOT IN ('http', 'https') OR {host(u)} = '' THEN 'must be an absolute HTTP(S) URL'"
    if https_only:
        out += f" WHEN {part(u, 'scheme')} <> 'https' THEN 'must use HTTPS'"
    out += f" WHEN contains({part(u, 'authority')}, '@') THEN 'must not contain URL userinfo or credentials'"
    if https_only:
        out += f" WHEN coalesce({port}, 443) <> 443 THEN 'must not use a non-443 port'"
    return out + f" WHEN len({secret}) > 0 THEN 'must not contain sensitive query key(s): ' || array_to_string({secret}, ', ') END"


def slug(x: str) -> str:
    low = f"regexp_replace(replace(lower(strip_accents({nfkc(x)})), 'ß', 'ss'), '\\p{{M}}+', '', 'g')"
    joined = f"regexp_replace(regexp_replace({low}, '[^\\p{{L}}\\p{{N}}]+', '-', 'g'), '^-+|-+$', '', 'g')"
    return f"coalesce(nullif({joined}, ''), 'item-' || substr(sha256({x}), 1, 10))"


def label(x: str) -> str:
    """A slug without the parts api and service, unless nothing else is in it."""
    return f"list_transform([{slug(x)}], lambda s: coalesce(nullif(array_to_string(list_filter(string_split(s, '-'), lambda p: p NOT IN ('api', 'service')), '-'), ''), s))[1]"


def tiers() -> str:
    listed = "source_tier = 'apilayer' OR coalesce(len(list_filter(provenance, lambda p: starts_with(p.source_id, 'apilayer-'))) > 0, false)"
    public = "source_tier = 'public' OR coalesce(len(list_filter(provenance, lambda p: p.source_id = 'public-apis-readme')) > 0, false)"
    return f"list_filter([CASE WHEN coalesce({listed}, false) THEN 'apilayer' END, CASE WHEN coalesce({public}, false) THEN 'public' END], lambda x: x IS NOT NULL)"


AUTH = "list_distinct(list_filter(list_transform(coalesce(auth, []), lambda a: a.type), lambda k: k IN ('none', 'api_key', 'oauth2', 'basic', 'bearer', 'signed', 'user_agent', 'other', 'unknown')))"
STATUS = "CASE WHEN status IN ('active', 'coming_soon', 'stale', 'candidate', 'unknown') THEN status ELSE 'unknown' END"


def tri(c: str) -> str:
    return f"CASE WHEN {c} IN ('yes', 'no', 'unknown') THEN {c} ELSE 'unknown' END"


def joined(c: str) -> str:
    return f"coalesce(array_to_string(list_filter({c}, lambda v: v IS NOT NULL), chr(10)), '')"
