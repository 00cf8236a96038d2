"""Web addresses as Column expressions: parts, screening, canonical forms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names of query parameters that carry secrets, and endings of such names.
SENSITIVE_KEYS = (
    "api_key", "apikey", "access_key", "auth", "bearer", "client_secret", "credential", "googleaccessid", "jwt", "key", "passwd", "private_key",
    "refresh_token", "secret_key", "security_token", "sig", "subscription_key", "token", "access_token", "secret", "password", "signature", "authorization",
)
SENSITIVE_ENDINGS = ("_api_key", "_credential", "_secret", "_signature", "_subscription_key", "_token")

_PARTS = r"^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?$"


def part(url: Column, which: str) -> Column:
    """scheme (lower case), authority, path, query (without ?) or fragment of an absolute address; '' where there is none."""
    k = {"scheme": 1, "authority": 2, "path": 3, "query": 4, "fragment": 5}[which]
    got = F.regexp_extract(url, _PARTS, k)
    if which == "scheme":
        return F.lower(got)
    return F.regexp_replace(got, r"^[?#]", "") if k > 3 else got


def host(url: Column) -> Column:
    """Host in lower case, without userinfo and port; an IPv6 host keeps its brackets; '' where there is none."""
    return F.lower(F.regexp_replace(F.regexp_replace(part(url, "authority"), r"^.*@", ""), r":\d*$", ""))


def port(url: Column) -> Column:
    return F.regexp_extract(part(url, "authority"), r":(\d+)$", 1).try_cast("int")


def query_key(key: Column) -> Column:
    """The name of a query parameter, lower case, other characters as one underscore."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(key)), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def is_sensitive(key: Column) -> Column:
    k = query_key(key)
    return k.isin(*SENSITIVE_KEYS) | k.rlike(f"({'|'.join(SENSITIVE_ENDINGS)})$")


def query_keys(url: Column) -> Column:
    """Names of the query parameters, in order."""
    return F.transform(F.filter(F.split(part(url, "query"), "&"), lambda p: p != ""), lambda p: F.replace(F.regexp_extract(p, "^([^=]*)", 1), F.lit("+"), F.lit(" ")))


def has_sensitive_key(url: Column) -> Column:
    return F.exists(query_keys(url), is_sensitive)


def safe_public_url(url: Column) -> Column:
    """The address for show: no fragment, no utm_ parameters; null if it isn't http(s) with a host, or has userinfo or a secret."""
    u = F.trim(F.regexp_replace(url, r"^\s+|\s+$", ""))
    kept = F.filter(F.split(part(u, "query"), "&"), lambda p: (p != "") & ~query_key(F.regexp_extract(p, "^([^=]*)", 1)).startswith("utm_"))
    shown = F.concat(part(u, "scheme"), F.lit("://"), F.lower(part(u, "authority")), F.when(part(u, "path") == "", "/").otherwise(part(u, "path")), F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))
    ok = part(u, "scheme").isin("http", "https") & (host(u) != "") & ~part(u, "authority").contains("@") & ~has_sensitive_key(u) & ~u.rlike(r"\s")
    return F.when(ok, shown)


def url_problem(url: Column, https_only: bool = False) -> Column:
    """The first rule that an address breaks, as text; null for a sound one."""
    secret = F.array_sort(F.array_distinct(F.filter(F.transform(query_keys(url), query_key), is_sensitive)))
    place = F.regexp_replace(part(url, "authority"), r"^.*@", "")
    badport = place.rlike(r":[^\]]*$") & ~place.rlike(r":\d{0,5}$") | (F.coalesce(port(url), F.lit(0)) > 65535)
    checks = [
        (url.isNull() | (url == "") | url.rlike(r"\s"), F.lit("must be a non-empty absolute URL without whitespace")),
        (badport, F.lit("has an invalid host or port")),
        (~part(url, "scheme").isin("http", "https") | (host(url) == ""), F.lit("must be an absolute HTTP(S) URL")),
        *([(part(url, "scheme") != "https", F.lit("must use HTTPS"))] if https_only else []),
        (part(url, "authority").contains("@"), F.lit("must not contain URL userinfo or credentials")),
        *([(F.coalesce(port(url), F.lit(443)) != 443, F.lit("must not use a non-443 port"))] if https_only else []),
        (F.size(secret) > 0, F.concat(F.lit("must not contain sensitive query key(s): "), F.array_join(secret, ", "))),
    ]
    return F.coalesce(*[F.when(F.coalesce(c, F.lit(True)), m) for c, m in checks])


def canonical_url(url: Column) -> Column:
    """One form of an address: scheme and host in lower case, https where none is given, no default port, no fragment; null if it can't be one.

    Hosts that are not ASCII are kept as they are, in lower case.
    """
    raw = F.regexp_replace(F.replace(F.regexp_replace(url, r"^[\s<]+|[\s>]+$", ""), F.lit("&amp;"), F.lit("&")), r"^//", "https://")
    raw = F.when(raw.contains("://"), raw).when(raw.rlike(r"^[^/.][^/]*\.") & ~raw.rlike(r"^\.{0,2}/"), F.concat(F.lit("https://"), raw))
    s = part(raw, "scheme")
    plain_port = port(raw).isNull() | ((s == "http") & (port(raw) == 80)) | ((s == "https") & (port(raw) == 443))
    q = part(raw, "query")
    out = F.concat(s, F.lit("://"), host(raw), F.when(plain_port, "").otherwise(F.concat(F.lit(":"), port(raw).cast("string"))), part(raw, "path"), F.when(q != "", F.concat(F.lit("?"), q)).otherwise(""))
    ok = s.isin("http", "https") & (host(raw) != "") & ~part(raw, "authority").contains("@") & ~has_sensitive_key(raw)
    return F.when(ok, out)


def url_identity(url: Column) -> Column:
    """What two addresses of one page share: the canonical form with / for an empty path, all in lower case."""
    c = canonical_url(url)
    return F.lower(F.concat(part(c, "scheme"), F.lit("://"), part(c, "authority"), F.when(part(c, "path") == "", "/").otherwise(part(c, "path")), F.when(part(c, "query") != "", F.concat(F.lit("?"), part(c, "query"))).otherwise("")))


def provider_from_url(url: Column, fallback: Column) -> Column:
    """The host without a leading www. or api.; the fallback where there is none."""
    h = F.regexp_replace(host(url), r"^(?:www\d*|api)\.", "")
    return F.when(F.coalesce(h, F.lit("")) != "", h).otherwise(fallback)


def is_excluded(url: Column, hosts: tuple[str, ...] = (), paths: dict[str, str] | None = None) -> Column:
    """Whether an address is on one of hosts, or on a host of paths at its path or below it; letter case and a dot at the end of the host aside. Null is not."""
    h = F.rtrim(host(url), F.lit("."))
    path = F.lower(F.when(part(url, "path") == "", "/").otherwise(part(url, "path")))
    out = h.isin(*hosts) if hosts else F.lit(False)
    for at, start in (paths or {}).items():
        out = out | ((h == at) & ((path == start) | path.startswith(start.rstrip("/") + "/")))
    return F.coalesce(out, F.lit(False))
