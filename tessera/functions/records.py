"""Values of catalogue records as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import nfkc

# Fixed values of the record schema.
TRI_STATES = ("yes", "no", "unknown")
STATUSES = ("active", "coming_soon", "stale", "candidate", "unknown")
TIERS = ("public", "apilayer")
AUTH_TYPES = ("none", "api_key", "oauth2", "basic", "bearer", "signed", "user_agent", "other", "unknown")
AUTH_LOCATIONS = ("header", "query", "cookie", "unknown")
YES = ("yes", "y", "true", "1", "supported", "available", "enabled", "✓", "✔")
NO = ("no", "n", "false", "0", "unsupported", "unavailable", "disabled", "✗", "✘")
AUTH_NAMES = {
    "none": ("", "no", "none", "n", "null", "false", "notrequired"),
    "api_key": ("apikey", "key", "xapikey", "xmashapekey", "rapidapikey"),
    "basic": ("basic", "basicauth", "httpbasic"),
    "bearer": ("bearer", "bearertoken", "jwt", "token"),
    "signed": ("signed", "signature", "hmac", "aws4", "aws4hmacsha256"),
    "user_agent": ("useragent", "useragentheader"),
    "unknown": ("unknown", "tbd"),
}

# What sources stand for which tier.
SOURCE_PREFIXES = {"apilayer-": "apilayer"}
SOURCES = {"public-apis-readme": "public"}

RECORD = """row_id bigint, id string, name string, aliases array<string>, description string, categories array<string>, tags array<string>,
provider string, source_tier string, docs_url string, homepage_url string,
auth array<struct<type:string,location:string,name:string,source:string,confidence:double>>, https string, cors string, status string,
openapi struct<spec_url:string,specification:string,specification_version:string,api_version:string,title:string,path_count:bigint,operation_count:bigint,tags:array<string>,security_schemes:array<string>>,
provenance array<struct<source_id:string,source_url:string,revision:string,retrieved_at:string,content_hash:string,license:string>>,
last_checked_at string, quality_flags array<string>, rights map<string,string>"""


def one_of(value: Column, allowed: tuple[str, ...], otherwise: str = "unknown") -> Column:
    return F.when(value.isin(*allowed), value).otherwise(otherwise)


def tri_state(value: Column) -> Column:
    """yes, no or unknown of many spellings; null is unknown."""
    v = F.lower(F.trim(value.cast("string")))
    return F.when(v.isin(*YES), "yes").when(v.isin(*NO), "no").otherwise("unknown")


def auth_type(value: Column) -> Column:
    """The kind of authentication that a text names; null and blank are none."""
    v = F.regexp_replace(F.lower(F.coalesce(value, F.lit(""))), "[^a-z0-9]+", "")
    out = F.when(v.isin(*AUTH_NAMES["none"]), "none").when(v.isin(*AUTH_NAMES["api_key"]), "api_key").when(v.contains("oauth"), "oauth2")
    for kind in ("basic", "bearer", "signed", "user_agent", "unknown"):
        out = out.when(v.isin(*AUTH_NAMES[kind]), kind)
    return out.otherwise("other")


def auth_entry(value: Column, source: str) -> Column:
    """A list of one auth entry made from a text."""
    kind = auth_type(value)
    raw = F.regexp_replace(F.trim(F.coalesce(value, F.lit(""))), "^`+|`+$", "")
    header = (kind == "api_key") & raw.rlike("[-_]")
    place = F.when(header | kind.isin("basic", "bearer", "user_agent"), "header").when(F.lower(raw).contains("query"), "query").otherwise("unknown")
    return F.array(F.struct(kind.alias("type"), place.alias("location"), F.when(header, raw).otherwise("").alias("name"), F.lit(source).alias("source"), F.when(kind == "unknown", 0.5).otherwise(1.0).alias("confidence")))


def slugify(text: Column) -> Column:
    """Letters and digits in lower case without accents, joined by hyphens; of a text without any: item- and a part of its hash."""
    t = F.coalesce(text, F.lit(""))
    base = F.regexp_replace(F.replace(F.lower(nfkc(t, "NFKD")), F.lit("ß"), F.lit("ss")), r"\p{M}+", "")
    slug = F.regexp_replace(F.regexp_replace(base, r"[^\p{L}\p{N}]+", "-"), "^-+|-+$", "")
    return F.when(slug != "", slug).otherwise(F.concat(F.lit("item-"), F.substring(F.sha2(t, 256), 1, 10)))


def identity_label(text: Column) -> Column:
    """A slug without the parts api and service, unless nothing else is in it."""
    slug = slugify(text)
    bare = F.array_join(F.filter(F.split(slug, "-"), lambda p: ~p.isin("api", "service")), "-")
    return F.when(bare != "", bare).otherwise(slug)


def stable_record_id(provider: Column, name: Column) -> Column:
    p = F.when(F.trim(F.coalesce(provider, F.lit(""))) != "", slugify(provider)).otherwise("public")
    n = slugify(name)
    return F.when(p == n, n).otherwise(F.concat_ws(":", p, n))


def auth_types(auth: Column) -> Column:
    """Different valid kinds of an auth list, in order of appearance; null has none."""
    kinds = F.transform(F.filter(F.coalesce(auth, F.array().cast("array<struct<type:string,location:string,name:string,source:string,confidence:double>>")), lambda a: a["type"].isin(*AUTH_TYPES)), lambda a: a["type"])
    return F.array_distinct(kinds)


def source_tiers(tier: Column, provenance: Column, prefixes: dict[str, str] | None = None, exact: dict[str, str] | None = None) -> Column:
    """Tiers of a record: its own, and those that the sources it comes from stand for; apilayer comes first.

    prefixes, exact: tier by the start, or by the whole, of a source_id.
    """
    prefixes = SOURCE_PREFIXES if prefixes is None else prefixes
    exact = SOURCES if exact is None else exact
    out = []
    for t in reversed(TIERS):
        hit = tier == t
        for p in (k for k, v in prefixes.items() if v == t):
            hit = F.coalesce(hit, F.lit(False)) | F.coalesce(F.exists(provenance, lambda s: s["source_id"].startswith(p)), F.lit(False))
        for p in (k for k, v in exact.items() if v == t):
            hit = F.coalesce(hit, F.lit(False)) | F.coalesce(F.exists(provenance, lambda s: s["source_id"] == p), F.lit(False))
        out.append(F.when(F.coalesce(hit, F.lit(False)), t))
    return F.array_compact(F.array(*out))


def canonical_strings(values: Column) -> Column:
    """Trimmed, not blank, once whatever the letter case (the smallest spelling), sorted by lower case; null is empty.

    Lists are of one record; for lists over many rows see resolve.
    """
    clean = F.filter(F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda v: F.trim(v)), lambda v: v != "")
    pairs = F.array_sort(F.array_distinct(F.transform(clean, lambda v: F.struct(F.lower(v).alias("k"), v.alias("v")))))
    first = F.filter(pairs, lambda p, i: (i == 0) | (F.get(pairs, i - 1)["k"] != p["k"]))
    return F.transform(first, lambda p: p["v"])


def ordered_unique(values: Column) -> Column:
    """Trimmed values, not blank, the first of those equal in lower case, in order; null is empty."""
    clean = F.filter(F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda v: F.trim(v)), lambda v: v != "")
    low = F.transform(clean, lambda v: F.lower(v))
    return F.filter(clean, lambda v, i: F.array_position(low, F.lower(v)) == i + 1)
