"""Catalogue documents: strict JSON, alias files, Markdown files, and publishing them whole."""

from __future__ import annotations

import json
import os
import re
import shutil
import stat
import tempfile
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.records import RECORD

MAX_BYTES, MAX_DEPTH, MAX_NODES = 16 * 2**20, 64, 250_000
MAX_KEYS, MAX_ENTRIES, MAX_STRING = 1_024, 20_000, 65_536
CATALOG_KEYS = {"schema_version", "catalog_version", "generated_at", "records"}


class CatalogError(ValueError):
    """A document can't be taken; messages name no path and no value."""


def read_bytes(path: str, most: int = MAX_BYTES) -> bytes:
    """The content of a regular file of at most most bytes; folders, pipes and devices are refused without waiting."""
    try:
        fd = os.open(path, os.O_RDONLY | os.O_NONBLOCK)
    except OSError as e:
        raise CatalogError(f"file can't be opened ({e.strerror})") from None
    info = os.fstat(fd)
    if not stat.S_ISREG(info.st_mode):
        os.close(fd)
        raise CatalogError("not a regular file")
    with os.fdopen(fd, "rb") as f:
        if info.st_size > most:
            raise CatalogError("file is too large")
        data = f.read(most + 1)
    if len(data) > most:
        raise CatalogError("file is too large")
    return data


def strict_json(data: bytes | str, depth: int = MAX_DEPTH, nodes: int = MAX_NODES):
    """The value of a JSON document: valid UTF-8, no repeated keys, no NaN, bounded depth and number of values."""

    def once(pairs):
        out = dict(pairs)
        if len(out) != len(pairs):
            raise CatalogError("repeated key in an object")
        return out

    def refuse(_):
        raise CatalogError("number is not finite")

    try:
        text = data.decode("utf-8") if isinstance(data, bytes) else data
        level = deepest = 0
        for m in re.finditer(r'"(?:[^"\\]|\\.)*"|[\[{]|[\]}]', text):
            c = m.group()[0]
            level += (c in "[{") - (c in "]}")
            deepest = max(deepest, level)
            if deepest > depth:
                raise CatalogError("nested too deeply")
        value = json.loads(text, object_pairs_hook=once, parse_constant=refuse)
    except UnicodeDecodeError:
        raise CatalogError("not valid UTF-8") from None
    except RecursionError:
        raise CatalogError("nested too deeply") from None
    except json.JSONDecodeError:
        raise CatalogError("not valid JSON") from None
    stack, seen = [value], 0
    while stack:
        v = stack.pop()
        seen += 1
        if seen > nodes:
            raise CatalogError("too many values")
        if isinstance(v, dict) and len(v) > MAX_KEYS or isinstance(v, list) and len(v) > MAX_ENTRIES:
            raise CatalogError("too many entries in an object or a list")
        if any(len(x) > MAX_STRING // 2 and len(x.encode("utf-16-le", "surrogatepass")) // 2 > MAX_STRING for x in ([v] if isinstance(v, str) else v if isinstance(v, dict) else ())):
            raise CatalogError("a text is too long")
        stack += v.values() if isinstance(v, dict) else v if isinstance(v, list) else ()
    return value


@dataclass
class Catalog:
    records: DataFrame
    aliases: list[tuple[str, list[str]]]
    metadata: dict
    source: str


def load_catalog(spark: SparkSession, bundled: str, external: str | None = None, aliases: str | None = None) -> Catalog:
    """A catalogue document as records; an external one takes the bundled one's place and never falls back to it.

    For catalogues of one file (up to 16 MiB); larger ones are read as tables.
    """
    if external is not None and not os.path.isabs(external):
        raise CatalogError("path must be absolute")
    doc = strict_json(read_bytes(external or bundled))
    if not isinstance(doc, dict) or set(doc) != CATALOG_KEYS or not isinstance(doc["records"], list):
        raise CatalogError("not a catalogue document")
    names = {c.split()[0] for c in RECORD.replace("\n", " ").split(", ")} - {"row_id"}
    if any(not isinstance(r, dict) or set(r) != names for r in doc["records"]):
        raise CatalogError("a record has missing or unexpected keys")
    lines = [json.dumps({"row_id": k, **r}) for k, r in enumerate(doc["records"])]
    raw = spark.createDataFrame([(x,) for x in lines], "j string")
    records = raw.select(F.from_json("j", RECORD).alias("r")).select("r.*")
    meta = {k: doc[k] for k in CATALOG_KEYS - {"records"}} | {"record_count": len(lines)}
    return Catalog(records, load_alias_file(aliases) if aliases else [], meta, "external" if external else "bundled")


def load_alias_file(path: str, optional: bool = False) -> list[tuple[str, list[str]]]:
    """Concepts and synonyms in the order of the file: {"aliases": {...}} or the map alone; only an optional file may be missing."""
    if optional and not os.path.exists(path):
        return []
    doc = strict_json(read_bytes(path))
    table = doc.get("aliases", doc) if isinstance(doc, dict) else None
    ok = isinstance(table, dict) and len(table) <= 512
    for c, s in (table or {}).items() if ok else ():
        ok = ok and 0 < len(c) <= 128 and isinstance(s, list) and 0 < len(s) <= 128 and all(isinstance(x, str) and 0 < len(x) <= 128 for x in s)
    if not ok:
        raise CatalogError("not an alias document")
    return list(table.items())


def read_markdown(spark: SparkSession, path: str, most: int = MAX_BYTES) -> DataFrame:
    """line_id, file_id, line_no, raw_line of Markdown files of at most most bytes; order and numbers are those of each file."""
    if spark.read.format("binaryFile").load(path).where(F.col("length") > most).select("path").limit(1).count():
        raise CatalogError("file is too large")
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file_id"), F.posexplode(F.split("value", r"\r?\n")).alias("p", "raw_line"))
    return files.select(F.xxhash64("file_id", "p").alias("line_id"), "file_id", (F.col("p") + 1).alias("line_no"), "raw_line")


def valid_ref(ref: str) -> bool:
    """Whether a name may be a revision: 40 hex digits, or a plain branch or tag name."""
    return bool(re.fullmatch(r"[0-9a-f]{40}", ref) or (re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9._/-]{0,199}", ref) and ".." not in ref and "//" not in ref and not ref.endswith(("/", ".lock", "."))))


def pick_ref(ref: str, listing: str) -> str:
    """The commit of a ref in a listing of "commit name" lines: of a branch, else of a tag, else of what a tag stands for; of several the first in order."""
    if re.fullmatch(r"[0-9a-fA-F]{40}", ref):
        return ref.lower()
    if not valid_ref(ref):
        raise CatalogError("not a valid ref")
    order = [f"refs/heads/{ref}", f"refs/tags/{ref}", f"refs/tags/{ref}^{{}}"]
    found = [m.groups() for m in re.finditer(r"(?m)^([0-9a-fA-F]{40})\s+(\S+)$", listing)]
    commits = sorted((order.index(name), commit.lower()) for commit, name in found if name in order)
    if not commits:
        raise CatalogError("ref does not exist")
    return commits[0][1]


def kept_time(existing, revision: str, content_hash: str) -> str | None:
    """generated_at of an existing document whose first record has this source, so that writing it again changes nothing; else null."""
    try:
        source = existing["records"][0]["provenance"][0]
        same = (source["revision"], source["content_hash"]) == (revision, content_hash)
        return existing["generated_at"] if same and isinstance(existing["generated_at"], str) else None
    except (KeyError, IndexError, TypeError):
        return None


def alias_errors(doc) -> list[str]:
    """What is wrong with an alias document that is published: version 1, concepts trimmed and in order, synonyms not empty, trimmed, unique and in order."""
    if not isinstance(doc, dict):
        return ["root must be an object"]
    out = [] if doc.get("version") == 1 else ["version: must equal 1"]
    table = doc.get("aliases")
    if not isinstance(table, dict) or not table:
        return [*out, "aliases: must be a non-empty object"]
    ordered = lambda xs: xs == sorted(xs, key=lambda x: (x.casefold(), x))
    if not ordered(list(table)):
        out.append("aliases: keys must be in canonical order")
    for concept, synonyms in table.items():
        if not concept.strip() or concept != concept.strip():
            out.append(f"aliases.{concept}: key must be trimmed")
        if not isinstance(synonyms, list) or any(not isinstance(x, str) or not x.strip() or x != x.strip() for x in synonyms):
            out.append(f"aliases.{concept}: items must be non-empty trimmed strings")
        elif len({x.casefold() for x in synonyms}) < len(synonyms) or not ordered(synonyms):
            out.append(f"aliases.{concept}: items must be unique and in canonical order")
    return out


def policy_document_errors(doc, source: dict[str, str]) -> list[str]:
    """What is wrong with a source policy: version 1, public only, and the source as expected."""
    if not isinstance(doc, dict):
        return ["root must be an object"]
    out = [f"{k}: must equal {v}" for k, v in (("policy_version", 1), ("public_only", True)) if doc.get(k) is not v and (doc.get(k) != v or isinstance(doc.get(k), bool) != isinstance(v, bool))]
    given = doc.get("source")
    if not isinstance(given, dict):
        return [*out, "source: must be an object"]
    return out + [f"source.{k}: must equal {v}" for k, v in source.items() if given.get(k) != v]


def file_errors(names: set[str], required: set[str], forbidden: set[str] = frozenset()) -> list[str]:
    """Files of a published folder that must not be there, are not known, or are missing; names that start with a dot don't count."""
    names = {n for n in names if not n.startswith(".")}
    groups = ((names & forbidden, "forbidden"), (names - required - forbidden, "unexpected"), (required - names, "missing"))
    return [f"{n}: {what}" for group, what in groups for n in sorted(group)]


def canonical_json(value) -> bytes:
    """Sorted keys, two blanks of indent, UTF-8, a line end."""
    return (json.dumps(value, ensure_ascii=False, sort_keys=True, indent=2, allow_nan=False) + "\n").encode()


def publish(files: dict[str, bytes]) -> None:
    """Replace local files together: all are staged first, and put back if one can't be replaced."""
    staged, kept = {}, {}
    try:
        for path, data in files.items():
            fd, tmp = tempfile.mkstemp(dir=os.path.dirname(path) or ".", prefix=".staged-")
            with os.fdopen(fd, "wb") as f:
                f.write(data)
                f.flush()
                os.fsync(f.fileno())
            if os.path.exists(path):
                os.chmod(tmp, stat.S_IMODE(os.stat(path).st_mode))
            staged[path] = tmp
        done: list[str] = []
        try:
            for path, tmp in staged.items():
                if os.path.exists(path):
                    kept[path] = f"{path}.{uuid.uuid4().hex}"
                    shutil.copy2(path, kept[path])
                os.replace(tmp, path)
                done.append(path)
        except OSError:
            for path in done:
                os.replace(kept.pop(path), path) if path in kept else os.remove(path)
            raise
    finally:
        for tmp in [*staged.values(), *kept.values()]:
            if os.path.exists(tmp):
                os.remove(tmp)
