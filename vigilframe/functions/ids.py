"""Deterministic, content-derived identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Object types whose natural key is compared without case, and type spellings.
CASELESS_TYPES = [
    "host", "user", "identity", "group", "role", "permission", "organization", "domain", "network", "service",
    "incident", "certificate", "package", "dependency", "policy", "snapshot",
]
TYPE_ALIASES = {
    "hostname": "host",
    "account": "identity",
    "ipaddress": "ip",
    "ip_address": "ip",
    "fqdn": "domain",
    "cloudresource": "cloud_resource",
    "vuln": "vulnerability",
    "cve": "vulnerability",
    "proc": "process",
    "dir": "directory",
    "cert": "certificate",
    "net": "network",
}
MAX_KEY = 200


def digest(*parts: Column, length: int = 24) -> Column:
    """Leading hex of SHA-256 over the parts, each followed by the unit separator byte."""
    text = F.concat(*[x for p in parts for x in (p.cast("string"), F.lit("\x1f"))])
    return F.substring(F.sha2(text, 256), 1, length)


def object_type(text: Column) -> Column:
    lowered = F.lower(F.trim(text))
    expr = None
    for alias, canonical in TYPE_ALIASES.items():
        expr = F.when(lowered == alias, canonical) if expr is None else expr.when(lowered == alias, canonical)
    return expr.otherwise(lowered)


def normalize_key(otype: Column, key: Column) -> Column:
    """Natural key in its comparable form: blanks folded, case folded where the type has no case."""
    text = F.trim(F.regexp_replace(key, r"\s+", " "))
    address = F.lower(F.regexp_replace(F.regexp_replace(text, r"%.*$", ""), r"^\[+|\]+$", ""))
    url = F.concat(
        F.lower(F.regexp_extract(text, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)),
        F.regexp_replace(F.regexp_replace(text, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", ""), r"#.*$", ""),
    )
    folded = (
        F.when(otype == "ip", address)
        .when(otype == "domain", F.regexp_replace(F.lower(text), r"\.+$", ""))
        .when(otype == "url", url)
        .when(otype.isin(CASELESS_TYPES), F.lower(text))
        .otherwise(text)
    )
    return F.when(
        F.length(folded) > MAX_KEY, F.concat(F.substring(folded, 1, MAX_KEY), F.lit("~"), digest(folded, length=16))
    ).otherwise(folded)


def object_id(otype: Column, key: Column) -> Column:
    return F.concat(otype, F.lit(":"), normalize_key(otype, key))


def relationship_id(source: Column, rel_type: Column, target: Column) -> Column:
    return F.concat(F.lit("rel:"), digest(source, rel_type, target))


def event_id(*parts: Column) -> Column:
    return F.concat(F.lit("event:"), digest(*parts))


def finding_id(product: Column, rule: Column, subject: Column) -> Column:
    return F.concat(F.lit("finding:"), product, F.lit(":"), rule, F.lit(":"), digest(subject, length=12))


def type_of(identifier: Column) -> Column:
    return F.substring_index(identifier, ":", 1)


def key_of(identifier: Column) -> Column:
    return F.substring(identifier, F.instr(identifier, ":") + 1, F.length(identifier))
