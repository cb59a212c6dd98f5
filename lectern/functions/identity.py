"""Deterministic keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The DNS namespace of RFC 4122.
DNS_NAMESPACE = "6ba7b8109dad11d180b400c04fd430c8"
_ROLES = {"Character": "character", "Location": "location", "Faction": "faction", "Theme": "theme"}


def uuid5(name: Column, namespace: str = DNS_NAMESPACE) -> Column:
    """RFC 4122 version 5, from built-in SHA-1."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace)), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    part = lambda a, n: F.substring(h, a, n)
    return F.concat_ws(
        "-", part(1, 8), part(9, 4), F.concat(F.lit("5"), part(14, 3)), F.concat(variant, part(18, 3)), part(21, 12)
    )


def named_node_id(node_type: str, name: Column) -> Column:
    return uuid5(F.concat(F.lit(_ROLES[node_type] + ":"), name))


def event_id(chapter: Column, description: Column) -> Column:
    return uuid5(F.concat(F.lit("event:"), chapter.cast("string"), F.lit(":"), F.substring(description, 1, 60)))


def relationship_id(source: Column, relation: Column, target: Column) -> Column:
    return uuid5(F.concat(F.lit("rel:"), F.concat_ws(":", source, relation, target)))


def cache_key(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", *parts), 256)
