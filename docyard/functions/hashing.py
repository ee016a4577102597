"""Content hash and deterministic point id, as native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: UUID namespace the point ids are derived in (RFC 4122 URL namespace).
POINT_ID_NAMESPACE = "6ba7b810-9dad-11d1-80b4-00c04fd430c8"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def chunk_hash(text: Column | str) -> Column:
    """SHA-256 hex of the UTF-8 text."""
    return F.sha2(_c(text), 256)


def uuid5(name: Column | str, namespace: str = POINT_ID_NAMESPACE) -> Column:
    """RFC 4122 version-5 UUID of a string in a namespace, without a UDF.

    SHA-1 over namespace bytes + UTF-8 name; set the version nibble to 5 and
    the variant bits to 10xx.
    """
    ns = F.unhex(F.lit(namespace.replace("-", "")))
    h = F.sha1(F.concat(ns, F.encode(_c(name), "UTF-8")))
    variant = F.lower(F.hex(
        F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    return F.concat_ws(
        "-",
        F.substring(h, 1, 8),
        F.substring(h, 9, 4),
        F.concat(F.lit("5"), F.substring(h, 14, 3)),
        F.concat(variant, F.substring(h, 18, 3)),
        F.substring(h, 21, 12),
    )


def point_id(hash_hex: Column | str) -> Column:
    """Deterministic point id: UUIDv5 of the chunk hash hex."""
    return uuid5(hash_hex)
