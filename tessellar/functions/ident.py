"""Content digests and length-framed identities as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def digest(column: Column) -> Column:
    """SHA-256 of the UTF-8 bytes, lower-case hex."""
    return F.sha2(column, 256)


def frame(column: Column) -> Column:
    """Byte length as an unsigned little-endian 64-bit number, then the bytes."""
    size = F.lpad(F.hex(F.octet_length(column).cast("long")), 16, "0")
    pairs = [F.substring(size, 15 - 2 * i, 2) for i in range(8)]
    return F.concat(F.unhex(F.concat(*pairs)), F.encode(column, "UTF-8"))


def identity(*parts: Column) -> Column:
    """Digest of framed parts: no two lists of parts share their bytes."""
    return F.sha2(F.concat(*[frame(p) for p in parts]), 256)


def stable_id(kind: str, key: Column) -> Column:
    return F.concat(F.lit(f"{kind}:"), F.substring(identity(F.lit(kind), key), 1, 24))
