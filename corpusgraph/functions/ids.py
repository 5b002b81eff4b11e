"""Deterministic identifiers that agree bit for bit with their definitions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ID_SPACE = 10**18
# Fixed value: the URL name space of RFC 4122.
URL_NAMESPACE = "6ba7b811-9dad-11d1-80b4-00c04fd430c8"


def chunk_point_id(doc_id: Column, chunk_index: Column) -> Column:
    """First 64 bits of md5(``doc_v2_index``) modulo 10^18.

    The unsigned value does not fit a BIGINT, hence the DECIMAL(20,0) step.
    """
    digest = F.md5(F.concat_ws("_", doc_id.cast("string"), F.lit("v2"), chunk_index.cast("string")))
    wide = F.conv(F.substring(digest, 1, 16), 16, 10).cast("decimal(20,0)")
    return (wide % F.lit(ID_SPACE).cast("decimal(20,0)")).cast("bigint")


def hash_point_id(text: Column) -> Column:
    """Absolute value of the 32-bit polynomial (base 31) string hash."""
    codes = F.transform(F.split(text, ""), lambda c: F.ascii(c).cast("bigint"))
    unsigned = F.aggregate(codes, F.lit(0).cast("bigint"), lambda acc, c: (acc * 31 + c) % F.lit(2**32))
    return F.abs(F.when(unsigned >= 2**31, unsigned - F.lit(2**32)).otherwise(unsigned))


def uuid5(name: Column, namespace: str = URL_NAMESPACE) -> Column:
    """RFC 4122 version-5 UUID of ``name``."""
    space = F.unhex(F.lit(namespace.replace("-", "")))
    h = F.sha1(F.concat(space, F.encode(name, "UTF-8")))
    variant = F.translate(F.substring(h, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return F.concat_ws(
        "-",
        F.substring(h, 1, 8),
        F.substring(h, 9, 4),
        F.concat(F.lit("5"), F.substring(h, 14, 3)),
        F.concat(variant, F.substring(h, 18, 3)),
        F.substring(h, 21, 12),
    )


def uuid_point_id(uuid: Column) -> Column:
    """The 128-bit UUID value modulo 10^18, in two 64-bit halves."""
    h = F.replace(uuid, F.lit("-"), F.lit(""))
    space = F.lit(ID_SPACE).cast("decimal(20,0)")

    def half(start: int) -> Column:
        return F.conv(F.substring(h, start, 16), 16, 10).cast("decimal(20,0)") % space

    shift = F.lit(2**64 % ID_SPACE).cast("decimal(18,0)")
    high = (half(1).cast("decimal(18,0)") * shift).cast("decimal(37,0)")
    return ((high + half(17)) % space).cast("bigint")
