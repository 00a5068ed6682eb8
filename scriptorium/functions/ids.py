"""Deterministic identifiers and content hashes as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The URL namespace of RFC 4122.
NAMESPACE_URL = "6ba7b811-9dad-11d1-80b4-00c04fd430c8"


def uuid5(text: Column, namespace: str = NAMESPACE_URL) -> Column:
    """Version-5 UUID of ``text``: SHA-1 over namespace bytes and UTF-8 text."""
    prefix = F.unhex(F.lit(namespace.replace("-", "")))
    digest = F.sha1(F.concat(prefix, F.encode(text, "UTF-8")))
    nibble = F.conv(F.substring(digest, 17, 1), 16, 10).cast("int")
    variant = F.lower(F.hex((nibble.bitwiseAND(F.lit(3))).bitwiseOR(F.lit(8)).cast("long")))
    return F.concat_ws(
        "-",
        F.substring(digest, 1, 8),
        F.substring(digest, 9, 4),
        F.concat(F.lit("5"), F.substring(digest, 14, 3)),
        F.concat(variant, F.substring(digest, 18, 3)),
        F.substring(digest, 21, 12),
    )


def test_label(number: Column) -> Column:
    return F.format_string("Test %02d", number)


def page_file(number: Column) -> Column:
    return F.format_string("page_%04d.png", number)


def sample_file(number: Column) -> Column:
    return F.format_string("sample_%03d.png", number)


def numbered(prefix: str, number: Column) -> Column:
    return F.format_string(prefix + "_%03d", number)


def slug(text: Column) -> Column:
    """Safe directory name; NULL marks text that leaves nothing usable."""
    cleaned = F.regexp_replace(text, "[^a-zA-Z0-9._-]+", "-")
    trimmed = F.lower(F.regexp_replace(cleaned, "^[-.]+|[-.]+$", ""))
    return F.when(F.length(trimmed) > 0, trimmed)


def utc_stamp(moment: Column) -> Column:
    return F.date_format(moment, "yyyyMMdd'T'HHmmss.SSSSSS'Z'")
