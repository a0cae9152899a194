"""Reproducible draws from stable ids (never rand(), which depends on partitioning)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HASH_SPAN = 4294967296


def hash_text(seed: int, *parts: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[p.cast("string") for p in parts]))


def hash_long(seed: int, *parts: Column) -> Column:
    """32-bit unsigned integer from the first eight hex digits of md5."""
    return F.conv(F.substring(hash_text(seed, *parts), 1, 8), 16, 10).cast("long")


def hash_uniform(seed: int, *parts: Column) -> Column:
    return hash_long(seed, *parts) / F.lit(float(HASH_SPAN))


def hash_bucket(digest: Column, hex_digits: int = 3) -> Column:
    """Leading hex digits of a digest: evenly filled, ordered like the digest itself."""
    return F.substring(digest, 1, hex_digits)


def fingerprint(json_text: Column) -> Column:
    """First 16 hex digits of SHA-256 over an already sorted JSON text."""
    return F.substring(F.sha2(json_text, 256), 1, 16)
