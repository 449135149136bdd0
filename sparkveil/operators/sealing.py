"""Sealing of originals: what is written anywhere is encrypted, and compared by keyed digests.

Each session has a key of its own, derived from the master key. A sealed value is
AES-GCM with a fresh nonce, so equal values do not look alike; lookups use a
keyed digest, the tag. Both are column expressions.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _session_key(key: Column, session: Column, use: str) -> Column:
    return F.unhex(F.sha2(F.concat(key, F.lit(f"{use}:").cast("binary"), session.cast("string").cast("binary")), 256))


def sealed(value: Column, key: Column, session: Column) -> Column:
    """Binary that only :func:`opened` with the same key and session reads; null stays null."""
    return F.aes_encrypt(value.cast("string").cast("binary"), _session_key(key, session, "seal"), F.lit("GCM"))


def opened(box: Column, key: Column, session: Column) -> Column:
    """The value of a sealed one; another key or session is an error."""
    return F.aes_decrypt(box, _session_key(key, session, "seal"), F.lit("GCM")).cast("string")


def tag(value: Column, key: Column, session: Column) -> Column:
    """128 bits by which equal values of a session are found, without the value."""
    return F.substring(F.sha2(F.concat(_session_key(key, session, "tag"), value.cast("string").cast("binary")), 256), 1, 32)
