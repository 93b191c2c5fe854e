"""Keyed hashes and decoded content as Column expressions."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F


def hmac_pads(key: str) -> tuple[str, str]:
    """(outer, inner) pads of HMAC-SHA-256 for a key, in hex."""
    k = key.encode()
    k = (hashlib.sha256(k).digest() if len(k) > 64 else k).ljust(64, b"\0")
    return bytes(b ^ 0x5C for b in k).hex(), bytes(b ^ 0x36 for b in k).hex()


def hmac_tag(x: Column | str, key: str) -> Column:
    """The first 16 hex digits of the HMAC-SHA-256 of a text."""
    outer, inner = (F.unhex(F.lit(p)) for p in hmac_pads(key))
    first = F.sha2(F.concat(inner, F.encode(x, "UTF-8")), 256)
    return F.substring(F.sha2(F.concat(outer, F.unhex(first)), 256), 1, 16)


def decoded(x: Column | str) -> Column:
    """Text kept as base64, line breaks in it allowed; null where it isn't base64 or not UTF-8."""
    return F.try_to_binary(F.regexp_replace(x, r"\s+", ""), F.lit("base64")).cast("string")
