"""Identity tokens, join keys and pseudonyms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def identity_token(folder: Column) -> Column:
    """Last path segment; null if there is none."""
    path = F.rtrim(F.regexp_replace(F.trim(folder), r"\\", "/"), F.lit("/"))
    token = F.trim(F.element_at(F.split(path, "/"), -1))
    return F.when(token != "", token)


def join_key(value: Column) -> Column:
    """Without white space, upper case."""
    return F.upper(F.regexp_replace(F.coalesce(value, F.lit("")), r"\s+", ""))


def hmac_sha256(message: Column, secret: bytes) -> Column:
    """HMAC-SHA256 as hex, from nested SHA-256 of padded keys; the secret is at most 64 bytes long."""
    if len(secret) > 64:
        raise ValueError("the secret has more than 64 bytes")
    key = secret.ljust(64, b"\0")
    pad = lambda x: F.lit(bytes(b ^ x for b in key))
    inner = F.unhex(F.sha2(F.concat(pad(0x36), message.cast("binary")), 256))
    return F.sha2(F.concat(pad(0x5C), inner), 256)


def pseudonym(identity: Column, secret: bytes, prefix: str) -> Column:
    """Prefix and the first 16 hex digits of the keyed hash. Lower-casing equals case folding but for a few alphabets."""
    return F.concat(F.lit(prefix + "_"), F.upper(F.substring(hmac_sha256(F.lower(F.trim(identity)), secret), 1, 16)))


def resolve_identity(tokens: Column, alias: Column) -> Column:
    """The one token that isn't the folder's alias (or the alias if it is alone); null unless exactly one is left."""
    distinct = F.array_distinct(tokens)
    own = F.filter(distinct, lambda t: F.lower(F.trim(t)) != F.lower(F.trim(alias)))
    left = F.when(F.size(own) > 0, own).otherwise(distinct)
    return F.when(F.size(left) == 1, F.element_at(left, 1))
