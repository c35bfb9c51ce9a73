"""Identifiers and hashes. A salt comes from the caller's configuration, never from code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from weirflow.functions.text import is_present


def _sha256(c: Column) -> Column:
    return F.sha2(c.cast("binary"), 256)


def author_hash(platform: Column, author: Column, salt: str) -> Column:
    """Salted hash of platform and author; null without an author."""
    return F.when(is_present(author), _sha256(F.concat(platform, F.lit(":"), author, F.lit(f":{salt}"))))


def author_status(author: Column, name: Column) -> Column:
    return F.when(is_present(author), "available").when(name.isin("[deleted]", "[removed]"), "deleted").when(is_present(name), "unavailable").otherwise("not_provided")


def permalink_hash(url: Column) -> Column:
    return F.when(is_present(url), _sha256(url))


def record_uid(platform: Column, file: Column, row: Column) -> Column:
    return _sha256(F.concat_ws(":", platform, file, row.cast("string")))


def content_id(native: Column, uid: Column) -> Column:
    """The native id, else the record's own."""
    return F.when(is_present(native), native).otherwise(F.concat(F.lit("uid::"), uid))


def derived_id(post: Column, text: Column) -> Column:
    return F.concat(F.lit("derived:"), post, F.lit(":"), F.substring(F.sha1(text.cast("binary")), 1, 12))


def row_hash(columns: dict[str, Column]) -> Column:
    """SHA-1 over sorted name=value pairs, joined by a unit separator; null is empty."""
    return F.sha1(F.concat_ws("\u001f", *[F.concat(F.lit(f"{n}="), F.coalesce(c.cast("string"), F.lit(""))) for n, c in sorted(columns.items())]).cast("binary"))


def cache_key(*parts: Column) -> Column:
    return _sha256(F.concat(*[x for p in parts for x in (p, F.lit("\u0000"))]))


def job_id(*parts: Column) -> Column:
    return F.concat_ws("|", *parts)


def shard(c: Column, n: int) -> Column:
    """The crc32 shard of an id."""
    return F.pmod(F.crc32(c.cast("binary")), F.lit(n))
