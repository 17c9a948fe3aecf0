"""Identifiers, numbers, dates and URLs as column expressions; malformed input gives null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def barcode(value: Column) -> Column:
    """Digits of a GTIN of 8, 12, 13 or 14 digits with a right check digit; null otherwise, also for all zeros."""
    compact = F.regexp_replace(value, r"(?U)[\s-]+", "")
    weighted = F.aggregate(
        F.transform(F.split(F.reverse(compact), ""), lambda d, i: F.coalesce(d.try_cast("int"), F.lit(0)) * F.when(i % 2 == 1, 3).otherwise(1)), F.lit(0), lambda s, x: s + x
    )
    shaped = compact.rlike(r"^(\d{8}|\d{12,14})$") & ~compact.rlike(r"^0+$")
    return F.when(shaped & (F.when(shaped, weighted).otherwise(1) % 10 == 0), compact)


def barcode_key(value: Column) -> Column:
    """Equal for barcodes that differ in leading zeros only."""
    return F.lpad(barcode(value), 14, "0")


def uuid(value: Column) -> Column:
    """Canonical UUID of any usual spelling (braces, urn, no hyphens); the nil UUID gives null."""
    hexes = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(F.trim(value)), "urn:|uuid:", ""), r"^[{}]+|[{}]+$", ""), "-", "")
    spelled = F.regexp_replace(hexes, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    return F.when(hexes.rlike("^[0-9a-f]{32}$") & ~hexes.rlike("^0+$"), spelled)


def number_pair(value: Column) -> Column:
    """struct<number,total> of `n` or `n/total`, one to four digits each, total not below the number."""
    text = F.trim(value)
    shaped = (F.length(value) <= 32) & text.rlike(r"^\d{1,4}(\s*/\s*\d{1,4})?$")
    number = F.regexp_extract(text, r"^(\d{1,4})", 1).try_cast("int")
    total = F.regexp_extract(text, r"/\s*(\d{1,4})$", 1).try_cast("int")
    good = F.when(shaped & (number > 0), number)
    return F.struct(good.alias("number"), F.when(good.isNotNull() & (total >= good), total).alias("total"))


def standalone_total(value: Column) -> Column:
    text = F.trim(value)
    return F.when((F.length(value) <= 32) & text.rlike(r"^\d{1,4}$") & (text.try_cast("int") > 0), text.try_cast("int"))


def year(value: Column) -> Column:
    """The first year from 1800 to 2199 that stands alone in the text."""
    return F.regexp_extract(value, r"(?<!\d)((?:18|19|20|21)\d{2})(?!\d)", 1).try_cast("int")


def cache_key(**parts: Column) -> Column:
    """SHA-256 of the JSON object of the parts with its names in order; null parts are left out."""
    return F.sha2(F.to_json(F.struct(*(parts[n].alias(n) for n in sorted(parts)))), 256)


def picture_size(mime: Column, description: Column, data: Column) -> Column:
    """Bytes of a picture block: eight numbers of four bytes, and the three variable parts."""
    length = lambda c: F.coalesce(F.octet_length(c), F.lit(0))
    return 32 + length(mime) + length(description) + length(data)


def retry_delay(attempt: Column, jitter: Column | float = 0.0, base: float = 1.8, cap: float = 30.0) -> Column:
    """Seconds to wait before the next attempt: growing by a factor up to a cap, and a jitter on top."""
    return F.least(F.lit(cap), F.pow(F.lit(base), attempt)) + (F.lit(jitter) if isinstance(jitter, float) else jitter)


def basis(release_id: Column, code: Column) -> Column:
    """Which identifiers a release is matched by: `musicbrainz`, `upc`, both joined by +, or `legacy`."""
    joined = F.concat_ws("+", F.when(uuid(release_id).isNotNull(), "musicbrainz"), F.when(barcode(code).isNotNull(), "upc"))
    return F.when(joined == "", "legacy").otherwise(joined)


def allowed_https(url: Column, hosts: list[str], suffixes: list[str] = []) -> Column:  # noqa: B006
    """HTTPS on the default port to a listed host or below a listed suffix, without user information."""
    host = F.lower(F.regexp_extract(url, r"^(?i)https://([^/?#:@]+)(?::443)?(?:[/?#]|$)", 1))
    listed = host.isin(*hosts) if hosts else F.lit(False)
    for s in suffixes:
        listed = listed | host.endswith(f".{s}")
    return F.coalesce((host != "") & listed, F.lit(False))


def collection_id(url: Column, hosts: list[str]) -> Column:
    """Number of an album page on HTTPS: the last path segment (`123` or `id123`) behind `/album/`, or `id=` of a viewAlbum link."""
    path = F.regexp_extract(url, r"^(?i:https)://[^/?#]+(/[^?#]*)", 1)
    page = F.regexp_extract(path, r"^(?:/[a-z]{2})?/album/(?:[^/]+/)?(?:id)?(\d{1,18})/?$", 1)
    legacy = F.when(path.rlike(r"(?i)/viewalbum$"), F.regexp_extract(url, r"[?&]id=(\d{1,18})(?:&|#|$)", 1))
    found = F.coalesce(F.nullif(page, F.lit("")), F.nullif(legacy, F.lit(""))).try_cast("bigint")
    return F.when(allowed_https(url, hosts) & (found > 0), found)


def release_id(url: Column) -> Column:
    """UUID behind `/release/` in a URL."""
    return uuid(F.regexp_extract(url, r"/release/([^/?#]+)/?(?:[?#]|$)", 1))
