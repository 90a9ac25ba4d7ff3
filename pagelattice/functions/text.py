"""Text functions with the whitespace and case rules of Unicode, in JVM expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def strip(c: Column) -> Column:
    """Without white space, of any kind, at either end."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def round_exact(x: Column, digits: int) -> Column:
    """Half to even on the binary value of a double well below 10 ** 11.

    bround rounds the shortest decimal, which is right unless that one ends in a 5 behind the last digit while the binary value lies
    a little to one side of it. Which side is the error of the product with a power of ten, found by splitting both factors.
    """
    ten = 10.0 ** (digits + 1)
    high = lambda v: v * 134217729.0 - (v * 134217729.0 - v)
    ten_high = ten * 134217729.0 - (ten * 134217729.0 - ten)
    ten_low = ten - ten_high
    product = x * F.lit(ten)
    low = x - high(x)
    error = ((high(x) * ten_high - product) + high(x) * ten_low + low * ten_high) + low * ten_low
    tie = F.rint(product)
    off = (product - tie) + error
    beside = (F.abs(tie) % 10 == 5) & (F.abs(product - tie) <= F.abs(product) * F.lit(2.0**-48)) & (off != 0)
    return F.when(beside, (tie + F.signum(off) * 5) / F.lit(ten)).otherwise(F.bround(x, digits))


def fixed6(x: Column) -> Column:
    """Six decimals of the binary value; format_string alone rounds the shortest decimal half up."""
    return F.when(x.isNotNull(), F.format_string("%.6f", round_exact(x, 6)))


def escape_html(c: Column) -> Column:
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(F.coalesce(c, F.lit("")), F.lit(raw), F.lit(entity))
    return c


def normalize_cell(c: Column) -> Column:
    """A table cell without its pipes, unescaped, with single spaces."""
    c = F.regexp_replace(c, r"(?U)^\s*\|\s*", "")
    c = F.regexp_replace(c, r"(?Ud)\s*\|\s*$", "")
    c = F.replace(c, F.lit("\\|"), F.lit("|"))
    return strip(F.regexp_replace(c, r"(?U)[^\S\r\n]+", " "))


def split_row(c: Column) -> Column:
    """Cells of a pipe-separated line; an empty first and last one come from the outer pipes and go."""
    parts = F.split(c, r"\|", -1)
    parts = F.when(strip(F.get(parts, F.lit(0))) == "", F.slice(parts, F.lit(2), F.size(parts))).otherwise(parts)
    last = F.size(parts)
    parts = F.when((last > 0) & (strip(F.get(parts, last - 1)) == ""), F.slice(parts, F.lit(1), last - 1)).otherwise(parts)
    return F.transform(parts, strip)


def figure_urls(c: Column) -> Column:
    """The distinct figure URLs in a text or JSON column; none for null."""
    return F.coalesce(F.array_distinct(F.regexp_extract_all(c, F.lit(r"""/media/figures/[^\s"'<>]+"""), F.lit(0))), F.array().cast("array<string>"))


def s3_url(media_url: Column, bucket: str, region: str) -> Column:
    return F.concat(F.lit(f"https://{bucket}.s3.{region}.amazonaws.com/"), F.regexp_replace(media_url, "^/media/", ""))


def isoformat(c: Column) -> Column:
    """A time of the session's zone in UTC, in ISO form; microseconds only where there are any."""
    utc = F.convert_timezone(None, F.lit("UTC"), c.cast("timestamp_ntz"))
    return F.concat(F.regexp_replace(F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), r"\.000000$", ""), F.lit("+00:00"))


def duration_ms(began: Column, ended: Column) -> Column:
    """Milliseconds from began to ended with one decimal, halves to even."""
    return F.bround(F.timestamp_diff("MICROSECOND", began, ended) / 100) / 10


def data_url_bytes(c: Column) -> Column:
    """The bytes of a base64 data URL; null without a comma."""
    return F.when(F.contains(c, F.lit(",")), F.try_to_binary(F.substr(c, F.locate(",", c) + 1), F.lit("base64")))
