"""Scalar idioms: time texts, clamps, hashes, prefixes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters of a key shown to people, before the ellipsis.
KEY_PREFIX = 11
#: Unicode white space, as in the White_Space property.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def date_text(ts: Column | str) -> Column:
    return F.date_format(ts, "yyyy-MM-dd")


def minute_text(ts: Column | str) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm")


def second_text(ts: Column | str) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")


def clock_text(ts: Column | str) -> Column:
    return F.date_format(ts, "hh:mm a")


def day_text(ts: Column | str) -> Column:
    return F.date_format(ts, "MMM dd")


def day_key(ts: Column | str) -> Column:
    return F.date_format(ts, "yyyyMMdd")


def next_utc_midnight(ts: Column) -> Column:
    """Unix seconds of the UTC midnight strictly after `ts`."""
    return (F.floor(F.unix_seconds(ts) / 86400) + 1) * 86400


def clamp(c: Column, low: int, high: int) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def hash_key(key: Column) -> Column:
    """SHA-256 in hexadecimal; secrets are stored and compared in this form only."""
    return F.sha2(key, 256)


def key_prefix(key: Column) -> Column:
    return F.concat(F.substring(key, 1, KEY_PREFIX), F.lit("…"))


def trim_space(text: Column) -> Column:
    """Trim of all Unicode white space."""
    return F.btrim(text, F.lit(WHITE_SPACE))


def is_web_url(url: Column) -> Column:
    return url.startswith("https://") | url.startswith("http://")
