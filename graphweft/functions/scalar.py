"""Scalar column functions (G1-G17). All built-in expressions: they stay in codegen."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: reference date for account age (UTC).
ACCOUNT_AGE_REFERENCE = dt.datetime(2020, 9, 5, 0, 0, 0)
EPOCH = dt.datetime(1970, 1, 1)
MICROS_PER_DAY = 86_400_000_000


def lenient_timestamp(c: Column, fmt: str | None = None) -> Column:
    """G1: parse a timestamp; anything unparseable becomes null.

    Values that are already timestamps pass through; strings go through
    ``try_to_timestamp`` (ISO forms, optional ``Z``/offset) when no format is given.
    """
    if fmt:
        return F.try_to_timestamp(c.cast("string"), F.lit(fmt))
    s = F.regexp_replace(F.trim(c.cast("string")), "Z$", "+00:00")
    return F.coalesce(F.try_to_timestamp(s), F.try_to_timestamp(s, F.lit("yyyy-MM-dd'T'HH:mm:ssXXX")),
                      F.try_to_timestamp(s, F.lit("yyyy-MM-dd'T'HH:mm:ss.SSSXXX")))


def strict_timestamp(c: Column) -> Column:
    """Parse or fail (ANSI mode raises on malformed input)."""
    return F.to_timestamp(c)


def days_between_floor(later: Column | dt.datetime, earlier: Column) -> Column:
    """Whole days from ``earlier`` to ``later``, floored (-1 h gives -1), null -> 0.

    A Python ``later`` without a zone is in UTC, whatever zone the driver process has."""
    if isinstance(later, dt.datetime):
        end = F.lit((later - EPOCH) // dt.timedelta(microseconds=1))
    else:
        end = F.unix_micros(later.cast("timestamp"))
    diff = end - F.unix_micros(earlier.cast("timestamp"))
    return F.coalesce(F.floor(diff / F.lit(MICROS_PER_DAY)), F.lit(0)).cast("bigint")


def account_age_days(created_at: Column) -> Column:
    return days_between_floor(ACCOUNT_AGE_REFERENCE, created_at)


def char_len(c: Column) -> Column:
    """Length in code points, null -> 0."""
    return F.char_length(F.coalesce(c, F.lit("")))


def bool_flag(c: Column) -> Column:
    """Boolean with null -> false, as 0.0/1.0."""
    return F.coalesce(c.cast("boolean"), F.lit(False)).cast("float")


def default_image_flag(url: Column, default_url: str) -> Column:
    """1.0 when the image is missing, blank, or the default image."""
    return (F.when(url.isNull() | url.rlike(r"^\s*$") | (url == F.lit(default_url)), F.lit(1.0))
            .otherwise(F.lit(0.0)).cast("float"))


def prefixed(prefix: str, c: Column) -> Column:
    """``prefix || c``."""
    return F.concat(F.lit(prefix), c.cast("string"))


def log10_eps(c: Column, eps: float = 0.0) -> Column:
    """log10(x + eps)."""
    return F.log10(c + F.lit(eps)) if eps else F.log10(c)


def leaky_relu(c: Column, slope: float = 0.01) -> Column:
    """max(x, slope*x)."""
    return F.greatest(c, c * F.lit(slope))


def relu(c: Column) -> Column:
    return F.greatest(c, F.lit(0.0))


def sigmoid(c: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-c))
