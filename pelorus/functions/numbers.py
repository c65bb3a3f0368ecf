"""Numeric and time functions as Spark columns."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F


def token_estimate(*texts: Column) -> Column:
    """A quarter of the texts' code points; a null text has none."""
    return sum((F.length(F.coalesce(t, F.lit(""))).cast("double") for t in texts), F.lit(0.0)) / F.lit(4.0)


def expected_cost(price_per_token: Column, *texts: Column, margin: float = 1.1) -> Column:
    """Estimated tokens times a margin times the price; null without a price."""
    return token_estimate(*texts) * F.lit(margin) * price_per_token


def backoff(step: Column, base: float, ceiling: float) -> Column:
    """``base * 2**step``, at most ``ceiling``."""
    return F.least(F.lit(float(base)) * F.pow(F.lit(2.0), step), F.lit(float(ceiling)))


def duration_ms(start: Column, end: Column) -> Column:
    return F.timestamp_diff("MILLISECOND", start, end)


def minute_timestamp(text: Column) -> Column:
    """An ISO time without zone as ``timestamp_ntz``; null if it can't be read."""
    return text.try_cast("timestamp_ntz")


def utc_now(at: datetime | None = None) -> Column:
    """The time now, or a given one where results must repeat, as ``timestamp_ntz`` in UTC."""
    if at is not None:
        return F.lit(at.isoformat(sep=" ")).cast("timestamp_ntz")
    return F.convert_timezone(None, F.lit("UTC"), F.localtimestamp())


def or_zero(value: Column) -> Column:
    return F.coalesce(value.cast("double"), F.lit(0.0))


def normal_rate(rate: float, period: float) -> tuple[float, float]:
    """A rate below one per period as one per longer period."""
    if rate <= 0 or period <= 0:
        raise ValueError("rate and period must be positive")
    return (1.0, period / rate) if rate < 1 else (rate, period)
