"""Scalar functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TICK = 1.0001


def tick_price(tick: Column) -> Column:
    """Price of token0 at a tick."""
    return F.pow(F.lit(TICK), tick.cast("double"))


def tick_sqrt_price(tick: Column) -> Column:
    return F.pow(F.lit(TICK), tick.cast("double") / 2.0)


def ratio(a: Column, b: Column) -> Column:
    """a / b; null where b is 0 or null."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def clip(x: Column, low: float, high: float) -> Column:
    """x within bounds; null and NaN stay what they are."""
    return F.when(x.isNull() | F.isnan(x), x).otherwise(F.greatest(F.lit(low), F.least(F.lit(high), x)))


def log_of(x: Column, log=F.log) -> Column:
    """A logarithm of x, -infinity at 0; null where x is null or below 0."""
    return F.when(x == 0, float("-inf")).otherwise(log(x))


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def human_number(x: Column) -> Column:
    """1234567 as 1.23457M, 1500 as 1.5K, 0.25 as 0.25, 12.0 as 12: six significant digits, no trailing zeros.

    Fractions below 0.0001 are written out, not as powers of ten. Null stays null."""

    def short(v: Column) -> Column:
        size = F.floor(F.log10(F.greatest(F.abs(v), F.lit(1e-300)))).cast("int")
        scale = F.pow(F.lit(10.0), (F.lit(5) - size).cast("double"))
        text = F.format_string("%.12f", F.when(v == 0, 0.0).otherwise(F.round(v * scale) / scale))
        return F.regexp_replace(F.regexp_replace(text, r"(\.\d*?)0+$", "$1"), r"\.$", "")

    def scaled(v: Column, unit: str) -> Column:  # whole numbers are written in full
        return F.concat(F.when(v % 1 == 0, v.cast("long").cast("string")).otherwise(short(v)), F.lit(unit))

    return F.when(x.isNull(), None).when(F.abs(x) >= 1e6, scaled(x / 1e6, "M")).when(F.abs(x) >= 1e3, scaled(x / 1e3, "K")).otherwise(short(x))


def percent_label(share: Column) -> Column:
    """0.256 as "25 %": truncated."""
    return F.concat((share * 100).cast("int").cast("string"), F.lit(" %"))


def day_number(seconds: Column) -> Column:
    """Days since the epoch, with fractions."""
    return seconds / 86400.0


def timestamp_of(seconds: Column) -> Column:
    """Epoch seconds as a timestamp without time zone, in UTC."""
    return F.timestamp_add("SECOND", seconds, F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))


def epoch_of(timestamp: Column) -> Column:
    """A timestamp without time zone, taken as UTC, in whole epoch seconds."""
    whole = F.date_trunc("second", timestamp).cast("timestamp_ntz")
    return F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), whole)


def iso_label(seconds: Column) -> Column:
    """Epoch seconds as 2024-01-01T00:00:00+00:00."""
    days, rest = F.floor(seconds / 86400), F.pmod(seconds, F.lit(86400))
    clock = F.format_string("T%02d:%02d:%02d+00:00", F.floor(rest / 3600), F.floor(rest % 3600 / 60), rest % 60)
    return F.concat(F.date_add(F.lit("1970-01-01").cast("date"), days.cast("int")).cast("string"), clock)
