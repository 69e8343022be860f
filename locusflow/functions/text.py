"""Text helpers: elapsed time, vector text, decimal commas."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def format_duration(milliseconds: Column | str) -> Column:
    """``{h}hrs, {m}mins, {s}sec``; zero hours or minutes are left out, seconds never are."""
    total = F.floor(_col(milliseconds) / 1000).cast("bigint")
    hours = F.floor(total / 3600).cast("bigint")
    minutes = F.floor((total % 3600) / 60).cast("bigint")
    seconds = (total % 60).cast("bigint")
    return F.concat(
        F.when(hours != 0, F.concat(hours.cast("string"), F.lit("hrs, "))).otherwise(F.lit("")),
        F.when(minutes != 0, F.concat(minutes.cast("string"), F.lit("mins, "))).otherwise(F.lit("")),
        seconds.cast("string"),
        F.lit("sec"),
    )


def parse_vector_text(text: Column | str) -> Column:
    """``"[a,b,..]"`` → ``array<double>``."""
    bare = F.regexp_replace(_col(text), r"[\[\]\s]", "")
    return F.transform(F.split(bare, ","), lambda t: t.cast("double"))


def vector_text(values: Column | str) -> Column:
    """Array → ``"[a,b,..]"``."""
    return F.concat(
        F.lit("["), F.array_join(F.transform(_col(values), lambda v: v.cast("string")), ","), F.lit("]")
    )


def to_decimal_comma(value: Column | str) -> Column:
    return F.regexp_replace(_col(value).cast("string"), r"\.", ",")


def from_decimal_comma(text: Column | str) -> Column:
    """Number with a decimal point or comma; an unreadable text raises instead of becoming NULL."""
    raw = F.trim(_col(text))
    number = F.regexp_replace(raw, ",", ".").try_cast("double")
    return F.when(
        raw.isNotNull() & number.isNull(), F.raise_error(F.concat(F.lit("not a number: "), raw)).cast("double")
    ).otherwise(number)
