"""Column expressions for cleaning and comparing values."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def blank_to_null(c: Column) -> Column:
    """Without spaces at the ends; null if nothing is left."""
    return F.nullif(F.trim(c), F.lit(""))


def join_text(*parts: Column) -> Column:
    """The parts one after the other; null counts as empty."""
    return F.concat_ws("", *parts)


def full_name(first: Column, middle: Column, last: Column, default: str | None = None) -> Column:
    """The trimmed parts with a space between them; `default` (or empty) if all are blank."""
    name = F.concat_ws(" ", blank_to_null(first), blank_to_null(middle), blank_to_null(last))
    return name if default is None else F.coalesce(F.nullif(name, F.lit("")), F.lit(default))


def differs(a: Column, b: Column, null_is_empty: bool = False) -> Column:
    """Whether two values differ; two nulls do not. With `null_is_empty` null and
    the empty text are the same."""
    if null_is_empty:
        return F.coalesce(a, F.lit("")) != F.coalesce(b, F.lit(""))
    return ~a.eqNullSafe(b)


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def as_text(c: Column, kind: T.DataType) -> Column:
    """A value as text with one form for each type: decimals with all their
    digits, flags as 1 and 0, times in ISO form with a fraction only if there is one."""
    if isinstance(kind, T.BooleanType):
        return c.cast("int").cast("string")
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        whole = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
        fraction = F.date_format(c, "SSSSSS")
        return F.when(fraction == "000000", whole).otherwise(F.concat(whole, F.lit("."), F.regexp_replace(fraction, "000$", "")))
    if isinstance(kind, T.DateType):
        return F.date_format(c, "yyyy-MM-dd")
    return c.cast("string")


def to_second(c: Column) -> Column:
    """A time rounded (not cut) to the second."""
    return F.date_trunc("second", c + F.expr("INTERVAL 500 MILLISECONDS")).cast("timestamp_ntz")


def date_key(c: Column) -> Column:
    """yyyymmdd as a number."""
    return (F.year(c) * 10000 + F.month(c) * 100 + F.dayofmonth(c)).cast("int")


def years_apart(a: Column, b: Column) -> Column:
    """How many year boundaries lie between two dates."""
    return F.year(b) - F.year(a)


def first_chars(c: Column, n: int) -> Column:
    return F.substring(c, 1, n)


def margin_pct(net: Column, cost: Column) -> Column:
    """(net - cost) / net in percent; null for a net of zero."""
    return F.try_divide(net - cost, net) * 100
