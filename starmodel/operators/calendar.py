"""The date dimension."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from starmodel.functions.clean import date_key, join_text

#: English names, the same in every locale.
DAYS = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]
MONTHS = ["January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December"]


def _nth(names: list[str], n: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, names)), n)


def with_unknown_date(days: DataFrame) -> DataFrame:
    """The calendar with a member of key -1 for facts without a date: -1 for
    numbers, Unknown for names, nothing for the date and the flags."""
    value = {"int": F.lit(-1), "bigint": F.lit(-1), "string": F.lit("Unknown")}
    row = days.sparkSession.range(1).select(*[value.get(kind, F.lit(None)).cast(kind).alias(c) for c, kind in days.dtypes])
    return days.unionByName(row)


def dates(spark: SparkSession, start: dt.date, end: dt.date) -> DataFrame:
    """One row for each day from start to end, both included."""
    if end < start:
        raise ValueError("the end date is before the start date")
    if end.year - start.year > 100:
        raise ValueError("the range is over 100 years")
    n = (end - start).days + 1
    return spark.range(n).select(F.date_add(F.lit(start), F.col("id").cast("int")).alias("FullDate"))


def with_attributes(days: DataFrame) -> DataFrame:
    """The calendar's columns for each `FullDate`."""
    d = F.col("FullDate")
    base = days.select(
        date_key(d).alias("DateKey"), d, (F.weekday(d) + 1).alias("DayNumberOfWeek"), F.dayofmonth(d).alias("DayNumberOfMonth"), F.dayofyear(d).alias("DayNumberOfYear"),
        F.weekofyear(d).alias("WeekNumberOfYear"), F.month(d).alias("MonthNumber"), F.quarter(d).alias("QuarterNumber"), F.year(d).alias("CalendarYear"),
    )
    day, month, quarter, year = (F.col(c) for c in ("DayNumberOfWeek", "MonthNumber", "QuarterNumber", "CalendarYear"))
    semester = F.when(month <= 6, 1).otherwise(2)
    return base.select(
        "DateKey", "FullDate", "DayNumberOfWeek", _nth(DAYS, day).alias("DayName"), _nth([x[:3] for x in DAYS], day).alias("DayShortName"), "DayNumberOfMonth", "DayNumberOfYear", "WeekNumberOfYear",
        "MonthNumber", _nth(MONTHS, month).alias("MonthName"), _nth([x[:3] for x in MONTHS], month).alias("MonthShortName"), F.date_format("FullDate", "yyyy-MM").alias("YearMonth"), (year * 100 + month).alias("YearMonthNumber"),
        "QuarterNumber", join_text(F.lit("Q"), quarter).alias("QuarterName"), join_text(year, F.lit("-Q"), quarter).alias("YearQuarter"), (year * 10 + quarter).alias("YearQuarterNumber"),
        semester.alias("SemesterNumber"), join_text(F.lit("S"), semester).alias("SemesterName"), "CalendarYear", day.isin(6, 7).alias("IsWeekend"), day.between(1, 5).alias("IsWeekday"),
    )


def date_dim(spark: SparkSession, start: dt.date, end: dt.date) -> DataFrame:
    return with_attributes(dates(spark, start, end))


def append_missing_dates(existing: DataFrame, generated: DataFrame) -> DataFrame:
    """The existing calendar and the generated days that it hasn't got."""
    new = generated.join(existing.select("FullDate"), "FullDate", "left_anti")
    return existing.unionByName(new.select(*existing.columns))
