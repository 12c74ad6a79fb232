import datetime as dt

import pytest

from starmodel.operators import calendar, quality


def day(spark, *date):
    return calendar.date_dim(spark, dt.date(*date), dt.date(*date)).first()


def test_attributes(spark):
    r = day(spark, 2020, 2, 29)
    assert (r.DateKey, r.DayName, r.DayShortName, r.DayNumberOfYear, r.QuarterName, r.YearQuarter, r.SemesterName) == (20200229, "Saturday", "Sat", 60, "Q1", "2020-Q1", "S1")
    assert r.IsWeekend and not r.IsWeekday
    r = day(spark, 2021, 1, 3)  # an ISO week of the year before, beside the calendar year
    assert (r.WeekNumberOfYear, r.CalendarYear, r.DayNumberOfWeek) == (53, 2021, 7)
    r = day(spark, 2024, 12, 31)
    assert (r.DayNumberOfYear, r.MonthName, r.YearMonth, r.YearMonthNumber, r.YearQuarterNumber, r.SemesterNumber) == (366, "December", "2024-12", 202412, 20244, 2)


def test_range_is_inclusive_and_valid(spark):
    whole = calendar.date_dim(spark, dt.date(2010, 1, 1), dt.date(2035, 12, 31))
    assert whole.count() == 9496
    assert quality.check_calendar(whole).count() == 0 and quality.check_calendar_complete(whole).count() == 0
    for start, end in ((dt.date(2020, 1, 2), dt.date(2020, 1, 1)), (dt.date(1900, 1, 1), dt.date(2001, 1, 1))):
        with pytest.raises(ValueError):
            calendar.dates(spark, start, end)


def test_append_missing_dates_twice(spark):
    old = calendar.date_dim(spark, dt.date(2020, 1, 1), dt.date(2020, 1, 10))
    new = calendar.date_dim(spark, dt.date(2020, 1, 5), dt.date(2020, 1, 20))
    once = calendar.append_missing_dates(old, new)
    assert once.count() == 20 == calendar.append_missing_dates(once, new).count()


def test_gap_is_found(spark):
    c = calendar.date_dim(spark, dt.date(2020, 1, 1), dt.date(2020, 1, 10)).where("DateKey <> 20200105")
    assert [tuple(r) for r in quality.check_calendar_complete(c).collect()] == [("calendar_complete", "20200104", "2")]
