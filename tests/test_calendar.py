from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from wayline.functions import calendar as cal
from wayline.operators import filters


@pytest.mark.parametrize("text, hours", [("6:30AM", 6.5), (" 12:00 am ", 0), ("12:00PM", 12), ("9PM", 21)])
def test_clock(text, hours):
    assert cal.parse_clock(text) == hours * 3600


@pytest.mark.parametrize("text", ["25:00", "13PM", "noon", "6:75AM", ""])
def test_clock_rejects(text):
    with pytest.raises(ValueError):
        cal.parse_clock(text)


def test_hours_up_to_24():
    assert cal.clock_seconds(24) == cal.DAY
    with pytest.raises(ValueError):
        cal.clock_seconds(25)


def test_weekdays():
    assert [cal.parse_weekday(d) for d in ("mon", "Tuesday", "6", 0)] == [0, 1, 6, 0]
    with pytest.raises(ValueError):
        cal.parse_weekday(7)


def test_day_scheme_wraps_and_last_wins():
    scheme = cal.day_scheme(["Friday-Monday", "Monday"])
    assert scheme == {4: "Friday-Monday", 5: "Friday-Monday", 6: "Friday-Monday", 0: "Monday"}


def test_period_end_takes_in_its_day():
    assert cal.parse_period("20240109-20240118") == (datetime(2024, 1, 9), datetime(2024, 1, 19))
    assert cal.parse_period((date(2024, 1, 1), datetime(2024, 1, 2, 6))) == (datetime(2024, 1, 1), datetime(2024, 1, 2, 6))
    with pytest.raises(ValueError):
        cal.parse_period("20240109-20240101")


def test_periods_may_touch_but_not_overlap():
    cal.check_periods("20240101-20240105", "20240106-20240110")
    with pytest.raises(ValueError):
        cal.check_periods("20240101-20240106", "20240106-20240110")


def test_default_periods():
    """Spans of 0 to 60 days: halves after a warm-up of seven days or, in a short span, of all but two."""
    first = date(2024, 1, 1)
    assert cal.default_periods(first, date(2024, 1, 31)) == ((date(2024, 1, 8), date(2024, 1, 18)), (date(2024, 1, 19), date(2024, 1, 31)))
    for span in range(61):
        last = first + timedelta(days=span)
        found = cal.default_periods(first, last)
        if span < 2:
            assert found is None
            continue
        (b0, b1), (a0, a1) = found
        assert (b0 - first).days == min(7, span - 2) and a1 == last and a0 == b1 + timedelta(days=1)
        assert (b1 - b0).days + 1 == (last - b0).days // 2 >= 1


def frame(spark, *moments):
    rows = spark.createDataFrame([(k, m) for k, m in enumerate(moments)], "id int, text string").withColumn("ts_utc", F.col("text").cast("timestamp_ntz"))
    return cal.to_local(rows, "America/Denver")


def test_local_calendar_over_clock_changes(spark):
    rows = frame(spark, "2026-03-08 08:30:00", "2026-03-08 10:00:00", "2026-11-01 07:30:00", "2026-11-01 08:30:00").orderBy("id").collect()
    assert [r["local_ts"].hour for r in rows] == [1, 4, 1, 1]
    assert [r["dow"] for r in rows] == [6] * 4
    assert len({r["ts_utc"] for r in rows}) == 4  # the repeated hour stays two instants


def test_windows_bins_and_days(spark):
    # 13:00Z is 06:00 in Denver in winter
    df = frame(spark, "2024-01-08 13:30:00", "2024-01-08 16:00:00", "2024-01-09 05:00:00", "2024-01-12 20:00:00")
    ids = lambda d: sorted(r["id"] for r in d.collect())
    assert ids(filters.filter_time_window(df, "6:30AM-9:00AM")) == [0]  # half-open: 09:00 is out
    assert ids(filters.filter_time_window(df, ("9PM", "7AM"))) == [0, 2]
    assert ids(filters.filter_time_window(df, (5, 5))) == [0, 1, 2, 3]
    assert ids(filters.filter_day_of_week(df, ["Friday"])) == [3]
    assert ids(filters.filter_day_of_week(df, [])) == [0, 1, 2, 3]
    assert ids(filters.filter_date_range(df, "2024-01-08", "2024-01-08")) == [0, 1, 2]
    assert ids(filters.filter_date_range(df, "2024-01-09", "2024-01-08")) == []
    labelled = filters.assign_group_label(filters.assign_time_bins(filters.assign_day_group(df), ["6AM-7AM", "6AM-10AM", "5AM-5AM"]))
    assert [r["group_label"] for r in labelled.orderBy("id").collect()] == ["Mon–Thu, 6AM-7AM", "Mon–Thu, 6AM-10AM", None, None]


def test_window_keys_of_equal_restrictions():
    assert filters.window_key("6AM-9AM", ["mon"]) == filters.window_key((6, 9), [0])
    assert filters.window_key((0, 24), range(7)) == (None, None)


def test_confidence_is_strict(spark):
    df = spark.createDataFrame([(1, 80.0), (2, 80.5), (3, None)], "id int, cvalue double")
    assert [r["id"] for r in filters.filter_confidence(df, 80).collect()] == [2]
