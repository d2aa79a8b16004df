"""Calendar columns: weekdays, cyclic encodings, the Jalali calendar by integer arithmetic, event distance."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Thursday and Friday, Monday being 0.
WEEKEND = (3, 4)
#: Days of a 33-year cycle, of four years in it, and of the first six months of a Jalali year.
CYCLE, FOUR, HALF = 12053, 1461, 186


def _div(a: Column, b: int) -> Column:
    return F.floor(a / b).cast("int")


def jalali_parts(day: str) -> tuple[Column, Column, Column]:
    """Year, month and day of a date in the Jalali calendar."""
    n = F.datediff(F.col(day), F.lit("1600-01-01").cast("date")) - 79
    in_cycle = F.pmod(n, F.lit(CYCLE))
    in_four = F.pmod(in_cycle, F.lit(FOUR))
    later = in_four >= 366
    year = 979 + 33 * _div(n, CYCLE) + 4 * _div(in_cycle, FOUR) + F.when(later, _div(in_four - 1, 365)).otherwise(0)
    rest = F.when(later, F.pmod(in_four - 1, F.lit(365))).otherwise(in_four)
    first = rest < HALF
    month = F.when(first, 1 + _div(rest, 31)).otherwise(7 + _div(rest - HALF, 30))
    number = F.when(first, F.pmod(rest, F.lit(31)) + 1).otherwise(F.pmod(rest - HALF, F.lit(30)) + 1)
    return year.cast("int"), month.cast("int"), number.cast("int")


def from_jalali(year: Column, month: Column, number: Column) -> Column:
    """The Gregorian date of a Jalali year, month and day."""
    y = year - 979
    days = 365 * y + 8 * _div(y, 33) + _div(F.pmod(y, F.lit(33)) + 3, 4)
    days += F.when(month <= 7, (month - 1) * 31).otherwise(HALF + (month - 7) * 30) + number - 1
    return F.date_add(F.lit("1600-01-01").cast("date"), days.cast("int") + 79)


def prior_jalali(day: str) -> Column:
    """The same Jalali day a year before; of the 30th of the last month the 29th, where that year has no 30th."""
    year, month, number = jalali_parts(day)
    first = lambda y: from_jalali(y, F.lit(1), F.lit(1))
    longest = F.when(month < 12, number).otherwise(F.least(number, 29 + F.datediff(first(year), first(year - 1)) - 365))
    return from_jalali(year - 1, month, longest)


def is_weekend(day: str) -> Column:
    return F.weekday(day).isin(*WEEKEND).cast("int")


def cyclic(value: Column, period: float, name: str) -> dict[str, Column]:
    turn = value * (2 * math.pi / period)
    return {f"cal_sin_{name}": F.sin(turn), f"cal_cos_{name}": F.cos(turn)}


def calendar_columns(day: str, freq: str = "D") -> dict[str, Column]:
    """Calendar features of a date; weekly and monthly data have none below the week, hourly data more."""
    d = F.col(day)
    dow, month, doy = F.weekday(d), F.month(d), F.dayofyear(d)
    out = {
        "cal_year": F.year(d),
        "cal_quarter": F.quarter(d),
        "cal_month": month,
        "cal_week_of_year": F.weekofyear(d),
        "cal_day_of_year": doy,
        "cal_is_month_start": (F.dayofmonth(d) == 1).cast("int"),
        "cal_is_month_end": (F.last_day(d) == F.to_date(d)).cast("int"),
        **cyclic(month, 12, "month"),
        **cyclic(doy, 365.25, "doy"),
    }
    if freq not in ("W", "MS"):
        out |= {"cal_day_of_month": F.dayofmonth(d), "cal_day_of_week": dow, "cal_is_weekend": is_weekend(day), **cyclic(dow, 7, "dow")}
    if freq == "h":
        out |= {"cal_hour": F.hour(d), **cyclic(F.hour(d), 24, "hour")}
    return out


def season_name(day: str) -> Column:
    """Winter from December to February, and so on."""
    season = F.floor(F.pmod(F.month(day), F.lit(12)) / 3)
    return F.element_at(F.array(*map(F.lit, ("winter", "spring", "summer", "autumn"))), (season + 1).cast("int"))


def phase(day: str, season: int) -> Column:
    """The place of a date in the seasonal cycle."""
    known = {7: F.weekday(day), 12: F.month(day), 24: F.hour(day)}
    return known.get(season, F.pmod(F.dayofyear(day), F.lit(max(season, 1))))


def event_distance(dates: DataFrame, day: str, flag: str, cap: int = 60) -> DataFrame:
    """Adds days_from and days_to, the distance to the nearest flagged date before and after, at most ``cap``.

    ``dates`` has a row for each date of a calendar, which is bounded by time, not by the data.
    """
    past = Window.orderBy(day).rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.orderBy(day).rowsBetween(0, Window.unboundedFollowing)
    marked = F.when(F.col(flag) > 0, F.col(day))
    gap = lambda a, b: F.least(F.coalesce(F.datediff(a, b), F.lit(cap)), F.lit(cap))
    return dates.withColumns({"days_from": gap(F.col(day), F.last(marked, True).over(past)), "days_to": gap(F.first(marked, True).over(ahead), F.col(day))})
