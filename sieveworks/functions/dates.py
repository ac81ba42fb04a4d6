"""Dates written as text, and the recency boost."""

from __future__ import annotations

import datetime
import math

from pyspark.sql import Column, functions as F

from ..config import ScoringConfig


#: Year 1 to 9999, month 1 to 12, day 1 to 31, each with optional plus and zeros in front.
YEAR_MONTH_DAY = r"\A\+?0*[1-9][0-9]{0,3}-\+?0*([1-9]|1[0-2])-\+?0*([1-9]|[12][0-9]|3[01])\z"


def parse_date(text: Column) -> Column:
    """A date from year-month-day; null for anything else. Days beyond the end of a month run into the next one."""
    year, month, day = (F.get(F.split(text, "-"), F.lit(k)).try_cast("int") for k in range(3))
    return F.when(text.rlike(YEAR_MONTH_DAY), F.date_add(F.make_date(year, month, F.lit(1)), day - 1))


def days_since(text: Column, as_of: Column) -> Column:
    return F.datediff(as_of, parse_date(text))


def date_of_seconds(seconds: Column) -> Column:
    """The UTC date of a number of seconds since 1970."""
    return F.date_from_unix_date(F.floor(seconds / 86400).cast("int"))


def as_date(as_of: str | datetime.date | Column | None) -> Column:
    """The day that ages are counted from; by default today in the session's time zone."""
    if as_of is None:
        return F.current_date()
    return as_of if isinstance(as_of, Column) else F.lit(as_of).cast("date")


def recency_boost(date: Column, config: ScoringConfig, as_of: str | datetime.date | Column | None = None) -> Column:
    """0 for dates that cannot be read, the full boost for future ones, otherwise by strategy."""
    return recency_of_days(days_since(date, as_date(as_of)), config)


def recency_of_days(days: Column, config: ScoringConfig) -> Column:
    """The boost for a number of days; null stands for a date that cannot be read."""
    of_age = recency_by_row if isinstance(config.recency_strategy, Column) else recency_of_age
    return F.when(days.isNull(), F.lit(0.0)).when(days < 0, F.lit(config.recency_boost_max)).otherwise(of_age(days.cast("double"), config))


def recency_of_age(days: Column, config: ScoringConfig) -> Column:
    most, half, limit = config.recency_boost_max, config.recency_half_life_days, float(config.recency_penalty_after_days)
    old = -F.least((days - limit) / 365.0 * 0.05, F.lit(config.recency_max_penalty))
    fresh = days < limit
    if config.recency_strategy == "none":
        return F.lit(0.0)
    if config.recency_strategy == "custom":
        return on_curve(days, config.recency_curve)
    if config.recency_strategy == "linear":
        return F.when(fresh, F.greatest(F.lit(most) * (1 - days / (limit or 1.0)), F.lit(0.0))).otherwise(old)
    if config.recency_strategy == "step":
        return F.when(days < half, F.lit(most)).when(fresh, F.lit(0.0)).otherwise(old)
    if half == 0:
        return F.lit(0.0)
    return F.when(fresh, F.greatest(F.lit(most) * F.exp(-days / float(half) * math.log(2)), F.lit(0.0))).otherwise(old)


def recency_by_row(days: Column, config) -> Column:
    """As ``recency_of_age``, for settings that are columns."""
    most, half, limit = config.recency_boost_max, config.recency_half_life_days, config.recency_penalty_after_days.cast("double")
    old, fresh, strategy = -F.least((days - limit) / 365.0 * 0.05, config.recency_max_penalty), days < limit, config.recency_strategy
    linear = F.when(fresh, F.greatest(most * (1 - days / F.when(limit == 0, F.lit(1.0)).otherwise(limit)), F.lit(0.0))).otherwise(old)
    step = F.when(days < half, most).when(fresh, F.lit(0.0)).otherwise(old)
    falling = F.when(fresh, F.greatest(most * F.exp(-days / F.when(half > 0, half.cast("double")) * math.log(2)), F.lit(0.0))).otherwise(old)
    curved = F.when(strategy == "linear", linear).when(strategy == "step", step).when(half == 0, F.lit(0.0)).otherwise(falling)
    return F.when(strategy == "none", F.lit(0.0)).when(strategy == "custom", on_points(days, config.recency_curve)).otherwise(curved)


def on_points(days: Column, points: Column) -> Column:
    """As ``on_curve``, for points in an array of (day, boost)."""
    low, high = F.get(points, F.lit(0)), F.get(points, F.size(points) - 1)
    starts = F.sequence(F.lit(0), F.greatest(F.size(points) - 2, F.lit(0)))
    first = F.get(F.filter(starts, lambda k: (days >= F.get(points, k)["day"]) & (days <= F.get(points, k + 1)["day"])), F.lit(0))
    a, b = F.get(points, first), F.get(points, first + 1)
    between = F.when(a["day"] == b["day"], a["boost"]).otherwise(a["boost"] + (days - a["day"]) / F.nullif(b["day"] - a["day"], F.lit(0.0)) * (b["boost"] - a["boost"]))
    return F.coalesce(F.when(days <= low["day"], low["boost"]).when(days >= high["day"], high["boost"]).otherwise(between), F.lit(0.0))


def on_curve(days: Column, curve: tuple[tuple[float, float], ...]) -> Column:
    """Straight lines between the points, level beyond them; 0 without points."""
    if not curve:
        return F.lit(0.0)
    (low, at_low), (high, at_high) = curve[0], curve[-1]
    out = F.when(days <= low, F.lit(at_low)).when(days >= high, F.lit(at_high))
    for (x0, y0), (x1, y1) in zip(curve, curve[1:], strict=False):
        between = F.lit(y0) if x1 == x0 else y0 + (days - x0) / (x1 - x0) * (y1 - y0)
        out = out.when((days >= x0) & (days <= x1), between)
    return out.otherwise(F.lit(0.0))
