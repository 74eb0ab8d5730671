"""Strict ``yyyyMMdd`` dates, ages and date shifts as Column expressions; what cannot be read is null, never guessed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strict_date(text: Column) -> Column:
    return F.when(text.rlike("^[0-9]{8}$"), F.try_to_date(text, "yyyyMMdd"))


def whole_years(birth: Column, at: Column) -> Column:
    """Years by birthdays; one born on 29 February has the birthday on the 28th in common years."""
    day = F.when((F.month(birth) == 2) & (F.dayofmonth(birth) == 29), F.when(F.dayofmonth(F.last_day(F.make_date(F.year(at), F.lit(2), F.lit(1)))) == 29, 29).otherwise(28)).otherwise(F.dayofmonth(birth))
    reached = (F.month(at) > F.month(birth)) | ((F.month(at) == F.month(birth)) & (F.dayofmonth(at) >= day))
    return F.year(at) - F.year(birth) - F.when(reached, 0).otherwise(1)


def stated_age(text: Column) -> Column:
    """``034Y``, ``018M``, ``030W``, ``090D`` or bare digits, in whole years."""
    number = F.regexp_extract(F.upper(F.trim(text)), "^([0-9]+)([YMWD]?)$", 1).try_cast("int")
    unit = F.regexp_extract(F.upper(F.trim(text)), "^([0-9]+)([YMWD]?)$", 2)
    return F.when(unit == "M", F.floor(number / 12)).when(unit == "W", F.floor(number / 52)).when(unit == "D", F.floor(number / 365)).otherwise(number).cast("int")


def age_years(text: Column, birth: Column, study: Column, cap: int = 90) -> Column:
    """The stated age, else by dates; outside 0 to 120 unknown; older than ``cap`` reads as ``cap``."""
    age = F.coalesce(stated_age(text), whole_years(birth, study).cast("int"))
    return F.when(age.between(0, 120), F.least(age, F.lit(cap)))


def shifted(text: Column, days: Column) -> Column:
    """A date moved by days; of a date and time the rest stays as it is; unreadable is null."""
    day = F.date_add(strict_date(F.substring(text, 1, 8)), days.cast("int"))
    return F.concat(F.date_format(day, "yyyyMMdd"), F.substring(text, 9, 1_000_000))
