"""Timestamps of events: whole Unix seconds from numbers, ISO 8601 text or numeric text."""

from __future__ import annotations

import math
from datetime import UTC, datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

# The ISO forms that are accepted; anything else is read as a number.
_DATE = r"[0-9]{4}-[0-9]{2}-[0-9]{2}"
_BASIC_DATE = r"[0-9]{8}"
_WEEK = r"[0-9]{4}-?W[0-9]{2}(?:-?[1-7])?"
_TIME = r"[0-9]{2}(?::[0-9]{2}(?::[0-9]{2}(?:[.,][0-9]+)?)?)?"
_ZONE = r"(?:Z|[+-][0-9]{2}:?[0-9]{2}(?::?[0-9]{2})?)?"
ISO = rf"^{_DATE}(?:.{_TIME}{_ZONE})?$"
BASIC = rf"^{_BASIC_DATE}$"
WEEK = rf"^{_WEEK}$"
NUMBER = r"^[+-]?(?:[0-9]+(?:_[0-9]+)*\.?(?:[0-9]+(?:_[0-9]+)*)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$"


def _epoch(text: Column, form: str) -> Column:
    return F.unix_seconds(F.try_to_timestamp(text, F.lit(form)))


def parse_text(text: Column) -> Column:
    """Whole seconds, or null. Text without a zone is UTC; fractions are dropped towards zero."""
    s = F.regexp_replace(text, r"^\s+|\s+$", "")
    clock = F.regexp_extract(s, rf"^{_DATE}.({_TIME})", 1)
    clock = F.concat(F.substring(clock, 1, 8), F.substring(F.lit("00:00:00"), F.least(F.length(clock), F.lit(8)) + 1, F.lit(8)))
    whole = F.unix_seconds(F.try_to_timestamp(F.concat(F.substring(s, 1, 10), F.lit(" "), clock), F.lit("yyyy-MM-dd HH:mm:ss")))
    zone = F.regexp_extract(s, rf"^{_DATE}.{_TIME}([+-][0-9]{{2}}:?[0-9]{{2}})", 1)
    minutes = F.try_to_number(F.concat(F.substring(zone, 2, 2)), F.lit("99")) * 60 + F.try_to_number(F.substring(zone, -2, 2), F.lit("99"))
    shift = F.when(zone == "", 0).otherwise(F.when(zone.startswith("-"), -minutes).otherwise(minutes) * 60)
    iso = F.when(F.length(s) == 10, _epoch(s, "yyyy-MM-dd")).otherwise(whole - shift.cast("long"))
    # a date before 1970 with a fraction still drops the fraction towards zero
    part = F.regexp_extract(s, r":[0-9]{2}[.,]([0-9]{1,6})", 1)
    iso = F.when((iso < 0) & part.rlike("[1-9]"), iso + 1).otherwise(iso)
    year, week = F.substring(s, 1, 4).cast("int"), F.regexp_extract(s, "W([0-9]{2})", 1)
    day = F.regexp_extract(s, "W[0-9]{2}-?([1-7])$", 1)
    first = F.date_trunc("week", F.make_timestamp(year, F.lit(1), F.lit(4), F.lit(0), F.lit(0), F.lit(0)))
    by_week = F.unix_seconds(first) + ((week.cast("int") - 1) * 7 + F.when(day == "", 0).otherwise(day.cast("int") - 1)) * 86400
    number = F.regexp_replace(s, "_", "").try_cast("double")
    plain = F.when(s.rlike(NUMBER) & (F.abs(number) < 9.2e18), number.cast("long"))
    dated = F.when(s.rlike(ISO), iso).when(s.rlike(BASIC), _epoch(s, "yyyyMMdd")).when(s.rlike(WEEK) & (week > "00") & (week < "54"), by_week)
    return F.coalesce(dated, plain)


def parse_literal(value: int | float | str) -> int:
    """The same rules for a literal of the query language."""
    if isinstance(value, int | float):
        if not math.isfinite(value):
            raise ValueError(f"not a timestamp: {value}")
        return int(value)
    s = value.strip()
    try:
        got = datetime.fromisoformat(s[:-1] + "+00:00" if s.endswith("Z") else s)
    except ValueError:
        try:
            return parse_literal(float(s))
        except ValueError:
            raise ValueError(f"not a timestamp: {value!r}") from None
    return int((got if got.tzinfo else got.replace(tzinfo=UTC)).timestamp())
