"""RFC 3339 times as naive UTC, whatever the session's zone."""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_STAMP = re.compile(r"(\d{4})-(\d\d)-(\d\d)T(\d\d):(\d\d):(\d\d)(?:([.,])(\d+))?(?:Z|([+-])(\d\d):(\d\d))", re.ASCII)


def ntz(at: dt.datetime) -> Column:
    """A naive time as a constant. As a Python value it would pass through the zones of the process and the session."""
    return F.lit(at.isoformat(sep=" ")).cast("timestamp_ntz")


def utc(text: str, strict: bool = True) -> dt.datetime:
    """The time in UTC, cut to microseconds; ValueError for anything else.

    A query's times may have a comma before the fraction and offsets of up to 24:60, those of a
    push may not.
    """
    found = _STAMP.fullmatch(text)
    if not found:
        raise ValueError(f"{text!r} isn't an RFC 3339 time")
    *parts, point, fraction, sign, hours, minutes = found.groups()
    at = dt.datetime(*map(int, parts), int((fraction or "0").ljust(6, "0")[:6]))
    if strict and point == ",":
        raise ValueError(f"{text!r} has a comma")
    if sign:
        h, m = int(hours), int(minutes)
        if h > (23 if strict else 24) or m > (59 if strict else 60):
            raise ValueError(f"{text!r} has no such offset")
        try:
            at -= (-1 if sign == "-" else 1) * dt.timedelta(hours=h, minutes=m)
        except OverflowError as e:
            raise ValueError(f"{text!r} is out of range") from e
    return at
