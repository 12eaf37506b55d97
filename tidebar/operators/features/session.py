"""Session and time of day, in UTC."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from ...functions.frames import flag

#: First match wins: sessions by the hour they end at, with the minute they start and end.
SESSIONS = ((8, 0, 480), (16, 420, 960), (21, 720, 1260))


def _wave(f, x: Column, period: int) -> Column:
    return f(2 * math.pi * x / period)


def _by_session(hour: Column, value) -> Column:
    out = F.when(hour < SESSIONS[0][0], value(*SESSIONS[0][1:]))
    for until, start, end in SESSIONS[1:]:
        out = out.when(hour < until, value(start, end))
    return out


def first() -> dict[str, Column]:
    hour, minute, day = F.hour("ts"), F.minute("ts"), F.weekday("ts")
    now = hour * 60 + minute
    return {
        "hour_sin": _wave(F.sin, hour, 24),
        "hour_cos": _wave(F.cos, hour, 24),
        "minute_sin": _wave(F.sin, minute, 60),
        "minute_cos": _wave(F.cos, minute, 60),
        "day_of_week_sin": _wave(F.sin, day, 5),
        "day_of_week_cos": _wave(F.cos, day, 5),
        "is_asian_session": flag(hour < 8),
        "is_london_session": flag((hour >= 7) & (hour < 16)),
        "is_newyork_session": flag((hour >= 12) & (hour < 21)),
        "is_overlap_ln": flag((hour >= 12) & (hour < 16)),
        "minutes_into_session": _by_session(hour, lambda start, end: (now - start).cast("double")),
        "minutes_to_close": _by_session(hour, lambda start, end: (end - now).cast("double")),
    }
