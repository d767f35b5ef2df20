"""Event times, which come from the messages alone and never from the session's zone."""

from __future__ import annotations

from lumenward.functions.text import quote, trim_all

UTC = "UTC"
#: Later event times are taken for errors, as one of them would close all windows before it.
MAX_FUTURE = "1 day"

MISSING, UNREADABLE, FUTURE = "missing", "unreadable", "future"


def event_time(text: str, zone: str = UTC) -> str:
    """The instant a timestamp text names, null if it cannot be read.

    Text is ISO 8601, with an offset or else in ``zone``; a date is its midnight.
    Numbers are seconds, milliseconds or microseconds since 1970, told apart by
    their digits: up to 11, up to 14, and more."""
    given = trim_all(text)
    number = f"cast({given} AS decimal(18, 0))"
    micros = f"cast(CASE WHEN length({given}) <= 11 THEN {number} * 1000000 WHEN length({given}) <= 14 THEN {number} * 1000 ELSE {number} END AS bigint)"
    local = quote(" " + zone)
    return (
        f"CASE WHEN {given} RLIKE '^[0-9]{{9,17}}$' THEN timestamp_micros({micros})"
        f" WHEN {given} RLIKE '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$' THEN try_to_timestamp(concat({given}, 'T00:00:00', {local}))"
        f" WHEN {given} RLIKE '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}[Tt ][0-9:.]+([Zz]|[+-][0-9]{{2}}:?[0-9]{{2}})$' THEN try_to_timestamp(upper({given}))"
        f" WHEN {given} RLIKE '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}[Tt ][0-9]{{2}}:[0-9]{{2}}$' THEN try_to_timestamp(concat(upper({given}), ':00', {local}))"
        f" WHEN {given} RLIKE '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}[Tt ][0-9:.]+$' THEN try_to_timestamp(concat(upper({given}), {local})) END")


def usable_event_time(text: str, zone: str = UTC, max_future: str = MAX_FUTURE) -> str:
    """The event time, null also where it lies further ahead of the clock than it can be."""
    time = event_time(text, zone)
    return f"if({time} > current_timestamp() + INTERVAL {max_future}, NULL, {time})"


def undated_reason(text: str, zone: str = UTC) -> str:
    """Why a message has no usable event time."""
    return (f"CASE WHEN coalesce({trim_all(text)}, '') = '' THEN '{MISSING}'"
            f" WHEN {event_time(text, zone)} IS NULL THEN '{UNREADABLE}' ELSE '{FUTURE}' END")


def day_of(time: str, zone: str = UTC) -> str:
    """The calendar day of an instant in a zone, whatever the session's zone is."""
    utc = f"timestampadd(MICROSECOND, unix_micros({time}), TIMESTAMP_NTZ'1970-01-01 00:00:00')"
    return f"to_date(convert_timezone('UTC', {quote(zone)}, {utc}))"


DAILY, WEEKLY = "daily", "weekly"
_PERIOD_DAYS = {DAILY: 1, WEEKLY: 7}


def period_start(time: str, zone: str = UTC, period: str = DAILY) -> str:
    """The first day of the day or the week, beginning on Monday, that an instant lies in."""
    days = _PERIOD_DAYS[period]
    day = day_of(time, zone)
    return day if days == 1 else f"date_sub({day}, weekday({day}))"


def period_end(start: str, zone: str = UTC, period: str = DAILY) -> str:
    """The instant at which the period beginning on a day is over in a zone."""
    midnight = f"cast(date_add({start}, {_PERIOD_DAYS[period]}) AS timestamp_ntz)"
    utc = f"convert_timezone({quote(zone)}, 'UTC', {midnight})"
    return f"timestamp_micros(timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {utc}))"
