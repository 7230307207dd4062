"""The day in Japan a site's timestamp falls on."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from seriatim.functions.bind import let, whole
from seriatim.functions.urls import strip

#: Seconds Japan is ahead of UTC, all year.
JAPAN_AHEAD = 9 * 3600
#: Numbers at or above this are milliseconds, below it seconds.
EPOCH_IN_MILLIS = 100_000_000_000
#: Ways a day is written, anywhere in a text.
WRITTEN_DAY = r"([0-9]{4})[年/.\-]([0-9]{1,2})[月/.\-]([0-9]{1,2})"
#: An ISO moment, spelt out or compact: year, month, day, hour, minute, second, offset.
ISO_MOMENT = (
    r"^([0-9]{4})(-?)([0-9]{2})\2([0-9]{2})(?:[T ]([0-9]{2})(?::?([0-9]{2})(?::?([0-9]{2}))?)?(?:[.,][0-9]+)?"
    r"(Z|[+\-][0-9]{2}:?[0-9]{2})?)?$"
)
#: An HTTP date: day, month name, year of two or four digits, time, zone.
HTTP_DATE = (
    r"^(?:[A-Za-z]{3,9}, *)?([0-9]{1,2})[ \-]([A-Za-z]{3})[ \-]([0-9]{4}|[0-9]{2}) +([0-9]{2}:[0-9]{2}(?::[0-9]{2})?)"
    r"(?: +([A-Za-z]{1,5}|[+\-][0-9]{4}))?$"
)
#: Zone names of mail dates and the hours each is ahead of UTC.
NAMED_ZONES = {
    "UT": 0, "UTC": 0, "GMT": 0, "Z": 0, "AST": -4, "ADT": -3, "EST": -5, "EDT": -4,
    "CST": -6, "CDT": -5, "MST": -7, "MDT": -6, "PST": -8, "PDT": -7,
}
#: Two-digit years from here on are of the 1900s, smaller ones of the 2000s.
CENTURY_TURNS = 69
#: Month names of HTTP dates, three letters each, in order.
MONTHS = "janfebmaraprmayjunjulaugsepoctnovdec"


def _digits(text: Column) -> Column:
    """Full-width digits folded to ASCII."""
    return F.translate(text, "０１２３４５６７８９", "0123456789")


def _zone_seconds(zone: Column) -> Column:
    """Seconds an offset such as ``+09:00`` is ahead of UTC; 0 for ``Z`` and zone names."""
    hours = whole(F.substr(zone, F.lit(2), F.lit(2)), "int")
    minutes = whole(F.right(zone, F.lit(2)), "int")
    ahead = hours * 3600 + minutes * 60
    return F.when(F.startswith(zone, F.lit("+")), ahead).when(F.startswith(zone, F.lit("-")), -ahead).otherwise(F.lit(0))


def _day_of(day: Column, time: Column, zone: Column) -> Column:
    """The Japan day of a wall-clock moment; its own day when it names no zone."""

    def part(n: int) -> Column:
        return F.coalesce(whole(F.split_part(time, F.lit(":"), F.lit(n)), "int"), F.lit(0))

    seconds = part(1) * 3600 + part(2) * 60 + part(3)
    shifted = F.floor((seconds - _zone_seconds(zone) + JAPAN_AHEAD) / 86400).cast("int")
    date = F.nullif(day, F.lit("")).try_cast("date")
    return F.when(zone == "", date).otherwise(F.date_add(date, shifted))


def _named_zone(zone: Column) -> Column:
    """A zone of a mail date as an offset; none for ``-0000`` and for names that stand for no zone."""
    offsets = {name: f"{'-' if hours < 0 else '+'}{abs(hours):02d}00" for name, hours in NAMED_ZONES.items()}
    known = F.create_map(*[F.lit(text) for pair in offsets.items() for text in pair])
    told = F.coalesce(F.try_element_at(known, F.upper(zone)), F.lit(""))
    return F.when(zone == "-0000", F.lit("")).when(zone.rlike(r"^[+\-]"), zone).otherwise(told)


def _full_year(year: Column) -> Column:
    century = F.when(whole(year, "int") < CENTURY_TURNS, F.lit("20")).otherwise(F.lit("19"))
    return F.when(F.length(year) == 2, F.concat(century, year)).otherwise(year)


def _groups(text: Column, pattern: str, count: int) -> Column:
    """The groups of a pattern over the whole text, matched once."""
    marks = "\x01".join(f"${n}" for n in range(1, count + 1))
    return F.split(F.regexp_replace(text, pattern, marks), "\x01")


def _spelt(year: Column, month: Column, day: Column) -> Column:
    return F.concat(year, F.lit("-"), F.lpad(month, 2, "0"), F.lit("-"), F.lpad(day, 2, "0"))


def written_day(text: Column) -> Column:
    """The first ``year month day`` in a text, whatever surrounds it; null when no such day exists."""

    def read(found: Column) -> Column:
        parts = _groups(found, WRITTEN_DAY, 3)
        return let(parts, lambda g: _spelt(g[0], g[1], g[2]).try_cast("date"))

    return let(F.regexp_extract(_digits(text), WRITTEN_DAY, 0), lambda found: F.when(found != "", read(found)))


def _iso_day(text: Column) -> Column:
    def read(g: Column) -> Column:
        return _day_of(_spelt(g[0], g[2], g[3]), F.concat_ws(":", g[4], g[5], g[6]), g[7])

    told = let(_groups(text, ISO_MOMENT, 8), read)
    return F.when(text.rlike(ISO_MOMENT), told)


def http_day(text: Column) -> Column:
    """The Japan day of an HTTP date, with or without its weekday."""

    def read(g: Column) -> Column:
        place = F.instr(F.lit(MONTHS), F.lower(g[1]))
        number = F.floor((place + 2) / 3).cast("string")
        return F.when((place > 0) & (place % 3 == 1), _day_of(_spelt(_full_year(g[2]), number, g[0]), g[3], _named_zone(g[4])))

    return F.when(text.rlike(HTTP_DATE), let(_groups(text, HTTP_DATE, 5), read))


def epoch_day(number: Column) -> Column:
    """The Japan day of an epoch in seconds or milliseconds; null at or below zero."""
    value = number.cast("double")
    seconds = F.when(value >= EPOCH_IN_MILLIS, value / 1000).otherwise(value)
    days = F.floor((seconds + JAPAN_AHEAD) / 86400).cast("int")
    return F.when(value > 0, F.date_add(F.lit("1970-01-01").cast("date"), days))


def japan_day(text: Column) -> Column:
    """The Japan day of a timestamp text: ISO, then HTTP date, then a day written anywhere."""
    return let(strip(text), lambda t: F.coalesce(_iso_day(t), http_day(t), written_day(t)))
